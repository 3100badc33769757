"""What a task holds and what is dealt stay small as tables grow; results are those of the plain forms."""

import pyarrow as pa

from codaria.functions import batches as B
from codaria.operators import encoder as E


class Counting:
    """An encoder that refuses more texts or characters at once than it is promised."""

    def encode(self, texts, max_length):
        assert len(texts) == 1 or len(texts) <= E.TEXTS and sum(map(len, texts)) < 2 * E.CHARS
        return E.HashEncoder(1).encode(texts, max_length)


def test_alignment_in_small_batches_and_without_join(spark):
    texts = spark.createDataFrame([(i, None if i == 7 else f"w{i} " * 900) for i in range(200)], "doc_id long, text string").repartition(2)
    made = E.align(texts, Counting())
    assert "Join" not in made._jdf.queryExecution().toString()
    rows = made.collect()
    assert len(rows) == 199 * 902 and {r["text"] for r in rows if r["doc_id"] == "3"} == {"w3", None}
    tokens = E.encode_texts(texts, Counting())
    assert tokens.count() == len(rows)
    sizes = [b.num_rows for b in B.in_batches(((i, "x" * 3) for i in range(20_000)), pa.schema({"i": pa.int64(), "t": pa.string()}))]
    assert sum(sizes) == 20_000 and max(sizes) == B.ROWS
    assert max(b.num_rows for b in B.in_batches(((i, "x" * B.CELLS) for i in range(9)), pa.schema({"i": pa.int64(), "t": pa.string()}))) == 1
