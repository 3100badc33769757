"""Text classes against Python's, and small pieces of texts, sentences and tokens."""

import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F

from codaria.functions import text as T
from codaria.operators import retrieval, spans


def test_space_classes_equal_pythons(spark):
    chars = [chr(c) for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000] + ["\ufeff", "\ufe00", "\U0001f600"]
    rows = spark.createDataFrame([(c, f"{c}{c}a{c} b{c}") for c in chars], "c string, t string")
    t = F.col("t")
    got = rows.select("c", "t", T.strip(t).alias("s"), T.rule_text(t).alias("r"), T._re(t, f"[{T.BLANK}]+", " ").alias("b"), T._re(t, T.ZERO_WIDTH).alias("z"), T._re(t, f"[^{T.WORD}{T.SPACE}]", "#").alias("w"), T.nfkc(t).alias("n")).collect()
    zero = set("\u200b\u200c\u200d\ufeff\u00ad\u200e\u200f\u202a\u202b\u202c\u202d\u202e")
    for r in got:
        c, t = r["c"], r["t"]
        space = c.isspace()
        assert r["s"] == t.strip() and r["r"] == " ".join(t.split()) if space else r["r"] == t
        assert r["b"] == (" a b " if space and c != "\n" else t) and r["z"] == (t.replace(c, "") if c in zero else t)
        assert not space or "#" not in r["w"]
        assert r["n"] == unicodedata.normalize("NFKC", t)


def test_strip_has_no_regex_and_ascii_stays(spark):
    plan = spark.range(1).select(T.strip(F.col("id").cast("string")), T.nfkc(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and "octet_length" in plan.lower()


def test_sentences_and_queries_in_pieces(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "Ab c. De f! Gh"), (2, None), (3, "  ")], "doc_id long, text string")
    made = spans.segment(docs)
    assert "MapInArrow" in made._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["doc_id"], r["sentence_index"], r["text"], r["char_start"]) for r in made.collect()) == [("1", 0, "Ab c.", 0), ("1", 1, "De f!", 6), ("1", 2, "Gh", 12), ("3", 0, "  ", 0)]
    monkeypatch.setattr(retrieval, "TOKENS", 3)
    batch = pa.record_batch({"q": [1, 2, 3, 4, 5], "tokens": [["a", "b"], None, ["c"], ["d"] * 9, []]})
    assert [p.column(0).to_pylist() for p in retrieval._parts(batch)] == [[1, 2, 3], [4], [5]]
