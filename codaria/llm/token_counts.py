"""Token counts through a digest cache.

The key of a count is the SHA-256 of the normalised content and that of the
tokenizer's file. Normalisation maps texts together only if the tokenizer can't
tell them apart, so it never changes a count. Documents join the stored counts by
the key; only distinct misses are encoded, and their counts are appended to the
cache, which then answers for all.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from codaria.llm.skew import spread_join
from codaria.llm.storage import cut

MARK = "▁"
_CACHE = "content binary, tokenizer string, n_tokens long, added_by string"


class PieceCounter:
    """Counts the pieces that a sentencepiece model gives a text.

    Where pieces hold the space mark at their start only, no merge crosses from
    a character into a following mark, so a text's count is the sum over its
    marks-and-word parts, and equal parts need one encoding. This holds only for
    BPE models that leave text as it is; others encode whole texts.
    """

    #: Parts of either generation that are remembered: those met since the last turn, and those of the turn before.
    LIMIT = 1 << 18

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        spec = proto.ModelProto()
        spec.ParseFromString(model)
        norm = spec.normalizer_spec
        self.parts = (
            spec.trainer_spec.model_type == 2
            and not norm.precompiled_charsmap
            and norm.add_dummy_prefix
            and not norm.remove_extra_whitespaces
            and not spec.trainer_spec.treat_whitespace_as_suffix
            and all(p.type != 4 and MARK not in p.piece.lstrip(MARK) for p in spec.pieces)
        )
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def normal(self, text: Column) -> Column:
        """A space is the space mark to these models, so texts that differ in that only are one."""
        return F.replace(text, F.lit(MARK), F.lit(" ")) if self.parts else text

    def _part(self, part: str) -> int:
        # the model puts a mark before what it is given, so the part comes without its first one
        n = self.older.get(part)
        if n is None:
            n = len(self.model.encode(part)) if part else 1
        if len(part) <= 64:
            if len(self.known) >= self.LIMIT:
                self.older, self.known = self.known, {}
            self.known[part] = n
        return n

    def count(self, text: str) -> int:
        if not text or not self.parts:
            return len(self.model.encode(text)) if text else 0
        text = text.replace(MARK, " ")
        if text[0] == " " or text[-1] == " " or "  " in text:
            parts = [p[1:] for p in re.findall(r" +[^ ]*", " " + text)]
        else:
            parts = text.split(" ")
        total, known = 0, self.known
        for part in parts:
            n = known.get(part)
            total += self._part(part) if n is None else n
        return total


class JsonCounter:
    """Counts by a tokenizers .json file, without added special tokens; special strings in a text are as its default takes them."""

    def __init__(self, model: bytes):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(model.decode())
        self.model.no_truncation()
        self.model.no_padding()

    def normal(self, text: Column) -> Column:
        return text

    def count(self, text: str) -> int:
        return len(self.model.encode(text, add_special_tokens=False)) if text else 0


class _Cache:
    """The stored counts of one tokenizer file, and the texts of docs by their digests."""

    def __init__(self, docs: DataFrame, tokenizer: str, path: str):
        self.spark, self.path = docs.sparkSession, path
        self.model = Path(tokenizer).read_bytes()
        self.version, self.me = hashlib.sha256(self.model).hexdigest(), uuid.uuid4().hex
        self.kind = PieceCounter if tokenizer.endswith(".model") else JsonCounter
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        self.texts = docs.select("doc_id", text.alias("text"), F.unhex(F.sha2(self.kind(self.model).normal(text), 256)).alias("content"))

    def stored(self) -> DataFrame:
        """content, n_tokens, cached: whether another call added it."""
        try:
            found = self.spark.read.schema(_CACHE).parquet(self.path)
        except AnalysisException:
            found = self.spark.createDataFrame([], _CACHE)
        known = found.filter(F.col("tokenizer") == self.version).groupBy("content")
        return known.agg(F.min("n_tokens").alias("n_tokens"), F.max(F.col("added_by") != self.me).alias("cached"))

    def fill(self) -> None:
        kind, model, version, me = self.kind, self.model, self.version, self.me

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counter = kind(model)
            for batch in batches:
                n = [counter.count(t.as_py()) for t in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64()), pa.array([me] * len(n), pa.string())], ["content", "tokenizer", "n_tokens", "added_by"])

        # copies become one row before the first exchange, so no digest is hot behind it
        distinct = self.texts.select("content", "text").dropDuplicates(["content"])
        misses = distinct.join(self.stored().select("content"), "content", "left_anti")
        misses.mapInArrow(encode, _CACHE).write.mode("append").parquet(self.path)


def fill_cache(docs: DataFrame, tokenizer: str, cache: str) -> None:
    """Stores the counts of docs(doc_id, text) that cache lacks."""
    _Cache(docs, tokenizer, cache).fill()


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, limit: int = 4096) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, n_bytes, n_tokens, over_limit, cached.

    tokenizer: path of a .model (sentencepiece) or .json (tokenizers) file, read
    on the driver and sent with the tasks. cache: a Parquet folder, made if it
    isn't there; entries that two writers both appended count once. cached: the
    count was stored before this call. A null text is empty; empty texts have no
    tokens. Rows that repeat come back as often; null ids and their counts come
    back too; other columns are ignored; an empty table gives an empty one.
    """
    store = _Cache(docs, tokenizer, cache)
    store.fill()
    rows = cut(store.texts.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "content"))
    found = spread_join(rows, cut(store.stored()), ["content"])
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "cached")
