"""Texts to token vectors through a pluggable encoder, labels to prompts to vectors, and tokens to places in their text.

An encoder is any picklable object with encode(texts, max_length) -> for each text
its tokens, as (token id, vector, start, end); start and end are code points, None
for tokens that stand for no text. It runs on batches in Arrow workers, so weights
are loaded once a worker. No weights come with this library; HashEncoder is a
stand-in that needs none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codaria.functions import text as T
from codaria.functions.batches import CELLS, ROWS, pairs
from codaria.operators import vectors

Token = tuple[int, Sequence[float], int | None, int | None]


class Encoder(Protocol):
    def encode(self, texts: list[str], max_length: int | None) -> list[list[Token]]: ...


@dataclass(frozen=True)
class HashEncoder:
    """Words between white space, each with a vector of its SHA-256, between one opening and one closing token."""

    dim: int = 8

    def _word(self, word: str) -> tuple[int, list[float]]:
        digest = hashlib.sha256(word.encode()).digest()
        return int.from_bytes(digest[:4], "big") >> 1, [digest[i % 32] / 127.5 - 1 for i in range(self.dim)]

    def encode(self, texts: list[str], max_length: int | None) -> list[list[Token]]:
        out, known = [], {}
        for text in texts:
            words = []
            for m in re.finditer(r"\S+", text):
                if (found := known.get(word := m.group())) is None:
                    found = known[word] = self._word(word)
                words.append((*found, m.start(), m.end()))
            if max_length:
                words = words[: max(0, max_length - 2)]
            out.append([(0, self._word("<s>")[1], None, None), *words, (1, self._word("</s>")[1], None, None)])
        return out


TOKENS = "doc_id string, pos int, token_id long, vector array<double>, mask boolean, char_start int, char_end int"


#: Texts, and characters of texts, that an encoder gets at once, but for one text's own.
TEXTS, CHARS = 64, 1 << 18


def _encoded(batches: Iterator[pa.RecordBatch], encoder: Encoder, max_length: int | None) -> Iterator[tuple[str, str, list[Token]]]:
    """Id, text and tokens of batches(doc_id, text), encoded in small groups; null texts go."""
    group, chars = [], 0
    for doc, text in pairs(batches):
        if text is not None:
            group.append((doc, text))
            chars += len(text)
        if len(group) >= TEXTS or chars >= CHARS:
            yield from ((*g, t) for g, t in zip(group, encoder.encode([t for _, t in group], max_length), strict=True))
            group, chars = [], 0
    if group:
        yield from ((*g, t) for g, t in zip(group, encoder.encode([t for _, t in group], max_length), strict=True))


def _in_columns(texts: Iterator[tuple[str, str, list[Token]]], schema: pa.Schema, columns) -> Iterator[pa.RecordBatch]:
    """Batches of what columns(doc, text, first place, tokens) makes of some tokens of a text, a list a column, by column, as rows are too many for a tuple each."""
    held = [[] for _ in schema]
    for doc, text, tokens in texts:
        step = max(1, min(ROWS, CELLS // max(1, len(tokens[0][1])))) if tokens else 1
        for lo in range(0, len(tokens), step):
            for all_, new in zip(held, columns(doc, text, lo, tokens[lo : lo + step]), strict=True):
                all_.extend(new)
            if len(held[0]) >= step:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(held, schema.types, strict=True)], schema=schema)
                held = [[] for _ in schema]
    if held[0]:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(held, schema.types, strict=True)], schema=schema)


def _places(doc: str, lo: int, tokens: list[Token]) -> tuple:
    return [doc] * len(tokens), range(lo, lo + len(tokens)), [t[0] for t in tokens]


def encode_texts(texts: DataFrame, encoder: Encoder, max_length: int | None = None) -> DataFrame:
    """texts(doc_id, text) -> TOKENS: one row a token, in the encoder's order; null texts have none."""

    def columns(doc, text, lo, tokens):
        return *_places(doc, lo, tokens), [[float(x) for x in t[1]] for t in tokens], [True] * len(tokens), [t[2] for t in tokens], [t[3] for t in tokens]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema({"doc_id": pa.string(), "pos": pa.int32(), "token_id": pa.int64(), "vector": pa.list_(pa.float64()), "mask": pa.bool_(), "char_start": pa.int32(), "char_end": pa.int32()})
        return _in_columns(_encoded(batches, encoder, max_length), schema, columns)

    return texts.select(F.col("doc_id").cast("string"), "text").mapInArrow(run, TOKENS)


def encode_documents(docs: DataFrame, encoder: Encoder, max_length: int | None = None) -> DataFrame:
    """Tokens of docs(doc_id, normalized_text, retrieval_text, raw_text): of the first text that isn't empty; raises without rows or for a document without text."""
    if docs.isEmpty():
        raise ValueError("no documents")
    text = T.best_text(F.col("normalized_text"), F.col("retrieval_text"), F.col("raw_text"))
    return encode_texts(docs.select("doc_id", text.alias("text")), encoder, max_length)


def label_prompts(codes: DataFrame, max_chars: int = 256) -> DataFrame:
    """label, text of codes(code_3char, title_vi, title_en, search_text); raises without rows, for a code given twice and for an empty prompt."""
    if codes.isEmpty():
        raise ValueError("no labels")
    if not codes.groupBy("code_3char").count().filter("count > 1").isEmpty():
        raise ValueError("a label is given twice")
    text = T.label_prompt(F.col("code_3char"), F.col("title_vi"), F.col("title_en"), F.col("search_text"), max_chars)
    prompts = codes.select(F.col("code_3char").alias("label"), text.alias("text"))
    if not prompts.filter(T.strip(F.coalesce("text", F.lit(""))) == "").isEmpty():
        raise ValueError("a label has an empty prompt")
    return prompts


def encode_labels(codes: DataFrame, encoder: Encoder, max_length: int | None = None, pooling: str = "mean", max_chars: int = 256) -> DataFrame:
    """label, dim, value: the pooled vectors of the labels' prompts."""
    tokens = encode_texts(label_prompts(codes, max_chars).withColumnRenamed("label", "doc_id"), encoder, max_length)
    return vectors.pool(tokens, pooling).withColumnRenamed("doc_id", "label")


def align(texts: DataFrame, encoder: Encoder, max_length: int | None = None, encoded: DataFrame | None = None) -> DataFrame:
    """doc_id, pos, token_id, char_start, char_end, text: the piece of the text that each token stands for, null for none.

    encoded: tokens of an earlier run; raises ValueError unless its documents, token
    ids and masks are exactly these.
    """
    if encoded is not None:
        tokens = encode_texts(texts, encoder, max_length)
        key = ["doc_id", "pos", "token_id", "mask"]
        if not tokens.select(key).exceptAll(encoded.select(key)).isEmpty() or not encoded.select(key).exceptAll(tokens.select(key)).isEmpty():
            raise ValueError("tokens differ from the encoder's")

    def columns(doc, text, lo, tokens):
        return *_places(doc, lo, tokens), [t[2] for t in tokens], [t[3] for t in tokens], [None if t[2] is None else text[t[2] : t[3]] for t in tokens]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema({"doc_id": pa.string(), "pos": pa.int32(), "token_id": pa.int64(), "char_start": pa.int32(), "char_end": pa.int32(), "text": pa.string()})
        return _in_columns(_encoded(batches, encoder, max_length), schema, columns)

    return texts.select(F.col("doc_id").cast("string"), "text").mapInArrow(run, "doc_id string, pos int, token_id long, char_start int, char_end int, text string")
