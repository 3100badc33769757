"""Removal of repeated word windows, behind a merged count-min sketch.

A window is 35 consecutive words. Its anchor is the 12-word run inside it with
the least hash, leftmost on ties, so equal windows have equal anchors at equal
offsets, and the count of an anchor is at least that of each window it serves.
Neighbouring windows share anchors: there are about twelve times fewer anchors
than windows to count.

The rows are dealt to chunks of bounded size, written once as a table bucketed by
chunk, so every later pass reads a chunk where it is and texts move once.

1. Each chunk sketches its anchors: three rows of cells, counts saturating at 2,
   sent as sparse blocks of cells. Blocks are merged by key. The answer to a
   chunk is one bit for each cell that it sent: whether the merged count is 2 or
   more. Cells grow with the input and no task or broadcast holds the sketch, so
   it answers as sharply for any input.
2. Windows whose anchor is estimated repeated are grouped exactly by 128-bit
   fingerprint: each chunk first unites its own equal windows, so a passage in a
   third of all rows sends one entry a chunk. The answer is again one bit for each
   entry that the chunk sent: whether its window occurs more than once.
3. A last pass removes the words of the windows that are repeated.

A chunk's entries are sorted sets, so it finds again which bit is whose from its
rows alone. The sketch only overestimates, so no repeated window is lost.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codaria.llm.storage import cut, new_path
from codaria.llm.textops import GOLD, Words, chunks, mix, runs, seeded, words_of

_U = np.uint64


@dataclass(frozen=True)
class SubstringConfig:
    window: int = 35
    anchor: int = 12
    #: Independent rows of cells; an anchor passes if it does in all.
    rows: int = 3
    #: Cells of a row for each expected anchor, before rounding up to a power of two.
    cells_per_anchor: int = 8
    min_cells: int = 1 << 16
    #: Bytes of text that a chunk holds on average, that a bucket of chunks does, and that a grouping block answers for.
    chunk_bytes: int = 8 << 20
    bucket_bytes: int = 32 << 20
    block_bytes: int = 16 << 20
    #: Spark's own limit.
    max_buckets: int = 100_000


@dataclass(frozen=True)
class Layout:
    """Cells of a sketch row, their number in a block as a power of two, and blocks of exact grouping."""

    cells: int
    bits: int
    blocks: int


def _anchors(words: Words, cfg: SubstringConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, window hashes, first words, and each window's anchor hash and position."""
    h = words.hashes()
    value, start = runs(h, words.doc, cfg.window, 0)
    if not len(start):
        return h, value, start, value, start
    sub, _ = runs(h, np.zeros(len(h), np.int8), cfg.anchor, 0)  # runs over document ends are never inside a window
    best, width, reach = np.arange(len(sub)), 1, cfg.window - cfg.anchor + 1

    def least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(sub[b] < sub[a], b, a)

    while 2 * width <= reach:
        best = least(best[: len(best) - width], best[width:])
        width *= 2
    if width < reach:
        best = least(best[: len(best) - (reach - width)], best[reach - width :])
    at = best[start]
    return h, value, start, sub[at], at


@np.errstate(over="ignore")
def _cells(anchor: np.ndarray, row: int, cells: int) -> np.ndarray:
    return (mix(anchor + _U(row + 1) * GOLD) & _U(cells - 1)).astype(np.int64)


def _bucketed(docs: DataFrame, cfg: SubstringConfig) -> tuple[DataFrame, Layout]:
    """docs with a chunk, as a table bucketed by it; rows are dealt by their place, so copies spread like all others."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // cfg.bucket_bytes), cfg.max_buckets)
    chunks_ = max(4 * buckets, size // cfg.chunk_bytes)
    chunk = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(chunks_)).cast("int")
    name = f"codaria_{uuid.uuid4().hex}"
    dealt = docs.withColumn("chunk", chunk).repartition(buckets, "chunk")
    dealt.write.bucketBy(buckets, "chunk").option("path", new_path(spark, "chunks")).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its files stay, and the plan knows them
    expected = size // 6 * 2 // (cfg.window - cfg.anchor + 2)
    cells = 1 << max(cfg.cells_per_anchor * expected, cfg.min_cells).bit_length()
    groups = max(1, size // cfg.bucket_bytes).bit_length()
    return table, Layout(cells, max(0, cells.bit_length() - 1 - groups), max(8, size // cfg.block_bytes))


@dataclass
class Piece:
    """Some texts of a chunk, with their windows."""

    lo: int
    hi: int
    words: Words
    hashes: np.ndarray
    value: np.ndarray
    start: np.ndarray
    anchor: np.ndarray
    at: np.ndarray


def _pieces(text: pa.Array, cfg: SubstringConfig) -> list[Piece]:
    out = []
    for lo, hi in chunks(text):
        words = words_of(text.slice(lo, hi - lo))
        out.append(Piece(lo, hi, words, *_anchors(words, cfg)))
    return out


def _column(table: pa.Table, name: str) -> pa.Array:
    found = table.column(name).combine_chunks()
    return found.chunk(0) if isinstance(found, pa.ChunkedArray) else found


def _joined(parts: list[np.ndarray], kind=_U) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _sent(pieces: list[Piece], lay: Layout, cfg: SubstringConfig) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each row of the sketch a chunk's distinct cells, sorted, their block, and whether the chunk counts 2 or more there."""
    anchor = _joined([p.anchor[np.unique(p.at, return_index=True)[1]] for p in pieces])
    out = []
    for row in range(cfg.rows):
        cell, count = np.unique(_cells(anchor, row, lay.cells), return_counts=True)
        out.append((cell, row * (lay.cells >> lay.bits) + (cell >> lay.bits), count > 1))
    return out


def _cut_at(key: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of equal keys of a sorted array."""
    edge = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
    return list(zip(edge, edge[1:], strict=False)) if len(key) else []


def _answers(table: pa.Table, kind: int) -> dict[int, bytes]:
    if not table.num_rows:
        return {}
    return {b: bits for k, b, bits in zip(table["kind"].to_pylist(), table["block"].to_pylist(), table["bits"].to_pylist(), strict=True) if k == kind}


def _decoded(block: np.ndarray, bits: dict[int, bytes]) -> np.ndarray:
    """The answers' bits for entries whose sorted blocks these are."""
    parts = [np.unpackbits(np.frombuffer(bits[int(block[a])], np.uint8), count=b - a).view(bool) for a, b in _cut_at(block)]
    return _joined(parts, bool)


@dataclass
class Windows:
    """A chunk's distinct windows that pass the sketch, sorted by block and hash; of each passing window of a piece, which one it is."""

    a: np.ndarray
    b: np.ndarray
    block: np.ndarray
    twice: np.ndarray
    which: np.ndarray
    ok: list[np.ndarray]


def _windows(pieces: list[Piece], bits: dict[int, bytes], lay: Layout, cfg: SubstringConfig) -> Windows:
    ok = [np.ones(len(p.anchor), bool) for p in pieces]
    for row, (cell, block, _) in enumerate(_sent(pieces, lay, cfg)):
        passed = _decoded(block, bits)
        for p, o in zip(pieces, ok, strict=True):
            if len(p.anchor):
                o &= passed[np.searchsorted(cell, _cells(p.anchor, row, lay.cells))]
    a = _joined([p.value[o] for p, o in zip(pieces, ok, strict=True)])
    b = _joined([runs(seeded(p.hashes, 1), p.words.doc, cfg.window, 1)[0][o] for p, o in zip(pieces, ok, strict=True) if o.any()])
    block = (a % _U(lay.blocks)).astype(np.int64)
    order = np.lexsort((b, a, block))
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    which = np.empty(len(a), np.int64)
    which[order] = np.cumsum(fresh) - 1
    first = order[fresh]
    return Windows(a[first], b[first], block[first], np.bincount(which, minlength=len(first)) > 1, which, ok)


def _sketch_bits(table: DataFrame, lay: Layout, cfg: SubstringConfig) -> DataFrame:
    """chunk, kind 0, block, bits: of each cell that a chunk sent, whether its merged count is 2 or more."""

    def send(group: pa.Table) -> pa.Table:
        chunk, keys, parts = group["chunk"][0].as_py(), [], []
        for cell, block, twice in _sent(_pieces(_column(group, "text"), cfg), lay, cfg):
            packed = ((cell & ((1 << lay.bits) - 1)) << 1 | twice).astype("<u4")
            for a, b in _cut_at(block):
                keys.append(int(block[a]))
                parts.append(packed[a:b].tobytes())
        return pa.table({"chunk": pa.array([chunk] * len(keys), pa.int32()), "block": pa.array(keys, pa.int64()), "cells": pa.array(parts, pa.binary())})

    def merge(group: pa.Table) -> pa.Table:
        sent = [np.frombuffer(c, "<u4") for c in group["cells"].to_pylist()]
        seen = np.zeros(1 << lay.bits, np.uint8)
        for v in sent:  # cells of one chunk are distinct
            seen[v >> 1] = np.minimum(seen[v >> 1] + 1 + (v & 1).astype(np.uint8), 2)
        bits = [np.packbits(seen[v >> 1] > 1).tobytes() for v in sent]
        return pa.table({"chunk": group["chunk"], "kind": pa.array([0] * len(bits), pa.int32()), "block": group["block"], "bits": pa.array(bits, pa.binary())})

    sent = table.groupBy("chunk").applyInArrow(send, "chunk int, block long, cells binary")
    return sent.groupBy("block").applyInArrow(merge, _BITS)


_BITS = "chunk int, kind int, block long, bits binary"


def _window_bits(table: DataFrame, sketch: DataFrame, lay: Layout, cfg: SubstringConfig) -> DataFrame:
    """chunk, kind 1, block, bits: of each window that a chunk sent, whether it occurs more than once."""

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, a, b, twice = [], [], [], []
        if left.num_rows:
            w = _windows(_pieces(_column(left, "text"), cfg), _answers(right, 0), lay, cfg)
            for lo, hi in _cut_at(w.block):
                keys.append(int(w.block[lo]))
                a.append(w.a[lo:hi].astype("<u8").tobytes())
                b.append(w.b[lo:hi].astype("<u8").tobytes())
                twice.append(np.packbits(w.twice[lo:hi]).tobytes())
        chunk = left["chunk"][0].as_py() if left.num_rows else 0
        return pa.table({"chunk": pa.array([chunk] * len(keys), pa.int32()), "block": pa.array(keys, pa.int64()), "a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "twice": pa.array(twice, pa.binary())})

    def group(entries: pa.Table) -> pa.Table:
        a, b = ([np.frombuffer(x, "<u8") for x in entries[f].to_pylist()] for f in "ab")
        n = np.array([len(x) for x in a])
        count = 1 + np.concatenate([np.unpackbits(np.frombuffer(t, np.uint8), count=k) for t, k in zip(entries["twice"].to_pylist(), n, strict=True)]).astype(np.int64)
        a, b = np.concatenate(a), np.concatenate(b)
        order = np.lexsort((b, a))
        fresh = np.ones(len(a), bool)
        fresh[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        which = np.empty(len(a), np.int64)
        which[order] = np.cumsum(fresh) - 1
        repeated = (np.bincount(which, count) > 1)[which]
        bits = [np.packbits(repeated[e - k : e]).tobytes() for e, k in zip(np.cumsum(n), n, strict=True)]
        return pa.table({"chunk": entries["chunk"], "kind": pa.array([1] * len(bits), pa.int32()), "block": entries["block"], "bits": pa.array(bits, pa.binary())})

    sent = table.groupBy("chunk").cogroup(sketch.groupBy("chunk")).applyInArrow(send, "chunk int, block long, a binary, b binary, twice binary")
    return sent.groupBy("block").applyInArrow(group, _BITS)


def remove_repeats(docs: DataFrame, cfg: SubstringConfig = SubstringConfig()) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, n_words, n_removed, kept_sha256, kept_text.

    Words are runs other than ASCII white space, compared byte for byte. A word
    goes if any window of its document that covers it also starts anywhere else
    in docs. kept_text has the kept words joined by one space. A null text has
    no words, and an empty kept_text; texts under 35 words keep all. Rows that
    repeat a document repeat its windows, so both lose them. Null ids come back
    as null; other columns of docs are ignored; an empty table gives an empty one.
    """
    table, lay = _bucketed(docs.select("doc_id", F.col("text").cast("string").alias("text")), cfg)
    sketch = cut(_sketch_bits(table, lay, cfg))
    bits = sketch.union(_window_bits(table, sketch, lay, cfg))
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"]

    def clean(left: pa.Table, right: pa.Table) -> pa.Table:
        text = _column(left, "text")
        pieces = _pieces(text, cfg)
        w = _windows(pieces, _answers(right, 0), lay, cfg)
        repeated = _decoded(w.block, _answers(right, 1))[w.which]
        n_words, kept, removed, done = [], [], [], 0
        for p, ok in zip(pieces, w.ok, strict=True):
            mine = repeated[done : done + int(ok.sum())]
            done += len(mine)
            edge = np.zeros(len(p.words.start) + 1, np.int32)
            edge[p.start[ok][mine]] = 1
            covered = np.cumsum(edge[:-1])
            if len(covered) > cfg.window:
                covered[cfg.window :] -= covered[: len(covered) - cfg.window].copy()
            keep = covered == 0
            for i, t in enumerate(text.slice(p.lo, p.hi - p.lo).to_pylist()):
                own = keep[p.words.first[i] : p.words.first[i + 1]]
                kept.append(b" ".join(compress((t or "").encode().split(), own)))
                n_words.append(len(own))
                removed.append(int(len(own) - own.sum()))
        columns = [left["doc_id"], pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array([k.decode() for k in kept], pa.string())]
        return pa.table(dict(zip(names, columns, strict=True)))

    def clean_or_none(left: pa.Table, right: pa.Table) -> pa.Table:
        return clean(left, right) if left.num_rows else pa.table({n: pa.array([], t) for n, t in zip(names, (left.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept_text string"
    return table.groupBy("chunk").cogroup(bits.groupBy("chunk")).applyInArrow(clean_or_none, schema)
