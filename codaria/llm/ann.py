"""Approximate nearest neighbours by inner product: a sharded hash-prefix forest.

The rows are dealt to shards by hash. A shard's tree is a sorted array of long
hash strings, signs of random projections; vectors are first lifted by one
coordinate to one norm, so that larger inner products are smaller angles. A
query descends in each tree to its place. From there all trees ascend together,
one bit of common prefix less at a time, until the rows below hold as many
entries as were found to be needed. Counts below a prefix only grow on the way
up, so the level is found by bisection.

How many entries are needed is measured in each shard: probe rows are searched
exhaustively, and the least number that finds `aim` of their neighbours is used,
in steps of a quarter.
Every row is indexed in every tree; no bucket or candidate list is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codaria.llm.storage import cut


@dataclass(frozen=True)
class ForestConfig:
    k: int = 20
    trees: int = 64
    bits: int = 32
    shard_rows: int = 8192
    query_rows: int = 8192
    probes: int = 48
    aim: float = 0.95
    seed: int = 7


class Forest:
    """The trees of one shard."""

    def __init__(self, base: np.ndarray, cfg: ForestConfig):
        self.base, self.cfg, self.dim = base, cfg, base.shape[1]
        rng = np.random.default_rng(cfg.seed)
        self.planes = rng.standard_normal((cfg.trees, self.dim + 1, cfg.bits)).astype(np.float32)
        norm = np.sqrt((base * base).sum(axis=1))
        self.top = norm.max()
        code = self._codes(np.hstack([base / self.top, np.sqrt(np.maximum(0, 1 - (norm / self.top) ** 2))[:, None]]))
        self.order = np.argsort(code, axis=1, kind="stable")
        self.code = np.take_along_axis(code, self.order, axis=1)
        self.need = self._needed()

    def _codes(self, lifted: np.ndarray) -> np.ndarray:
        lifted = lifted.astype(np.float32)
        power = np.uint64(1) << np.arange(self.cfg.bits - 1, -1, -1, dtype=np.uint64)
        return np.stack([((lifted @ plane) > 0) @ power for plane in self.planes]).astype(np.uint64)

    def _below(self, code: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each tree's range of rows that share level bits with each query; [trees, queries]."""
        free = (np.uint64(self.cfg.bits) - level.astype(np.uint64)).astype(np.uint64)
        low = (code >> free) << free
        high = low + ((np.uint64(1) << free) - np.uint64(1))
        lo = np.stack([np.searchsorted(s, q, "left") for s, q in zip(self.code, low, strict=True)])
        hi = np.stack([np.searchsorted(s, q, "right") for s, q in zip(self.code, high, strict=True)])
        return lo, hi

    def _ranges(self, query: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
        code = self._codes(np.hstack([query, np.zeros((len(query), 1))]))
        low, high = np.zeros(len(query), np.int64), np.full(len(query), self.cfg.bits)
        while (low < high).any():  # the deepest level with enough entries
            mid = (low + high + 1) // 2
            lo, hi = self._below(code, mid)
            enough = (hi - lo).sum(axis=0) >= need
            low, high = np.where(enough, mid, low), np.where(enough, high, mid - 1)
        return self._below(code, low)

    def _top(self, scores: np.ndarray, k: int) -> np.ndarray:
        return np.argpartition(-scores, min(k, len(scores)) - 1)[:k]

    def _needed(self) -> int:
        n, cfg = len(self.base), self.cfg
        probe = self.base[np.linspace(0, n - 1, min(n, cfg.probes)).astype(int)]
        exact = probe @ self.base.T
        want = [self._top(row, cfg.k) for row in exact]
        need = 4 * cfg.k
        while need < n * cfg.trees:
            lo, hi = self._ranges(probe, need)
            found = total = 0
            for i, w in enumerate(want):
                mask = self.mask(lo[:, i], hi[:, i])
                found, total = found + int(mask[w].sum()), total + len(w)
            if found >= cfg.aim * total:
                return need
            need += -(-need // 4)
        return n * cfg.trees

    def mask(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.base), bool)
        out[np.concatenate([o[a:b] for o, a, b in zip(self.order, lo, hi, strict=True)])] = True
        return out

    def search(self, ids: np.ndarray, query: np.ndarray, query_id: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query_id, vec_id, score) of each query's k best candidates here, ties to the smaller id."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for begin in range(0, len(query), 512):
            part = query[begin : begin + 512]
            lo, hi = self._ranges(part, self.need)
            # where most rows are candidates, one product costs less than gathering them
            dense = part @ self.base.T if (hi - lo).sum(axis=0).mean() > 0.2 * len(self.base) else None
            for i in range(len(part)):
                mask = self.mask(lo[:, i], hi[:, i])
                mask[np.searchsorted(ids, query_id[begin + i], "left") : np.searchsorted(ids, query_id[begin + i], "right")] = False
                cand = np.flatnonzero(mask)
                if not len(cand):
                    continue
                score = dense[i, cand] if dense is not None else self.base[cand] @ part[i]
                if len(cand) > self.cfg.k:
                    bar = np.partition(score, len(score) - self.cfg.k)[len(score) - self.cfg.k]
                    cand = cand[score >= bar - 1e-9 * max(1.0, abs(bar))]
                score = (self.base[cand] * part[i]).sum(axis=1)
                best = np.lexsort((ids[cand], -score))[: self.cfg.k]
                out.append((np.full(len(best), query_id[begin + i]), ids[cand][best], score[best]))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def nearest(vectors: DataFrame, queries: DataFrame, cfg: ForestConfig = ForestConfig()) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest of vectors(vec_id, embedding).

    Score: the inner product in double precision, largest first, ties to the
    smaller vec_id. A query's own id is no candidate. Rows whose id is null, or
    whose vector is null, empty, zero or holds null or non-finite components,
    take no part; vectors of another length are not compared. Rows that repeat a
    vec_id and vector count once; an id with different vectors is a candidate by
    each, and a query by each. Fewer candidates than k are all returned; other
    columns are ignored, and empty tables give an empty result. Reruns agree.
    """

    def sound(df: DataFrame) -> DataFrame:
        v = F.col("v")
        df = df.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
        ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
        return df.filter(F.col("id").isNotNull() & v.isNotNull() & ok).withColumn("dim", F.size("v"))

    base, asked = cut(sound(vectors)), cut(sound(queries))
    n, m = base.count(), asked.count()
    shards, blocks = max(1, -(-n // cfg.shard_rows)), max(1, -(-m // cfg.query_rows))
    dealt = base.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asks = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))

    def matrix(table: pa.Table, dim: int) -> np.ndarray:
        return table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)

    def run(left: pa.Table, right: pa.Table) -> Iterator[pa.RecordBatch] | pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        dim = left.column("dim")[0].as_py()
        ids, x = left.column("id").to_numpy(), matrix(left, dim)
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        fresh = np.ones(len(ids), bool)
        fresh[1:] = (ids[1:] != ids[:-1]) | (x[1:] != x[:-1]).any(axis=1)
        ids, x = ids[fresh], x[fresh]
        q, v, s = Forest(x, cfg).search(ids, matrix(right, dim), right.column("id").to_numpy())
        return pa.table({"query_id": q, "vec_id": v, "score": s})

    key = ["dim", "shard", "block"]
    found = dealt.groupBy(*key).cogroup(asks.groupBy(*key)).applyInArrow(run, "query_id long, vec_id long, score double")
    # each task keeps its k best of a query before they are dealt, whatever the number of shards
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= cfg.k).select("query_id", "rank", "vec_id", "score")
