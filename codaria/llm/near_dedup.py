"""Near-duplicate documents: SuperMinHash, banding, exact verification, union-find.

1. One Arrow pass gives each document its set's 128-bit key, its size and the
   band keys of its SuperMinHash signature (superminhash.py).
2. Documents with equal sets collapse to the one with the smallest id.
3. Representatives that share a band bucket get a star edge to the bucket's
   smallest id, its head, never all pairs. Each star is verified: its head's set is
   compared with its members', which are cut into blocks. Links are united.
4. A bucket whose members are then one component is done. The others are open.
   Each candidate pair whose ends are still apart lies in the open buckets of one
   head; all but the largest component of these are compared with all of them,
   block by block, through an inverted list of exact shingle intersections. So
   copies of one text cost time in proportion to their number, as all but few are
   settled by their star.
5. The new links join the components.

Keys that many rows share, sets as well as bands, are joined by broadcasting the
few hot ones (skew.py).

With 25 bands of 5 slots a pair at similarity 0.85 shares no bucket with
probability 4e-7, at 0.8 with 5e-5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codaria.llm.components import components
from codaria.llm.skew import hot_keys, maybe_broadcast, spread_join
from codaria.llm.storage import cut
from codaria.llm.superminhash import EMPTY, signatures
from codaria.llm.textops import GOLD, chunks, mix, shingle_sets, words_of


@dataclass(frozen=True)
class NearDedupConfig:
    """percent: link when 100 * intersection >= percent * union."""

    percent: int = 80
    shingle: int = 5
    bands: int = 25
    rows: int = 5
    #: Documents and shingles that one task compares at once; larger stars and groups of open buckets are cut into blocks.
    block_docs: int = 2048
    block_shingles: int = 2_000_000
    #: Smaller groups are cut into up to this many blocks too, of no fewer documents than these.
    spread_blocks: int = 16
    spread_docs: int = 192


@np.errstate(over="ignore")
def _sketch_batch(ids: pa.Array, texts: pa.Array, cfg: NearDedupConfig) -> pa.RecordBatch:
    n = len(ids)
    (value, second), doc = shingle_sets(words_of(texts, lower=True), cfg.shingle, (0, 1))
    first = np.searchsorted(doc, np.arange(n + 1))
    size = np.diff(first)
    keys = []
    for seed, v in enumerate((value, mix(value) ^ second)):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(v + np.uint64(seed) * GOLD), dtype=np.uint64)])
        keys.append(sums[first[1:]] - sums[first[:-1]] + size.astype(np.uint64))
    sig = signatures(value, doc, n, cfg.bands * cfg.rows).reshape(n, cfg.bands, cfg.rows)
    band = np.zeros((n, cfg.bands), np.uint64)
    for r in range(cfg.rows):
        band = mix(band * GOLD + sig[:, :, r] + np.uint64(r + 1))
    band = mix(band + np.arange(1, cfg.bands + 1, dtype=np.uint64) * GOLD)
    full = size > 0
    offsets = np.concatenate([[0], np.cumsum(full * cfg.bands)]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(band[full].reshape(-1).view(np.int64)))
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(size), pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)), lists],
        ["doc_id", "n_shingles", "key_a", "key_b", "bands"],
    )


def sketches(docs: DataFrame, cfg: NearDedupConfig = NearDedupConfig()) -> DataFrame:
    """doc_id, n_shingles, key_a, key_b, bands (empty for a document without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(batch.column(1)):
                yield _sketch_batch(batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), cfg)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, n_shingles long, key_a long, key_b long, bands array<long>")


def unite(sets: list[np.ndarray], percent: int, split: int | None = None) -> np.ndarray:
    """Index of the first linked set, transitively, for each of several sorted distinct hash sets.

    With split, only pairs across that position are compared.
    """
    n = len(sets)
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    size = np.array([len(s) for s in sets], np.int64)
    total = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(total, kind="stable")
    ranked = total[order]
    fresh = np.ones(len(ranked), bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    begin = np.append(np.flatnonzero(fresh), len(ranked))
    term = np.empty(len(total), np.int64)
    term[order] = np.cumsum(fresh) - 1
    posting = owner[order]
    at = np.cumsum(size) - size
    for i in range(n):
        if not size[i] or (split is not None and i < split):
            continue
        mine = term[at[i] : at[i] + size[i]]
        # of the list of each shingle, the part before i; lists are ascending
        lo, hi = begin[mine], begin[mine + 1]
        length = hi - lo
        idx = np.repeat(lo - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
        shared = np.bincount(posting[idx], minlength=n)[: i if split is None else split]
        other = size[: len(shared)]
        for j in np.flatnonzero((shared > 0) & (100 * shared >= percent * (other + size[i] - shared))):
            a, b = find(int(j)), find(i)
            if a != b:
                root[max(a, b)] = min(a, b)
    return np.array([find(i) for i in range(n)], np.int64)


def _link_groups(percent: int, shingle: int):
    def solve(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Rows of whole groups, in order of group and side; columns place, side, doc_id, text."""
        sets: list[np.ndarray] = []
        for a, b in chunks(batch.column(3)):
            (value,), doc = shingle_sets(words_of(batch.column(3).slice(a, b - a), lower=True), shingle)
            first = np.searchsorted(doc, np.arange(b - a + 1))
            sets += [value[first[i] : first[i + 1]] for i in range(b - a)]
        group, side = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        edges = np.append(np.flatnonzero(group[1:] != group[:-1]) + 1, len(group))
        begin, left, right = 0, [], []
        for end in edges:
            roots = unite(sets[begin:end], percent, int((side[begin:end] == 0).sum()))
            moved = np.flatnonzero(roots != np.arange(end - begin))
            left.append(moved + begin)
            right.append(roots[moved] + begin)
            begin = end
        ids = batch.column(2)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(np.concatenate(left))), ids.take(pa.array(np.concatenate(right)))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.column(0).to_numpy()
            last = np.flatnonzero(group != group[-1])
            cut_at = int(last[-1]) + 1 if len(last) else 0
            if held and held[-1].column(0)[-1].as_py() != group[0]:
                yield solve(joined(held))
                held = []
            if cut_at:
                yield solve(joined([*held, batch.slice(0, cut_at)]))
                held = []
            held.append(batch.slice(cut_at))
        if held:
            yield solve(joined(held))

    return run


def _blocks(group: DataFrame, cfg: NearDedupConfig) -> DataFrame:
    """group(hub, docs, shingles) with blocks, the number that its rows are cut into."""
    few = F.least(F.ceil(F.col("docs") / cfg.spread_docs), F.lit(cfg.spread_blocks))
    return group.select("hub", F.greatest(F.ceil(F.col("docs") / cfg.block_docs), F.ceil(F.col("shingles") / cfg.block_shingles), few, F.lit(1)).cast("long").alias("blocks"))


def _links(texts: DataFrame, dealt: DataFrame, cfg: NearDedupConfig) -> DataFrame:
    """a, b: a spanning forest of the links between the sides of each group of dealt(place, side, doc_id)."""
    kind = texts.schema["doc_id"].dataType.simpleString()
    rows = texts.join(maybe_broadcast(dealt), "doc_id").select("place", "side", "doc_id", "text")
    rows = rows.repartition("place").sortWithinPartitions("place", "side", "doc_id")
    return rows.mapInArrow(_link_groups(cfg.percent, cfg.shingle), f"a {kind}, b {kind}").filter("a != b")


def _star_groups(star: DataFrame, sizes: DataFrame, hot: DataFrame, cfg: NearDedupConfig) -> DataFrame:
    """place, side, doc_id: the members of each star in blocks, each with the star's head; star(a, hub)."""
    weight = star.join(sizes.withColumnRenamed("doc_id", "a"), "a").groupBy("hub").agg(F.count("*").alias("docs"), F.sum("n_shingles").alias("shingles"))
    weight = cut(_blocks(weight, cfg))
    blocks = spread_join(star, weight, ["hub"], hot)
    place = F.xxhash64("hub", "block").alias("place")
    members = blocks.withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks"))).select(place, F.lit(0).cast("long").alias("side"), F.col("a").alias("doc_id"))
    heads = weight.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return cut(members.unionByName(heads.select(place, F.lit(1).cast("long").alias("side"), F.col("hub").alias("doc_id"))))


def _open_groups(rows: DataFrame, cfg: NearDedupConfig) -> DataFrame:
    """place, side, doc_id: of each head's rows(hub, doc_id, root, n_shingles), every block with every block of those outside its largest component."""
    by_root = rows.groupBy("hub", "root").agg(F.count("*").alias("docs"), F.sum("n_shingles").alias("shingles"))
    whole = by_root.groupBy("hub").agg(F.sum("docs").alias("docs"), F.sum("shingles").alias("shingles"), F.max(F.struct("docs", "shingles", "root")).alias("most"))
    whole = cut(whole)
    rest = _blocks(whole.select("hub", (F.col("docs") - F.col("most.docs")).alias("docs"), (F.col("shingles") - F.col("most.shingles")).alias("shingles")), cfg)
    weight = _blocks(whole, cfg).join(rest.withColumnRenamed("blocks", "asked"), "hub").join(whole.select("hub", F.col("most.root").alias("most")), "hub")
    rows = spread_join(rows, weight, ["hub"], hot_keys(whole, rows.count(), ["hub"], "docs"))
    mine = F.xxhash64("doc_id")
    place = F.xxhash64("hub", "block", "part").alias("place")
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    every = rows.withColumn("block", F.pmod(mine, F.col("blocks"))).withColumn("part", spread("asked"))
    asks = rows.filter("root != most").withColumn("part", F.pmod(mine, F.col("asked"))).withColumn("block", spread("blocks"))
    side = lambda df, n: df.select(place, F.lit(n).cast("long").alias("side"), "doc_id")
    return cut(side(every, 0).unionByName(side(asks, 1)))


def near_duplicates(docs: DataFrame, cfg: NearDedupConfig = NearDedupConfig()) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, n_shingles, component_id, kept.

    doc_id may be of any type that orders; component_id is of the same. Words are
    runs other than ASCII white space, A-Z lower-cased; a document's set is its
    distinct 5-word shingles, or its whole sequence if it is shorter. Null, empty
    and blank texts have the empty set and link with nothing. Rows that repeat a
    doc_id are one node, linked by any of their texts, and each comes back. A row
    with a null doc_id takes no part: its component_id is null and it is kept.
    Other columns of docs are ignored; an empty table gives an empty one. Reruns
    agree.
    """
    sk = cut(sketches(docs, cfg))
    full = sk.filter("doc_id IS NOT NULL AND n_shingles > 0")
    heads = full.groupBy("key_a", "key_b").agg(F.min(F.struct("doc_id", "n_shingles", "bands")).alias("first"), F.count("*").alias("copies"))
    heads = cut(heads.select("key_a", "key_b", "first.*", "copies"))
    many = heads.filter("copies > 1").select("key_a", "key_b", F.col("doc_id").alias("b"), "copies")
    keys = ["key_a", "key_b"]
    equal = spread_join(full.select(F.col("doc_id").alias("a"), *keys), many.drop("copies"), keys, hot_keys(many, sk.count(), keys, "copies")).select("a", "b").filter("a != b")
    sizes = heads.groupBy("doc_id").agg(F.sum("n_shingles").alias("n_shingles"))
    bucket = heads.select(F.col("doc_id").alias("a"), F.explode("bands").alias("band"))
    found = cut(bucket.groupBy("band").agg(F.min("a").alias("hub"), F.count("*").alias("n")).filter("n > 1"))
    hot = hot_keys(found, cfg.bands * heads.count(), ["band"])
    star = cut(spread_join(bucket, found.drop("n"), ["band"], hot).filter("a != hub"))
    texts = docs.select("doc_id", F.col("text").cast("string"))
    edges = cut(star.select("a", "hub").distinct())
    hot_hubs = hot_keys(edges.groupBy("hub").agg(F.count("*").alias("n")), edges.count(), ["hub"])
    links = _links(texts, _star_groups(edges, sizes, hot_hubs, cfg), cfg).union(equal)
    roots = cut(components(links).select(F.col("node").alias("doc_id"), F.col("component").alias("root")))
    # a bucket is its star's members and its head
    ends = star.select("a", "hub", "band").unionByName(found.select(F.col("hub").alias("a"), "hub", "band"))
    ends = ends.join(roots.withColumnRenamed("doc_id", "a"), "a", "left").withColumn("root", F.coalesce("root", "a"))
    apart = cut(ends.groupBy("band").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least != most").select("band"))
    if not apart.isEmpty():
        rest = spread_join(ends, apart, ["band"], hot).select("hub", F.col("a").alias("doc_id"), "root").distinct()
        rest = cut(rest.join(sizes, "doc_id"))
        more = _links(texts, _open_groups(rest, cfg), cfg)
        # links of documents are links of their components, of which there are fewer
        for end in ("a", "b"):
            named = roots.select(F.col("doc_id").alias(end), F.col("root").alias(f"root_{end}"))
            more = more.join(named, end, "left").withColumn(end, F.coalesce(f"root_{end}", end)).drop(f"root_{end}")
        joined = cut(components(more.distinct()).select(F.col("node").alias("root"), F.col("component").alias("last")))
        alone = joined.select(F.col("root").alias("doc_id"), "root")  # documents that no star linked
        roots = roots.unionByName(alone.join(roots.select("doc_id"), "doc_id", "left_anti").select("doc_id", "root"))
        roots = roots.join(joined, "root", "left").select("doc_id", F.coalesce("last", "root").alias("root"))
    named = sk.select("doc_id", "n_shingles")
    out = named.filter("doc_id IS NOT NULL").join(roots, "doc_id", "left").withColumn("component_id", F.coalesce("root", "doc_id"))
    out = out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    nowhere = named.filter("doc_id IS NULL")
    return out.unionByName(nowhere.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept")))
