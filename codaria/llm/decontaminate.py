"""Benchmark items inside documents: size-partitioned MinHash containment search, in DataFrame operations only.

An item with q distinct shingles is contained at t if at least t * q of them are
a document's. Items are partitioned by the power of two of q. Each gets the k
least hashes of its shingles, a bottom-k MinHash sketch, with k = floor((1 - t) *
u) + 1 for its partition's largest q, u: since at most (1 - t) * q may be
missing, a containing document holds at least one of the k, however long it is.
So candidates are the documents that share a hash with an item's sketch, which is
lossless, and they are then verified by counting whole shingles exactly, of the
candidate pairs only.

Documents' hashes above the largest sketched one are dropped before the join.
The items' tables are broadcast only if their counted rows are within a limit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codaria.llm.skew import maybe_broadcast
from codaria.llm.storage import cut


@dataclass(frozen=True)
class DecontaminationConfig:
    shingle: int = 5
    containment: float = 0.8
    #: Counted rows of a table of ids or of items' shingles that may be broadcast.
    broadcast_rows: int = 500_000
    #: Words of a text whose runs are made at once.
    piece: int = 20_000


NOT_WORD = r"[^\p{L}\p{N}\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def normal_words(text: Column) -> Column:
    """Lower-cased words without punctuation; null and blank texts have none."""
    plain = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), NOT_WORD, ""))
    return F.array_remove(F.split(plain, SPACES), "")


def shingles(words: Column, k: int, make) -> Column:
    """make(array of words) of each run of k words; none if there are fewer."""
    last = F.size(words) - k + 1
    return F.when(last < 1, F.array()).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: make(F.slice(words, i, k))))


def _runs(rows: DataFrame, name: str, words: Column, sizes: list[int], make, piece: int) -> DataFrame:
    """rows' columns with a row named name for make(run) of each run of each of the sizes; words are cut into pieces first, so arrays of runs are bounded."""
    own = rows.columns
    # exploded, so that the optimiser can't put the expressions in the place of their columns and compute them for each run
    rows = rows.select("*", F.explode(F.array(words)).alias("_w"))
    begins = F.sequence(F.lit(1), F.greatest(F.size("_w"), F.lit(1)), F.lit(piece))
    # a piece's runs are those that begin in its first words; it has the words that they reach into
    rows = rows.select(*own, F.explode(F.transform(begins, lambda b: F.slice("_w", b, piece + max(sizes) - 1))).alias("_p"))
    found = [F.filter(shingles(F.col("_p"), k, make), lambda x, i: i < piece) for k in sizes]
    return rows.select(*own, F.explode(F.concat(*found)).alias(name))


def _gram(run: Column) -> Column:
    return F.concat_ws(" ", run)


def contaminated(docs: DataFrame, items: DataFrame, cfg: DecontaminationConfig = DecontaminationConfig()) -> DataFrame:
    """doc_id, item_id, n_shared, n_shingles, containment for each item at least t contained in a document.

    Words are lower-cased, without punctuation; shingles are 5 words, compared
    whole. An item under 5 words is one shingle, its whole sequence, and is found
    wherever a document has that run of words. Items and documents that are null
    or have no words, and rows without ids, take no part. Rows that repeat an id
    are one document (or item) with the shingles of all. Other columns are
    ignored; an empty table gives an empty result.
    """
    t, k = cfg.containment, cfg.shingle
    items = items.filter("item_id IS NOT NULL").select("item_id", normal_words(F.col("text").cast("string")).alias("w")).filter(F.size("w") > 0)
    own = F.when(F.size("w") < k, F.array(_gram(F.col("w")))).otherwise(shingles(F.col("w"), k, _gram))
    grams = items.select("item_id", F.least(F.size("w"), F.lit(k)).alias("k"), F.explode(own).alias("gram")).distinct()
    grams = cut(grams.withColumn("h", F.xxhash64(F.split("gram", " "))))
    sizes = sorted(r[0] for r in grams.select("k").distinct().collect())  # k values at most
    size = grams.groupBy("item_id").agg(F.count("*").alias("n_shingles")).withColumn("part", F.floor(F.log2("n_shingles")))
    largest = size.groupBy("part").agg((F.floor((1 - t) * F.max("n_shingles") + 1e-9) + 1).alias("keep"))  # 64 rows at most
    size = cut(size.join(F.broadcast(largest), "part"))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy("h", "gram"))
    sketch = cut(grams.join(size, "item_id").withColumn("place", place).filter("place <= keep").groupBy("h").agg(F.collect_set("item_id").alias("ids")))
    top = sketch.agg(F.max("h")).first()[0]
    docs = docs.filter("doc_id IS NOT NULL").select("doc_id", F.col("text").cast("string"))
    if top is None:
        return docs.select("doc_id").limit(0).crossJoin(size.select("item_id", F.lit(0).cast("long").alias("n_shared"), "n_shingles", F.lit(1.0).alias("containment")).limit(0))
    normal = normal_words(F.col("text"))
    hashes = _runs(docs, "h", normal, sizes, F.xxhash64, cfg.piece).select("doc_id", "h").filter(F.col("h") <= F.lit(top))
    pairs = cut(hashes.join(maybe_broadcast(sketch, cfg.broadcast_rows), "h").select("doc_id", F.explode("ids").alias("item_id")).distinct())
    held = docs.join(maybe_broadcast(cut(pairs.select("doc_id").distinct()), cfg.broadcast_rows), "doc_id", "left_semi")
    known = maybe_broadcast(cut(grams.select("gram").distinct()), cfg.broadcast_rows)
    held = _runs(held, "gram", normal, sizes, _gram, cfg.piece).select("doc_id", "gram").join(known, "gram", "left_semi").distinct()
    # of each candidate pair only, the item's shingles that the document has
    wanted = pairs.join(maybe_broadcast(grams.select("item_id", "gram"), cfg.broadcast_rows), "item_id")
    shared = wanted.join(held, ["doc_id", "gram"]).groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"))
    found = shared.join(size.select("item_id", "n_shingles"), "item_id")
    return found.filter(F.col("n_shared") >= t * F.col("n_shingles") - 1e-9).select(
        "doc_id", "item_id", "n_shared", "n_shingles", (F.col("n_shared") / F.col("n_shingles")).alias("containment")
    )
