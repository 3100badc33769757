"""Mixing sources to target weights, by distributed prefix sums over hash-random order.

Each document gets a random key, the MD5 of the seed, its id and its text; rows
with one key are counted first, so copies are one row with a count. Within a
source the key's leading bits give its range, of which a source has as many as its
rows need; ranges are summed first, then stretches of ranges, so the running
total inside a range starts from its offset. No source meets in one task, whatever
its share. Each source is cut at its budget exactly. The table of sources itself,
one row a source, is laid in order in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codaria.llm.skew import hot_keys, spread_join
from codaria.llm.storage import cut
from codaria.llm.textops import WORD_PATTERN


@dataclass(frozen=True)
class MixConfig:
    """Weights go round the sources in code point order, null last. Budget: share * all words; no source beyond cap * its words."""

    weights: tuple[int, ...] = (3, 1, 2)
    share: float = 1.5
    cap: float = 2.0
    seed: str = "mix"
    #: Rows that one range of a source holds on average, and ranges that are summed up together.
    range_rows: int = 2048
    stretch_ranges: int = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(totals: DataFrame, cfg: MixConfig = MixConfig()) -> DataFrame:
    """source, source_size -> source, source_size, target: water-filling of the budget under the caps.

    Sources are laid by cap / weight. The level of the first one that does not
    exceed its cap is the level of all that are not capped. One row a source.
    """
    n = len(cfg.weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cfg.weights]), F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(n)) + 1)
    rows = totals.withColumn("w", weight).withColumn("c", F.col("source_size") * cfg.cap)
    by = Window.orderBy(F.col("c") / F.col("w"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("c").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    budget = F.sum("source_size").over(Window.partitionBy()) * cfg.share
    rows = rows.withColumn("level", (budget - before) / rest).withColumn("place", F.row_number().over(by))
    free = F.when(F.col("c") / F.col("w") >= F.col("level"), F.struct("place", "level"))
    rows = rows.withColumn("free", F.min(free).over(Window.partitionBy())["level"])
    return rows.select("source", "source_size", F.coalesce(F.least("c", F.col("free") * F.col("w")), F.col("c")).alias("target"))


def _source_key(source: Column) -> Column:
    """The source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def _random_key(cfg: MixConfig) -> Column:
    """The MD5 of seed, id and text: rows with one key are copies of one row, but for their other columns."""
    doc_id, text = F.col("doc_id").cast("string"), F.col("text").cast("string")
    return F.md5(F.concat_ws(":", F.lit(cfg.seed), F.coalesce(doc_id, F.lit("null")), F.coalesce(F.md5(text), F.lit("null"))))


def _placed(docs: DataFrame, cfg: MixConfig) -> DataFrame:
    """A row for each distinct source_key, key and size: source, doc_id, n (copies), source_size, target, epochs, left and before.

    before: words of the source that come earlier in random order. left: words
    that the budget holds beyond whole epochs.
    """
    rows = docs.select("doc_id", F.col("source").cast("string"), word_count(F.col("text").cast("string")).alias("size"), _random_key(cfg).alias("key"))
    rows = cut(rows.groupBy("source", "doc_id", "size", "key").agg(F.count("*").alias("n")).withColumn("source_key", _source_key(F.col("source"))))
    totals = rows.groupBy("source", "source_key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("rows"))
    totals = cut(totals)
    goal = targets(totals.select("source", "source_size"), cfg).withColumn("source_key", _source_key(F.col("source"))).drop("source", "source_size")
    words = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long")
    goal = totals.join(goal, "source_key").withColumn("epochs", epochs).withColumn("left", words - F.col("epochs") * F.col("source_size"))
    goal = cut(goal.withColumn("ranges", F.ceil(F.col("rows") / cfg.range_rows)).drop("source"))
    rows = spread_join(rows, goal.drop("rows"), ["source_key"], hot_keys(totals, rows.count(), ["source_key"], "rows"))
    # leading bits of the key as a fraction, times the source's ranges
    place = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("ranges") / F.lit(2**32)).cast("long")
    rows = rows.withColumn("place", place).withColumn("stretch", F.floor(F.col("place") / cfg.stretch_ranges).cast("long"))
    parts = cut(rows.groupBy("source_key", "stretch", "place").agg(F.sum(F.col("size") * F.col("n")).alias("in_range")))

    def earlier(total: str, *by: str, order: Sequence[str]) -> Column:
        window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(total).over(window), F.lit(0))

    stretches = parts.groupBy("source_key", "stretch").agg(F.sum("in_range").alias("in_stretch"))
    stretches = stretches.select("source_key", "stretch", earlier("in_stretch", "source_key", order=["stretch"]).alias("offset"))
    parts = parts.withColumn("in_part", earlier("in_range", "source_key", "stretch", order=["place"])).join(stretches, ["source_key", "stretch"])
    parts = parts.select("source_key", "place", (F.col("offset") + F.col("in_part")).alias("offset"))
    rows = rows.withColumn("words", F.col("size") * F.col("n")).withColumn("inside", earlier("words", "source_key", "place", order=["key", "doc_id", "size"]))
    return rows.join(parts, ["source_key", "place"]).withColumn("before", F.col("offset") + F.col("inside"))


def _taken(copy: Column) -> Column:
    """Words taken of a copy, the first being 0."""
    rest = F.col("left") - F.col("before") - copy * F.col("size")
    return (F.col("epochs") * F.col("size") + F.least(F.greatest(rest, F.lit(0)), F.col("size"))).cast("long")


def mix_sources(docs: DataFrame, cfg: MixConfig = MixConfig()) -> DataFrame:
    """One row for each row of docs(doc_id, text, source): doc_id, source, size, source_size, target, taken.

    size: words of the text (null: 0). taken: words that the mix takes, each
    whole epoch of the source and then the documents first in random order until
    the budget's last word, in the middle of a document if need be. So a
    source's taken words sum to floor(target). A null source is one of its own,
    and a null id counts like an id; rows that repeat id, text and source are
    counted before they are dealt and come back as often, other columns are
    ignored, and an empty table gives an empty one. Reruns agree.
    """
    rows = _placed(docs, cfg)
    # copies in blocks, so that no array is as long as a third of all rows
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long"))).alias("block")
    rows = rows.select("*", block)
    copy = F.explode(F.sequence(F.col("block"), F.least(F.col("block") + COPIES, F.col("n")) - 1)).alias("copy")
    return rows.select("*", copy).select("doc_id", "source", "size", "source_size", "target", _taken(F.col("copy")).alias("taken"))


#: Copies of one row that are made at once.
COPIES = 10_000


def mixed_documents(docs: DataFrame, cfg: MixConfig = MixConfig()) -> DataFrame:
    """The rows of docs(doc_id, text, source, ...) of which the mix takes any words, with all columns and size, target and taken.

    Columns of docs that have those three names are replaced. What a row gets is
    what mix_sources gives it; of rows that repeat id, text and source the first by
    their other columns' JSON is the first copy. Nulls and empty tables as there.
    """
    mark = "mix"
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"
    names = [c for c in docs.columns if c not in ("size", "target", "taken")]
    join = [f"{mark}source", f"{mark}key"]
    rows = _placed(docs, cfg).select(
        F.col("source_key").alias(join[0]), F.col("key").alias(join[1]), *[F.col(c).alias(f"{mark}_{c}") for c in ("n", "size", "target", "epochs", "left", "before")]
    )
    found = docs.select(*names, _source_key(F.col("source").cast("string")).alias(join[0]), _random_key(cfg).alias(join[1])).join(rows, join)
    copies = Window.partitionBy(*join).orderBy(F.to_json(F.struct(*[F.col(c) for c in names if c != "text"])))
    one, more = found.filter(F.col(f"{mark}_n") == 1).withColumn(f"{mark}_copy", F.lit(0)), found.filter(F.col(f"{mark}_n") > 1).withColumn(f"{mark}_copy", F.row_number().over(copies) - 1)
    found = one.unionByName(more)
    size, rest = F.col(f"{mark}_size"), F.col(f"{mark}_left") - F.col(f"{mark}_before") - F.col(f"{mark}_copy") * F.col(f"{mark}_size")
    taken = (F.col(f"{mark}_epochs") * size + F.least(F.greatest(rest, F.lit(0)), size)).cast("long")
    return found.select(*names, size.alias("size"), F.col(f"{mark}_target").alias("target"), taken.alias("taken")).filter("taken > 0")
