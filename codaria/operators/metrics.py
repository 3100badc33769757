"""Multilabel metrics from sparse scores and targets; cells that are absent score 0."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def check_inputs(scores: DataFrame, targets: DataFrame, threshold: float = 0.5) -> None:
    if not 0 < threshold < 1:
        raise ValueError("threshold must be between 0 and 1")
    if not scores.filter("score IS NULL OR isnan(score) OR score < 0 OR score > 1").isEmpty():
        raise ValueError("scores must be in [0, 1]")
    if not targets.groupBy("doc_id", "label").count().filter("count > 1").isEmpty():
        raise ValueError("a target is given twice")


def confusion(scores: DataFrame, targets: DataFrame, docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """label, tp, fp, fn over docs(doc_id), those predicted for; targets of other documents count for the vocabulary only.

    scores(doc_id, label, score): positive above the threshold. targets(doc_id, label).
    """
    seen = targets.join(docs, "doc_id", "left_semi").withColumn("y", F.lit(1))
    cells = scores.select("doc_id", "label", (F.col("score") > threshold).cast("int").alias("p")).join(seen, ["doc_id", "label"], "full")
    p, y = F.coalesce("p", F.lit(0)), F.coalesce("y", F.lit(0))
    counts = cells.groupBy("label").agg(F.sum(p * y).alias("tp"), F.sum(p * (1 - y)).alias("fp"), F.sum((1 - p) * y).alias("fn"))
    labels = scores.select("label").union(targets.select("label")).distinct()
    return labels.join(counts, "label", "left").na.fill(0, ["tp", "fp", "fn"])


def micro_macro(counts: DataFrame) -> DataFrame:
    """micro_f1, macro_f1, micro_precision, micro_recall; 0 where a denominator is."""
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    f1 = ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    whole = counts.withColumn("f1", f1).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.avg("f1").alias("macro_f1"))
    return whole.select(f1.alias("micro_f1"), "macro_f1", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("micro_precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("micro_recall"))


def auroc(scores: DataFrame, targets: DataFrame, docs: DataFrame) -> DataFrame:
    """label, auroc by rank sum with ties at half; NaN without both classes. Absent cells are counted, not made."""
    seen = targets.join(docs, "doc_id", "left_semi").withColumn("y", F.lit(1))
    cells = scores.select("doc_id", "label", "score").join(seen, ["doc_id", "label"], "full").select("label", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("y", F.lit(0)).alias("y"))
    by = cells.groupBy("label", "score").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    known = by.groupBy("label").agg(F.sum("n").alias("have"))
    zeros = known.crossJoin(F.broadcast(docs.agg(F.count("*").alias("all")))).select("label", F.lit(0.0).alias("score"), (F.col("all") - F.col("have")).alias("n"), F.lit(0).cast("long").alias("pos"))
    by = by.unionByName(zeros).groupBy("label", "score").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).filter("n > 0")
    # a label that only documents without a prediction have is one without positives
    missing = targets.select("label").distinct().join(known, "label", "left_anti").crossJoin(F.broadcast(docs.agg(F.count("*").alias("n")))).select("label", F.lit(0.0).alias("score"), "n", F.lit(0).cast("long").alias("pos"))
    return rank_sums(by.unionByName(missing))


def rank_sums(by: DataFrame) -> DataFrame:
    """label, auroc of by(label, score, n, pos): cells and positive ones by score."""
    below = F.coalesce(F.sum(F.col("n") - F.col("pos")).over(Window.partitionBy("label").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by = by.withColumn("wins", F.col("pos") * (below + (F.col("n") - F.col("pos")) / 2))
    out = by.groupBy("label").agg(F.sum("wins").alias("w"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("m"))
    return out.select("label", F.when((F.col("p") > 0) & (F.col("m") > 0), F.col("w") / (F.col("p") * F.col("m"))).otherwise(float("nan")).alias("auroc"))


def macro_auroc(by_label: DataFrame) -> DataFrame:
    """NaN unless every label has both classes."""
    return by_label.agg(F.when(F.max(F.isnan("auroc").cast("int")) == 0, F.avg("auroc")).otherwise(float("nan")).alias("macro_auroc"))


def at_k(scores: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """precision_at_k and recall_at_k, means over documents with targets."""
    top = scores.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "label"))).filter(F.col("rn") <= k)
    hits = top.join(targets, ["doc_id", "label"], "left_semi").groupBy("doc_id").agg(F.count("*").alias("hits"))
    per = targets.groupBy("doc_id").agg(F.count("*").alias("n")).join(hits, "doc_id", "left").na.fill(0, ["hits"])
    return per.agg(F.avg(F.col("hits") / k).alias("precision_at_k"), F.avg(F.col("hits") / F.col("n")).alias("recall_at_k"))


def chapter_projection(scores: DataFrame, codes: DataFrame) -> DataFrame:
    """doc_id, chapter_id, score: the best of a chapter's codes."""
    return scores.join(codes.select(F.col("code_3char").alias("label"), "chapter_id"), "label").groupBy("doc_id", "chapter_id").agg(F.max("score").alias("score"))


@dataclass(frozen=True)
class MetricConfig:
    """What an evaluator measures; raises ValueError for fewer than one label or a threshold outside (0, 1)."""

    granularity: str
    num_labels: int
    threshold: float = 0.5

    def __post_init__(self) -> None:
        if self.num_labels < 1:
            raise ValueError("num_labels must be at least 1")
        if not 0 < self.threshold < 1:
            raise ValueError("threshold must be between 0 and 1")


class Evaluator:
    """Multilabel metrics over batches of cells; the result is that of all cells at once.

    A batch is kept as its counts by label and score, which are merged when the
    metrics are computed.
    """

    def __init__(self, config: MetricConfig):
        self.config = config
        self.batches: list[DataFrame] = []

    def update(self, cells: DataFrame) -> None:
        """cells(doc_id, label, score, target): one for each document and each of num_labels labels; raises ValueError otherwise, and for scores outside [0, 1] or targets other than 0 and 1."""
        kinds = dict(cells.dtypes)
        if kinds["score"] not in ("float", "double"):
            raise ValueError(f"scores must be floating point, not {kinds['score']}")
        if kinds["target"] not in ("tinyint", "smallint", "int", "bigint", "boolean"):
            raise ValueError(f"targets must be integer or boolean, not {kinds['target']}")
        cells = cells.withColumn("target", F.col("target").cast("int"))
        bad = F.col("score").isNull() | F.isnan("score") | (F.col("score") < 0) | (F.col("score") > 1)
        if not cells.filter(bad).isEmpty():
            raise ValueError("scores must be in [0, 1]")
        if not cells.filter("target IS NULL OR target NOT IN (0, 1)").isEmpty():
            raise ValueError("targets must be 0 or 1")
        width = cells.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("label").alias("d"))
        if not width.filter((F.col("n") != self.config.num_labels) | (F.col("d") != self.config.num_labels)).isEmpty():
            raise ValueError(f"a document must have {self.config.num_labels} cells")
        self.batches.append(cells.groupBy("label", "score").agg(F.count("*").alias("n"), F.sum("target").alias("pos")))

    def reset(self) -> None:
        self.batches = []

    def compute(self) -> dict[str, float]:
        """Each metric by its name behind the granularity; macro_auroc is NaN unless every label has both classes."""
        if not self.batches:
            raise ValueError("no batch was given")
        cells = self.batches[0]
        for b in self.batches[1:]:
            cells = cells.unionByName(b)
        cells = cells.groupBy("label", "score").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
        over = (F.col("score") > self.config.threshold).cast("int")
        counts = cells.groupBy("label").agg(F.sum(over * F.col("pos")).alias("tp"), F.sum(over * (F.col("n") - F.col("pos"))).alias("fp"), F.sum((1 - over) * F.col("pos")).alias("fn"))
        both = {**micro_macro(counts).first().asDict(), **macro_auroc(rank_sums(cells)).first().asDict()}
        return {f"{self.config.granularity}/{name}": float(value) for name, value in both.items()}


def evaluate(predictions: DataFrame, targets: DataFrame, granularity: str = "code_3char", threshold: float = 0.5) -> dict[str, float]:
    """Metrics of predictions(doc_id, scores: code -> score) against targets(doc_id, silver_labels); empty with fewer than two labels.

    Labels are all predicted and all target ones. A document without targets has
    none of them, targets of documents that weren't predicted count for the labels
    only, and of several targets of a document the last by its labels holds.
    Absent cells are counted, not made.
    """
    scores = predictions.select("doc_id", F.explode("scores").alias("label", "score"))
    truth = targets.groupBy("doc_id").agg(F.max("silver_labels").alias("labels")).select("doc_id", F.explode("labels").alias("label")).distinct()
    if scores.select("label").union(truth.select("label")).distinct().count() < 2:
        return {}
    check_inputs(scores, truth, threshold)
    docs = predictions.select("doc_id").distinct()
    both = {**micro_macro(confusion(scores, truth, docs, threshold)).first().asDict(), **macro_auroc(auroc(scores, truth, docs)).first().asDict()}
    return {f"{granularity}/{name}": float(value) for name, value in both.items()}
