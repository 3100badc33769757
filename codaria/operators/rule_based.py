"""The rule-based baseline: evidence per code in arrival order, exclusion, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codaria.functions.text import fold_key

TITLE, ALIAS, NORMALIZED, LEXICAL, INCLUSION, REPEAT, MOST_REPEATS = 1.0, 0.95, 0.85, 0.60, 0.75, 0.05, 4


def mention_matches(mentions: DataFrame, titles: DataFrame, aliases: DataFrame) -> DataFrame:
    """doc_id, code, source, weight, arrival; mentions(doc_id, text, normalized_text, ordinal)."""
    m = mentions.select("doc_id", "ordinal", fold_key(F.col("text")).alias("key"), fold_key(F.col("normalized_text")).alias("norm"))
    t, n, a = (x.select(F.col("key").alias(k), F.col("code").alias(c)) for x, k, c in ((titles, "key", "t"), (titles, "norm", "n"), (aliases, "norm", "a")))
    m = m.join(t, "key", "left").join(n, "norm", "left").join(a, "norm", "left")
    other = (F.col("norm") != F.col("key")) & ~F.coalesce(F.col("t") == F.col("n"), F.lit(False))
    steps = F.array(
        F.struct(F.col("t").alias("code"), F.lit("mention:exact_title").alias("source"), F.lit(TITLE).alias("weight"), F.lit(0).alias("step")),
        F.struct(F.col("a").alias("code"), F.lit("mention:exact_alias").alias("source"), F.lit(ALIAS).alias("weight"), F.lit(1).alias("step")),
        F.struct(F.when(other, F.col("n")).alias("code"), F.lit("mention:normalized").alias("source"), F.lit(NORMALIZED).alias("weight"), F.lit(2).alias("step")),
    )
    rows = m.select("doc_id", "ordinal", F.explode(steps).alias("s")).filter("s.code IS NOT NULL")
    return rows.select("doc_id", "s.code", "s.source", "s.weight", (F.col("ordinal") * 3 + F.col("s.step")).cast("long").alias("arrival"))


def evidence_scores(mention: DataFrame, lexical: DataFrame, inclusion: DataFrame | None = None) -> DataFrame:
    """doc_id, code, score: most over distinct sources, in arrival order, of weight + .05 for each earlier one (4 at most), over the document's largest.

    lexical and inclusion(doc_id, code, score) arrive after all mentions, in this order.
    """
    late = 1 << 62
    rows = mention.select("doc_id", "code", "source", "weight", "arrival")
    for i, (df, name, w) in enumerate(((lexical, "doc_lexical", LEXICAL), (inclusion, "inclusion", INCLUSION))):
        if df is not None:
            rows = rows.unionByName(df.select("doc_id", "code", F.lit(name).alias("source"), F.least(F.col("score") * w, F.lit(w)).alias("weight"), F.lit(late + i).alias("arrival")))
    first = rows.groupBy("doc_id", "code", "source").agg(F.min(F.struct("arrival", "weight")).alias("f"))
    place = F.row_number().over(Window.partitionBy("doc_id", "code").orderBy("f.arrival", "source")) - 1
    scored = first.withColumn("s", F.col("f.weight") + REPEAT * F.least(place, F.lit(MOST_REPEATS))).groupBy("doc_id", "code").agg(F.max("s").alias("s"))
    whole = F.max("s").over(Window.partitionBy("doc_id"))
    return scored.withColumn("score", F.least(F.col("s") / whole, F.lit(1.0))).filter("s > 0").select("doc_id", "code", "score")


def prune(scores: DataFrame, rules: DataFrame) -> DataFrame:
    """Codes with an exclude rule go, after normalisation."""
    out = rules.filter("topic = 'exclude_note' AND code_3char != ''").select(F.col("code_3char").alias("code")).distinct()
    return scores.join(out, "code", "left_anti").select("doc_id", "code", "score")


def predictions(scores: DataFrame, k: int = 5, limit: int | None = None) -> DataFrame:
    """doc_id, predicted_codes (top k), ranked: array of (code, score) by (score desc, code), all or the first `limit`."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "code", "score")))
    out = scores.groupBy("doc_id").agg((F.slice(order, 1, limit) if limit else order).alias("r"))
    ranked = F.transform("r", lambda x: F.struct(x["code"].alias("code"), x["score"].alias("score")))
    return out.select("doc_id", F.slice(F.transform("r", lambda x: x["code"]), 1, k).alias("predicted_codes"), ranked.alias("ranked"))


def rule_based(docs: DataFrame, mentions: DataFrame, titles: DataFrame, aliases: DataFrame, rules: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, code, score."""
    from codaria.operators.lexicon import title_containment

    scores = evidence_scores(mention_matches(mentions, titles, aliases), title_containment(docs, titles))
    return prune(scores, rules)
