"""The corpus pipeline: toxic documents, near copies, benchmark leaks and secrets go, then sources are mixed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codaria.llm.decontaminate import contaminated
from codaria.llm.mixing import mixed_documents
from codaria.llm.near_dedup import near_duplicates
from codaria.llm.secret_scan import SecretConfig, redact_secrets
from codaria.llm.skew import maybe_broadcast
from codaria.llm.storage import cut, new_path, remove
from codaria.llm.textops import WORD_PATTERN
from codaria.llm.toxicity import drop_toxic


def _key(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column that tells its id and text apart from all others', null or not, and that column's name."""
    name = "text_key"
    while name in docs.columns:
        name += "_"
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("0")) for c in ("doc_id", "text")]
    return docs.withColumn(name, F.unhex(F.md5(F.concat(F.length(parts[0]), *parts)))), name


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of toxicity.py predicts as toxic go; the labels' table is the one to learn from.

    Each row is judged by its text: null and empty ones score as texts without
    toxic words, equal texts alike. Extra columns stay; without rows none come.
    """
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id (then the smallest key), null ids last.

    Each text is judged by itself: different texts with one id are different
    documents. Rows of equal id and text are one, the least by their other columns' JSON.
    Texts without words are near to nothing, so those rows all stay. Extra columns
    stay, whatever their names; an empty table gives an empty one.
    """
    keyed, key = _key(docs)
    names = docs.columns
    found = near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text")).filter("n_shingles > 0")
    group = found.select(F.col("doc_id").alias(key), F.col("component_id").alias("group")).distinct()
    ids = keyed.select(key, "doc_id").distinct()
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col(key))
    kept = group.join(ids, key).groupBy("group").agg(F.min(first).alias("first")).select(F.col(f"first.{key}").alias(key))
    wordless = ~F.coalesce(F.regexp_like("text", F.lit(WORD_PATTERN)), F.lit(False))
    rest = docs.filter(wordless)
    rows = keyed.filter(~wordless).join(kept, key, "left_semi").groupBy(key).agg(F.min_by(F.struct(*[F.col(c) for c in names]), F.to_json(F.struct(*[F.col(c) for c in names if c != "text"]))).alias("row"))
    return rows.select(*[F.col("row").getField(c).alias(c) for c in names]).unionByName(rest)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item, as contaminated() finds them, go.

    Each text is judged by itself, with or without an id; rows of equal id and text
    share their fate. Null and empty texts stay, extra columns too; an empty table
    gives an empty one.
    """
    keyed, key = _key(docs)
    found = contaminated(keyed.select(F.col(key).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return keyed.join(maybe_broadcast(cut(found.select(F.col("doc_id").alias(key)).distinct())), key, "left_anti").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; all rows and columns stay, null texts as null, equal texts alike."""
    import public_tokenizers

    return redact_secrets(docs, SecretConfig(vocabulary=public_tokenizers.path("byte_bpe_50k.tiktoken")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the mix takes any words, with size, target and taken, which replace columns of these names; see mixed_documents()."""
    return mixed_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("mixing", mixing),
]

#: The CRF's scores are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written to the shared folder and read again, and deleted once the next one is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            remove(spark, last)
        docs, last = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
