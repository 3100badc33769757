"""The document stages as Structured Streaming queries.

Normalisation, mentions and the joins with the code book keep no state, so they are
the batch functions themselves on a stream; the code book is a static side. State
is kept only where it is asked for: records seen twice within a delay, and counts by
event-time window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codaria import schemas
from codaria.operators import lexicon
from codaria.plans.stages import mentions_of, normalize


def read_records(spark: SparkSession, folder: str, record: str, files_at_once: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Good records of JSONL files as they come, and errors(file, error); lines have no number on a stream."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_at_once).text(folder).select("value", F.col("_metadata.file_path").alias("file"))
    rows = schemas.parse(lines.withColumn("line_no", F.lit(0).cast("long")), record, keep=("file",))
    return rows.filter("error IS NULL").select("record.*"), rows.filter("error IS NOT NULL").select("file", "error")


def first_seen(docs: DataFrame, delay: str = "1 hour") -> DataFrame:
    """docs(doc_id, created_at, ...) without records whose doc_id came before within the delay; later ones may come again."""
    return docs.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["doc_id"])


def links(docs: DataFrame, codes: DataFrame, aliases: DataFrame) -> DataFrame:
    """Exact and normalized links of the mentions of docs(doc_id, raw_text) to the static code book."""
    found = mentions_of(normalize(docs))
    return lexicon.exact_links(found, lexicon.title_index(codes)).unionByName(lexicon.normalized_links(found, lexicon.alias_index(aliases)))


def mention_counts(docs: DataFrame, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """start, mention_type, n: mentions of docs(doc_id, raw_text, created_at) by event-time window; documents later than the delay are left out."""
    timed = docs.withWatermark("created_at", delay).withColumn("at", F.window("created_at", window)["start"])
    # the mentions' table function sees texts only, so the window goes with the id
    keyed = timed.withColumn("doc_id", F.to_json(F.struct("doc_id", F.unix_micros("at").alias("at"))))
    found = mentions_of(keyed).withColumn("start", F.timestamp_micros(F.get_json_object("doc_id", "$.at").cast("long")))
    return found.groupBy("start", "mention_type").agg(F.count("*").alias("n"))


def write(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Starts a query that writes what there is and ends; what it has read it does not read again."""
    writer = df.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
    if mode == "append":
        return writer.format("parquet").start(path)
    return writer.outputMode(mode).foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).start()
