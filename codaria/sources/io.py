"""Sources and sinks: snapshots of files, JSONL with quarantine, manifests, CSV and templates."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from codaria import schemas


@dataclass(frozen=True)
class Source:
    """How a dataset's files are read: format, reader options, id column and the file of each split."""

    format: str
    splits: dict[str, str]
    id_column: str | None = None
    options: dict[str, str] = field(default_factory=dict)


CSV_OPTIONS = {"header": "true", "multiLine": "true", "escape": '"', "inferSchema": "true"}
READERS: dict[str, Callable[[SparkSession, str, dict[str, str]], DataFrame]] = {
    "parquet": lambda spark, path, options: spark.read.options(**options).parquet(path),
    "csv": lambda spark, path, options: spark.read.options(**(CSV_OPTIONS | options)).csv(path),
}
SOURCES = {
    "vietmed-sum": Source("parquet", {"train": "train.parquet", "dev": "dev.parquet", "test": "test.parquet"}),
    "vihealthqa": Source("csv", {"train": "train.csv", "val": "val.csv", "test": "test.csv"}, "id"),
}


def numbered(df: DataFrame, name: str = "row_index", by_file: bool = False) -> DataFrame:
    """df, as a reader gave it, with numbers from 0 in the order of its files by path and their rows; by_file: from 0 in each file.

    Rows are counted block by block; what is broadcast has one row a block of a file.
    """
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    part = df.select("*", at.alias("_block"), F.monotonically_increasing_id().alias("_at"))
    sizes = part.groupBy("_block").agg(F.count("*").alias("n"), F.min("_at").alias("first"))
    order = (Window.partitionBy("_block.file") if by_file else Window).orderBy("_block")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_block", "first", before.alias("before"))
    return part.join(F.broadcast(sizes), "_block").withColumn(name, F.col("before") + F.col("_at") - F.col("first")).drop("_block", "_at", "before", "first")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if it comes of fewer files than there are: a small file is one split, but the work on its texts is worth all cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def snapshots(df: DataFrame, dataset: str, split: str, source: Source, path: str, version: str = "1") -> DataFrame:
    """One snapshot a row: all columns as payload; the id column, or the row's number, as id."""
    names = df.columns
    rows = numbered(df)
    key = F.col(source.id_column) if source.id_column else F.col("row_index")
    none = F.lit(None).cast("string")
    return rows.select(
        F.lit(dataset).alias("dataset_name"), F.lit(split).alias("source_split"), key.cast("string").alias("source_record_id"), F.parse_json(F.to_json(F.struct(*names))).alias("payload"),
        F.lit(source.format).alias("source_format"), F.lit(path).alias("source_path"), F.lit(version).alias("ingest_version"), none.alias("source_url"), F.lit("vi").alias("language"), none.alias("raw_checksum"),
    )


def ingest(spark: SparkSession, dataset: str, folder: str) -> DataFrame:
    """Snapshots of all splits of a registered dataset."""
    good, bad = ingest_checked(spark, dataset, folder)
    return good


def ingest_checked(spark: SparkSession, dataset: str, folder: str) -> tuple[DataFrame, DataFrame]:
    """Snapshots, and those that are none: rows without an id or a payload, which are counted and not written."""
    if dataset not in SOURCES:
        raise ValueError(f"unknown dataset {dataset!r}")
    source = SOURCES[dataset]
    out = None
    for split, name in source.splits.items():
        path = f"{folder}/{name}"
        part = snapshots(READERS[source.format](spark, path, source.options), dataset, split, source, path)
        out = part if out is None else out.unionByName(part)
    sound = F.col("source_record_id").isNotNull() & F.col("payload").isNotNull()
    return out.filter(sound), out.filter(~sound)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 1 in each file), value."""
    return numbered(spark.read.text(path), "n", by_file=True).select((F.col("n") + 1).alias("line_no"), "value")


def quarantine(spark: SparkSession, path: str, record: str) -> tuple[DataFrame, DataFrame]:
    """Good records, and errors(line, error)."""
    rows = schemas.parse(read_lines(spark, path), record)
    return rows.filter("error IS NULL").select("record.*"), rows.filter("error IS NOT NULL").select(F.col("line_no").alias("line"), "error")


def read_strict(spark: SparkSession, path: str, record: str) -> DataFrame:
    """Records; reading a bad line raises."""
    rows = schemas.parse(read_lines(spark, path), record)
    checked = F.when(F.col("error").isNull(), F.col("record")).otherwise(F.raise_error(F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(": "), F.col("error"))))
    return rows.select(checked.alias("record")).select("record.*")


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path).schema  # noqa: B018
        return True
    except AnalysisException:
        return False


def read_optional(spark: SparkSession, path: str | None, record: str) -> DataFrame:
    """Records, or an empty table if there is no such path."""
    return read_strict(spark, path, record) if path and _exists(spark, path) else schemas.empty(spark, record)


def read_required(spark: SparkSession, path: str, record: str) -> DataFrame:
    """Records; FileNotFoundError without the path, ValueError without rows."""
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    df = read_strict(spark, path, record)
    if df.isEmpty():
        raise ValueError(f"no records in {path}")
    return df


def read_seed(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of abbreviations -> abbr (upper case), expansion; empty without the path."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "abbr string, expansion string")
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("abbr", "expansion"))
    return rows.select(F.upper("abbr").alias("abbr"), "expansion")


def fetch(url: str, path: str, timeout: float = 120.0) -> str:
    """path, after the document at an http(s) url was written there; redirects are followed, errors raise."""
    import urllib.request

    if not url.startswith(("http://", "https://")):
        raise FileNotFoundError(url)
    with urllib.request.urlopen(url, timeout=timeout) as answer, open(path, "wb") as out:
        while block := answer.read(1 << 20):
            out.write(block)
    return path


def form_feed_pages(content: bytes) -> list[str]:
    """The pages of UTF-8 text, parted by form feeds; an extractor for books that are text already."""
    pages = content.decode("utf-8").split("\f")
    return pages if any(p.strip() for p in pages) else []


def pages_from_binary(spark: SparkSession, path: str, extract: Callable[[bytes], list[str]], source: str = "icd10_official_pdf") -> DataFrame:
    """One document a page of binary files, by a pluggable extractor of page texts; raises for files without pages."""
    return pages_of(spark.read.format("binaryFile").load(path).select("path", "content"), extract, source)


def pages_of(files: DataFrame, extract: Callable[[bytes], list[str]], source: str = "icd10_official_pdf") -> DataFrame:
    """pages_from_binary of files(path, content)."""
    import pandas as pd

    def run(frames):
        for f in frames:
            rows = []
            for name, content, sha in zip(f["path"], f["content"], f["sha"], strict=True):
                texts = extract(bytes(content))
                if not texts:
                    raise ValueError(f"no pages in {name}")
                rows += [(f"{source}:page:{i}", i, t, not t.strip(), sha, len(texts)) for i, t in enumerate(texts, 1)]
            yield pd.DataFrame(rows, columns=["doc_id", "page_no", "raw_text", "is_empty_page", "sha256", "total_pages"])

    return files.withColumn("sha", F.sha2("content", 256)).mapInPandas(run, "doc_id string, page_no int, raw_text string, is_empty_page boolean, sha256 string, total_pages int")


# Parsers of snapshots: columns of the text, and the document id.
PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def parser(name: str):
    def register(f: Callable[[DataFrame], DataFrame]):
        PARSERS[name] = f
        return f

    return register


def _field(name: str):
    is_text = F.schema_of_variant(F.try_variant_get("payload", f"$.{name}", "variant")) == "STRING"
    return F.when(is_text, F.try_variant_get("payload", f"$.{name}", "string"))


def _documents(rows: DataFrame, first: str, second: str, doc_id, second_may_be_empty: bool) -> DataFrame:
    a, b = _field(first), _field(second)
    error = F.when(a.isNull() | (a == ""), F.lit(f"{first} must be a non-empty string")).when(b.isNull() | (F.lit(not second_may_be_empty) & (b == "")), F.lit(f"{second} must be a string"))
    return rows.select(doc_id.alias("doc_id"), F.col("dataset_name").alias("source"), F.coalesce("language", F.lit("vi")).alias("language"), F.concat_ws("\n", a, b).alias("raw_text"), "source_record_id", F.col("source_split").alias("split"), "payload", error.alias("error"))


@parser("vietmed-sum")
def parse_summaries(rows: DataFrame) -> DataFrame:
    return _documents(rows, "transcript", "summary", F.concat(F.lit("vietmed-sum:"), "source_record_id"), True)


@parser("vihealthqa")
def parse_questions(rows: DataFrame) -> DataFrame:
    return _documents(rows, "question", "answer", F.concat_ws(":", F.lit("vihealthqa"), "source_split", "source_record_id"), False)


def parse_dataset(rows: DataFrame, dataset: str) -> tuple[DataFrame, DataFrame]:
    """Documents, and errors(split, source_record_id, error)."""
    if dataset not in PARSERS:
        raise ValueError(f"unknown dataset {dataset!r}")
    out = PARSERS[dataset](rows)
    return out.filter("error IS NULL").drop("error"), out.filter("error IS NOT NULL").select("split", "source_record_id", "error")


def split_counts(df: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """split, records, failed."""
    good = df.groupBy("split").agg(F.count("*").alias("records"))
    if failed is None:
        return good.withColumn("failed", F.lit(0).cast("long"))
    bad = failed.groupBy("split").agg(F.count("*").alias("failed"))
    return good.join(bad, "split", "full").na.fill(0, ["records", "failed"])


def manifest(dataset: str, counts: DataFrame, created_at: str) -> str:
    """Pretty JSON of all splits' counts; a few rows, one a split."""
    rows = sorted(counts.collect(), key=lambda r: r["split"])
    splits = [r["split"] for r in rows]
    record = {"dataset": dataset, "input_splits": splits, "output_splits": splits, "record_count_by_split": {r["split"]: r["records"] for r in rows}, "failed_count_by_split": {r["split"]: r["failed"] for r in rows}, "created_at": created_at}
    return json.dumps(record, ensure_ascii=False, indent=2)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One text file's folder."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_jsonl(df: DataFrame, path: str, single: bool = False) -> None:
    """Nulls are kept as null fields; single: one file, for small tables."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_errors(errors: DataFrame, path: str) -> bool:
    """Written only if there are any."""
    if errors.isEmpty():
        return False
    write_jsonl(errors, path)
    return True


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ssXXX").option("escape", '"').csv(path)


def rule_template(rules: DataFrame) -> str:
    """A JSON array of seven columns of the rules, by id; rules are of one code book."""
    cols = ["rule_id", "scope", "code_3char", "topic", "action", "priority", "normalized_text"]
    packed = F.array_sort(F.collect_list(F.struct(*cols)))
    return rules.agg(F.to_json(packed, {"ignoreNullFields": "false"}).alias("j")).first()["j"]
