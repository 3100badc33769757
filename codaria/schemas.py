"""Closed record schemas, their value domains, and validation that quarantines or fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: DDL of each record; a trailing * marks required fields of the reader's checks.
RECORDS = {
    "snapshot": "dataset_name STRING, source_split STRING, source_record_id STRING, payload VARIANT, source_format STRING, source_path STRING, ingest_version STRING, source_url STRING, language STRING, raw_checksum STRING",
    "document": "doc_id STRING, source STRING, language STRING, raw_text STRING, source_record_id STRING, split STRING, payload VARIANT, normalized_text STRING, retrieval_text STRING, sentences ARRAY<STRING>, created_at TIMESTAMP",
    "sentence": "sentence_id STRING, doc_id STRING, sentence_index INT, text STRING, char_start INT, char_end INT, created_at TIMESTAMP",
    "mention": "mention_id STRING, doc_id STRING, text STRING, normalized_text STRING, mention_type STRING, char_start INT, char_end INT, confidence DOUBLE, created_at TIMESTAMP",
    "ontology": "code_3char STRING, chapter_id STRING, title_vi STRING, title_en STRING, aliases ARRAY<STRING>, search_text STRING, created_at TIMESTAMP",
    "alias": "alias_id STRING, code_3char STRING, alias STRING, alias_norm STRING, alias_type STRING, language STRING, match_level STRING, source_page INT, source_line STRING, created_at TIMESTAMP",
    "rule": "rule_id STRING, scope STRING, code_3char STRING, topic STRING, action STRING, priority INT, source_page_start INT, source_page_end INT, evidence_text STRING, normalized_text STRING, created_at TIMESTAMP",
    "candidate": "doc_id STRING, mention_id STRING, code_3char STRING, method STRING, score DOUBLE, char_start INT, char_end INT, created_at TIMESTAMP",
    "weak_label": "doc_id STRING, code_3char STRING, label_type STRING, confidence DOUBLE, rank INT, support_methods ARRAY<STRING>, support_rule_ids ARRAY<STRING>, evidence_spans ARRAY<STRUCT<mention_id: STRING, char_start: INT, char_end: INT, text: STRING, methods: ARRAY<STRING>, score: DOUBLE>>, created_at TIMESTAMP",
    "silver": "doc_id STRING, label_granularity STRING, silver_labels ARRAY<STRING>, candidate_codes ARRAY<STRING>, confidence DOUBLE, split STRING, created_at TIMESTAMP",
    "prediction": "doc_id STRING, model_name STRING, label_granularity STRING, predicted_codes ARRAY<STRING>, scores MAP<STRING, DOUBLE>, created_at TIMESTAMP",
    "explanation": "doc_id STRING, code_3char STRING, spans ARRAY<STRUCT<char_start: INT, char_end: INT, text: STRING, score: DOUBLE>>, matched_label_text STRING, summary STRING, created_at TIMESTAMP",
    "manifest": "dataset STRING, input_splits ARRAY<STRING>, output_splits ARRAY<STRING>, record_count_by_split MAP<STRING, BIGINT>, failed_count_by_split MAP<STRING, BIGINT>, created_at TIMESTAMP",
}
#: Fields that may be missing or null; all others are required. created_at is stamped where it is missing.
OPTIONAL = {
    "payload", "source_url", "language", "raw_checksum", "source_record_id", "split", "normalized_text", "retrieval_text", "sentences", "confidence", "chapter_id", "title_en",
    "aliases", "match_level", "source_page", "source_line", "code_3char", "source_page_start", "source_page_end", "mention_id", "char_start", "char_end",
    "matched_label_text", "summary", "created_at", "support_rule_ids", "evidence_spans", "support_methods", "candidate_codes",
}
REQUIRED_ANYWAY = {("document", "language"), ("mention", "mention_id"), ("mention", "char_start"), ("mention", "char_end"), ("mention", "normalized_text"), ("sentence", "char_start"), ("sentence", "char_end"), ("ontology", "code_3char"), ("alias", "code_3char"), ("alias", "language"), ("candidate", "code_3char"), ("weak_label", "code_3char"), ("weak_label", "confidence"), ("explanation", "code_3char"), ("rule", "normalized_text"), ("silver", "split")}
# The domains of enumerated fields.
DOMAINS = {
    ("mention", "mention_type"): "disease symptom diagnosis procedure abbreviation other",
    ("candidate", "method"): "exact normalized fuzzy tfidf bm25 dense",
    ("alias", "alias_type"): "title_vi title_en parenthetical inclusion nos_form bilingual_variant",
    ("alias", "language"): "vi en mixed unknown",
    ("alias", "match_level"): "exact normalized fuzzy",
    ("rule", "scope"): "global code",
    ("rule", "topic"): "principal_diagnosis symptom_fallback mortality_coding official_3char_policy include_note exclude_note use_additional_code code_first general_note",
    ("rule", "action"): "prefer fallback restrict allow require_additional_code code_first note",
    ("silver", "split"): "train val test",
    ("weak_label", "label_type"): "positive",
}


def schema(record: str) -> StructType:
    return StructType.fromDDL(RECORDS[record])


def required(record: str) -> list[str]:
    return [f.name for f in schema(record) if f.name not in OPTIONAL or (record, f.name) in REQUIRED_ANYWAY]


def _type_ok(record: str, name: str, kind: str, value: Column) -> Column:
    """Whether a field's JSON value can be the field's; numbers may come as text, text never as numbers."""
    found = F.schema_of_variant(value)
    null = found == "VOID"
    number = F.try_variant_get(value, "$", "double").isNotNull()
    if kind == "string":
        return null | (found == "STRING")
    if kind == "int":
        return null | (number & (F.try_variant_get(value, "$", "double") == F.floor(F.try_variant_get(value, "$", "double"))))
    if kind == "double":
        return null | number
    if kind.startswith("array"):
        return null | found.startswith("ARRAY")
    if kind == "variant":
        return null | (found.startswith("OBJECT") & ~found.rlike("[<,] ?[^:,<>]+: (OBJECT|ARRAY)"))
    return null | found.startswith("OBJECT") if kind.startswith("map") else null | ~found.startswith("OBJECT")


def parse(lines: DataFrame, record: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """lines(line_no, value) -> line_no, value, those to keep, record (null if bad), error (null if good). Blank lines go.

    Unknown keys, missing required fields, wrong JSON types and values outside
    an enumeration are errors, with the first one found as the message.
    """
    fields = schema(record)
    rows = lines.filter(F.trim(F.regexp_replace("value", r"[\r\t]", " ")) != "").withColumn("v", F.try_parse_json("value"))
    keys = F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>"))
    unknown = F.array_except(keys, F.array(*[F.lit(f.name) for f in fields]))
    error = F.when(F.col("v").isNull() | ~F.schema_of_variant("v").startswith("OBJECT"), F.lit("not a JSON object"))
    error = error.when(F.size(unknown) > 0, F.concat(F.lit("unknown field: "), F.array_join(unknown, ", ")))
    for f in fields:
        part = F.try_variant_get("v", f"$.{f.name}", "variant")
        if f.name in required(record):
            error = error.when(part.isNull() | F.coalesce(F.is_variant_null(part), F.lit(True)), F.lit(f"missing field: {f.name}"))
        error = error.when(part.isNotNull() & ~_type_ok(record, f.name, f.dataType.simpleString(), part), F.lit(f"wrong type: {f.name}"))
        if (record, f.name) in DOMAINS:
            text = F.try_variant_get("v", f"$.{f.name}", "string")
            error = error.when(text.isNotNull() & ~text.isin(*DOMAINS[record, f.name].split()), F.lit(f"value not allowed: {f.name}"))
    rows = rows.withColumn("error", error)
    return rows.select("line_no", "value", *keep, F.when(F.col("error").isNull(), F.from_json("value", fields)).alias("record"), "error")


def empty(spark: SparkSession, record: str) -> DataFrame:
    return spark.createDataFrame([], schema(record))
