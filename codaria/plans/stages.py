"""The whole run from files to labels and predictions, stage by stage.

Each stage reads the tables of those before it and writes its own, as Parquet
under root/dataset/table/split=NAME: document ids are unique in a split only, so
splits are never joined with each other. The code book has the tables codes,
aliases and rules under root/BOOK, from its table pages(page_no, raw_text).
"""

from __future__ import annotations

import json
import tempfile
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from codaria.functions import text as T
from codaria.functions.abbreviations import default_seed
from codaria.operators import candidates, lexicon, metrics, ontology, retrieval, rule_based, spans, weak_labels
from codaria.sources import io

BOOK = "icd10"
GRANULARITY = "code_3char"


@dataclass(frozen=True)
class Run:
    """Where a run's tables are, and the parameters of its stages."""

    spark: SparkSession
    root: str
    source: str = ""  #: folder with a folder of files for each dataset
    seed: str | None = None  #: JSON of abbreviations; the default ones without it
    candidates: int = 50
    labels: int = 5
    predicted: int = 5
    scores: int = 100
    k1: float = 1.5
    b: float = 0.75
    targets: str | None = None  #: JSONL of silver targets; metrics are written only with it
    aliases: str | None = None  #: JSONL of alias records in the place of the book's
    rules: str | None = None  #: JSONL of rule records in the place of the book's
    pdf: str | None = None  #: binary files or an http(s) address of the book, in the place of its table pages
    extract: Callable[[bytes], list[str]] = io.form_feed_pages  #: page texts of one such file

    def path(self, dataset: str, table: str, split: str | None = None) -> str:
        return f"{self.root.rstrip('/')}/{dataset}/{table}" + (f"/split={split}" if split else "")

    def read(self, dataset: str, table: str, split: str | None = None) -> DataFrame:
        """A table of an earlier stage without its time; FileNotFoundError if it isn't there."""
        path = self.path(dataset, table, split)
        try:
            return self.spark.read.parquet(path).drop("created_at")
        except AnalysisException as error:
            raise FileNotFoundError(path) from error

    def write(self, df: DataFrame, dataset: str, table: str, split: str | None = None) -> None:
        df.withColumn("created_at", F.current_timestamp()).write.mode("overwrite").parquet(self.path(dataset, table, split))

    def splits(self, dataset: str) -> list[str]:
        """The splits of a dataset that have documents."""
        self.read(dataset, "parsed")
        found = []
        for split in io.SOURCES[dataset].splits:
            try:
                self.read(dataset, "parsed", split)
            except FileNotFoundError:
                continue
            found.append(split)
        return found

    def count(self, good: DataFrame, bad: DataFrame | None, dataset: str, table: str) -> None:
        """The manifest of a table: records and failures by split."""
        now = datetime.now(timezone.utc).isoformat()
        io.write_text(self.spark, io.manifest(dataset, io.split_counts(good, bad), now), self.path(dataset, f"{table}_manifest"))


def in_code_order(df: DataFrame) -> DataFrame:
    """df with ordinal, the place of its code among all codes of a letter and two digits."""
    return df.withColumn("ordinal", (F.ascii("code_3char") * 100 + F.substring("code_3char", 2, 2).cast("int")).cast("long"))


def normalize(docs: DataFrame) -> DataFrame:
    """docs(doc_id, raw_text, ...) with normalized_text, retrieval_text and sentences."""
    out = docs.withColumn("normalized_text", T.document_text(F.col("raw_text")))
    return out.withColumn("retrieval_text", T.retrieval_text(F.col("normalized_text"))).withColumn("sentences", T.sentences(F.col("normalized_text")))


def mentions_of(docs: DataFrame) -> DataFrame:
    """Mentions of raw texts with normalized_text and ordinal; starts are unique in a document, so they are its order."""
    found = spans.extract_mentions(docs)
    return found.withColumn("normalized_text", T.mention_text(F.col("text"))).withColumn("ordinal", F.col("char_start").cast("long"))


def retrieval_predictions(docs: DataFrame, codes: DataFrame, predicted: int = 5, scores: int = 100, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """doc_id, model_name, predicted_codes, ranked of each model, tfidf and bm25; documents without hits have no row."""
    docs = io.spread(docs)
    text = docs.select("doc_id", T.query_text(F.col("retrieval_text"), F.col("normalized_text")).alias("q"))
    out = None
    for name, tokens in (("tfidf", T.word_tokens), ("bm25", T.space_tokens)):
        c = retrieval.term_counts(codes, "code_3char", tokens(F.col("search_text")))
        top = retrieval.search(text, "doc_id", tokens(F.col("q")), c, "code_3char", name, scores, k1=k1, b=b)
        rows = rule_based.predictions(top.select("doc_id", F.col("code_3char").alias("code"), "score"), predicted, scores).withColumn("model_name", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def rule_predictions(docs: DataFrame, mentions: DataFrame, codes: DataFrame, aliases: DataFrame, rules: DataFrame, predicted: int = 5) -> DataFrame:
    """doc_id, model_name, predicted_codes, ranked of the rule-based model; codes and aliases with ordinal."""
    text = io.spread(docs).select("doc_id", T.query_text(F.col("retrieval_text"), F.col("normalized_text")).alias("text"))
    scores = rule_based.rule_based(text, mentions, lexicon.title_index(codes), lexicon.alias_index(aliases), rules)
    return rule_based.predictions(scores, predicted).withColumn("model_name", F.lit("rule_based"))


# Stages, in order; each takes a run and the name of a dataset.
STAGES: dict[str, Callable[[Run, str], None]] = {}


def stage(f: Callable[[Run, str], None]) -> Callable[[Run, str], None]:
    STAGES[f.__name__.removesuffix("_stage")] = f
    return f


def by_split(f: Callable[[Run, str, str], None]) -> Callable[[Run, str], None]:
    """A stage that does each split that has documents."""

    def each(run: Run, dataset: str) -> None:
        for split in run.splits(dataset):
            f(run, dataset, split)

    each.__name__, each.__doc__ = f.__name__, f.__doc__
    return stage(each)


def _book(run: Run, table: str) -> DataFrame:
    """A table of the code book; aliases and rules from a file if one is given, none if it isn't there."""
    given = {"aliases": run.aliases, "rules": run.rules}.get(table)
    df = io.read_optional(run.spark, given, {"aliases": "alias", "rules": "rule"}[table]).drop("created_at") if given else run.read(BOOK, table)
    return df if table in ("pages", "rules") else in_code_order(df)


@stage
def pdf_stage(run: Run, dataset: str = BOOK) -> None:
    """pages from the files in run.pdf, or from what is fetched from that address."""
    if not run.pdf:
        raise FileNotFoundError("no file of the code book is given")
    path = run.pdf
    if path.startswith(("http://", "https://")):
        with tempfile.TemporaryDirectory() as folder:
            content = Path(io.fetch(path, f"{folder}/book")).read_bytes()
        found = io.pages_of(run.spark.createDataFrame([(path, bytearray(content))], "path string, content binary"), run.extract)
    else:
        found = io.pages_from_binary(run.spark, path, run.extract)
    run.write(found, BOOK, "pages")
    ontology.check_pages(run.read(BOOK, "pages"))


@stage
def book_stage(run: Run, dataset: str = BOOK) -> None:
    """codes, aliases and rules from pages; aliases as CSV and the rules' template besides."""
    if run.pdf:
        pdf_stage(run, dataset)
    pages = _book(run, "pages").select("page_no", "raw_text")
    ontology.check_pages(pages)
    codes = ontology.ontology(pages)
    ontology.check_ontology(codes)
    run.write(codes, BOOK, "codes")
    codes = _book(run, "codes")
    run.write(ontology.alias_dictionary(codes, pages), BOOK, "aliases")
    io.write_csv(run.read(BOOK, "aliases").orderBy("code_3char", "alias_norm"), run.path(BOOK, "aliases_csv"))
    intro = ontology.guidance(pages)
    ontology.check_guidance(intro)
    run.write(ontology.coding_rules(intro, pages, codes), BOOK, "rules")
    io.write_text(run.spark, io.rule_template(run.read(BOOK, "rules")), run.path(BOOK, "rules_template"))


@stage
def ingest_stage(run: Run, dataset: str) -> None:
    """snapshots from the dataset's files."""
    good, bad = io.ingest_checked(run.spark, dataset, f"{run.source.rstrip('/')}/{dataset}")
    run.write(good, dataset, "snapshots")
    run.count(run.read(dataset, "snapshots").withColumnRenamed("source_split", "split"), bad.withColumnRenamed("source_split", "split"), dataset, "snapshots")


@stage
def parse_stage(run: Run, dataset: str) -> None:
    """parsed documents by split, and parse_errors if there are any."""
    good, bad = io.parse_dataset(run.read(dataset, "snapshots"), dataset)
    good.write.mode("overwrite").partitionBy("split").parquet(run.path(dataset, "parsed"))
    io.write_errors(bad, run.path(dataset, "parse_errors"))
    run.count(good, bad, dataset, "parsed")


@by_split
def normalize_stage(run: Run, dataset: str, split: str) -> None:
    """documents, text_sentences with offsets and raw_mentions."""
    run.write(normalize(io.spread(run.read(dataset, "parsed", split))), dataset, "documents", split)
    docs = run.read(dataset, "documents", split)
    run.write(spans.segment(docs.select("doc_id", F.col("normalized_text").alias("text"))), dataset, "text_sentences", split)
    run.write(mentions_of(docs), dataset, "raw_mentions", split)


@by_split
def abbrev_stage(run: Run, dataset: str, split: str) -> None:
    """mentions, with abbreviations expanded."""
    seed = io.read_seed(run.spark, run.seed) if run.seed else default_seed(run.spark)
    docs = run.read(dataset, "documents", split).select("doc_id", "raw_text")
    run.write(spans.resolve_abbreviations(run.read(dataset, "raw_mentions", split), docs, seed), dataset, "mentions", split)


@by_split
def candidates_stage(run: Run, dataset: str, split: str) -> None:
    """candidates: the best links of each document to codes."""
    docs, mentions = run.read(dataset, "documents", split), run.read(dataset, "mentions", split)
    run.write(candidates.generate(docs, mentions, _book(run, "codes"), _book(run, "aliases"), run.candidates), dataset, "candidates", split)


@by_split
def labels_stage(run: Run, dataset: str, split: str) -> None:
    """weak_labels of candidates by rules."""
    links, mentions = run.read(dataset, "candidates", split), run.read(dataset, "mentions", split)
    run.write(weak_labels.weak_labels(links, mentions, _book(run, "rules"), run.labels), dataset, "weak_labels", split)


@stage
def audit_stage(run: Run, dataset: str) -> None:
    """chapter_counts of weak_labels, and unknown_codes that the code book lacks if there are any."""
    if run.splits(dataset):
        labels = run.read(dataset, "weak_labels")
        run.write(weak_labels.chapter_counts(labels, _book(run, "codes")), dataset, "chapter_counts")
        io.write_errors(weak_labels.unknown_codes(labels, _book(run, "codes")), run.path(dataset, "unknown_codes"))


def _predict(run: Run, rows: DataFrame, dataset: str, table: str, split: str) -> None:
    run.write(rows.withColumn("scores", F.map_from_entries("ranked")).withColumn("label_granularity", F.lit(GRANULARITY)).drop("ranked"), dataset, table, split)


@by_split
def rules_stage(run: Run, dataset: str, split: str) -> None:
    """rule_predictions of the rule-based model."""
    docs, mentions = run.read(dataset, "documents", split), run.read(dataset, "mentions", split)
    _predict(run, rule_predictions(docs, mentions, _book(run, "codes"), _book(run, "aliases"), _book(run, "rules"), run.predicted), dataset, "rule_predictions", split)


@by_split
def retrieval_stage(run: Run, dataset: str, split: str) -> None:
    """retrieval_predictions of TF-IDF and BM25."""
    docs = run.read(dataset, "documents", split)
    _predict(run, retrieval_predictions(docs, _book(run, "codes"), run.predicted, run.scores, run.k1, run.b), dataset, "retrieval_predictions", split)


@by_split
def metrics_stage(run: Run, dataset: str, split: str) -> None:
    """metrics: JSON of each model's metrics on the targets of the split, if targets are given."""
    if not run.targets:
        return
    targets = io.read_required(run.spark, run.targets, "silver").filter(F.col("split") == split).select("doc_id", "silver_labels")
    for table in ("rule_predictions", "retrieval_predictions"):
        rows = run.read(dataset, table, split)
        for model in sorted(r[0] for r in rows.select("model_name").distinct().collect()):
            found = metrics.evaluate(rows.filter(F.col("model_name") == model), targets, GRANULARITY)
            io.write_text(run.spark, json.dumps(found, indent=2), run.path(dataset, f"metrics/{model}", split))
