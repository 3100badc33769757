"""Encoders, alignment, the label head, batched metrics, sources of pages and tables, against plain Python."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from codaria.operators import encoder as E
from codaria.operators import metrics, ontology, retrieval, vectors, weak_labels
from codaria.plans import stages
from codaria.sources import io

DOCS = [("d1", "Sốt  cao", "x", "y"), ("d2", "", "", "ho khan kéo dài")]


def test_encoding_and_alignment(spark):
    docs = spark.createDataFrame(DOCS, "doc_id string, normalized_text string, retrieval_text string, raw_text string")
    coder = E.HashEncoder(4)
    tokens = E.encode_documents(docs, coder)
    got = sorted((r["doc_id"], r["pos"], r["char_start"], r["char_end"]) for r in tokens.collect())
    assert got[:4] == [("d1", 0, None, None), ("d1", 1, 0, 3), ("d1", 2, 5, 8), ("d1", 3, None, None)] and len(got) == 10
    texts = docs.select("doc_id", F.coalesce(F.nullif("normalized_text", F.lit("")), "raw_text").alias("text"))
    assert {(r["doc_id"], r["pos"], r["text"]) for r in E.align(texts, coder, encoded=tokens).collect()} >= {("d1", 1, "Sốt"), ("d1", 2, "cao"), ("d2", 4, "dài"), ("d1", 0, None)}
    assert E.encode_documents(docs, coder, 3).count() == 6
    with pytest.raises(ValueError, match="differ"):
        E.align(texts, coder, 3, tokens)
    with pytest.raises(ValueError):
        E.encode_documents(docs.limit(0), coder)
    with pytest.raises(Exception, match="no text"):
        E.encode_documents(docs.withColumn("raw_text", F.lit("")), coder).collect()
    codes = spark.createDataFrame([("A00", "Bệnh tả", "Cholera", "A00 | Bệnh tả"), ("B50", "Sốt rét", "", "B50 | x")], "code_3char string, title_vi string, title_en string, search_text string")
    rows = E.encode_labels(codes, coder).collect()
    text = E.label_prompts(codes).filter("label = 'A00'").first()["text"]
    want = np.mean([t[1] for t in coder.encode([text], None)[0]], axis=0)
    assert np.allclose([r["value"] for r in sorted((r for r in rows if r["label"] == "A00"), key=lambda r: r["dim"])], want)
    for bad in (codes.limit(0), codes.unionByName(codes), codes.select(F.lit(" ").alias("code_3char"), F.lit("").alias("title_vi"), F.lit("").alias("title_en"), F.lit("").alias("search_text")).limit(1)):
        with pytest.raises(ValueError):
            E.label_prompts(bad)


@pytest.mark.parametrize("block", [1, 4096])
def test_head_equals_arrays(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "LABELS", block)
    rng = np.random.default_rng(1)
    x, q, w, b = rng.normal(size=(2, 10, 6)) * 5, rng.normal(size=(3, 4)), rng.normal(size=(3, 6)), rng.normal(size=3)
    m = rng.normal(size=(4, 6))
    mask = np.ones((2, 10), bool)
    mask[1, 7:] = False
    names = ["A00", "B20", "C34"]
    tokens = spark.createDataFrame([(f"d{i}", s, x[i, s].tolist(), bool(mask[i, s])) for i in range(2) for s in range(10)], "doc_id string, pos int, vector array<double>, mask boolean").repartition(5)
    queries = spark.createDataFrame([(names[i], d, float(q[i, d])) for i in range(3) for d in range(4)], "label string, dim int, value double")
    matrix = spark.createDataFrame([(d, o, float(m[d, o])) for d in range(4) for o in range(6)], "dim int, out int, w double")
    weights = spark.createDataFrame([(names[i], d, float(w[i, d]), float(b[i])) for i in range(3) for d in range(6)], "label string, dim int, w double, bias double")
    score = np.where(mask[:, None, :], np.einsum("lh,bsh->bls", q @ m, x), -np.inf)
    a = np.exp(score - score.max(axis=2, keepdims=True))
    a /= a.sum(axis=2, keepdims=True)
    want = np.einsum("bls,bsh,lh->bl", a, x, w) + b
    got = {(r["doc_id"], r["label"]): r["logit"] for r in vectors.head(tokens, queries, weights, 6, matrix).collect()}
    assert len(got) == 6 and all(got[f"d{i}", n] == pytest.approx(want[i, j]) for i in range(2) for j, n in enumerate(names))
    for bad in ((tokens, queries.filter("label = 'A00'"), weights, 6, matrix), (tokens, queries, weights, 6, None), (tokens, queries, weights, 5, matrix), (tokens.withColumn("mask", F.lit(False)), queries, weights, 6, matrix)):
        with pytest.raises(ValueError):
            vectors.head(*bad)


def test_evaluator_over_batches(spark):
    rng = np.random.default_rng(2)
    score, target = rng.random((8, 3)).round(2), rng.integers(0, 2, (8, 3))
    target[0], target[1] = 0, 1
    cells = spark.createDataFrame([(i, f"l{j}", float(score[i, j]), int(target[i, j])) for i in range(8) for j in range(3)], "doc_id int, label string, score double, target int")
    whole, parts = (metrics.Evaluator(metrics.MetricConfig("chapter", 3)) for _ in range(2))
    whole.update(cells)
    parts.update(cells.filter("doc_id < 3"))
    parts.update(cells.filter("doc_id >= 3"))
    got = whole.compute()
    assert got.keys() == parts.compute().keys() and all(v == pytest.approx(parts.compute()[k]) for k, v in got.items())
    p = score > 0.5
    tp, fp, fn = (p & (target == 1)).sum(0), (p & (target == 0)).sum(0), (~p & (target == 1)).sum(0)
    assert got["chapter/micro_f1"] == pytest.approx(2 * tp.sum() / (2 * tp.sum() + fp.sum() + fn.sum()))
    assert got["chapter/macro_f1"] == pytest.approx(np.mean(2 * tp / (2 * tp + fp + fn)))
    auc = [np.mean([(a > b) + 0.5 * (a == b) for a in score[target[:, j] == 1, j] for b in score[target[:, j] == 0, j]]) for j in range(3)]
    assert got["chapter/macro_auroc"] == pytest.approx(np.mean(auc))
    parts.reset()
    parts.update(cells.filter("doc_id = 0"))
    assert math.isnan(parts.compute()["chapter/macro_auroc"])
    for bad in (cells.withColumn("score", F.lit(1.5)), cells.withColumn("target", F.lit(2)), cells.withColumn("target", F.lit(1.0)), cells.withColumn("score", F.lit(1)), cells.filter("label != 'l1'")):
        with pytest.raises(ValueError):
            whole.update(bad)
    for bad in ((0, 0.5), (1, 0.0), (1, 1.0)):
        with pytest.raises(ValueError):
            metrics.MetricConfig("x", *bad)


def test_evaluation_of_predictions(spark):
    predictions = spark.createDataFrame([("a", {"A00": 1.0, "B50": 0.4}), ("b", {"B50": 0.9})], "doc_id string, scores map<string,double>")
    targets = spark.createDataFrame([("a", ["A00"]), ("c", ["C34"])], "doc_id string, silver_labels array<string>")
    got = metrics.evaluate(predictions, targets)
    assert got["code_3char/micro_precision"] == 0.5 and got["code_3char/micro_recall"] == 1 and got["code_3char/macro_f1"] == pytest.approx(1 / 3)
    assert math.isnan(got["code_3char/macro_auroc"])
    assert metrics.evaluate(predictions.filter("doc_id = 'b'"), targets.limit(0)) == {}


def test_metrics_and_book_from_files(spark, tmp_path):
    from tests.test_stages import PAGES

    known = dict(PAGES)
    (tmp_path / "book.txt").write_text("\f".join(known.get(i, "x") for i in range(1, 22)))
    rows = [{"doc_id": "vihealthqa:test:7", "label_granularity": "code_3char", "silver_labels": ["A00", "J00"], "split": "test"}]
    (tmp_path / "targets.jsonl").write_text("\n".join(map(json.dumps, rows)))
    folder = tmp_path / "source" / "vihealthqa"
    folder.mkdir(parents=True)
    for split in ("train", "val", "test"):
        (folder / f"{split}.csv").write_text('id,question,answer,link\n7,"Bệnh tả, là gì?","Dòng một\nDòng ""hai""",u\n8,,x,u\n,hỏi,đáp,u\n' if split == "test" else "id,question,answer,link\n")
    from codaria.__main__ import main

    root = str(tmp_path / "run")
    main(["all", "--root", root, "--source", str(tmp_path / "source"), "--dataset", "vihealthqa", "--pdf", str(tmp_path / "book.txt"), "--targets", str(tmp_path / "targets.jsonl"), "--k1", "1.2", "--b", "0.5"])
    docs = spark.read.parquet(f"{root}/vihealthqa/documents").collect()
    assert [(r["doc_id"], r["raw_text"]) for r in docs] == [("vihealthqa:test:7", 'Bệnh tả, là gì?\nDòng một\nDòng "hai"')]
    manifest = "\n".join(r[0] for r in spark.read.text(f"{root}/vihealthqa/snapshots_manifest").collect())
    assert json.loads(manifest)["failed_count_by_split"]["test"] == 1 and json.loads(manifest)["record_count_by_split"]["test"] == 2
    for model in ("rule_based", "bm25", "tfidf"):
        found = json.loads("\n".join(r[0] for r in spark.read.text(f"{root}/vihealthqa/metrics/{model}/split=test").collect()))
        assert found["code_3char/micro_recall"] == 0.5
    assert spark.read.csv(f"{root}/icd10/aliases_csv", header=True).count() == spark.read.parquet(f"{root}/icd10/aliases").count()
    assert len(json.loads(spark.read.text(f"{root}/icd10/rules_template").first()[0])) == spark.read.parquet(f"{root}/icd10/rules").count()
    none = stages.Run(spark, root, rules=f"{tmp_path}/none.jsonl")
    assert stages._book(none, "rules").count() == 0
    with pytest.raises(FileNotFoundError):
        io.fetch("ftp://x", str(tmp_path / "y"))
    with pytest.raises(Exception, match="no pages"):
        io.pages_of(spark.createDataFrame([("p", bytearray(b" "))], "path string, content binary"), io.form_feed_pages).collect()


def test_seed_and_numbers_by_file(spark, tmp_path):
    (tmp_path / "seed.json").write_text('{"ha": "huyết áp", "BN": "bệnh nhân"}')
    assert {tuple(r) for r in io.read_seed(spark, f"{tmp_path}/seed.json").collect()} == {("HA", "huyết áp"), ("BN", "bệnh nhân")}
    assert io.read_seed(spark, f"{tmp_path}/none.json").count() == 0
    (tmp_path / "lines").mkdir()
    for n in "ab":
        (tmp_path / "lines" / f"{n}.txt").write_text("".join(f"{n}{i}\n" for i in range(500)))
    rows = [tuple(r) for r in io.read_lines(spark, f"{tmp_path}/lines").collect()]
    assert sorted(rows) == sorted((i + 1, f"{n}{i}") for n in "ab" for i in range(500))
    spark.range(3000, numPartitions=5).write.option("maxRecordsPerFile", 211).parquet(f"{tmp_path}/p")
    got = io.numbered(spark.read.parquet(f"{tmp_path}/p")).collect()
    assert all(r["id"] == r["row_index"] for r in got) and len(got) == 3000


def test_search_ranks_rows_that_share_an_id(spark, monkeypatch):
    from codaria.functions import text as T

    q = spark.createDataFrame([(1, "a b"), (1, "c"), (2, "a a c")], "q_id long, q string")
    c = retrieval.term_counts(spark.createDataFrame([(j, t) for j, t in enumerate(("a b", "c a", "b b c", "d"))], "item long, s string"), "item", T.space_tokens(F.col("s")))
    for method in ("bm25", "tfidf"):
        found = []
        for limit in (2_000_000, 2):
            monkeypatch.setattr(retrieval, "POSTINGS", limit)
            rows = retrieval.search(q, "q_id", T.space_tokens(F.col("q")), c, "item", method, 3)
            found.append((rows.columns, sorted((r["q_id"], r["item"], r["raw"], round(r["score"], 9), r["rank"]) for r in rows.collect())))
        assert found[0] == found[1] and [r[4] for r in found[0][1] if r[0] == 1].count(1) == 2


def test_places_beyond_a_thousand(spark):
    codes = spark.createDataFrame([("A00", "x", "", 0), ("A01", "y", "", 1)], "code_3char string, title_vi string, title_en string, ordinal long")
    many = " ".join(f"(p{i})" for i in range(1200))
    pages = spark.createDataFrame([(20, f"A00 {many}\nIncludes: (p1100) z")], "page_no int, raw_text string")
    got = {r["alias_norm"]: r["source_line"] for r in ontology.alias_dictionary(codes, pages).collect()}
    assert got["p1100"].startswith("A00") and len(got) == 1203
    links = spark.createDataFrame([("d", f"d:m:{s}:x", "A00", "exact", 1.0, s, s + 1) for s in (10, 2)], "doc_id string, mention_id string, code_3char string, method string, score double, char_start int, char_end int")
    from codaria.operators import candidates

    assert candidates.rank_and_cut(links).first()["char_start"] == 2
    labels = spark.createDataFrame([("A00",), ("A01",), ("A00",)], "code_3char string")
    assert {tuple(r) for r in weak_labels.chapter_counts(labels, codes.withColumn("chapter_id", F.when(F.col("ordinal") == 0, "Ch-1"))).collect()} == {("Ch-1", 2), ("unknown", 1)}
