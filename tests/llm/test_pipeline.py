"""Stages on rows that share or lack ids, and on columns with the stages' own names."""

import corpus_pipeline
from tests.llm.test_operators import edited, prose

SCHEMA = "doc_id long, text string, source string, size string, text_key int, mix_key int, mark string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", n, n, "m") for n, (i, t, s) in enumerate(rows)], SCHEMA)


def test_each_text_is_judged_by_itself(spark, tmp_path):
    a, b, c = prose(1, 100), prose(2, 100), prose(3, 100)
    rows = [(1, a, "s"), (1, b, "s"), (1, a, "s"), (2, edited(a, 5, 1), "s"), (None, edited(b, 6, 1), "s"), (None, c, None), (None, c, None), (7, None, "s"), (7, None, "s"), (8, " ", "s")]
    docs = docs_of(spark, rows)
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    kept = sorted(((r["doc_id"], r["text"], r["text_key"]) for r in got.collect()), key=str)
    assert kept == sorted([(1, a, 0), (1, b, 1), (None, c, 5), (7, None, 7), (7, None, 8), (8, " ", 9)], key=str)
    spark.createDataFrame([(0, " ".join(c.split()[20:60])), (1, "answer is forty two"), (None, a)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    more = docs_of(spark, [*rows, (9, prose(9, 30) + ", the Answer is forty-two! " + prose(10, 30), "s"), (9, "the answer is forty", "s")])
    left = corpus_pipeline.decontamination(spark, more, str(tmp_path))
    assert left.columns == docs.columns
    assert sorted(r["text_key"] for r in left.collect()) == [0, 1, 2, 3, 4, 7, 8, 9, 10, 11]  # forty-two is one word without its hyphen
    gone = corpus_pipeline.decontamination(spark, docs_of(spark, [(9, "so the Answer, is forty two then", "s"), (9, "answer is two", "s")]), str(tmp_path))
    assert [r["text"] for r in gone.collect()] == ["answer is two"]


def test_mix_keeps_columns_and_budgets(spark):
    rows = [(i, prose(i, 20 + i % 7), "ab"[i % 3 == 0]) for i in range(40)] + [(None, prose(99, 30), None)] * 3
    docs = docs_of(spark, rows)
    got = corpus_pipeline.mixing(spark, docs, "")
    assert got.columns == ["doc_id", "text", "source", "text_key", "mix_key", "mark", "size", "target", "taken"]
    by = {}
    for r in got.collect():
        assert r["size"] == len(r["text"].split()) and 0 < r["taken"] <= 2 * r["size"]
        by.setdefault(r["source"], [r["target"], 0])[1] += r["taken"]
    assert len(by) == 3 and all(taken == int(target) for target, taken in by.values())
    assert corpus_pipeline.mixing(spark, docs.limit(0), "").count() == 0
    assert corpus_pipeline.secrets(spark, docs, "").columns == docs.columns
