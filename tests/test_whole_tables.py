"""Queries over whole tables: no query or SQL cuts its rows or texts, and partners may be missing."""

from codaria.plans import queries


def test_whole_turns_and_tables(spark):
    folder = "/root/testdata/sf0.001"
    assert max(len(r["evidence_text"]) for r in queries.QUERIES["lookahead_block"](spark, folder).collect()) > 200
    assert queries.rules(spark, folder).count() == 200
    for cut in ("substring(text, 1, 40)", "% 97", "vec_id < ", "p_size <= 24", "nationkey % ", "ordinal % 4"):
        assert not [n for n, sql in queries.SQL.items() if cut in sql]


def test_missing_partners(spark, tmp_path):
    spark.createDataFrame([(1, "c1"), (2, "")], "c_nationkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(2, "s2"), (3, "s3")], "s_nationkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    assert sorted(tuple(r) for r in queries.en_vi_full_outer(spark, str(tmp_path)).collect()) == [(1, "c1", None), (2, "s2", "s2"), (3, "s3", "s3")]
    spark.createDataFrame([(0, "a"), (1, "b")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 7) for i in (0, 1, 2, 15)], "event_id long, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    assert [tuple(r) for r in queries.label_audit(spark, str(tmp_path)).collect()] == [("A02", 1)]
