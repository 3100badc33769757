import pytest

from codaria.__main__ import main
from codaria.plans import stages

PAGES = [
    (14, "Mã 3 kí tự."), (15, "Bệnh chính. Và"), (16, "dấu hiệu đặc trưng, tử vong"),
    (20, "Chương I\nA00\nBệnh tả\nA01\nThương hàn\nBao gồm: sốt cao\nLoại trừ: sốt rét\nA00\nCholera\nA01\nTyphoid fever"), (21, "R05\nHo\nI10\nTăng huyết áp\nR05\nCough\nI10\nHypertension"),
]


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    root, source = str(tmp_path_factory.mktemp("run")), str(tmp_path_factory.mktemp("source"))
    known = dict(PAGES)
    pages = [(i, known.get(i, "x")) for i in range(1, 22)]
    spark.createDataFrame(pages, "page_no int, raw_text string").write.parquet(f"{root}/icd10/pages")
    for split, rows in {"train": [("Bệnh nhân bị ho. Có THA từ lâu.", "Bệnh tả nặng"), ("", "x")], "dev": [("đau bụng", "")], "test": []}.items():
        spark.createDataFrame(rows, "transcript string, summary string").coalesce(1).write.parquet(f"{source}/vietmed-sum/{split}.parquet")
    main(["all", "--root", root, "--source", source, "--dataset", "vietmed-sum"])
    return root


def test_run_from_files_to_predictions(spark, root):
    read = lambda t: spark.read.parquet(f"{root}/vietmed-sum/{t}")
    docs = {(r["split"], r["doc_id"]): r["normalized_text"] for r in read("documents").collect()}
    assert set(docs) == {("train", "vietmed-sum:0"), ("dev", "vietmed-sum:0")} and docs["dev", "vietmed-sum:0"].strip() == "đau bụng"
    assert '"failed_count_by_split"' in "\n".join(r[0] for r in spark.read.text(f"{root}/vietmed-sum/parsed_manifest").collect())
    assert spark.read.json(f"{root}/vietmed-sum/parse_errors").count() == 1
    mentions = {r["text"]: r["normalized_text"] for r in read("mentions").collect()}
    assert mentions["THA"] == "tăng huyết áp"
    links = {(r["code_3char"], r["method"]) for r in read("candidates").collect()}
    assert {"A00", "R05"} <= {c for c, _ in links}
    ranks = {(r["split"], r["doc_id"], r["rank"]) for r in read("candidates").collect()}
    assert len(ranks) == read("candidates").count()
    assert {"R05"} <= {c for r in read("rule_predictions").collect() for c in r["predicted_codes"]}
    found = {r["model_name"]: r for r in read("retrieval_predictions").filter("split = 'train'").collect()}
    assert set(found) == {"tfidf", "bm25"} and "A00" in found["bm25"]["predicted_codes"] and max(found["bm25"]["scores"].values()) == 1
    assert "created_at" in read("weak_labels").columns and spark.read.parquet(f"{root}/icd10/rules").filter("scope = 'global'").count() == 4


def test_arguments_and_missing_tables(spark, tmp_path):
    with pytest.raises(SystemExit):
        main(["ingest", "--root", str(tmp_path)])
    with pytest.raises(FileNotFoundError):
        stages.STAGES["parse"](stages.Run(spark, str(tmp_path)), "vietmed-sum")


def test_row_stages_run_on_streams(spark, tmp_path):
    spark.createDataFrame([("d", "Sốt  cao .THA")], "doc_id string, raw_text string").write.parquet(f"{tmp_path}/in")
    docs = spark.readStream.schema("doc_id string, raw_text string").parquet(f"{tmp_path}/in")
    for name, df in {"docs": stages.normalize(docs), "mentions": stages.mentions_of(docs)}.items():
        df.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/ck-{name}").format("parquet").start(f"{tmp_path}/{name}").awaitTermination(60)
    want = stages.mentions_of(spark.read.parquet(f"{tmp_path}/in")).collect()
    assert sorted(spark.read.parquet(f"{tmp_path}/mentions").collect()) == sorted(want) and want
    assert spark.read.parquet(f"{tmp_path}/docs").first()["normalized_text"] == stages.normalize(spark.read.parquet(f"{tmp_path}/in")).first()["normalized_text"]
