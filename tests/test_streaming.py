"""Streams give what the batch functions give, read nothing twice and forget by their delay."""

import json
from datetime import datetime

from codaria.plans import stages
from codaria.streaming import stages as streams


def _records(path, rows):
    path.mkdir(exist_ok=True)
    for n, group in enumerate(rows):
        (path / f"{len(list(path.iterdir()))}-{n}.jsonl").write_text("\n".join(json.dumps(r) if isinstance(r, dict) else r for r in group))


def _doc(i, text, minute):
    return {"doc_id": f"d{i}", "source": "s", "language": "vi", "raw_text": text, "created_at": f"2024-01-01T{minute // 60:02d}:{minute % 60:02d}:00Z"}


def test_records_once_and_links(spark, tmp_path):
    folder = tmp_path / "in"
    _records(folder, [[_doc(1, "bị sốt rét và HIV", 0), "broken"], [_doc(2, "đau bụng", 5), _doc(1, "bị sốt rét và HIV", 6)]])
    good, bad = streams.read_records(spark, str(folder), "document", 1)
    out = lambda n: (f"{tmp_path}/{n}", f"{tmp_path}/ck-{n}")
    streams.write(bad, *out("bad")).awaitTermination(120)
    assert [r["error"] for r in spark.read.parquet(f"{tmp_path}/bad").collect()] == ["not a JSON object"]
    once = streams.first_seen(good)
    streams.write(once, *out("once")).awaitTermination(120)
    assert sorted(r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/once").collect()) == ["d1", "d2"]
    _records(folder, [[_doc(3, "ho", 7), _doc(2, "đau bụng", 8)]])
    streams.write(streams.first_seen(streams.read_records(spark, str(folder), "document", 1)[0]), *out("once")).awaitTermination(120)
    assert sorted(r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/once").collect()) == ["d1", "d2", "d3"]
    codes = spark.createDataFrame([(0, "B50", "sốt rét", ""), (1, "Z21", "HIV", "")], "ordinal long, code_3char string, title_vi string, title_en string")
    aliases = spark.createDataFrame([("R52", "đau bụng", 0)], "code_3char string, alias_norm string, ordinal long")
    streams.write(streams.links(good, codes, aliases), *out("links")).awaitTermination(120)
    got = {(r["doc_id"], r["code_3char"], r["method"]) for r in spark.read.parquet(f"{tmp_path}/links").collect()}
    batch = spark.read.json(str(folder)).filter("doc_id IS NOT NULL")
    want = {(r["doc_id"], r["code_3char"], r["method"]) for r in streams.links(batch, codes, aliases).collect()}
    assert got == want and ("d2", "R52", "normalized") in got and ("d1", "Z21", "exact") in got


def test_counts_by_window(spark, tmp_path):
    folder = tmp_path / "in"
    _records(folder, [[_doc(1, "HIV", 0), _doc(2, "HIV BHYT", 59), _doc(3, "HIV", 61)]])
    good, _ = streams.read_records(spark, str(folder), "document")
    streams.write(streams.mention_counts(good), f"{tmp_path}/n", f"{tmp_path}/ck", "complete").awaitTermination(120)
    got = {(r["start"], r["mention_type"]): r["n"] for r in spark.read.parquet(f"{tmp_path}/n").collect()}
    assert got == {(datetime(2024, 1, 1, 0), "abbreviation"): 3, (datetime(2024, 1, 1, 1), "abbreviation"): 1}
    assert stages.mentions_of(spark.read.json(str(folder))).count() == 4
