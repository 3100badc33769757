"""Hand-computed values, and the SQL of every query at the smallest scale."""

import duckdb
import pytest
from pyspark.sql import functions as F

from codaria.functions import text as T
from codaria.operators import candidates, lexicon, metrics, ontology, retrieval, rule_based, spans, weak_labels
from codaria.plans import book_queries, queries  # noqa: F401
from codaria.sources import io

# The five-code book that the expected scores below are computed for.
CODES = [("A00", "Bệnh tả", "Cholera"), ("B50", "Sốt rét", "Malaria"), ("J00", "Viêm họng", "Pharyngitis"), ("K35", "Viêm ruột thừa", "Appendicitis"), ("E11", "Tiểu đường", "Diabetes")]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name, tmp_path):
    folder = "/root/testdata/sf0.001"
    queries.QUERIES[name](spark, folder).write.parquet(f"{tmp_path}/out")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    c.execute(f"CREATE TABLE o AS {queries.SQL[name]}")
    c.execute(f"CREATE TABLE g AS SELECT * FROM '{tmp_path}/out/*.parquet'")
    names = ", ".join(r[0] for r in c.execute("DESCRIBE o").fetchall())
    for a, b in (("o", "g"), ("g", "o")):
        assert c.execute(f"SELECT count(*) FROM (SELECT {names} FROM {a} EXCEPT ALL SELECT {names} FROM {b})").fetchall() == [(0,)]


def _codes(spark):
    rows = [(i, c, v, e, f"{c} | {v} | {e}", []) for i, (c, v, e) in enumerate(CODES)]
    return spark.createDataFrame(rows, "ordinal long, code_3char string, title_vi string, title_en string, search_text string, aliases array<string>")


def test_text(spark):
    got = lambda c: spark.range(1).select(c).first()[0]
    assert got(T.document_text(F.lit("U.S.A a...b BS.Nam 3.5"))) == "U. S. A a. .. b BS. Nam 3.5"
    assert got(T.document_text(F.lit("ﬁ\r\nx  ,y​"))) == "fi\nx, y"
    assert got(T.retrieval_text(F.lit("Viêm, HỌNG!"))) == "viêm họng"
    assert got(T.alias_key(F.lit(" A\tB.:; "))) == "a b"
    assert got(T.chapter_id(F.lit("xiv"))) == "Ch-14" and got(T.chapter_id(F.lit(""))) is None
    assert got(T.nos_form(F.lit("x NOSE nos"))) == "NOS"
    assert got(T.search_text(F.lit("A"), F.lit("b"), F.lit(""), F.array(F.lit("c")))) == "A | b | c"


def test_spans(spark):
    assert spans.trim_span("viêm gan B") == "viêm gan"
    raw = "Bệnh nhân bị viêm gan và HIV KHI"
    assert all(raw[s:e] == t for _, t, s, e in spans.mention_spans(raw))
    assert ("abbreviation", "HIV", 25, 28) in spans.mention_spans(raw)
    docs = spark.createDataFrame([("d", "tăng huyết áp (THA). THA (tăng huyết áp)\nABC (một hai) ABC (ba bốn)")], "doc_id string, raw_text string")
    assert [(r["abbr"], r["full"]) for r in spans.definitions(docs).collect()] == [("THA", "tăng huyết áp")]
    m = spark.createDataFrame([("d", "THA", "THA", "abbreviation"), ("d", "XYZ", "xyz", "abbreviation"), ("e", "HIV", "HIV", "abbreviation")], "doc_id string, text string, normalized_text string, mention_type string")
    seed = spark.createDataFrame([("hiv", "virus"), ("THA", "no")], "abbr string, expansion string")
    assert {(r["doc_id"], r["text"], r["normalized_text"]) for r in spans.resolve_abbreviations(m, docs, seed).collect()} == {("d", "THA", "tăng huyết áp"), ("d", "XYZ", "xyz"), ("e", "HIV", "virus")}
    s = spans.segment(docs.withColumnRenamed("raw_text", "text")).collect()
    assert all(docs.first()["raw_text"][r["char_start"] : r["char_end"]] == r["text"] for r in s)


def test_retrieval(spark):
    q = spark.createDataFrame([("g1", "bệnh tả là một bệnh truyền nhiễm"), ("g2", "viêm họng và viêm ruột thừa")], "doc_id string, q string")
    for score, tokens, want in ((retrieval.bm25, T.space_tokens, {("g1", "A00"): 3.551663, ("g2", "K35"): 3.436993, ("g2", "J00"): 2.679179}), (retrieval.tfidf, T.word_tokens, {("g1", "A00"): 0.670820, ("g2", "K35"): 0.646770, ("g2", "J00"): 0.508905})):
        a = retrieval.term_counts(q, "doc_id", tokens(F.col("q")))
        b = retrieval.term_counts(_codes(spark), "code_3char", tokens(F.col("search_text")))
        got = {(r["doc_id"], r["code_3char"]): r["raw"] for r in retrieval.top_k(score(a, b, "doc_id", "code_3char"), "doc_id", "code_3char", 5).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


@pytest.mark.parametrize("cells", [1, 1 << 21])
def test_search_by_index_equals_search_by_join(spark, monkeypatch, cells):
    words = "a b c d e f g h".split()
    q = spark.createDataFrame([(i, " ".join(words[(i * k) % 8] for k in range(i % 6))) for i in range(30)] + [(99, None), (98, "zzz zzz")], "q_id long, q string")
    c = retrieval.term_counts(spark.createDataFrame([(j, " ".join(words[(j * k + 1) % 7] for k in range(1, j))) for j in range(2, 12)], "item long, s string"), "item", T.space_tokens(F.col("s")))
    monkeypatch.setattr(retrieval, "CELLS", cells)
    for method in ("bm25", "tfidf"):
        found = []
        for limit in (2_000_000, 3):
            monkeypatch.setattr(retrieval, "POSTINGS", limit)
            rows = retrieval.search(q, "q_id", T.space_tokens(F.col("q")), c, "item", method, 4).collect()
            found.append(sorted((r["q_id"], r["rank"], r["item"], round(r["raw"], 8), round(r["score"], 8)) for r in rows))
        assert found[0] == found[1] and len(found[0]) > 40
        assert retrieval.search(q.limit(0), "q_id", T.space_tokens(F.col("q")), c, "item", method, 4).count() == 0
        assert retrieval.search(q, "q_id", T.space_tokens(F.col("q")), c.limit(0), "item", method, 4).count() == 0


@pytest.mark.parametrize("limit", [1, 100])
def test_contained_keys(spark, monkeypatch, limit):
    texts = [(1, "sốt rét ác tính"), (2, "rét"), (2, "sốt"), (3, None), (4, ""), (5, "tt" * 5000 + "sốt rét")]
    keys = ["sốt", "rét", "t", "sốt rét", "", "ính", None, "rét"]
    monkeypatch.setattr(lexicon, "KEY_ROWS", limit)
    got = lexicon.contained_keys(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(k,) for k in keys], "key string"))
    want = sorted((i, k, len(t)) for i, t in texts for k in {x for x in keys if x is not None} if t is not None and k in t)
    assert sorted((r["doc_id"], r["key"], r["total"]) for r in got.collect()) == want


def test_candidates_and_fuzzy(spark):
    def textbook(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    import random

    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choices("abcd", k=rng.randint(0, 12))) for _ in range(2))
        assert lexicon.lcs_length(a, b) == textbook(a, b)
    assert abs(lexicon.token_sort_ratio("bệnh tả", "Bệnh tả") - 85.714286) < 1e-6
    assert abs(lexicon.token_sort_ratio("thừa viêm", "Viêm thừa") - 44.444444) < 1e-6
    m = spark.createDataFrame([("m1", "d", "Bệnh tả", "Bệnh tả", 0, 7)], "mention_id string, doc_id string, text string, normalized_text string, char_start int, char_end int")
    docs = spark.createDataFrame([("d", "", "bệnh tả là một bệnh truyền nhiễm")], "doc_id string, retrieval_text string, normalized_text string")
    none = spark.createDataFrame([], "code_3char string, alias_norm string, ordinal long")
    got = [(r["code_3char"], r["method"], r["mention_id"]) for r in candidates.generate(docs, m, _codes(spark), none).filter("score = 1").collect()]
    assert ("A00", "bm25", None) in got and len([g for g in got if g[0] == "A00"]) == 1


def test_weak_labels(spark):
    links = spark.createDataFrame([("d", "m", "A00", "normalized", 0.68, 0, 1), ("d", "m", "B50", "fuzzy", 0.55, 0, 1)], "doc_id string, mention_id string, code_3char string, method string, score double, char_start int, char_end int")
    mentions = spark.createDataFrame([("m", "t", "n")], "mention_id string, text string, normalized_text string")
    rules = spark.createDataFrame([("r1", "A00", "exclude_note"), ("r2", "B50", "include_note")], "rule_id string, code_3char string, topic string")
    got = weak_labels.weak_labels(links, mentions, rules).collect()
    assert [(r["code_3char"], r["confidence"], r["rank"], r["support_rule_ids"]) for r in got] == [("B50", 0.54, 1, ["r2"])]
    twice = rules.union(spark.createDataFrame([("r3", "B50", "include_note")], rules.schema))
    assert {r["code_3char"]: round(r["adjustment"], 6) for r in weak_labels.adjust(weak_labels.method_scores(links), twice).collect()} == {"A00": -0.25, "B50": 0.2}


def test_rule_based(spark):
    m = spark.createDataFrame([("a", "c", "mention:exact_alias", 0.95, 0), ("a", "c", "mention:exact_title", 1.0, 1), ("a", "x", "mention:exact_title", 1.0, 0), ("a", "x", "mention:exact_alias", 0.95, 1)], "doc_id string, code string, source string, weight double, arrival long")
    lex = spark.createDataFrame([], "doc_id string, code string, score double")
    got = {r["code"]: r["score"] for r in rule_based.evidence_scores(m, lex).collect()}
    assert got["c"] == 1.0 and abs(got["x"] - 1 / 1.05) < 1e-9
    p = rule_based.predictions(rule_based.evidence_scores(m, lex), 1).first()
    assert p["predicted_codes"] == ["c"] and [r["code"] for r in p["ranked"]] == ["c", "x"]


def test_metrics(spark):
    scores = spark.createDataFrame([(i, "l", s) for i, s in enumerate((0.9, 0.8, 0.8, 0.3))], "doc_id int, label string, score double")
    targets = spark.createDataFrame([(0, "l"), (2, "l")], "doc_id int, label string")
    docs = scores.select("doc_id")
    assert metrics.auroc(scores, targets, docs).first()["auroc"] == 0.875
    m = metrics.micro_macro(metrics.confusion(scores, targets, docs)).first()
    assert m["micro_precision"] == pytest.approx(2 / 3) and m["micro_recall"] == 1.0
    with pytest.raises(ValueError):
        metrics.check_inputs(scores.withColumn("score", F.lit(2.0)), targets)


PAGE = "Chapter I\nA00\nCholera\nA00.0 Cholera due to Vibrio\nA01\nTyphoid\nfever\nIncludes: paratyphoid (B)\nmore text\nExcludes: x\n–20–\nA00\nBệnh tả\nA00.0 Bệnh tả do Vibrio\nA01\nThương hàn"


def test_ontology(spark):
    pages = spark.createDataFrame([(20, PAGE), (21, "B00\nHerpes\nBao gồm: rộp (kxđk)")], "page_no int, raw_text string")
    codes = ontology.ontology(pages)
    ontology.check_ontology(codes)
    got = {r["code_3char"]: r for r in codes.collect()}
    assert (got["A00"]["title_vi"], got["A00"]["title_en"], got["A00"]["chapter_id"]) == ("Bệnh tả", "Cholera", "Ch-1")
    assert got["A01"]["title_en"].startswith("Typhoid fever") and got["A00"]["aliases"] == ["Cholera due to Vibrio", "Bệnh tả do Vibrio"]
    assert got["B00"]["title_vi"] == "Herpes" and got["B00"]["chapter_id"] == "Ch-1"
    numbered = codes.withColumn("ordinal", F.ascii("code_3char").cast("long"))
    aliases = {(r["code_3char"], r["alias_norm"], r["alias_type"]) for r in ontology.alias_dictionary(numbered, pages).collect()}
    assert {("A01", "paratyphoid (b)", "inclusion"), ("A01", "more text", "inclusion"), ("A01", "b", "parenthetical"), ("B00", "rộp (kxđk)", "inclusion")} <= aliases
    rules = {(r["code_3char"], r["topic"], r["evidence_text"]) for r in ontology.code_rules(pages, codes).collect()}
    assert ("A01", "include_note", "Includes: paratyphoid (B)\nmore text") in rules and ("A01", "exclude_note", "Excludes: x\n–20–") in rules
    intro = spark.createDataFrame([(14, "Mã 3 kí tự."), (15, "Bệnh chính. Và"), (16, "dấu hiệu đặc trưng, tử vong")], "page_no int, raw_text string")
    assert {r["topic"]: r["page_span"] for r in ontology.guidance(intro).collect()}["official_3char_policy"] == "14"
    assert ontology.coding_rules(ontology.guidance(intro), pages, codes).filter("scope = 'global'").count() == 4
    with pytest.raises(ValueError):
        ontology.check_pages(pages)


def test_sources(spark, tmp_path):
    path = f"{tmp_path}/s.jsonl"
    good = '{"doc_id":"d","mention_id":null,"code_3char":"A00","method":"exact","score":"1.0"}'
    with open(path, "w") as f:
        f.write("\n".join([good, "", "nonsense", good.replace("exact", "odd"), good.replace('"d"', "1"), good[:-1] + ',"extra":1}']) + "\n")
    rows, errors = io.quarantine(spark, path, "candidate")
    assert [r["code_3char"] for r in rows.collect()] == ["A00"] and sorted(r["line"] for r in errors.collect()) == [3, 4, 5, 6]
    with pytest.raises(Exception, match="line 3"):
        io.read_strict(spark, path, "candidate").collect()
    assert io.read_optional(spark, f"{tmp_path}/none", "alias").count() == 0
    with pytest.raises(FileNotFoundError):
        io.read_required(spark, f"{tmp_path}/none", "rule")
    for split in ("train", "dev", "test"):
        spark.createDataFrame([("a", ""), ("", "b")], "transcript string, summary string").coalesce(1).write.parquet(f"{tmp_path}/{split}.parquet")
    docs, bad = io.parse_dataset(io.ingest(spark, "vietmed-sum", str(tmp_path)), "vietmed-sum")
    assert docs.count() == 3 == bad.count() and docs.first()["doc_id"] == "vietmed-sum:0"
    assert '"train": 1' in io.manifest("x", io.split_counts(docs, bad), "now")
    with pytest.raises(ValueError):
        io.ingest(spark, "other", "")


def test_without_training_operators():
    import __spark_entry__ as entry

    assert set(queries.SQL) <= set(entry.oracle_sql()) and "bm25_topk" in entry.queries()
