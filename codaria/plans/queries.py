"""The operators applied to the driver's tables, and the same rows in DuckDB SQL.

Stand-ins: `benchmark` is the code book, `documents` the documents, their
punctuation-free segments the mentions, `events` scored candidate links, `part`
rules and names, `conversations` ordered lines and `embeddings` token vectors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codaria.functions import text as T
from codaria.operators import candidates, lexicon, metrics, ontology, retrieval, rule_based, spans, vectors, weak_labels
from codaria.sources import io

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

S = r"[\x09-\x0D\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_IN = S[1:-1]


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{S}+|{S}+$', '', 'g')"


def sql_retrieval(x: str) -> str:
    return sql_strip(rf"regexp_replace(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_{_IN}]', ' ', 'g'), '{S}+', ' ', 'g')")


def sql_document(x: str) -> str:
    steps = (
        (r"\r\n?", r"\n"),
        (r"[\x{200b}-\x{200f}\x{feff}\x{ad}\x{202a}-\x{202e}]", ""),
        (S.replace(r"\x09-\x0D", r"\x09\x0B-\x0D") + "+", " "),
        (S + r"+([.,;:!?])", r"\1"),
        (r"([.,;:!?])([^" + _IN + r"\p{Nd}])", r"\1 \2"),
    )
    for pattern, to in steps:
        x = f"regexp_replace({x}, '{pattern}', {'chr(10)' if to == chr(92) + 'n' else repr(to).replace(chr(92) * 2, chr(92))}, 'g')"
    return sql_strip(x)


def code_of(number: Column) -> Column:
    return F.concat(F.char(F.lit(65) + F.floor(number / 100)), F.lpad((number % 100).cast("string"), 2, "0"))


SQL_CODE = "chr((65 + {0} // 100)::INT) || lpad(({0} % 100)::VARCHAR, 2, '0')"


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    code = code_of(F.col("item_id"))
    return b.select(
        F.col("item_id").alias("ordinal"), code.alias("code_3char"), F.concat(F.lit("Ch-"), (F.col("item_id") % 5 + 1).cast("string")).alias("chapter_id"),
        T.strip(F.element_at(F.split("text", r"[.,;:!?\n]"), 1)).alias("title_vi"), F.lit("").alias("title_en"), F.array().cast("array<string>").alias("aliases"),
        F.concat_ws(" | ", code, "text").alias("search_text"), "text",
    )


SQL_CODES = f"""codes AS (SELECT item_id AS ordinal, {SQL_CODE.format('item_id')} AS code, 'Ch-' || (item_id % 5 + 1) AS chapter_id,
  {sql_strip("regexp_split_to_array(text, '[.,;:!?\\n]')[1]")} AS title, text FROM benchmark)"""


def document_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.spread(table(spark, sf_dir, "documents")).select("doc_id", T.retrieval_text(F.col("text")).alias("q"))


@query(f"SELECT doc_id, {sql_retrieval('text')} AS retrieval_text FROM documents")
def retrieval_text(spark, sf_dir):
    return document_queries(spark, sf_dir).withColumnRenamed("q", "retrieval_text")


@query(f"SELECT doc_id, {sql_document('text')} AS normalized_text FROM documents")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.document_text(F.col("text")).alias("normalized_text"))


_TERMS = f"""qt AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({{q}}) AS term FROM (SELECT doc_id, {sql_retrieval('text')} AS q FROM documents)) GROUP BY ALL),
ct AS (SELECT code, term, count(*) AS tf FROM (SELECT code, unnest({{c}}) AS term FROM (SELECT code, code || ' | ' || text AS s FROM codes)) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM ct GROUP BY term), n AS (SELECT count(DISTINCT code) AS n FROM ct)"""
_TOP = """, r AS (SELECT doc_id, code, round(raw, 9) AS raw FROM s WHERE round(raw, 9) > 0)
SELECT doc_id, code AS code_3char, row_number() OVER (PARTITION BY doc_id ORDER BY raw DESC, code)::INT AS rank, round(raw / max(raw) OVER (PARTITION BY doc_id), 6) AS score
FROM r QUALIFY rank <= 20"""


def _terms(tokens: Callable[[str], str]) -> str:
    return _TERMS.replace("{q}", tokens("q")).replace("{c}", tokens("s"))


def _space(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '{S}+'), lambda t: t <> '')"


@query(
    f"WITH {SQL_CODES}, {_terms(_space)}, dl AS (SELECT code, sum(tf) AS dl FROM ct GROUP BY code), a AS (SELECT avg(dl) AS avgdl FROM dl),"
    "s AS (SELECT doc_id, ct.code, sum(qt.tf * ln((n - df + 0.5) / (df + 0.5) + 1) * ct.tf * 2.5 / (1.5 * (0.25 + 0.75 * dl / avgdl) * (ct.tf + 1))) AS raw"
    " FROM qt JOIN ct USING (term) JOIN df USING (term) JOIN dl ON dl.code = ct.code, n, a GROUP BY ALL)" + _TOP
)
def bm25_topk(spark, sf_dir):
    c = retrieval.term_counts(codes(spark, sf_dir), "code_3char", T.space_tokens(F.col("search_text")))
    top = retrieval.search(document_queries(spark, sf_dir), "doc_id", T.space_tokens(F.col("q")), c, "code_3char", "bm25", 20)
    return top.select("doc_id", "code_3char", "rank", F.round("score", 6).alias("score"))


def _wide(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]{{2,}}')"


@query(
    f"WITH {SQL_CODES}, {_terms(_wide)}, idf AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM df, n),"
    "wq AS (SELECT doc_id, term, tf * idf AS w FROM qt JOIN idf USING (term)), wd AS (SELECT code, term, tf * idf AS w FROM ct JOIN idf USING (term)),"
    "nq AS (SELECT doc_id, sqrt(sum(w * w)) AS nq FROM wq GROUP BY doc_id), nd AS (SELECT code, sqrt(sum(w * w)) AS nd FROM wd GROUP BY code),"
    "s AS (SELECT doc_id, code, sum((wq.w / nq) * (wd.w / nd)) AS raw FROM wq JOIN nq USING (doc_id) JOIN wd USING (term) JOIN nd USING (code) GROUP BY ALL)" + _TOP
)
def tfidf_topk(spark, sf_dir):
    c = retrieval.term_counts(codes(spark, sf_dir), "code_3char", T.word_tokens(F.col("search_text")))
    top = retrieval.search(document_queries(spark, sf_dir), "doc_id", T.word_tokens(F.col("q")), c, "code_3char", "tfidf", 20)
    return top.select("doc_id", "code_3char", "rank", F.round("score", 6).alias("score"))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of documents between punctuation."""
    parts = io.spread(table(spark, sf_dir, "documents")).select("doc_id", F.posexplode(F.split("text", r"[.,;:!?\n]")).alias("ordinal", "text"))
    return parts.withColumn("normalized_text", T.mention_text(F.col("text"), lambda c: c)).withColumn("mention_id", F.concat_ws(":", "doc_id", "ordinal")).withColumn("char_start", F.col("ordinal")).withColumn("char_end", F.col("ordinal") + 1)


SQL_MENTIONS = f"""m AS (SELECT doc_id, p - 1 AS ordinal, seg[p] AS text, lower({sql_strip("regexp_replace(seg[p], '" + S + "+', ' ', 'g')")}) AS norm, lower({sql_strip('seg[p]')}) AS key
 FROM (SELECT doc_id, regexp_split_to_array(text, '[.,;:!?\\n]') AS seg FROM documents), unnest(range(1, len(seg) + 1)) AS u(p))"""
SQL_TITLES = "titles AS (SELECT lower(title) AS key, arg_max(code, ordinal) AS code, min(ordinal) AS place FROM codes WHERE title <> '' GROUP BY 1)"


@query(f"WITH {SQL_CODES}, {SQL_MENTIONS}, {SQL_TITLES} SELECT doc_id, doc_id || ':' || ordinal AS mention_id, code AS code_3char, 1.0::DOUBLE AS score FROM m JOIN titles USING (key)")
def title_exact_join(spark, sf_dir):
    return lexicon.exact_links(mentions(spark, sf_dir), lexicon.title_index(codes(spark, sf_dir))).select("doc_id", "mention_id", "code_3char", "score")


def _aliases(spark, sf_dir) -> DataFrame:
    parts = codes(spark, sf_dir).select("code_3char", "ordinal", F.posexplode(F.split("text", r"[.,;:!?\n]")).alias("p", "alias"))
    return parts.select("code_3char", T.alias_key(F.col("alias")).alias("alias_norm"), F.struct("ordinal", "p").alias("ordinal"))


SQL_ALIASES = f"""aliases AS (SELECT key, arg_max(code, place) AS code FROM (SELECT code, ordinal::HUGEINT * 1000000000 + p - 1 AS place, lower({sql_strip("regexp_replace(seg[p], '" + S + "+', ' ', 'g')")}) AS key
 FROM (SELECT code, ordinal, regexp_split_to_array(text, '[.,;:!?\\n]') AS seg FROM codes), unnest(range(1, len(seg) + 1)) AS u(p)) WHERE key <> '' GROUP BY key)"""


@query(f"WITH {SQL_CODES}, {SQL_MENTIONS}, {SQL_ALIASES} SELECT doc_id, doc_id || ':' || ordinal AS mention_id, code AS code_3char, 0.85::DOUBLE AS score FROM m JOIN aliases ON m.norm = aliases.key")
def alias_normalized_join(spark, sf_dir):
    return lexicon.normalized_links(mentions(spark, sf_dir), lexicon.alias_index(_aliases(spark, sf_dir))).select("doc_id", "mention_id", "code_3char", "score")


METHODS = ("exact", "normalized", "fuzzy", "tfidf", "bm25")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    own = F.col("event_id") % 5 < 3
    return e.select(
        F.col("user_id").alias("doc_id"), F.when(own, F.concat(F.lit("m"), (F.col("event_id") % 7).cast("string"))).alias("mention_id"), code_of(F.col("event_id") % 11).alias("code_3char"),
        F.element_at(F.array(*[F.lit(m) for m in METHODS]), (F.col("event_id") % 5 + 1).cast("int")).alias("method"), (F.col("event_id") * 37 % 101 / 100.0).cast("double").alias("score"),
        F.when(own, (F.col("event_id") % 7).cast("int")).alias("char_start"), F.when(own, (F.col("event_id") % 7 + 3).cast("int")).alias("char_end"),
    )


SQL_LINKS = f"""links AS (SELECT user_id AS doc_id, CASE WHEN event_id % 5 < 3 THEN 'm' || (event_id % 7) END AS mention_id, {SQL_CODE.format('(event_id % 11)')} AS code_3char,
 ['exact', 'normalized', 'fuzzy', 'tfidf', 'bm25'][(event_id % 5 + 1)::INT] AS method, (event_id * 37 % 101 / 100.0)::DOUBLE AS score,
 CASE WHEN event_id % 5 < 3 THEN event_id % 7 END AS char_start FROM events)"""
SQL_MERGED = "merged AS (SELECT doc_id, mention_id, code_3char, method, max(score) AS score, any_value(char_start) AS char_start FROM links GROUP BY 1, 2, 3, 4)"


def merged_links(spark, sf_dir) -> DataFrame:
    all_links = links(spark, sf_dir)
    return candidates.merge(all_links.filter("mention_id IS NOT NULL"), all_links.filter("mention_id IS NULL"))


@query(f"WITH {SQL_LINKS}, {SQL_MERGED} SELECT doc_id, mention_id, code_3char, method, score FROM merged")
def merge_candidates(spark, sf_dir):
    return merged_links(spark, sf_dir).select("doc_id", "mention_id", "code_3char", "method", "score")


@query(
    f"""WITH {SQL_LINKS}, {SQL_MERGED}, one AS (SELECT * FROM merged QUALIFY row_number() OVER (PARTITION BY doc_id, code_3char ORDER BY score DESC, method, char_start NULLS LAST, mention_id NULLS LAST) = 1)
SELECT doc_id, mention_id, code_3char, method, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, code_3char)::INT AS rank FROM one QUALIFY rank <= 5"""
)
def rank_and_cut(spark, sf_dir):
    return candidates.rank_and_cut(merged_links(spark, sf_dir), 5).select("doc_id", "mention_id", "code_3char", "method", "score", "rank")


_W = "CASE method WHEN 'exact' THEN 1.0 WHEN 'normalized' THEN 0.9 WHEN 'fuzzy' THEN 0.8 WHEN 'tfidf' THEN 0.45 ELSE 0.5 END::DOUBLE * score"
SQL_SCORES = f"""scores AS (SELECT doc_id, code_3char, coalesce(max({_W}) FILTER (mention_id IS NOT NULL AND method IN ('exact', 'normalized', 'fuzzy')), 0.0)::DOUBLE AS mention_score,
 coalesce(max({_W}) FILTER (mention_id IS NULL AND method IN ('tfidf', 'bm25')), 0.0)::DOUBLE AS doc_score, array_to_string(list_sort(list(DISTINCT method)), ',') AS methods FROM merged GROUP BY 1, 2)"""


@query(f"WITH {SQL_LINKS}, {SQL_MERGED}, {SQL_SCORES} SELECT doc_id, code_3char, round(mention_score, 6) AS mention_score, round(doc_score, 6) AS doc_score, methods FROM scores")
def method_scores(spark, sf_dir):
    s = weak_labels.method_scores(merged_links(spark, sf_dir))
    return s.select("doc_id", "code_3char", F.round("mention_score", 6).alias("mention_score"), F.round("doc_score", 6).alias("doc_score"), F.array_join("methods", ",").alias("methods"))


TOPICS = ("include_note", "exclude_note", "use_additional_code", "code_first", "general_note")


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.concat(F.lit("r"), F.col("p_partkey").cast("string")).alias("rule_id"), code_of(F.col("p_partkey") % 23).alias("code_3char"), F.element_at(F.array(*[F.lit(t) for t in TOPICS]), (F.col("p_size") % 5 + 1).cast("int")).alias("topic"))


SQL_RULES = f"""rules AS (SELECT 'r' || p_partkey AS rule_id, {SQL_CODE.format('(p_partkey % 23)')} AS code_3char,
 ['include_note', 'exclude_note', 'use_additional_code', 'code_first', 'general_note'][(p_size % 5 + 1)::INT] AS topic FROM part)"""
SQL_ADJUSTED = """applied AS (SELECT s.doc_id, s.code_3char, r.rule_id, CASE WHEN topic = 'include_note' THEN 0.10 WHEN topic = 'exclude_note' AND mention_score < 0.9 THEN -0.25
 WHEN topic IN ('code_first', 'use_additional_code') AND mention_score = 0 THEN -0.10 END::DOUBLE AS a FROM scores s JOIN rules r USING (code_3char)),
adjusted AS (SELECT s.*, coalesce(x.adjustment, 0.0)::DOUBLE AS adjustment, coalesce(x.ids, '') AS rule_ids FROM scores s LEFT JOIN
 (SELECT doc_id, code_3char, sum(a) AS adjustment, array_to_string(list_sort(list(DISTINCT rule_id)), ',') AS ids FROM applied WHERE a IS NOT NULL GROUP BY 1, 2) x USING (doc_id, code_3char))"""


@query(f"WITH {SQL_LINKS}, {SQL_MERGED}, {SQL_SCORES}, {SQL_RULES}, {SQL_ADJUSTED} SELECT doc_id, code_3char, round(adjustment, 6) AS adjustment, rule_ids FROM adjusted")
def rule_adjustment(spark, sf_dir):
    s = weak_labels.adjust(weak_labels.method_scores(merged_links(spark, sf_dir)), rules(spark, sf_dir), lambda ids: F.array_join(ids, ","))
    return s.select("doc_id", "code_3char", F.round("adjustment", 6).alias("adjustment"), F.col("support_rule_ids").alias("rule_ids"))


def _mention_table(spark, sf_dir) -> DataFrame:
    return spark.range(7).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("mention_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.lit("").alias("normalized_text"))


SQL_EVIDENCE = f"""spans AS (SELECT doc_id, code_3char, mention_id, char_start, round(max({_W}), 6) AS score, array_to_string(list_sort(list(DISTINCT method)), '+') AS methods
 FROM merged WHERE mention_id IS NOT NULL GROUP BY 1, 2, 3, 4),
top AS (SELECT *, row_number() OVER (PARTITION BY doc_id, code_3char ORDER BY score DESC, char_start, mention_id) AS rn FROM spans)"""


@query(f"WITH {SQL_LINKS}, {SQL_MERGED}, {SQL_EVIDENCE} SELECT doc_id, code_3char, mention_id, 'text ' || substring(mention_id, 2) AS text, methods, score, rn::INT AS place FROM top WHERE rn <= 3")
def evidence_spans(spark, sf_dir):
    e = weak_labels.evidence(merged_links(spark, sf_dir), _mention_table(spark, sf_dir)).select("doc_id", "code_3char", F.posexplode("evidence").alias("place", "e"))
    return e.select("doc_id", "code_3char", "e.mention_id", "e.text", F.array_join("e.methods", "+").alias("methods"), "e.score", (F.col("place") + 1).alias("place"))


@query(
    f"""WITH {SQL_LINKS}, {SQL_MERGED}, {SQL_SCORES}, {SQL_RULES}, {SQL_ADJUSTED}, {SQL_EVIDENCE}, best AS (SELECT doc_id, code_3char, max(score) AS best FROM top WHERE rn <= 3 GROUP BY 1, 2),
c AS (SELECT doc_id, code_3char, round(least(1.0, mention_score + 0.35::DOUBLE * doc_score + adjustment), 6) AS confidence, methods, best FROM adjusted JOIN best USING (doc_id, code_3char) WHERE mention_score >= 0.4)
SELECT doc_id, code_3char, confidence, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, best DESC, code_3char)::INT AS rank, methods FROM c WHERE confidence >= 0.5 QUALIFY rank <= 5"""
)
def weak_label_ranks(spark, sf_dir):
    w = weak_labels.weak_labels(merged_links(spark, sf_dir), _mention_table(spark, sf_dir), rules(spark, sf_dir))
    return w.select("doc_id", "code_3char", "confidence", "rank", F.array_join("support_methods", ",").alias("methods"))


SQL_CONTAIN = f"""d AS (SELECT doc_id, {sql_retrieval('text')} AS text FROM documents),
lex AS (SELECT doc_id, code, greatest(least(arg_min(length(key), place) / greatest(arg_min(length(text), place), 1) * 10, 1.0), 0.3)::DOUBLE AS score FROM d JOIN titles ON contains(text, key) GROUP BY 1, 2)"""


@query(f"WITH {SQL_CODES}, {SQL_TITLES}, {SQL_CONTAIN} SELECT doc_id, code, round(score, 6) AS score FROM lex")
def doc_title_containment(spark, sf_dir):
    docs = document_queries(spark, sf_dir).withColumnRenamed("q", "text")
    return lexicon.title_containment(docs, lexicon.title_index(codes(spark, sf_dir))).select("doc_id", "code", F.round("score", 6).alias("score"))


@query(
    f"""WITH {SQL_CODES}, {SQL_MENTIONS}, {SQL_TITLES}, {SQL_ALIASES}, {SQL_CONTAIN}, {SQL_RULES},
ev AS (SELECT doc_id, code, 'a' AS source, 1.0 AS w, ordinal * 3 AS arrival FROM m JOIN titles USING (key)
 UNION ALL SELECT doc_id, code, 'b', 0.95, ordinal * 3 + 1 FROM m JOIN aliases ON norm = aliases.key
 UNION ALL SELECT doc_id, t.code, 'c', 0.85, ordinal * 3 + 2 FROM m JOIN titles t ON norm = t.key LEFT JOIN titles k ON m.key = k.key WHERE norm <> m.key AND k.code IS DISTINCT FROM t.code
 UNION ALL SELECT doc_id, code, 'd', least(score * 0.6, 0.6), 1000000000000 FROM lex),
f AS (SELECT doc_id, code, source, min(arrival) AS arrival, arg_min(w, arrival) AS w FROM ev GROUP BY 1, 2, 3),
g AS (SELECT doc_id, code, w + 0.05 * least(row_number() OVER (PARTITION BY doc_id, code ORDER BY arrival, source) - 1, 4) AS s FROM f),
h AS (SELECT doc_id, code, max(s)::DOUBLE AS s FROM g GROUP BY 1, 2), i AS (SELECT doc_id, code, least(s / max(s) OVER (PARTITION BY doc_id), 1.0) AS score FROM h)
SELECT doc_id, code, round(score, 6) AS score FROM i WHERE code NOT IN (SELECT code_3char FROM rules WHERE topic = 'exclude_note')"""
)
def rule_based_predictions(spark, sf_dir):
    docs = document_queries(spark, sf_dir).withColumnRenamed("q", "text")
    out = rule_based.rule_based(docs, mentions(spark, sf_dir), lexicon.title_index(codes(spark, sf_dir)), lexicon.alias_index(_aliases(spark, sf_dir)), rules(spark, sf_dir))
    return out.select("doc_id", "code", F.round("score", 6).alias("score"))


@query(
    rf"""SELECT doc_id, p - 1 AS pos, s[p] AS sentence FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?]){S}+(\p{{Lu}})', '\1' || chr(1) || '\2', 'g'), chr(1)),
lambda x: {sql_strip('x')}), lambda x: x <> '') AS s FROM documents), unnest(range(1, len(s) + 1)) AS u(p)"""
)
def split_sentences(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))
    return d.select("doc_id", F.col("pos").cast("long").alias("pos"), "sentence")


@query(
    r"""SELECT doc_id, w AS abbr, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS w FROM documents)
WHERE regexp_full_match(w, '[A-Z]{2,6}') AND w NOT IN ('CHO', 'KHI', 'RA') GROUP BY ALL"""
)
def abbr_tokens(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(spans.abbreviation_tokens(F.col("text"))).alias("abbr"))
    return d.groupBy("doc_id", "abbr").agg(F.count("*").alias("n"))


@query("SELECT user_id AS doc_id, event_id % 40 AS start, max(event_id * 13 % 29) AS len FROM events GROUP BY 1, 2")
def mention_dedup(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), (F.col("event_id") % 40).alias("start"), (F.col("event_id") * 13 % 29).alias("len"), F.col("event_id").alias("family"))
    return spans.dedup_spans(e).select("doc_id", "start", "len")


@query(r"SELECT doc_id, p, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\(([^)]+)\)', 1)) AS p FROM documents) GROUP BY ALL")
def parentheticals(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(spans.parentheticals(F.col("text"))).alias("p")).groupBy("doc_id", "p").agg(F.count("*").alias("n"))


@query("SELECT doc_id, p - 1 AS line_no, length(l[p]) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS u(p)")
def line_explode(spark, sf_dir):
    rows = spans.lines(table(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.length("line").cast("long").alias("n"))


def _pages(spark, sf_dir) -> DataFrame:
    """A conversation is a page; each turn a line, every third one a code line of its own."""
    c = table(spark, sf_dir, "conversations")
    head = F.when(F.col("turn") % 3 == 0, F.concat(code_of(F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(60))), F.lit(" "))).when(F.col("turn") % 3 == 1, F.lit("Includes: ")).otherwise(F.lit(""))
    line = F.concat(head, F.regexp_replace("text", r"\s+", " "))
    rows = c.groupBy(F.col("conv_id").alias("page_no")).agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("l"))
    return rows.select("page_no", F.array_join(F.transform("l", lambda x: F.trim(x["line"])), "\n").alias("raw_text"))


SQL_LINES = f"""known AS (SELECT {SQL_CODE.format('item_id')} AS own FROM benchmark),
line AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, x) - 1 AS line_no, x AS line FROM (SELECT conv_id, turn, trim(CASE turn % 3 WHEN 0 THEN {SQL_CODE.format('((conv_id * 7 + turn) % 60)')} || ' ' WHEN 1 THEN 'Includes: ' ELSE '' END
 || regexp_replace(text, '[\\s]+', ' ', 'g'), ' ') AS x FROM conversations)),
own AS (SELECT line.*, CASE WHEN substring(line, 1, 3) IN (SELECT own FROM known) AND regexp_matches(line, '^[A-Z][0-9]{{2}} ') THEN substring(line, 1, 3) END AS own FROM line),
filled AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS code,
 lead(line, 1) OVER w AS n1, lead(line, 2) OVER w AS n2, lead(line, 3) OVER w AS n3 FROM own WINDOW w AS (PARTITION BY conv_id ORDER BY line_no))"""


@query(f"WITH {SQL_LINES} SELECT conv_id AS page_no, line_no::INT AS line_no, code FROM filled WHERE code IS NOT NULL AND line <> ''")
def forward_fill(spark, sf_dir):
    return ontology.coded_lines(_pages(spark, sf_dir), codes(spark, sf_dir)).select("page_no", "line_no", "code")


_STOP = "regexp_matches({0}, '^[A-Z][0-9]{{2}}([^\\p{{L}}\\p{{N}}_]|$)') OR regexp_matches(lower({0}), '^(includes|excludes|use additional code|code first|note)')"


@query(
    f"""WITH {SQL_LINES}, b AS (SELECT conv_id, line_no, code, line || CASE WHEN n1 IS NULL OR {_STOP.format('n1')} THEN '' ELSE CASE WHEN n1 = '' THEN '' ELSE chr(10) || n1 END
 || CASE WHEN n2 IS NULL OR {_STOP.format('n2')} THEN '' ELSE CASE WHEN n2 = '' THEN '' ELSE chr(10) || n2 END || CASE WHEN n3 IS NULL OR n3 = '' OR {_STOP.format('n3')} THEN '' ELSE chr(10) || n3 END END END AS evidence_text
 FROM filled WHERE code IS NOT NULL AND line LIKE 'Includes: %')
SELECT code || ':include_note:' || substring(sha256({sql_strip(f"regexp_replace(evidence_text, '{S}+', ' ', 'g')")}), 1, 8) AS rule_id, conv_id AS page_no, evidence_text FROM b"""
)
def lookahead_block(spark, sf_dir):
    r = ontology.code_rules(_pages(spark, sf_dir), codes(spark, sf_dir)).filter("topic = 'include_note'")
    return r.select("rule_id", F.col("source_page_start").alias("page_no"), "evidence_text")


@query("SELECT lower(p_name) AS key, arg_max(p_brand, p_partkey) AS code, min(p_partkey) AS first_place FROM part GROUP BY 1")
def title_last_wins(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return lexicon.last_wins(p.select(F.lower("p_name").alias("key"), F.col("p_brand").alias("code"), F.col("p_partkey").alias("place")))


@query("SELECT p_brand AS code, lower(p_name) AS norm, arg_min(p_type, p_partkey) AS kind FROM part GROUP BY 1, 2")
def alias_first_wins(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("code"), F.col("p_name").alias("alias"), F.col("p_type").alias("kind"), F.col("p_partkey").alias("seq"))
    return ontology.first_aliases(p).select("code", "norm", "kind")


_TARGET = f"targets AS (SELECT doc_id, code AS label FROM (SELECT doc_id, {sql_retrieval('text')} AS text FROM documents) d JOIN (SELECT code, {sql_retrieval('text')} AS t FROM codes) c ON contains(d.text, c.t))"
_CELLS = f"""WITH {SQL_CODES}, {SQL_TITLES}, {SQL_CONTAIN}, {_TARGET}, docs AS (SELECT DISTINCT doc_id FROM lex), labels_ AS (SELECT code AS label FROM lex UNION SELECT label FROM targets),
cells AS (SELECT labels_.label, docs.doc_id, coalesce(round(lex.score, 6), 0.0) AS score, (t.label IS NOT NULL)::INT AS y FROM labels_ CROSS JOIN docs
 LEFT JOIN lex ON lex.doc_id = docs.doc_id AND lex.code = labels_.label LEFT JOIN targets t ON t.doc_id = docs.doc_id AND t.label = labels_.label)"""


def _predicted(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scores, targets and documents, found by one pass of an automaton of titles and items together and kept."""
    book, docs = codes(spark, sf_dir), document_queries(spark, sf_dir).withColumnRenamed("q", "text")
    titles = lexicon.title_index(book)
    items = book.select(F.col("code_3char").alias("label"), T.retrieval_text(F.col("text")).alias("key"))
    found = lexicon.contained_keys(docs, titles.select("key").union(items.select("key"))).persist()
    scores = lexicon.score_titles(found, titles).select("doc_id", F.col("code").alias("label"), F.round("score", 6).alias("score"))
    return scores, found.join(items, "key").select("doc_id", "label"), scores.select("doc_id").distinct()


_F1 = "CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END"


@query(
    f"""{_CELLS}, c AS (SELECT label, sum((score > 0.5)::INT * y) AS tp, sum((score > 0.5)::INT * (1 - y)) AS fp, sum((score <= 0.5)::INT * y) AS fn FROM cells GROUP BY label),
t AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, avg({_F1}) AS macro FROM c)
SELECT round({_F1}, 6)::DOUBLE AS micro_f1, round(macro, 6)::DOUBLE AS macro_f1, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 6)::DOUBLE AS micro_precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 6)::DOUBLE AS micro_recall FROM t"""
)
def micro_macro_f1(spark, sf_dir):
    out = metrics.micro_macro(metrics.confusion(*_predicted(spark, sf_dir)))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(
    f"""{_CELLS} SELECT p.label, round(avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0.0 END), 6)::DOUBLE AS auroc
FROM cells p JOIN cells n ON p.label = n.label AND p.y = 1 AND n.y = 0 GROUP BY 1"""
)
def label_auroc(spark, sf_dir):
    return metrics.auroc(*_predicted(spark, sf_dir)).filter("NOT isnan(auroc)").select("label", F.round("auroc", 6).alias("auroc"))


@query(
    f"""WITH {SQL_CODES}, {SQL_TITLES}, {SQL_CONTAIN} SELECT doc_id, chapter_id, max(round(score, 6)) AS score FROM lex JOIN codes USING (code) GROUP BY 1, 2"""
)
def chapter_projection(spark, sf_dir):
    scores, _, _ = _predicted(spark, sf_dir)
    return metrics.chapter_projection(scores, codes(spark, sf_dir))


@query(
    """WITH RECURSIVE n AS (SELECT lower(p_name) AS s, min(p_partkey) AS place FROM part GROUP BY 1),
w AS (SELECT s, place, array_to_string(list_sort(string_split(s, ' ')), ' ') AS t FROM n WHERE s <> ''),
p AS (SELECT DISTINCT a.t AS a, b.t AS b FROM w a, w b),
d AS (SELECT a, b, 0 AS i, list_transform(range(length(b)), lambda x: 0) AS row FROM p
 UNION ALL SELECT a, b, i + 1, list_transform(range(1, length(b) + 1), lambda j: list_max(list_slice(list_transform(range(1, length(b) + 1), lambda k: greatest(row[k], CASE WHEN k > 1 THEN row[k - 1] ELSE 0 END + (a[i + 1] = b[k])::INT)), 1, j))) FROM d WHERE i < length(a)),
l AS (SELECT a, b, 200.0::DOUBLE * row[length(b)] / (length(a) + length(b)) AS ratio FROM d WHERE i = length(a)),
r AS (SELECT q.s AS query, c.place, ratio FROM w q JOIN l ON l.a = q.t JOIN w c ON c.t = l.b WHERE ratio >= 75 QUALIFY row_number() OVER (PARTITION BY q.s ORDER BY ratio DESC, c.place) <= 10)
SELECT p_partkey::VARCHAR AS doc_id, 'P' || place AS code_3char, round(ratio / 100, 6) AS score FROM part JOIN r ON lower(p_name) = query"""
)
def fuzzy_topk(spark, sf_dir):
    """Names of parts against names of parts."""
    p = table(spark, sf_dir, "part")
    names = p.select(F.lower("p_name").alias("text"), F.col("p_partkey").cast("string").alias("doc_id"), F.col("p_partkey").cast("string").alias("mention_id"), F.lit(0).alias("char_start"), F.lit(0).alias("char_end"))
    index = p.groupBy(F.lower("p_name").alias("choice")).agg(F.min("p_partkey").alias("place")).select(F.concat(F.lit("P"), F.col("place").cast("string")).alias("code"), "choice", "place")
    return lexicon.fuzzy_links(names, index).select("doc_id", "code_3char", F.round("score", 6).alias("score"))


def _tokens(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("doc_id"), F.col("vec_id").alias("pos"), F.col("embedding").alias("vector"), (F.col("vec_id") % 10 < 8).alias("mask"))


@query("SELECT label AS doc_id, (d - 1)::INT AS dim, round(avg(embedding[d]::DOUBLE), 6) AS value FROM embeddings, unnest(range(1, 65)) AS u(d) WHERE vec_id % 10 < 8 GROUP BY 1, 2")
def masked_mean_pool(spark, sf_dir):
    return vectors.pool(_tokens(spark, sf_dir)).select("doc_id", "dim", F.round("value", 6).alias("value"))


@query(
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_dot_product(q.v, e.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(e.v, e.v)), 6) AS score
FROM e JOIN e q ON q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id) SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM p QUALIFY rank <= 10"""
)
def cosine_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return vectors.cosine_to(e, e.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("q")), 10)


@query(
    """WITH t AS (SELECT label AS doc_id, vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 10 < 8), q AS (SELECT vec_id AS label, embedding::DOUBLE[] AS q FROM embeddings),
s AS (SELECT doc_id, label, v, list_dot_product(q, v) AS s FROM t, q), e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY doc_id, label)) AS e FROM s), a AS (SELECT *, e / sum(e) OVER (PARTITION BY doc_id, label) AS a FROM e)
SELECT doc_id, label, (d - 1)::INT AS dim, round(sum(a * v[d]), 6) AS value FROM a, unnest(range(1, 65)) AS u(d) GROUP BY 1, 2, 3"""
)
def label_attention(spark, sf_dir):
    q = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("label"), F.col("embedding").alias("query"))
    return vectors.label_attention(_tokens(spark, sf_dir), q).select("doc_id", "label", "dim", F.round("value", 6).alias("value"))


@query("SELECT lang AS split, count(*) AS records, count(*) FILTER (n_chars < 100) AS failed FROM documents GROUP BY 1")
def split_manifest(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumnRenamed("lang", "split")
    return io.split_counts(d, d.filter("n_chars < 100"))


@query(
    """SELECT coalesce(a.c_nationkey, b.s_nationkey) AS code, coalesce(nullif(a.n, ''), b.n) AS title, b.n AS title_en FROM (SELECT c_nationkey, min(c_name) AS n FROM customer GROUP BY 1) a
FULL JOIN (SELECT s_nationkey, min(s_name) AS n FROM supplier GROUP BY 1) b ON a.c_nationkey = b.s_nationkey"""
)
def en_vi_full_outer(spark, sf_dir):
    a = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("code")).agg(F.min("c_name").alias("vi"))
    b = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("code")).agg(F.min("s_name").alias("title_en"))
    return ontology.both_titles(a, b).select("code", F.col("title_vi").alias("title"), "title_en")


_TOKENS = "SELECT doc_id, len({0}) AS n, len(list_distinct({0})) AS n_distinct FROM (SELECT doc_id, {1} AS t FROM documents)"


@query(_TOKENS.format("t", "coalesce(" + _space("text") + ", [])"))
def whitespace_tokens(spark, sf_dir):
    return _token_counts(spark, sf_dir, T.space_tokens)


@query(_TOKENS.format("t", "coalesce(" + _wide("text") + ", [])"))
def word_tokens(spark, sf_dir):
    return _token_counts(spark, sf_dir, T.word_tokens)


def _token_counts(spark, sf_dir, tokens) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(tokens(F.col("text")), F.array().cast("array<string>")).alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("n"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@query(f"SELECT doc_id, {sql_strip(rf"regexp_replace(regexp_replace(text, '[\x{{200b}}-\x{{200f}}\x{{feff}}\x{{ad}}\x{{202a}}-\x{{202e}}]', '', 'g'), '{S}+', ' ', 'g')")} AS mention FROM documents")
def normalize_mention(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.mention_text(F.col("text")).alias("mention"))


_COLLAPSED = sql_strip(f"regexp_replace(lower(text), '{S}+', ' ', 'g')")


@query(f"SELECT doc_id, {sql_strip(f"regexp_replace({_COLLAPSED}, '[.,;:]+$', '')")} AS alias_norm, {sql_strip("regexp_replace(lower(text), ' {2,}', ' ', 'g')")} AS ontology_norm FROM documents")
def alias_keys(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.alias_key(text).alias("alias_norm"), T.ontology_alias_key(text).alias("ontology_norm"))


_PAGE = f"regexp_replace({sql_strip("replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))")}, '\\n{{3,}}', chr(10) || chr(10), 'g')"


@query(f"SELECT doc_id, {_PAGE} AS page, regexp_replace({_PAGE}, ' {{2,}}', ' ', 'g') AS guidance FROM documents")
def page_text(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.page_text(text).alias("page"), T.page_text(text, True).alias("guidance"))


@query(f"SELECT doc_id, substring(sha256({sql_strip(f"regexp_replace(text, '{S}+', ' ', 'g')")}), 1, 8) AS hash8, sha256(text) AS sha256 FROM documents")
def text_digests(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.hash8(T.rule_text(text)).alias("hash8"), F.sha2(text, 256).alias("sha256"))


@query(f"SELECT p_partkey, CASE WHEN p_size <= 22 THEN 'Ch-' || p_size END AS chapter_id, CASE WHEN p_partkey % 3 = 0 THEN 'NOS' WHEN p_partkey % 3 = 1 THEN 'KXĐK' END AS nos FROM part")
def chapter_and_nos(spark, sf_dir):
    roman = F.get(F.array(*[F.lit(r) for r in (*T.ROMAN, "XXIII", "IXX")]), F.col("p_size").cast("int") - 1)
    form = F.concat("p_name", F.element_at(F.array(F.lit(" nos, x"), F.lit(" (kxđk)"), F.lit(" nosy")), (F.col("p_partkey") % 3 + 1).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", T.chapter_id(roman).alias("chapter_id"), T.nos_form(form).alias("nos"))


_BRIEF = sql_strip(f"regexp_replace(substring(code || ' | ' || text, 1, 256), '{S}+', ' ', 'g')")


@query(f"WITH {SQL_CODES} SELECT code, code || ' | ' || title || ' | ' || title || '.' AS search_text, concat_ws(chr(10), code, nullif(title, ''), nullif({_BRIEF}, '')) AS prompt FROM codes")
def search_text_and_prompt(spark, sf_dir):
    c = codes(spark, sf_dir)
    made = T.search_text(F.col("code_3char"), F.col("title_vi"), F.col("title_en"), F.array(F.concat("title_vi", F.lit("."))))
    return c.select(F.col("code_3char").alias("code"), made.alias("search_text"), T.label_prompt(F.col("code_3char"), F.col("title_vi"), F.col("title_en"), F.col("search_text")).alias("prompt"))


@query("SELECT user_id AS page_no, max_by('page ' || event_id, event_id) AS raw_text FROM events WHERE user_id IS NOT NULL GROUP BY 1")
def page_last_wins(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return ontology.latest_pages(e.select(F.col("user_id").alias("page_no"), F.concat(F.lit("page "), F.col("event_id").cast("string")).alias("raw_text"), F.col("event_id").alias("ordinal")))


_GUIDE = (("low", ("he", "la "), 5, 40), ("high", ("er",), 30, 90))


@query(
    "WITH t(topic, words, low, high) AS (VALUES "
    + ", ".join(f"('{t}', {list(k)!r}, {a}, {b})" for t, k, a, b in _GUIDE)
    + """) SELECT 'book:intro_guidance:' || topic AS doc_id, min(doc_id)::BIGINT AS page_start, max(doc_id)::BIGINT AS page_end, min(doc_id) || '-' || max(doc_id) AS page_span, string_agg(text, chr(10) || chr(10) ORDER BY doc_id) AS raw_text
FROM documents JOIN t ON doc_id >= low AND doc_id < high AND len(list_filter(words, lambda w: contains(lower(text), w))) > 0 GROUP BY topic"""
)
def topic_guidance(spark, sf_dir):
    pages = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_no"), F.col("text").alias("raw_text"))
    return ontology.guidance(pages, "book", _GUIDE).select("doc_id", "page_start", "page_end", "page_span", "raw_text")


@query(
    r"""WITH m AS (SELECT doc_id, w AS abbr, row_number() OVER (PARTITION BY doc_id ORDER BY w) AS n FROM (SELECT DISTINCT c_custkey AS doc_id, unnest(['AB' || chr((65 + c_custkey % 7)::INT), 'ZZ', 'QQ']) AS w FROM customer)),
d AS (SELECT c_custkey AS doc_id, 'AB' || chr((65 + c_custkey % 7)::INT) AS abbr, 'full form' AS f FROM customer WHERE c_custkey % 2 = 0)
SELECT m.doc_id, abbr, coalesce(d.f, CASE WHEN abbr IN ('ABA', 'ZZ') THEN 'from seed' END, lower(abbr)) AS normalized_text FROM m LEFT JOIN d USING (doc_id, abbr)"""
)
def abbreviation_resolution(spark, sf_dir):
    own = F.concat(F.lit("AB"), F.char(F.lit(65) + F.col("c_custkey") % 7))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), own.alias("own"))
    docs = c.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("full form ("), "own", F.lit(")"))).otherwise("none").alias("raw_text"))
    m = c.select("doc_id", F.explode(F.array(F.col("own"), F.lit("ZZ"), F.lit("QQ"))).alias("text")).withColumn("normalized_text", F.lower("text")).withColumn("mention_type", F.lit("abbreviation"))
    seed = spark.createDataFrame([("aba", "from seed"), ("ZZ", "from seed")], "abbr string, expansion string")
    return spans.resolve_abbreviations(m, docs, seed).select("doc_id", F.col("text").alias("abbr"), "normalized_text")


_SCORES = f"""{SQL_LINKS}, {SQL_MERGED}, s AS (SELECT doc_id, code_3char AS label, max(score)::DOUBLE AS score FROM merged GROUP BY 1, 2),
t AS (SELECT DISTINCT user_id AS doc_id, {SQL_CODE.format('(event_id % 13)')} AS label FROM events)"""


def _link_scores(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    s = merged_links(spark, sf_dir).groupBy("doc_id", F.col("code_3char").alias("label")).agg(F.max("score").alias("score"))
    return s, table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), code_of(F.col("event_id") % 13).alias("label")).distinct()


@query(
    f"""WITH {_SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) AS rn FROM s)
SELECT doc_id, string_agg(label, ',' ORDER BY rn) FILTER (rn <= 5) AS predicted, count(*) AS n_scores, max(score) AS best FROM r GROUP BY doc_id"""
)
def prediction_lists(spark, sf_dir):
    s, _ = _link_scores(spark, sf_dir)
    p = rule_based.predictions(s.withColumnRenamed("label", "code"), 5)
    return p.select("doc_id", F.array_join("predicted_codes", ",").alias("predicted"), F.size("ranked").cast("long").alias("n_scores"), F.element_at("ranked", 1)["score"].alias("best"))


@query(
    f"""WITH {_SCORES}, r AS (SELECT doc_id, label FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) <= 3),
h AS (SELECT doc_id, count(*) AS hits FROM r JOIN t USING (doc_id, label) GROUP BY 1), n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1)
SELECT round(avg(coalesce(hits, 0) / 3), 6) AS precision_at_k, round(avg(coalesce(hits, 0) / n), 6) AS recall_at_k FROM n LEFT JOIN h USING (doc_id)"""
)
def precision_recall_at_k(spark, sf_dir):
    out = metrics.at_k(*_link_scores(spark, sf_dir), 3)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(
    f"""WITH {_SCORES}, d AS (SELECT DISTINCT doc_id FROM s), l AS (SELECT label FROM s UNION SELECT label FROM t),
c AS (SELECT l.label, coalesce(s.score, 0.0) AS score, (t.label IS NOT NULL)::INT AS y FROM l CROSS JOIN d LEFT JOIN s ON s.doc_id = d.doc_id AND s.label = l.label LEFT JOIN t ON t.doc_id = d.doc_id AND t.label = l.label),
a AS (SELECT p.label, avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0.0 END) AS auroc FROM c p JOIN c n ON p.label = n.label AND p.y = 1 AND n.y = 0 GROUP BY 1)
SELECT CASE WHEN count(*) = (SELECT count(*) FROM l) THEN round(avg(auroc), 6) ELSE 'NaN'::DOUBLE END AS macro_auroc FROM a"""
)
def macro_auroc(spark, sf_dir):
    s, t = _link_scores(spark, sf_dir)
    out = metrics.macro_auroc(metrics.auroc(s, t, s.select("doc_id").distinct()))
    return out.select(F.round("macro_auroc", 6).alias("macro_auroc"))


@query(f"WITH {_SCORES}, {SQL_CODES} SELECT label AS code_3char, count(*) AS n FROM t WHERE label NOT IN (SELECT code FROM codes) GROUP BY 1")
def label_audit(spark, sf_dir):
    """Labels whose code is not in the book, by code."""
    _, t = _link_scores(spark, sf_dir)
    return weak_labels.unknown_codes(t.withColumnRenamed("label", "code_3char"), codes(spark, sf_dir))


@query("SELECT label AS doc_id, (d - 1)::INT AS dim, round(arg_min(embedding[d]::DOUBLE, vec_id), 6) AS value FROM embeddings, unnest(range(1, 65)) AS u(d) GROUP BY 1, 2")
def cls_pool(spark, sf_dir):
    t = _tokens(spark, sf_dir)
    first = t.groupBy("doc_id").agg(F.min("pos").alias("least"))
    t = t.join(first, "doc_id").withColumn("pos", F.col("pos") - F.col("least")).drop("least")
    return vectors.pool(t, "cls").select("doc_id", "dim", F.round("value", 6).alias("value"))


@query(f"WITH x AS ({SQL['bm25_topk']}), y AS ({SQL['tfidf_topk']}) SELECT doc_id, code_3char, 'bm25' AS method, score FROM x UNION ALL SELECT doc_id, code_3char, 'tfidf', score FROM y")
def document_candidates(spark, sf_dir):
    docs = document_queries(spark, sf_dir).select("doc_id", F.col("q").alias("retrieval_text"), F.col("q").alias("normalized_text"))
    out = candidates.document_links(docs, codes(spark, sf_dir))
    return out.select("doc_id", "code_3char", "method", F.round("score", 6).alias("score"))


@query(f"WITH {_SCORES}, {SQL_CODES} SELECT coalesce(chapter_id, 'unknown') AS chapter_id, count(*) AS n FROM t JOIN codes ON codes.code = t.label GROUP BY 1")
def chapter_counts(spark, sf_dir):
    _, t = _link_scores(spark, sf_dir)
    return weak_labels.chapter_counts(t.withColumnRenamed("label", "code_3char"), codes(spark, sf_dir))
