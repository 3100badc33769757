"""Builders of the code book, sentences, mentions, parsed documents and evaluation over the driver's tables, with SQL.

The book's pages are made of `part`: twelve rows a page, each with a code, titles,
four-character children and notes, first in English, then for some in Vietnamese.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codaria.functions import text as T
from codaria.operators import encoder, metrics, ontology, rule_based, spans, vectors
from codaria.plans.queries import _IN, SQL_LINKS, SQL_MERGED, S, _link_scores, query, sql_strip, table
from codaria.sources import io

_K = "CAST(p_partkey AS BIGINT)"
_CODE = f"chr(CAST(65 + floor({_K} / 100) % 26 AS INT)) || lpad(CAST({_K} % 100 AS STRING), 2, '0')"
_PAGE = f"CAST(20 + floor({_K} / 12) AS INT)"
#: Lines of a row: place in its page, when there is one, and the line. Understood by Spark and DuckDB alike.
_ROW_LINES = (
    (f"{_K} % 12 * 10", f"{_K} % 7 = 0", f"'Chapter ' || CASE {_K} % 5 WHEN 0 THEN 'I' WHEN 1 THEN 'iv' WHEN 2 THEN 'IX' WHEN 3 THEN 'XXII' ELSE 'Xy' END"),
    (f"{_K} % 12 * 10 + 1", "1 = 1", "code"),
    (f"{_K} % 12 * 10 + 2", "1 = 1", "' ' || p_name || '  (' || p_brand || ')'"),
    (f"{_K} % 12 * 10 + 3", f"{_K} % 3 = 0", "p_type"),
    (f"{_K} % 12 * 10 + 4", f"{_K} % 4 = 0", f"'–' || {_K} || '–'"),
    (f"{_K} % 12 * 10 + 5", f"{_K} % 2 = 0", "code || '.1 ' || p_type"),
    (f"{_K} % 12 * 10 + 6", f"{_K} % 6 = 0", "code || '.2† ' || p_name || '  (' || p_brand || ')'"),
    (f"{_K} % 12 * 10 + 7", f"{_K} % 4 = 1", f"'Includes: ' || p_brand || ' (x' || {_K} || ')'"),
    (f"{_K} % 12 * 10 + 8", f"{_K} % 4 = 1", "p_type || ' nos (B12)'"),
    (f"{_K} % 12 * 10 + 9", f"{_K} % 8 = 1", "'Excludes: ' || p_type"),
    (f"1000 + {_K} % 12 * 10", f"{_PAGE} % 3 <> 0 AND {_K} % 3 <> 1", "code"),
    (f"1001 + {_K} % 12 * 10", f"{_PAGE} % 3 <> 0 AND {_K} % 3 <> 1", "'Bệnh ' || p_name"),
    (f"1002 + {_K} % 12 * 10", f"{_PAGE} % 3 <> 0 AND {_K} % 6 = 2", "code || '.1 Viêm ' || p_type"),
    (f"1003 + {_K} % 12 * 10", f"{_PAGE} % 3 <> 0 AND {_K} % 5 = 2", "'Loại trừ: ' || p_brand"),
    (f"2000 + {_K} % 12 * 10", f"{_PAGE} % 3 = 0 AND {_K} % 12 = 0", "'Đầu phần'"),
    (f"2001 + {_K} % 12 * 10", f"{_PAGE} % 3 = 0 AND {_K} % 12 = 0", f"'Z' || lpad(CAST({_PAGE} % 100 AS STRING), 2, '0')"),
    (f"2002 + {_K} % 12 * 10", f"{_PAGE} % 3 = 0 AND {_K} % 12 = 0", "'Mới ' || p_name"),
)
_LINES = "SELECT page_no, ord, line FROM (" + " UNION ALL ".join(
    f"SELECT {_PAGE} AS page_no, CAST({at} AS BIGINT) AS ord, {line} AS line FROM (SELECT *, {_CODE} AS code FROM {{part}}) AS p WHERE {when}" for at, when, line in _ROW_LINES
) + ") AS l"


def book_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_no, raw_text."""
    lines = spark.sql(_LINES, part=table(spark, sf_dir, "part"))
    rows = lines.groupBy("page_no").agg(F.array_sort(F.collect_list(F.struct("ord", "line"))).alias("l"))
    return rows.select("page_no", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("raw_text"))


_W = r"\p{L}\p{N}_"
_HEAD = rf"^(?i:chapter|chương)[{_IN}]+(X{{0,3}}IX|X{{0,3}}IV|X{{0,3}}V?I{{0,3}}|x{{0,3}}ix|x{{0,3}}iv|x{{0,3}}v?i{{0,3}})([^{_W}]|$)"
_ROMAN = "[" + ", ".join(f"'{r}'" for r in T.ROMAN) + "]"
_SUB = rf"^([A-Z]\p{{Nd}}{{2}})\.\p{{Nd}}+[†*]?[{_IN}]+([^\n]+)$"
_TIDY = "regexp_replace({0}, ' {{2,}}', ' ', 'g')"
SQL_SECTIONS = f"""raw AS ({_LINES.format(part='part')}),
l AS (SELECT page_no, (row_number() OVER (PARTITION BY page_no ORDER BY ord) - 1)::INT AS line_no, {sql_strip('line')} AS line FROM raw),
c AS (SELECT *, CASE WHEN regexp_full_match(line, '[A-Z]\\p{{Nd}}{{2}}') THEN line END AS code, regexp_extract(line, '{_SUB}', 1) AS sub, regexp_extract(line, '{_SUB}', 2) AS sub_title FROM l),
a AS (SELECT *, CASE WHEN code IS NOT NULL THEN row_number() OVER (PARTITION BY page_no, code ORDER BY line_no) END AS again FROM c),
p AS (SELECT page_no, coalesce(min(line_no) FILTER (again = 2), CASE WHEN count(code) > 0 THEN min(line_no) FILTER (code IS NULL AND line <> '' AND regexp_matches(line, '[{T.VIETNAMESE}]') AND sub = '') END) AS split FROM a GROUP BY page_no),
s AS (SELECT a.*, CASE WHEN line_no >= split THEN 'vi' ELSE 'en' END AS section FROM a JOIN p USING (page_no))"""
SQL_TITLES_OF = f"""k AS (SELECT *, CASE WHEN sub <> '' THEN 'sub' WHEN code IS NOT NULL THEN 'code' WHEN regexp_matches(lower(line), '^({'|'.join(T.STRUCTURE)})') OR regexp_matches(line, '\\([A-Z]\\p{{Nd}}{{2}}-[A-Z]\\p{{Nd}}{{2}}\\)')
 OR regexp_matches(line, '{_HEAD}') THEN 'stop' ELSE 'text' END AS kind FROM s WHERE line <> '' AND NOT (left(line, 1) = '–' AND right(line, 1) = '–')),
g AS (SELECT *, sum((kind <> 'text')::INT) OVER (PARTITION BY page_no, section ORDER BY line_no) AS part FROM k),
t AS (SELECT page_no, section, max(code) FILTER (kind = 'code') AS code, min(line_no) AS line_no, coalesce(string_agg(line, ' ' ORDER BY line_no) FILTER (kind = 'text'), '') AS title FROM g GROUP BY page_no, section, part),
titles AS (SELECT section, code, {sql_strip(_TIDY.format('title'))} AS title, page_no FROM t WHERE code IS NOT NULL AND title <> '' QUALIFY row_number() OVER (PARTITION BY section, code ORDER BY page_no, line_no) = 1),
subs AS (SELECT section, sub AS code, {sql_strip('sub_title')} AS title, page_no, line_no FROM k WHERE kind = 'sub')"""
SQL_BOOK = f"""h AS (SELECT page_no, arg_max(list_position({_ROMAN}, upper(regexp_extract(line, '{_HEAD}', 1))), line_no) FILTER (list_position({_ROMAN}, upper(regexp_extract(line, '{_HEAD}', 1))) > 0) AS chapter FROM l GROUP BY page_no),
chapters AS (SELECT page_no, 'Ch-' || last_value(chapter IGNORE NULLS) OVER (ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS chapter_id FROM h),
en AS (SELECT code, title AS title_en FROM titles WHERE section = 'en'), vi AS (SELECT code, title AS vi FROM titles WHERE section = 'vi'),
both_ AS (SELECT code, coalesce(nullif(vi, ''), title_en) AS title_vi, title_en FROM en FULL JOIN vi USING (code)),
place AS (SELECT code, chapter_id FROM (SELECT code, min(page_no) AS page_no FROM titles GROUP BY code) JOIN chapters USING (page_no)),
n AS (SELECT subs.*, {sql_strip(_TIDY.format('lower(title)'))} AS norm, {sql_strip(_TIDY.format("lower(CASE WHEN section = 'en' THEN coalesce(title_en, '') ELSE title_vi END)"))} AS own FROM subs JOIN both_ USING (code)),
o AS (SELECT * FROM n WHERE norm <> '' AND norm <> own QUALIFY row_number() OVER (PARTITION BY code, norm ORDER BY section = 'vi', page_no, line_no) = 1),
al AS (SELECT code, list(title ORDER BY section = 'vi', page_no, line_no) AS aliases FROM o GROUP BY code),
book AS (SELECT code AS code_3char, chapter_id, title_vi, title_en, coalesce(aliases, []) AS aliases,
 concat_ws(' | ', code, title_vi, nullif(title_en, ''), nullif(array_to_string(aliases, ' | '), '')) AS search_text FROM both_ LEFT JOIN place USING (code) LEFT JOIN al USING (code))"""


@query(f"WITH {SQL_SECTIONS} SELECT page_no, line_no, line, section FROM s")
def book_sections(spark, sf_dir):
    return ontology.sections(ontology.page_lines(book_pages(spark, sf_dir))).select("page_no", "line_no", "line", "section")


@query(f"WITH {SQL_SECTIONS}, {SQL_TITLES_OF} SELECT section, code, title, page_no, -1 AS line_no, 'title' AS kind FROM titles UNION ALL SELECT section, code, title, page_no, line_no, 'subtitle' FROM subs")
def book_titles(spark, sf_dir):
    titles, subs = ontology.titles_and_subtitles(ontology.sections(ontology.page_lines(book_pages(spark, sf_dir))))
    return titles.withColumn("line_no", F.lit(-1)).withColumn("kind", F.lit("title")).unionByName(subs.withColumn("kind", F.lit("subtitle")))


@query(f"WITH {SQL_SECTIONS}, {SQL_TITLES_OF}, {SQL_BOOK} SELECT page_no, chapter_id FROM chapters")
def book_chapters(spark, sf_dir):
    return ontology.chapters(ontology.page_lines(book_pages(spark, sf_dir)))


@query(f"WITH {SQL_SECTIONS}, {SQL_TITLES_OF}, {SQL_BOOK} SELECT code_3char, chapter_id, title_vi, title_en, array_to_string(aliases, '; ') AS aliases, search_text FROM book")
def book_codes(spark, sf_dir):
    return ontology.ontology(book_pages(spark, sf_dir)).withColumn("aliases", F.array_join("aliases", "; "))


def _book(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    pages = book_pages(spark, sf_dir)
    return pages, ontology.ontology(pages).withColumn("ordinal", F.ascii("code_3char").cast("long") * 100 + F.substring("code_3char", 2, 2).cast("long"))


_STARTS = rf"regexp_matches(@, '^[A-Z]\p{{Nd}}{{2}}([^{_W}]|$)')"


def _until(stop: str, join: str, end: str) -> str:
    """SQL of what stands behind a line, as far as stop does not hold, each made by join; @ is the line, # the rest and ? the condition."""
    out = end
    for n in ("n3", "n2", "n1"):
        out = join.replace("#", out).replace("?", f"{n} IS NULL OR {stop}").replace("@", n)
    return out


SQL_CODED = rf"""own AS (SELECT l.*, CASE WHEN b.code_3char IS NOT NULL THEN b.code_3char END AS own_code FROM l LEFT JOIN book b ON b.code_3char = regexp_extract(line, '^([A-Z]\p{{Nd}}{{2}})([^{_W}]|$)', 1)),
filled AS (SELECT *, last_value(own_code IGNORE NULLS) OVER (PARTITION BY page_no ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS code,
 lead(line, 1) OVER w AS n1, lead(line, 2) OVER w AS n2, lead(line, 3) OVER w AS n3 FROM own WINDOW w AS (PARTITION BY page_no ORDER BY line_no)),
coded AS (SELECT * FROM filled WHERE line <> '' AND code IS NOT NULL)"""
_ALIAS_STOP = _STARTS + " OR regexp_matches(lower(@), '^(loại trừ|excludes|sử dụng mã|use additional code):')"
_INNER = r"regexp_extract_all({0}, '\(([^)]+)\)', 1)"
_BEHIND = _until(_ALIAS_STOP, "CASE WHEN ? THEN []::VARCHAR[] ELSE list_concat([@], #) END", "[]::VARCHAR[]")
_COLLAPSE = sql_strip(f"regexp_replace(lower(alias), '{S}+', ' ', 'g')")
SQL_ALIAS_ROWS = f"""b2 AS (SELECT *, (ascii(code_3char) * 100 + substring(code_3char, 2, 2)::INT) AS ordinal FROM book),
ar AS (SELECT code_3char AS code, title_vi AS alias, 'title_vi' AS alias_type, 'vi' AS language, NULL::INT AS page_no, NULL AS line, [0, ordinal, 0, 0, 0] AS seq FROM b2
 UNION ALL SELECT code_3char, title_en, 'title_en', 'en', NULL, NULL, [0, ordinal, 1, 0, 0] FROM b2
 UNION ALL SELECT code_3char, {_INNER.format("coalesce(title_vi, '')")}[i], 'parenthetical', 'vi', NULL, NULL, [0, ordinal, 2, i - 1, 0] FROM b2, unnest(range(1, len({_INNER.format("coalesce(title_vi, '')")}) + 1)) AS u(i)
 UNION ALL SELECT code_3char, {_INNER.format("coalesce(title_en, '')")}[i], 'parenthetical', 'en', NULL, NULL, [0, ordinal, 3, i - 1, 0] FROM b2, unnest(range(1, len({_INNER.format("coalesce(title_en, '')")}) + 1)) AS u(i)
 UNION ALL SELECT code, {sql_strip(f"regexp_replace(line, '^(?i:bao gồm|includes):?[{_IN}]*', '')")}, 'inclusion', 'mixed', page_no, line, [1, page_no, line_no, 0, 0] FROM coded WHERE regexp_matches(line, '^(?i:bao gồm|includes)')
 UNION ALL SELECT code, nx[i], 'inclusion', 'mixed', page_no, nx[i], [1, page_no, line_no, 0, i] FROM (SELECT *, {_BEHIND} AS nx FROM coded WHERE regexp_matches(line, '^(?i:bao gồm|includes)')), unnest(range(1, len(nx) + 1)) AS u(i)
 UNION ALL SELECT code, line, 'nos_form', 'mixed', page_no, line, [1, page_no, line_no, 1, 0] FROM coded WHERE list_has_any(regexp_extract_all(lower(line), '[{_W}]+'), ['nos', 'kxđk'])
 UNION ALL SELECT code, inner_[i], 'parenthetical', 'mixed', page_no, line, [1, page_no, line_no, 2, i - 1] FROM (SELECT *, {_INNER.format('line')} AS inner_ FROM coded), unnest(range(1, len(inner_) + 1)) AS u(i) WHERE NOT regexp_matches(inner_[i], '[A-Z]\\p{{Nd}}{{2}}')),
an AS (SELECT *, {sql_strip(f"regexp_replace({_COLLAPSE}, '[.,;:]+$', '')")} AS norm FROM ar)"""


@query(
    f"""WITH {SQL_SECTIONS}, {SQL_TITLES_OF}, {SQL_BOOK}, {SQL_CODED}, {SQL_ALIAS_ROWS}
SELECT code || ':' || norm AS alias_id, code AS code_3char, alias, norm AS alias_norm, alias_type, language, 'exact' AS match_level, page_no::INT AS source_page, line AS source_line FROM an WHERE norm <> '' AND norm <> lower(code)
QUALIFY row_number() OVER (PARTITION BY code, norm ORDER BY seq[1], seq[2], seq[3], seq[4], seq[5]) = 1"""
)
def book_aliases(spark, sf_dir):
    pages, codes = _book(spark, sf_dir)
    return ontology.alias_dictionary(codes, pages)


_PREFIX = "|".join(p for p, *_ in ontology.CODE_RULES)
_RULE_STOP = _STARTS + f" OR regexp_matches(lower(@), '^({_PREFIX})')"
_EVIDENCE = "line || " + _until(_RULE_STOP, "CASE WHEN ? THEN '' ELSE CASE WHEN @ = '' THEN '' ELSE chr(10) || @ END || # END", "''")
_KINDS = " ".join(f"WHEN regexp_matches(lower(line), '^({p})') THEN {{{i}}}" for i, (p, *_) in enumerate(ontology.CODE_RULES))
_KIND = lambda j, quote: "CASE " + _KINDS.format(*[f"'{r[j]}'" if quote else str(r[j]) for r in ontology.CODE_RULES]) + " END"
_ONE_SPACE = lambda x: sql_strip(f"regexp_replace({x}, '{S}+', ' ', 'g')")
_GLOBAL = ", ".join(f"('{t}', '{a}', {p})" for t, a, p in ontology.GLOBAL_RULES)
_TOPIC = "['" + "', '".join(t for t, *_ in ontology.GLOBAL_RULES) + "', 'other'][(r_regionkey + 1)::INT]"


@query(
    f"""WITH {SQL_SECTIONS}, {SQL_TITLES_OF}, {SQL_BOOK}, {SQL_CODED},
r AS (SELECT page_no, line_no, code, {_KIND(1, True)} AS topic, {_KIND(2, True)} AS action, {_KIND(3, False)} AS priority, {_EVIDENCE} AS evidence_text FROM coded),
m AS (SELECT 'code' AS scope, code AS code_3char, topic, action, priority, page_no, line_no, evidence_text, {_ONE_SPACE('evidence_text')} AS normalized_text FROM r WHERE topic IS NOT NULL),
x AS (SELECT code_3char || ':' || topic || ':' || substring(sha256(normalized_text), 1, 8) AS rule_id, * FROM m
 UNION ALL SELECT 'global:' || topic, 'global', NULL, topic, action, priority, NULL, 0, r_name, {_ONE_SPACE('r_name')} FROM (SELECT {_TOPIC} AS topic, r_name FROM region) JOIN (VALUES {_GLOBAL}) AS g(topic, action, priority) USING (topic))
SELECT rule_id, scope, code_3char, topic, action, priority::INT AS priority, page_no::INT AS source_page_start, evidence_text, normalized_text FROM x QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY page_no NULLS FIRST, line_no) = 1"""
)
def book_rules(spark, sf_dir):
    pages, codes = _book(spark, sf_dir)
    topics = F.array(*[F.lit(t) for t, *_ in ontology.GLOBAL_RULES], F.lit("other"))
    intro = table(spark, sf_dir, "region").select(F.concat(F.lit("book:intro:"), F.element_at(topics, (F.col("r_regionkey") + 1).cast("int"))).alias("doc_id"), F.col("r_name").alias("raw_text"))
    return ontology.coding_rules(intro, pages, codes).drop("source_page_end")


_LETTER = r"[\p{L}\p{Nl}\p{No}]"


@query(
    rf"""WITH d AS (SELECT doc_id, text, string_split(regexp_replace(text, '([.!?][{_IN}]+)({_LETTER})', '\1' || chr(1) || '\2', 'g'), chr(1)) AS p FROM documents WHERE text <> ''),
e AS (SELECT doc_id, text, i, p[i] AS part, list_sum([0] || list_transform(p[1:i - 1], lambda x: length(x))) AS before FROM d, unnest(range(1, len(p) + 1)) AS u(i)),
f AS (SELECT doc_id, i, {sql_strip('part')} AS text, before + length(part) - length(regexp_replace(part, '^{S}+', '')) AS char_start FROM e WHERE {sql_strip('part')} <> ''
 UNION ALL SELECT doc_id, 1, text, 0 FROM d WHERE {sql_strip('text')} = '')
SELECT doc_id::VARCHAR AS doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS sentence_index, text, char_start::INT AS char_start, (char_start + length(text))::INT AS char_end FROM f"""
)
def sentence_offsets(spark, sf_dir):
    return spans.segment(io.spread(table(spark, sf_dir, "documents"))).drop("sentence_id")


@query(
    rf"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '[{_W}]+|[^{_W}]+') AS t FROM documents),
v AS (SELECT doc_id, unnest(t) AS text, unnest(range(1, len(t) + 1)) AS i FROM t),
w AS (SELECT doc_id, text, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e FROM v)
SELECT doc_id || ':m:' || (e - length(text))::INT || ':' || e::INT AS mention_id, 'abbreviation' AS mention_type, text, (e - length(text))::INT AS char_start, e::INT AS char_end FROM w WHERE regexp_full_match(text, '[A-Z]{{2,6}}') AND text NOT IN ('CHO', 'KHI', 'RA')"""
)
def abbreviation_mentions(spark, sf_dir):
    """The mentions of a lexicon without cue words."""
    docs = io.spread(table(spark, sf_dir, "documents")).withColumnRenamed("text", "raw_text")
    return spans.extract_mentions(docs, spans.Lexicon(cues=())).drop("doc_id")


@query("SELECT 'vietmed-sum:' || doc_id AS doc_id, 'vietmed-sum' AS source, 'vi' AS language, text || chr(10) || source AS raw_text, doc_id::VARCHAR AS source_record_id, lang AS split FROM documents WHERE text <> ''")
def parsed_documents(spark, sf_dir):
    """Documents as snapshots whose transcript is the text and whose summary is the source."""
    d = table(spark, sf_dir, "documents")
    payload = F.parse_json(F.to_json(F.struct(F.col("text").alias("transcript"), F.col("source").alias("summary"))))
    rows = d.select(F.lit("vietmed-sum").alias("dataset_name"), F.col("lang").alias("source_split"), F.col("doc_id").cast("string").alias("source_record_id"), payload.alias("payload"), F.lit(None).cast("string").alias("language"))
    return io.parse_dataset(rows, "vietmed-sum")[0].drop("payload")


_EVAL = f"""{SQL_LINKS}, {SQL_MERGED}, s AS (SELECT doc_id, code_3char AS label, max(score)::DOUBLE AS score FROM merged GROUP BY 1, 2),
t AS (SELECT DISTINCT user_id AS doc_id, chr((65 + (event_id % 13) // 100)::INT) || lpad(((event_id % 13) % 100)::VARCHAR, 2, '0') AS label FROM events),
c AS (SELECT coalesce(s.label, t.label) AS label, coalesce(score, 0.0) AS score, (t.label IS NOT NULL)::INT AS y FROM s FULL JOIN (SELECT * FROM t WHERE doc_id IN (SELECT doc_id FROM s)) t ON s.doc_id = t.doc_id AND s.label = t.label),
v AS (SELECT label FROM s UNION SELECT label FROM t),
k AS (SELECT label, coalesce(sum((score > 0.5)::INT * y), 0) AS tp, coalesce(sum((score > 0.5)::INT * (1 - y)), 0) AS fp, coalesce(sum((score <= 0.5)::INT * y), 0) AS fn FROM v LEFT JOIN c USING (label) GROUP BY label),
q AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END) AS macro FROM k)"""


@query(
    f"""WITH {_EVAL} SELECT 'code_3char/micro_f1' AS metric, round(2 * tp / (2 * tp + fp + fn), 6)::DOUBLE AS value FROM q UNION ALL SELECT 'code_3char/macro_f1', round(macro, 6) FROM q
UNION ALL SELECT 'code_3char/micro_precision', round(tp / (tp + fp), 6) FROM q UNION ALL SELECT 'code_3char/micro_recall', round(tp / (tp + fn), 6) FROM q"""
)
def evaluation(spark, sf_dir):
    """The metrics of prediction records against target records, but for the AUROC, which macro_auroc has."""
    scores, truth = _link_scores(spark, sf_dir)
    made = rule_based.predictions(scores.withColumnRenamed("label", "code"), 5).select("doc_id", F.map_from_entries("ranked").alias("scores"))
    found = metrics.evaluate(made, truth.groupBy("doc_id").agg(F.collect_set("label").alias("silver_labels")))
    return spark.createDataFrame([(k, round(v, 6)) for k, v in found.items() if not k.endswith("auroc")], "metric string, value double")


@query("SELECT 'corpus' AS dataset_name, 'train' AS source_split, doc_id::VARCHAR AS source_record_id, text, n_chars, 'parquet' AS source_format, '1' AS ingest_version FROM documents")
def snapshot_records(spark, sf_dir):
    """Snapshots of the file of documents, with two fields of their payload."""
    path = f"{sf_dir}/documents.parquet"
    rows = io.snapshots(spark.read.parquet(path), "corpus", "train", io.Source("parquet", {}, "doc_id"), path)
    field = lambda name, kind: F.try_variant_get("payload", f"$.{name}", kind).alias(name)
    return rows.select("dataset_name", "source_split", "source_record_id", field("text", "string"), field("n_chars", "long"), "source_format", "ingest_version")


@query(
    f"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '[^{_IN}]+|[{_IN}]+') AS t FROM documents WHERE text IS NOT NULL),
v AS (SELECT doc_id, unnest(t) AS text, unnest(range(1, len(t) + 1)) AS i FROM t),
w AS (SELECT doc_id, text, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e FROM v),
k AS (SELECT doc_id, text, e, row_number() OVER (PARTITION BY doc_id ORDER BY e) AS pos FROM w WHERE regexp_matches(text, '^[^{_IN}]'))
SELECT doc_id::VARCHAR AS doc_id, pos::INT AS pos, (e - length(text))::INT AS char_start, e::INT AS char_end, text FROM k
UNION ALL SELECT doc_id::VARCHAR, 0, NULL, NULL, NULL FROM t UNION ALL SELECT doc_id::VARCHAR, (coalesce(n, 0) + 1)::INT, NULL, NULL, NULL FROM t LEFT JOIN (SELECT doc_id, max(pos) AS n FROM k GROUP BY doc_id) USING (doc_id)"""
)
def token_alignment(spark, sf_dir):
    """The piece of a document that each token of the stand-in encoder stands for."""
    return encoder.align(io.spread(table(spark, sf_dir, "documents")), encoder.HashEncoder(1)).drop("token_id")


@query(
    """WITH q AS (SELECT vec_id AS label, embedding::DOUBLE[] AS q FROM embeddings), t AS (SELECT label AS doc_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 10 < 8),
s AS (SELECT doc_id, label, v, list_dot_product(q, v) AS s, list_dot_product(q, v) AS own FROM t, q), e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY doc_id, label)) AS e FROM s)
SELECT doc_id, label, round(sum(e * own) / sum(e) + label / 1000.0, 6)::DOUBLE AS logit FROM e GROUP BY 1, 2"""
)
def label_head(spark, sf_dir):
    """The attention head whose label queries are its class weights too; each vector is a label and each group a document."""
    every = table(spark, sf_dir, "embeddings")
    own = every.select(F.col("vec_id").alias("label"), F.posexplode("embedding").alias("dim", "value"))
    weights = own.select("label", "dim", F.col("value").cast("double").alias("w"), (F.col("label") / 1000).alias("bias"))
    tokens = every.select(F.col("label").alias("doc_id"), F.col("vec_id").alias("pos"), F.col("embedding").alias("vector"), (F.col("vec_id") % 10 < 8).alias("mask"))
    return vectors.head(tokens, own, weights, 64).select("doc_id", "label", F.round("logit", 6).alias("logit"))
