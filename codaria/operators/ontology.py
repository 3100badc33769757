"""Ontology, aliases, coding rules and guidance from ordered page text, by window functions.

A parser's state, such as the open code or the current chapter, is a running
aggregate over a page's lines. pages(page_no, raw_text) has one row a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codaria.functions import text as T
from codaria.operators.spans import parentheticals, split_all_lines
from codaria.operators.weak_labels import missing_topics

FIRST_CODE_PAGE = 20
# Topics of the introduction with keywords and half-open page ranges.
TOPICS = (
    ("principal_diagnosis", ("bệnh chính", "chẩn đoán cuối cùng", "chẩn đoán xác định", "bệnh phụ"), 15, 17),
    ("symptom_fallback", ("không thể xác định chẩn đoán", "dấu hiệu và tình trang", "dấu hiệu đặc trưng"), 16, 17),
    ("mortality_coding", ("nguyên nhân tử vong", "tử vong", "nguyên nhân tử vong chính"), 16, 19),
    ("official_3char_policy", ("tạm thời sử dụng bộ mã 3 kí tự", "bộ mã 3 kí tự", "mã 3 kí tự"), 14, 16),
)
# Action and priority of global topics, and prefixes of code rules in order of precedence.
GLOBAL_RULES = (("principal_diagnosis", "prefer", 90), ("symptom_fallback", "fallback", 70), ("mortality_coding", "prefer", 80), ("official_3char_policy", "restrict", 100))
CODE_RULES = (
    ("bao gồm|includes", "include_note", "allow", 30),
    ("loại trừ|excludes", "exclude_note", "restrict", 40),
    ("sử dụng mã|mã thêm|use additional code", "use_additional_code", "require_additional_code", 50),
    ("code first", "code_first", "code_first", 60),
    ("ghi chú|note", "general_note", "note", 10),
)


def latest_pages(records: DataFrame) -> DataFrame:
    """records(page_no, raw_text, ordinal): the last record of each page."""
    return records.filter("page_no IS NOT NULL").groupBy("page_no").agg(F.max_by("raw_text", "ordinal").alias("raw_text"))


def page_lines(pages: DataFrame, first_page: int = FIRST_CODE_PAGE) -> DataFrame:
    rows = pages.filter(F.col("page_no") >= first_page).select("page_no", F.posexplode(F.split("raw_text", "\n")).alias("line_no", "line"))
    return rows.withColumn("line", T.strip(F.col("line")))


def sections(lines: DataFrame) -> DataFrame:
    """lines(page_no, line_no, line) with section en or vi: vi from the first repeated code line on, else from the first Vietnamese line that is no code."""
    code = T.code_line(F.col("line"))
    rows = lines.withColumn("code", F.nullif(code, F.lit("")))
    again = F.row_number().over(Window.partitionBy("page_no", "code").orderBy("line_no"))
    rows = rows.withColumn("again", F.when(F.col("code").isNotNull(), again))
    by = Window.partitionBy("page_no")
    repeated = F.min(F.when(F.col("again") == 2, F.col("line_no"))).over(by)
    foreign = F.col("code").isNull() & (F.col("line") != "") & T.is_vietnamese(F.col("line")) & (T.subcode_line(F.col("line"), 1) == "")
    fallback = F.when(F.count("code").over(by) > 0, F.min(F.when(foreign, F.col("line_no"))).over(by))
    return rows.withColumn("split", F.coalesce(repeated, fallback)).withColumn("section", F.when(F.col("line_no") >= F.col("split"), "vi").otherwise("en")).drop("again", "split")


def titles_and_subtitles(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From sections(): titles(section, code, title, page_no), first one a code and section, and subtitles(section, code, title, page_no, line_no).

    A code line opens a title and the lines behind it belong to it, until a
    four-character line, a structural line or another code; empty lines and page
    numbers between dashes are skipped.
    """
    rows = rows.filter((F.col("line") != "") & ~((F.left("line", F.lit(1)) == "–") & (F.right("line", F.lit(1)) == "–")))
    sub = T.subcode_line(F.col("line"), 1)
    kind = F.when(sub != "", "sub").when(F.col("code").isNotNull(), "code").when(T.is_structural(F.col("line")), "stop").otherwise("text")
    rows = rows.withColumn("kind", kind)
    order = Window.partitionBy("page_no", "section").orderBy("line_no")
    rows = rows.withColumn("part", F.sum((F.col("kind") != "text").cast("int")).over(order))
    parts = rows.groupBy("page_no", "section", "part").agg(
        F.max(F.when(F.col("kind") == "code", F.col("code"))).alias("code"),
        F.min("line_no").alias("line_no"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "text", F.struct("line_no", "line")))).alias("t"),
    )
    title = T.title_text(F.array_join(F.transform("t", lambda x: x["line"]), " "))
    named = parts.filter("code IS NOT NULL").withColumn("title", title).filter("title != ''")
    first = F.row_number().over(Window.partitionBy("section", "code").orderBy("page_no", "line_no"))
    titles = named.withColumn("rn", first).filter("rn = 1").select("section", "code", "title", "page_no")
    subs = rows.filter("kind = 'sub'").select("section", sub.alias("code"), T.strip(T.subcode_line(F.col("line"), 2)).alias("title"), "page_no", "line_no")
    return titles, subs


def chapters(lines: DataFrame) -> DataFrame:
    """page_no, chapter_id: a page's last heading, carried to later pages."""
    found = lines.withColumn("chapter", T.chapter_id(T.chapter_heading(F.col("line"))))
    last = found.groupBy("page_no").agg(F.max_by("chapter", F.when(F.col("chapter").isNotNull(), F.col("line_no"))).alias("chapter"))
    # one row a page of one book, so one ordered window is small
    carried = F.last("chapter", ignorenulls=True).over(Window.orderBy("page_no").rowsBetween(Window.unboundedPreceding, 0))
    return last.select("page_no", carried.alias("chapter_id"))


def both_titles(vi: DataFrame, en: DataFrame) -> DataFrame:
    """code, vi, title_en, title_vi of vi(code, vi) and en(code, title_en): codes of either; an English title stands for a missing or empty Vietnamese one."""
    return vi.join(en, "code", "full").withColumn("title_vi", F.coalesce(F.nullif("vi", F.lit("")), "title_en"))


def ontology(pages: DataFrame, first_page: int = FIRST_CODE_PAGE) -> DataFrame:
    """code_3char, chapter_id, title_vi, title_en, aliases, search_text."""
    lines = page_lines(pages, first_page)
    titles, subs = titles_and_subtitles(sections(lines))
    en = titles.filter("section = 'en'").select("code", F.col("title").alias("title_en"))
    vi = titles.filter("section = 'vi'").select("code", F.col("title").alias("vi"))
    both = both_titles(vi, en)
    place = titles.groupBy("code").agg(F.min("page_no").alias("page_no")).join(chapters(lines), "page_no", "left")
    keyed = subs.join(both, "code").withColumn("norm", T.ontology_alias_key(F.col("title")))
    own = T.ontology_alias_key(F.when(F.col("section") == "en", F.coalesce("title_en", F.lit(""))).otherwise(F.col("title_vi")))
    keyed = keyed.filter((F.col("norm") != "") & (F.col("norm") != own))
    order = F.struct((F.col("section") == "vi").alias("s"), "page_no", "line_no")
    once = keyed.groupBy("code", "norm").agg(F.min(F.struct(order.alias("o"), "title")).alias("a"))
    aliases = once.groupBy("code").agg(F.transform(F.array_sort(F.collect_list("a")), lambda a: a["title"]).alias("aliases"))
    out = both.join(place, "code", "left").join(aliases, "code", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
    search = T.search_text(F.col("code"), F.col("title_vi"), F.col("title_en"), F.col("aliases"))
    return out.select(F.col("code").alias("code_3char"), "chapter_id", "title_vi", "title_en", "aliases", search.alias("search_text"))


def check_ontology(codes: DataFrame) -> None:
    """Raises ValueError unless codes are unique, well-formed, titled and have distinct non-empty aliases."""
    if codes.isEmpty():
        raise ValueError("no ontology records")
    if not codes.groupBy("code_3char").count().filter("count > 1").isEmpty():
        raise ValueError("duplicate code")
    bad = ~F.col("code_3char").rlike(r"^[A-Z]\d{2}$") | (F.coalesce("title_vi", F.lit("")) == "") | (F.coalesce("search_text", F.lit("")) == "")
    norms = F.transform("aliases", T.ontology_alias_key)
    bad = bad | (F.size(F.array_distinct(norms)) != F.size(norms)) | F.array_contains("aliases", "")
    if not codes.filter(bad).isEmpty():
        raise ValueError("invalid ontology record")


def check_pages(pages: DataFrame) -> None:
    """Raises ValueError unless page numbers are 1..N, each once."""
    r = pages.agg(F.count("*").alias("n"), F.count_distinct("page_no").alias("d"), F.min("page_no").alias("lo"), F.max("page_no").alias("hi")).first()
    if not r["n"] or r["n"] != r["d"] or r["lo"] != 1 or r["hi"] != r["n"]:
        raise ValueError("pages are not contiguous from 1")


def check_guidance(rows: DataFrame, source: str = "icd10_official_pdf", topics=TOPICS) -> None:
    """Raises ValueError unless each topic has one record, with texts, its own id and pages in order."""
    known = [t for t, *_ in topics]
    bad = (F.coalesce(F.trim("raw_text"), F.lit("")) == "") | (F.coalesce(F.trim("normalized_text"), F.lit("")) == "") | (F.size("sentences") < 1)
    bad = bad | (F.col("doc_id") != F.concat(F.lit(f"{source}:intro_guidance:"), "topic")) | ~F.col("topic").isin(known) | (F.col("page_start") > F.col("page_end"))
    if not rows.filter(F.coalesce(bad, F.lit(True))).isEmpty():
        raise ValueError("invalid guidance record")
    have = [r[0] for r in rows.select("topic").collect()]  # a row a topic
    if sorted(have) != sorted(known):
        raise ValueError(f"guidance topics are {sorted(have)}")


def coded_lines(pages: DataFrame, codes: DataFrame) -> DataFrame:
    """page_no, line_no, line, code (the last known one at or before it on its page), next (up to three trimmed lines behind)."""
    rows = pages.select("page_no", F.posexplode(split_all_lines(F.col("raw_text"))).alias("line_no", "line")).withColumn("line", T.strip(F.col("line")))
    known = codes.select(F.col("code_3char").alias("own")).distinct()
    rows = rows.withColumn("own", F.nullif(T.leading_code(F.col("line")), F.lit(""))).join(known.withColumn("known", F.lit(True)), "own", "left")
    order = Window.partitionBy("page_no").orderBy("line_no")
    rows = rows.withColumn("code", F.last(F.when(F.col("known"), F.col("own")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ahead = F.filter(F.array(*[F.lead("line", i).over(order) for i in (1, 2, 3)]), lambda x: x.isNotNull())
    return rows.withColumn("next", ahead).filter("line != '' AND code IS NOT NULL").select("page_no", "line_no", "line", "code", "next")


def take_until(items: Column, stop) -> Column:
    """The items before the first that stop(item) holds for."""
    at = F.array_position(F.transform(items, lambda x: F.coalesce(stop(x), F.lit(False))), F.lit(True)).cast("int")
    return F.when(at > 0, F.slice(items, F.lit(1), at - 1)).otherwise(items)


def _starts_code(line: Column) -> Column:
    return T.leading_code(line) != ""


def alias_rows(codes: DataFrame, pages: DataFrame) -> DataFrame:
    """All aliases in order of precedence: code, alias, type, language, page_no, line, seq (array)."""
    code = F.col("code_3char").alias("code")
    none = (F.lit(None).cast("int").alias("page_no"), F.lit(None).cast("string").alias("line"))
    place = F.col("ordinal").cast("int")
    out = []
    for i, (title, lang) in enumerate((("title_vi", "vi"), ("title_en", "en"))):
        out.append(codes.select(code, F.col(title).alias("alias"), F.lit(title).alias("alias_type"), F.lit(lang).alias("language"), *none, F.array(F.lit(0), place, F.lit(i), F.lit(0), F.lit(0)).alias("seq")))
        inner = codes.select(code, "ordinal", F.posexplode(parentheticals(F.coalesce(F.col(title), F.lit("")))).alias("p", "alias"))
        out.append(inner.select("code", "alias", F.lit("parenthetical").alias("alias_type"), F.lit(lang).alias("language"), *none, F.array(F.lit(0), place, F.lit(2 + i), F.col("p"), F.lit(0)).alias("seq")))
    lines = coded_lines(pages, codes)
    seq = lambda step, pos: F.array(F.lit(1), F.col("page_no").cast("int"), F.col("line_no"), F.lit(step), pos).alias("seq")
    prefix = rf"^(?iu:bao gồm|includes):?[{T.SPACE}]*"
    mixed = F.lit("mixed").alias("language")
    started = lines.filter(F.col("line").rlike("^(?iu:bao gồm|includes)"))
    rest = T.strip(F.regexp_replace("line", prefix, ""))
    out.append(started.select("code", rest.alias("alias"), F.lit("inclusion").alias("alias_type"), mixed, "page_no", "line", seq(0, F.lit(0))))
    stop = lambda x: _starts_code(x) | x.rlike("^(?iu:loại trừ|excludes|sử dụng mã|use additional code):")
    behind = started.select("code", "page_no", "line_no", F.posexplode(take_until(F.col("next"), stop)).alias("p", "alias"))
    out.append(behind.select("code", "alias", F.lit("inclusion").alias("alias_type"), mixed, "page_no", F.col("alias").alias("line"), seq(0, F.col("p") + 1)))
    out.append(lines.filter(T.nos_form(F.col("line")).isNotNull()).select("code", F.col("line").alias("alias"), F.lit("nos_form").alias("alias_type"), mixed, "page_no", "line", seq(1, F.lit(0))))
    inner = lines.select("code", "page_no", "line_no", "line", F.posexplode(parentheticals(F.col("line"))).alias("p", "alias")).filter(~F.col("alias").rlike(r"[A-Z]\p{Nd}{2}"))
    out.append(inner.select("code", "alias", F.lit("parenthetical").alias("alias_type"), mixed, "page_no", "line", seq(2, F.col("p"))))
    rows = out[0]
    for o in out[1:]:
        rows = rows.unionByName(o)
    return rows


def first_aliases(rows: DataFrame) -> DataFrame:
    """rows(code, alias, seq, ...) with norm: the first by seq of each code and norm; empty ones and those that are the code go."""
    rows = rows.withColumn("norm", T.alias_key(F.col("alias"))).filter("norm != '' AND norm != lower(code)")
    first = F.row_number().over(Window.partitionBy("code", "norm").orderBy("seq"))
    return rows.withColumn("rn", first).filter("rn = 1").drop("rn")


def alias_dictionary(codes: DataFrame, pages: DataFrame) -> DataFrame:
    """alias_id, code_3char, alias, alias_norm, alias_type, language, match_level, source_page, source_line: first seen wins."""
    once = first_aliases(alias_rows(codes, pages))
    return once.select(F.concat_ws(":", "code", "norm").alias("alias_id"), F.col("code").alias("code_3char"), "alias", F.col("norm").alias("alias_norm"), "alias_type", "language", F.lit("exact").alias("match_level"), F.col("page_no").alias("source_page"), F.col("line").alias("source_line"))


def rule_kind(line: Column) -> Column:
    """struct(topic, action, priority) of a line by its prefix, or null."""
    out = F.lit(None).cast("struct<topic:string,action:string,priority:int>")
    for prefix, topic, action, priority in reversed(CODE_RULES):
        out = F.when(F.lower(line).rlike(f"^({prefix})"), F.struct(F.lit(topic).alias("topic"), F.lit(action).alias("action"), F.lit(priority).alias("priority"))).otherwise(out)
    return out


def code_rules(pages: DataFrame, codes: DataFrame) -> DataFrame:
    """rule_id, scope, code_3char, topic, action, priority, source_page_start, source_page_end, evidence_text, normalized_text."""
    every = "|".join(p for p, *_ in CODE_RULES)
    rows = coded_lines(pages, codes).withColumn("k", rule_kind(F.col("line"))).filter("k IS NOT NULL")
    block = take_until(F.col("next"), lambda x: _starts_code(x) | x.rlike(f"^(?iu:{every})"))
    evidence = F.array_join(F.concat(F.array("line"), F.filter(block, lambda x: x != "")), "\n")
    rows = rows.withColumn("evidence_text", evidence).withColumn("normalized_text", T.rule_text(F.col("evidence_text")))
    rule_id = F.concat_ws(":", "code", "k.topic", T.hash8(F.col("normalized_text")))
    return rows.select(rule_id.alias("rule_id"), F.lit("code").alias("scope"), F.col("code").alias("code_3char"), "k.topic", "k.action", "k.priority", F.col("page_no").alias("source_page_start"), F.col("page_no").alias("source_page_end"), "evidence_text", "normalized_text", "line_no")


def global_rules(intro: DataFrame) -> DataFrame:
    """intro(doc_id, raw_text[, page_no]): the rule of each known topic, the last part of doc_id."""
    page = F.col("page_no").cast("int") if "page_no" in intro.columns else F.lit(None).cast("int")
    known = intro.sparkSession.createDataFrame(GLOBAL_RULES, "topic string, action string, priority int")
    rows = intro.withColumn("topic", F.element_at(F.split("doc_id", ":"), -1)).join(F.broadcast(known), "topic")
    none = F.lit(None)
    return rows.select(F.concat(F.lit("global:"), "topic").alias("rule_id"), F.lit("global").alias("scope"), none.cast("string").alias("code_3char"), "topic", "action", "priority", page.alias("source_page_start"), none.cast("int").alias("source_page_end"), F.col("raw_text").alias("evidence_text"), T.rule_text(F.col("raw_text")).alias("normalized_text"), F.lit(0).alias("line_no"))


def coding_rules(intro: DataFrame, pages: DataFrame, codes: DataFrame) -> DataFrame:
    """Global and code rules, each id once, the first by page and line; raises unless all global topics are there."""
    whole = global_rules(intro)
    missing = missing_topics(whole, tuple(topic for topic, *_ in GLOBAL_RULES))
    if missing:
        raise ValueError(f"global topics without a rule: {missing}")
    rows = whole.unionByName(code_rules(pages, codes))
    first = F.row_number().over(Window.partitionBy("rule_id").orderBy(F.asc_nulls_first("source_page_start"), "line_no"))
    return rows.withColumn("rn", first).filter("rn = 1").drop("rn", "line_no")


def guidance(pages: DataFrame, source: str = "icd10_official_pdf", topics=TOPICS) -> DataFrame:
    """doc_id, topic, raw_text, normalized_text, sentences, page_start, page_end, page_span: pages of a topic's range that hold one of its keywords.

    Raises ValueError if a topic has no page. topics is a constant of a few rows.
    """
    spark = pages.sparkSession
    table = spark.createDataFrame([(t, list(k), a, b) for t, k, a, b in topics], "topic string, keywords array<string>, low int, high int")
    hit = (F.col("page_no") >= F.col("low")) & (F.col("page_no") < F.col("high")) & F.exists("keywords", lambda k: F.contains(F.lower("raw_text"), k))
    rows = pages.join(F.broadcast(table), hit).groupBy("topic").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "raw_text"))), lambda p: p["raw_text"]), "\n\n").alias("raw_text"),
        F.min("page_no").alias("page_start"), F.max("page_no").alias("page_end"),
    )
    missing = sorted({t for t, *_ in topics} - {r[0] for r in rows.select("topic").collect()})  # a row a topic
    if missing:
        raise ValueError(f"no guidance for {missing}")
    span = F.when(F.col("page_start") == F.col("page_end"), F.col("page_start").cast("string")).otherwise(F.concat_ws("-", "page_start", "page_end"))
    rows = rows.withColumn("normalized_text", T.page_text(F.col("raw_text"), True))
    return rows.select(F.concat(F.lit(f"{source}:intro_guidance:"), "topic").alias("doc_id"), "topic", "raw_text", "normalized_text", T.sentences(F.col("normalized_text")).alias("sentences"), "page_start", "page_end", span.alias("page_span"))
