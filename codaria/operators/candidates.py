"""Candidate links of a document: merge, then rank and cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codaria.functions.text import query_text, space_tokens, word_tokens
from codaria.operators import lexicon, retrieval

LINK = ("doc_id", "mention_id", "code_3char", "method", "score", "char_start", "char_end")


def merge(mention_links: DataFrame, doc_links: DataFrame) -> DataFrame:
    """Best link for each document, mention, code and method; mention links first on ties. A null mention is a key of its own."""
    both = mention_links.select(*LINK, F.lit(0).alias("side")).unionByName(doc_links.select(*LINK, F.lit(1).alias("side")))
    key = Window.partitionBy("doc_id", "mention_id", "code_3char", "method")
    order = [F.desc("score"), "side", "char_start", "char_end"]
    return both.withColumn("rn", F.row_number().over(key.orderBy(*order))).filter("rn = 1").select(*LINK)


def rank_and_cut(links: DataFrame, k: int = 50) -> DataFrame:
    """One link for each document and code, the best by (score desc, method, start of the mention, its id), those without a mention last, then the k best codes by (score desc, code)."""
    one = Window.partitionBy("doc_id", "code_3char").orderBy(F.desc("score"), "method", F.asc_nulls_last("char_start"), F.asc_nulls_last("mention_id"))
    best = links.withColumn("rn", F.row_number().over(one)).filter("rn = 1").drop("rn")
    ranked = Window.partitionBy("doc_id").orderBy(F.desc("score"), "code_3char")
    return best.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)


def document_links(docs: DataFrame, codes: DataFrame, k: int = 20) -> DataFrame:
    """TF-IDF and BM25 links of docs(doc_id, retrieval_text, normalized_text) to codes(code_3char, search_text)."""
    text = docs.select("doc_id", query_text(F.col("retrieval_text"), F.col("normalized_text")).alias("q"))
    out = []
    for method, tokens in (("tfidf", word_tokens), ("bm25", space_tokens)):
        c = retrieval.term_counts(codes, "code_3char", tokens(F.col("search_text")))
        top = retrieval.search(text, "doc_id", tokens(F.col("q")), c, "code_3char", method, k)
        none = F.lit(None)
        out.append(top.select("doc_id", none.cast("string").alias("mention_id"), "code_3char", F.lit(method).alias("method"), "score", none.cast("int").alias("char_start"), none.cast("int").alias("char_end")))
    return out[0].unionByName(out[1])


def mention_links(mentions: DataFrame, codes: DataFrame, aliases: DataFrame, k: int = 10) -> DataFrame:
    """Exact, normalized and fuzzy links."""
    out = lexicon.exact_links(mentions, lexicon.title_index(codes))
    out = out.unionByName(lexicon.normalized_links(mentions, lexicon.alias_index(aliases)))
    return out.unionByName(lexicon.fuzzy_links(mentions, lexicon.fuzzy_index(codes), k=k))


def generate(docs: DataFrame, mentions: DataFrame, codes: DataFrame, aliases: DataFrame, k: int = 50) -> DataFrame:
    return rank_and_cut(merge(mention_links(mentions, codes, aliases), document_links(docs, codes)), k)
