"""Retrieval of codes for documents: TF-IDF cosine and the BM25 variant, as inverted-index joins.

Terms of queries and corpus meet in one equi-join on the term; what is grouped
are pairs that share a term. Scores are rounded before ranking, so the order of
summation can't change ranks. Both give score / best score of the query.

`search` ranks a whole corpus for each row. A corpus of at most POSTINGS
postings, counted first, goes to the executors as one inverted index and a query's
scores are summed where its row is, without shuffle; a larger one is joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def term_counts(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    """key, term, tf."""
    return df.select(key, F.explode(tokens).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def _rounded(raw, digits: int, floor):
    """raw to digits, halves up: the same arithmetic on a column and on an array, so both ways of search rank alike."""
    return floor(raw * 10.0**digits + 0.5) / 10.0**digits


def top_k(scores: DataFrame, query: str, item: str, k: int, digits: int = 9) -> DataFrame:
    """query, item, raw -> query, item, raw, score, rank: positive scores, by (score desc, item)."""
    scores = scores.withColumn("raw", _rounded(F.col("raw"), digits, F.floor)).filter("raw > 0")
    ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("raw"), item))).filter(F.col("rank") <= k)
    return ranked.withColumn("score", F.col("raw") / F.max("raw").over(Window.partitionBy(query)))


def bm25(queries: DataFrame, corpus: DataFrame, query: str, item: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """queries(query, term, tf) and corpus(item, term, tf) -> query, item, raw.

    Per query token: idf * tf * (k1 + 1) / (K * (tf + 1)), where K = k1 * (1 - b + b * dl / avgdl)
    and idf = ln((N - df + .5) / (df + .5) + 1). A repeated query token counts again.
    """
    return _joined(queries, bm25_postings(corpus, item, k1, b), query, item)


def bm25_postings(corpus: DataFrame, item: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """item, term, w, and 1 as the weight of the term in a query."""
    length = corpus.groupBy(item).agg(F.sum("tf").alias("dl"))
    whole = length.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    df = corpus.groupBy("term").agg(F.count("*").alias("df"))
    grow = F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("dl") / F.col("avgdl"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    posting = corpus.join(length, item).join(df, "term").crossJoin(F.broadcast(whole))
    return posting.select(item, "term", (idf * F.col("tf") * (k1 + 1) / (grow * (F.col("tf") + 1))).alias("w"), F.lit(1.0).alias("wq"))


def _joined(queries: DataFrame, posting: DataFrame, query: str, item: str) -> DataFrame:
    return queries.join(posting, "term").groupBy(query, item).agg(F.sum(F.col("tf") * F.col("wq") * F.col("w")).alias("raw"))


def tfidf(queries: DataFrame, corpus: DataFrame, query: str, item: str) -> DataFrame:
    """Cosine of L2-normalised tf * (ln((1 + N) / (1 + df)) + 1); query terms outside the corpus don't count."""
    posting = tfidf_postings(corpus, item)
    own = F.col("tf") * F.col("wq")
    asked = queries.join(posting.select("term", "wq").distinct(), "term").withColumn("q", own / F.sqrt(F.sum(own * own).over(Window.partitionBy(query))))
    return asked.drop("wq").join(posting, "term").groupBy(query, item).agg(F.sum(F.col("q") * F.col("w")).alias("raw"))


def tfidf_postings(corpus: DataFrame, item: str) -> DataFrame:
    """item, term, normalised weight w, and the term's idf wq."""
    n = corpus.select(item).distinct().agg(F.count("*").alias("n"))
    df = corpus.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.crossJoin(F.broadcast(n)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("wq"))
    w = corpus.join(idf, "term").withColumn("w", F.col("tf") * F.col("wq"))
    norm = w.groupBy(item).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, item).select(item, "term", (F.col("w") / F.col("norm")).alias("w"), "wq")


#: Postings of a corpus that one index may hold; about 30 bytes each.
POSTINGS = 2_000_000
#: Scores and posting reads held at once.
CELLS = 1 << 21


@dataclass
class Index:
    """Postings by term: those of term i are first[i]:first[i + 1]. Items are in ascending order."""

    terms: pa.Array
    query_weight: np.ndarray
    first: np.ndarray
    at: np.ndarray
    weight: np.ndarray
    items: pa.Array
    cosine: bool

    def top(self, tokens: pa.Array, k: int, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, item, raw score and rank of the k best items with positive scores of each list of tokens."""
        flat = pc.index_in(pc.list_flatten(tokens), self.terms)
        row = pc.list_parent_indices(tokens).to_numpy(zero_copy_only=False)
        keep = flat.is_valid().to_numpy(zero_copy_only=False)
        term = flat.fill_null(0).to_numpy(zero_copy_only=False)[keep].astype(np.int64)
        pair, tf = np.unique(row[keep].astype(np.int64) * len(self.terms) + term, return_counts=True)
        row, term = pair // max(len(self.terms), 1), pair % max(len(self.terms), 1)
        weight = tf * self.query_weight[term]
        if self.cosine:
            weight = weight / np.sqrt(np.bincount(row, weight * weight))[row]
        reads = self.first[term + 1] - self.first[term]
        out = []
        lo, edges = 0, np.flatnonzero(np.diff(row, prepend=-1, append=-1))
        total = np.concatenate([[0], np.cumsum(reads)])
        rows_at_once = max(1, CELLS // max(len(self.items), 1))
        e = 0
        while lo < len(row):
            step = e + 1
            while step < len(edges) - 1 and step - e < rows_at_once and total[edges[step + 1]] - total[lo] <= CELLS:
                step += 1
            hi = int(edges[step])
            out.append(self._top(row[lo:hi], term[lo:hi], weight[lo:hi], reads[lo:hi], k, digits))
            lo, e = hi, step
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.float64, np.int64))

    def _top(self, row, term, weight, reads, k: int, digits: int):
        which, local = np.unique(row, return_inverse=True)
        place = np.arange(reads.sum()) - np.repeat(np.cumsum(reads) - reads, reads) + np.repeat(self.first[term], reads)
        cell = np.repeat(local, reads) * len(self.items) + self.at[place]
        raw = np.bincount(cell, np.repeat(weight, reads) * self.weight[place], len(which) * len(self.items))
        raw = _rounded(raw.reshape(len(which), len(self.items)), digits, np.floor)
        best = np.argsort(-raw, axis=1, kind="stable")[:, :k]
        score = np.take_along_axis(raw, best, axis=1)
        r, rank = np.nonzero(score > 0)
        return which[r], best[r, rank], score[r, rank], rank + 1


def _index(posting: DataFrame, item: str, cosine: bool) -> Index:
    rows = posting.select("term", item, "w", "wq").toArrow()
    terms, items = rows["term"].combine_chunks().unique(), rows[item].combine_chunks().unique()
    items = items.take(pc.sort_indices(items))
    term = pc.index_in(rows["term"].combine_chunks(), terms).to_numpy()
    order = np.argsort(term, kind="stable")
    first = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(terms)))])
    by_query = np.zeros(len(terms))
    by_query[term] = rows["wq"].to_numpy()
    return Index(terms, by_query, first, pc.index_in(rows[item].combine_chunks(), items).to_numpy()[order].astype(np.int64), rows["w"].to_numpy()[order], items, cosine)


#: Tokens of the rows that are ranked at once, but for one row's own.
TOKENS = 1 << 18


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of (query, tokens) in slices of about TOKENS tokens."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + TOKENS, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def search(docs: DataFrame, query: str, tokens: Column, corpus: DataFrame, item: str, method: str, k: int, digits: int = 9, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """query, item, raw, score, rank: the k best items of corpus(item, term, tf) for each row of docs, by (raw desc, item).

    tokens: the words of a row, repeated as they are; null counts as none. Rows
    without a positive score give none. method: "bm25" or "tfidf".
    """
    posting = bm25_postings(corpus, item, k1, b) if method == "bm25" else tfidf_postings(corpus, item)
    docs = docs.select(query, tokens.alias("tokens"))
    if corpus.limit(POSTINGS + 1).count() > POSTINGS:
        # each row is ranked by itself, as rows that share an id are by the index
        numbered = docs.select(F.struct(F.monotonically_increasing_id().alias("row"), F.col(query).alias("id")).alias("_row"), "tokens")
        counts = term_counts(numbered, "_row", F.col("tokens"))
        best = top_k(bm25(counts, corpus, "_row", item, k1, b) if method == "bm25" else tfidf(counts, corpus, "_row", item), "_row", item, k, digits)
        return best.select(F.col("_row.id").alias(query), item, "raw", "score", "rank")
    index = docs.sparkSession.sparkContext.broadcast(_index(posting, item, method == "tfidf"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        for batch in (part for whole in batches for part in _parts(whole)):
            row, at, raw, rank = ix.top(batch.column(1), k, digits)
            score = raw / raw[np.searchsorted(row, row)]  # the first of a row is its best
            columns = [batch.column(0).take(pa.array(row)), ix.items.take(pa.array(at)), pa.array(raw), pa.array(score), pa.array(rank, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, [query, item, "raw", "score", "rank"])

    kinds = docs.schema[query].dataType.simpleString(), corpus.schema[item].dataType.simpleString()
    return docs.mapInArrow(run, f"{query} {kinds[0]}, {item} {kinds[1]}, raw double, score double, rank int")
