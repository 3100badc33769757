"""Title, alias and fuzzy dictionaries, and the joins of mentions and documents with them."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codaria.functions.text import SPACE, fold_key

#: Keys, and characters of keys, that one automaton may hold.
KEY_ROWS, KEY_CHARS = 200_000, 4_000_000


def title_entries(codes: DataFrame) -> DataFrame:
    """key, code, place: Vietnamese then English title of each code by its ordinal; empty keys go."""
    both = [codes.select(fold_key(F.col(c)).alias("key"), F.col("code_3char").alias("code"), (F.col("ordinal") * 2 + i).alias("place")) for i, c in enumerate(("title_vi", "title_en"))]
    return both[0].unionByName(both[1]).filter("key != ''")


def last_wins(entries: DataFrame) -> DataFrame:
    """key, code, first_place: of equal keys the last code holds, at the first one's place, as a dictionary does."""
    return entries.groupBy("key").agg(F.max_by("code", "place").alias("code"), F.min("place").alias("first_place"))


def title_index(codes: DataFrame) -> DataFrame:
    return last_wins(title_entries(codes))


def alias_index(aliases: DataFrame) -> DataFrame:
    """aliases(code_3char, alias_norm, ordinal); ordinal is of any type that orders."""
    entries = aliases.select(fold_key(F.col("alias_norm")).alias("key"), F.col("code_3char").alias("code"), F.col("ordinal").alias("place"))
    return last_wins(entries.filter("key != ''"))


def fuzzy_index(codes: DataFrame) -> DataFrame:
    """code, choice, place: titles and aliases in order; empty ones go."""
    items = F.concat(F.array("title_vi", "title_en"), F.coalesce("aliases", F.array().cast("array<string>")))
    rows = codes.select(F.col("code_3char").alias("code"), "ordinal", F.posexplode(items).alias("pos", "choice"))
    return rows.filter("choice != ''").select("code", "choice", F.struct("ordinal", "pos").alias("place"))


def _link(mentions: DataFrame, index: DataFrame, key, method: str, score: float) -> DataFrame:
    found = mentions.withColumn("key", key).join(index.select("key", "code"), "key")
    return found.select("doc_id", "mention_id", F.col("code").alias("code_3char"), F.lit(method).alias("method"), F.lit(score).alias("score"), "char_start", "char_end")


def exact_links(mentions: DataFrame, titles: DataFrame) -> DataFrame:
    return _link(mentions, titles, fold_key(F.col("text")), "exact", 1.0)


def normalized_links(mentions: DataFrame, aliases: DataFrame) -> DataFrame:
    return _link(mentions, aliases, fold_key(F.col("normalized_text")), "normalized", 0.85)


def sorted_tokens(text: str) -> str:
    return " ".join(sorted(text.split()))


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence, all of b's columns at once as bits of one integer."""
    at: dict[str, int] = {}
    for i, c in enumerate(b):
        at[c] = at.get(c, 0) | 1 << i
    row, full = 0, (1 << len(b)) - 1
    for c in a:
        open_bits = row | at.get(c, 0)
        row = open_bits & ~(open_bits - ((row << 1) | 1)) & full
    return row.bit_count()


def token_sort_ratio(a: str, b: str) -> float:
    """100 * 2 * LCS / (len a + len b) of both texts with their words sorted; case counts."""
    a, b = sorted_tokens(a), sorted_tokens(b)
    return 100.0 * 2 * lcs_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def fuzzy_links(mentions: DataFrame, index: DataFrame, cutoff: float = 75.0, k: int = 10) -> DataFrame:
    """Links of method fuzzy: the k best entries from the cutoff on, by index order on ties, then the best one a code.

    Distinct mention texts only are scored, by pairs whose lengths allow the
    cutoff: 2 * least / (a + b) bounds the ratio. The pairs are found by length,
    an equi-join on each admissible length, so no product of both sides is made.
    """
    texts = mentions.select(F.col("text").alias("query")).filter("query != ''").distinct().withColumn("sorted_q", _sorted("query")).withColumn("n", F.length("sorted_q"))
    share = cutoff / (200.0 - cutoff)
    lengths = F.sequence(F.ceil(F.col("n") * share - 1e-9).cast("int"), F.floor(F.col("n") / share + 1e-9).cast("int"))
    choices = index.withColumn("sorted_c", _sorted("choice")).withColumn("m", F.length("sorted_c"))
    pairs = texts.withColumn("m", F.explode(lengths)).join(choices, "m").select("query", "sorted_q", "code", "sorted_c", "place")

    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([200.0 * lcs_length(a, b) / (len(a) + len(b)) if a or b else 100.0 for a, b in zip(left, right, strict=True)], dtype="float64")

    scored = pairs.withColumn("ratio", F.pandas_udf(ratio, "double")("sorted_q", "sorted_c")).filter(F.col("ratio") >= cutoff)
    best = scored.withColumn("rn", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("ratio"), "place"))).filter(F.col("rn") <= k)
    best = best.groupBy("query", "code").agg(F.max("ratio").alias("ratio"))
    return mentions.join(best, mentions["text"] == best["query"]).select("doc_id", "mention_id", F.col("code").alias("code_3char"), F.lit("fuzzy").alias("method"), (F.col("ratio") / 100).alias("score"), "char_start", "char_end")


def _sorted(column: str):
    return F.array_join(F.array_sort(F.array_remove(F.split(column, f"[{SPACE}]+"), "")), " ")


class Needles:
    """Keys and, once asked for in a process, their automaton."""

    def __init__(self, keys: list[str]):
        self.keys = keys
        self.machine = None

    def within(self, text: str) -> set[int]:
        if self.machine is None:
            self.machine = ahocorasick.Automaton()
            for i, key in enumerate(self.keys):
                if key:
                    self.machine.add_word(key, i)
            self.machine.make_automaton()
        found = {i for _, i in self.machine.iter(text)} if len(self.machine) else set()
        return found | {i for i, key in enumerate(self.keys[:1]) if not key}

    def __getstate__(self) -> list[str]:
        return self.keys

    def __setstate__(self, keys: list[str]) -> None:
        self.__init__(keys)


def contained_keys(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """doc_id, key, total: each of keys(key) that the text of a row of docs(doc_id, text) has as a substring, once, with the text's length.

    One pass over each text with an automaton of all keys, so the cost is that of
    the text and its finds, whatever the number of keys. The automaton is sent to
    executors within KEY_ROWS keys and KEY_CHARS characters; beyond them the keys
    are cut into pieces by hash, and each piece is one more pass. Null keys and
    texts have no finds; an empty key is in every text.
    """
    # null texts are left to the finder: a filter would compute the text twice, the first time below any exchange
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    keys = keys.select("key").filter("key IS NOT NULL").distinct()
    size = keys.agg(F.count("*"), F.coalesce(F.sum(F.length("key")), F.lit(0))).first()
    parts = max(1, -(-size[0] // KEY_ROWS), -(-size[1] // KEY_CHARS))
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = None
    for part in range(parts):
        piece = keys.filter(F.pmod(F.xxhash64("key"), F.lit(parts)) == part) if parts > 1 else keys
        needles = docs.sparkSession.sparkContext.broadcast(Needles(sorted(r[0] for r in piece.collect())))
        hit = docs.mapInArrow(_finder(needles), f"doc_id {kind}, key string, total int")
        found = hit if found is None else found.unionByName(hit)
    return found


def _finder(needles):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = needles.value
        for batch in batches:
            row, key, total = [], [], []
            for i, text in enumerate(batch.column(1)):
                text = text.as_py()
                if text is None:
                    continue
                for j in known.within(text):
                    row.append(i)
                    key.append(known.keys[j])
                    total.append(len(text))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(key, pa.string()), pa.array(total, pa.int32())], ["doc_id", "key", "total"])

    return run


def title_containment(docs: DataFrame, titles: DataFrame) -> DataFrame:
    """doc_id, code, score for titles that a document's text(doc_id, text) has as a substring.

    Of a code's titles the first in dictionary order counts. Score: ten times the
    share of the text that the title is, from 0.3 to 1.
    """
    return score_titles(contained_keys(docs.select("doc_id", F.lower("text").alias("text")), titles), titles)


def score_titles(found: DataFrame, titles: DataFrame) -> DataFrame:
    """title_containment of found(doc_id, key, total)."""
    found = found.join(titles, "key").select("doc_id", "code", "first_place", F.length("key").alias("len"), "total")
    first = found.groupBy("doc_id", "code").agg(F.min(F.struct("first_place", "len", "total")).alias("f"))
    raw = F.least(F.col("f.len") / F.greatest(F.col("f.total"), F.lit(1)) * 10, F.lit(1.0))
    return first.select("doc_id", "code", F.greatest(raw, F.lit(0.3)).alias("score"))
