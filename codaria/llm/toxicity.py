"""Toxicity: a linear-chain CRF tags words; forward-backward marginals give document scores and offsets.

Labels are of documents. Words are labelled from them: a word of a toxic
document is toxic if documents that hold it are toxic far more often than
others (log-odds and likelihood ratio over groups of similar texts, so that
copies count once). The CRF learns those labels from form and neighbours. A
logistic model of the marginals' sum, largest value and share of the words gives a document's score.
The fit uses at most train_toxic + train_clean documents and train_bytes of text of
either, by order of the MD5 of their id; its classes are weighed back to their shares of all labels.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codaria.llm.crf import OUTER, Chain, fit_chain
from codaria.llm.near_dedup import unite
from codaria.llm.storage import cut
from codaria.llm.textops import Words, chunks, shingle_sets, words_by_pieces, words_of


@dataclass(frozen=True)
class ToxicityConfig:
    train_toxic: int = 800
    train_clean: int = 1600
    #: Bytes of text, of either class, that the fit reads at most; it takes whole texts until the next would exceed them.
    train_bytes: int = 16 << 20
    threshold: float = 0.3
    #: A word is labelled toxic from this log-odds on, if its likelihood ratio exceeds twice the logarithm of the number of words tried.
    odds: float = 3.0
    rounds: int = 60
    span: float = 0.5


@dataclass
class ToxicityModel:
    """chain is None if the labels had not both classes; the score is then their share of toxic ones."""

    chain: Chain | None
    weights: np.ndarray
    prior: float

    def score(self, total: np.ndarray, most: np.ndarray, size: np.ndarray) -> np.ndarray:
        if self.chain is None:
            return np.full(len(total), self.prior)
        return 1 / (1 + np.exp(-(_inputs(total, most, size) @ self.weights)))


#: Words whose emissions a worker remembers of either generation: those met since the last turn, and those of the turn before.
MEMO = 1 << 17
#: Bytes of text scored at once; a word is looked up once in them.
CHUNK_BYTES = 2 << 20


def held_out(doc_id):
    """Whether the label of a document is kept from training."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def _inputs(total: np.ndarray, most: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(total)), np.log1p(total), most, np.log1p(1000 * total / np.maximum(size, 1))], axis=1)


def _by_document(words: Words, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum and largest of the marginals of each document, and its number of words."""
    n = len(words.first) - 1
    total = np.bincount(words.doc, p, n) if len(p) else np.zeros(n)
    most = np.zeros(n)
    np.maximum.at(most, words.doc, p)
    return total, most, np.diff(words.first)


def _begins(words: Words) -> np.ndarray:
    out = np.zeros(len(words.start), bool)
    at = words.first[:-1]
    out[at[np.diff(words.first) > 0]] = True
    return out


def _distinct(words: Words) -> tuple[list[str], np.ndarray, np.ndarray]:
    h = words.hashes()
    key, first, which = np.unique(h, return_index=True, return_inverse=True)
    raw = words.data.tobytes()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(words.start[first], words.end[first], strict=True)], which, key


def _toxic_words(column: pa.Array, words: Words, names: list[str], which: np.ndarray, toxic: np.ndarray, cfg: ToxicityConfig) -> np.ndarray:
    """Which distinct words are labelled toxic, by their letters or by their first letters, as inflected words share."""
    n, sets = len(toxic), []
    for lo, hi in chunks(column):
        (value,), doc = shingle_sets(words_of(column.slice(lo, hi - lo)))
        first = np.searchsorted(doc, np.arange(hi - lo + 1))
        sets += [value[first[i] : first[i + 1]] for i in range(hi - lo)]
    group = unite(sets, 20)
    groups = np.unique(group)
    label = np.zeros(n, bool)
    np.logical_or.at(label, group, toxic)
    many = label[groups].sum(), (~label[groups]).sum()
    forms = [OUTER.sub("", w.lower()) for w in names]
    out = np.zeros(len(names), bool)
    pair = np.unique(which.astype(np.int64) * n + group[words.doc])
    word, held = pair // n, pair % n  # each word of each group once
    for size in (None, 4, 5):
        keys = [f[:size] if size is None or len(f) > size else "" for f in forms]
        index = {k: i for i, k in enumerate(dict.fromkeys(keys))}
        of_word = np.array([index[k] for k in keys])
        seen = np.unique(of_word[word] * n + held)
        key, of_key = seen // n, label[seen % n]
        pos, neg = np.bincount(key, of_key, len(index)), np.bincount(key, ~of_key, len(index))
        # a syllable that clean words also begin with tells by how many different words of a text do so
        most, least = (np.bincount(of_word[word], y[held], len(index)) for y in (label, ~label))
        odds = np.log((most + 0.5) / (many[0] + 1)) - np.log((least + 0.5) / (many[1] + 1))
        with np.errstate(divide="ignore", invalid="ignore"):
            parts = [np.where(k > 0, k * np.log(k / ((pos + neg) * m / len(groups))), 0) for k, m in zip((pos, neg), many, strict=True)]
        chosen = (odds >= cfg.odds) & (sum(parts) >= np.log(len(index)))
        chosen[index.get("", len(index)) :][:1] = False
        out |= chosen[of_word]
    return out


def fit(texts: list[str], toxic: np.ndarray, shares: tuple[float, float], cfg: ToxicityConfig = ToxicityConfig()) -> ToxicityModel:
    """shares: the parts of clean and toxic documents among all labels."""
    if not toxic.any() or toxic.all():
        return ToxicityModel(None, np.zeros(4), float(toxic.mean()) if len(toxic) else 0.0)
    column = pa.array(texts, pa.large_string())
    words = words_by_pieces(column)
    names, which, _ = _distinct(words)
    bad = _toxic_words(column, words, names, which, toxic, cfg)
    begins = _begins(words)
    chain = fit_chain(names, which, begins, bad[which] & toxic[words.doc], cfg.rounds)
    emission = np.array([chain.emission(w) for w in names])[which]
    x, y = _inputs(*_by_document(words, chain.marginals(emission, begins))), toxic.astype(float)
    weight = np.where(toxic, shares[1] / toxic.mean(), shares[0] / (1 - toxic.mean()))
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ w)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(x.shape[1]), x.T @ (weight * (y - p)) - 0.5 * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return ToxicityModel(chain, w, float(shares[1]))


def sample(docs: DataFrame, labels: DataFrame, cfg: ToxicityConfig = ToxicityConfig()) -> tuple[DataFrame, tuple[float, float]]:
    """place, toxic, text of the documents that the fit reads, and the parts of clean and toxic ones among labels(doc_id, toxic) that are not held out; of several texts of an id, the smallest."""
    known = labels.filter(~held_out("doc_id") & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"), F.md5(F.col("doc_id").cast("string")).alias("place"))
    known = cut(known.join(docs.filter("text IS NOT NULL").select("doc_id"), "doc_id", "left_semi"))
    count = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = known.filter("toxic").orderBy("place").limit(cfg.train_toxic).union(known.filter("NOT toxic").orderBy("place").limit(cfg.train_clean))
    texts = docs.filter("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("place", "toxic").agg(F.min("text").alias("text"))
    # of train_toxic + train_clean rows at most
    so_far = F.sum(F.octet_length("text")).over(Window.partitionBy("toxic").orderBy("place"))
    rows = texts.withColumn("so_far", so_far).filter(F.col("so_far") <= cfg.train_bytes).select("place", "toxic", "text")
    n = max(1, sum(count.values()))
    return rows, (count.get(False, 0) / n, count.get(True, 0) / n)


def train(docs: DataFrame, labels: DataFrame, cfg: ToxicityConfig = ToxicityConfig()) -> ToxicityModel:
    """The model of sample(), fitted in one task, as the sample is bounded; the driver gets the model only."""
    rows, shares = sample(docs, labels, cfg)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        model = fit([r[2] for r in found], np.array([r[1] for r in found], bool), shares, cfg)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    first = rows.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(first["model"]) if first else fit([], np.zeros(0, bool), shares, cfg)


def toxicity_scores(docs: DataFrame, labels: DataFrame, cfg: ToxicityConfig = ToxicityConfig()) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, held_out, score, predicted, spans.

    score: 0 to 1, from the text alone. predicted: 1 from the threshold on. spans:
    offending words, start:end in code points, ends exclusive, comma-joined, next
    to each other united. Null, empty and blank texts have the score of a text
    without toxic words. Repeated rows come back as often; a null id is not held
    out; null labels are ignored and of several the toxic one holds; without both
    classes the score is the share of toxic labels. Other columns are ignored; an
    empty table gives an empty one.
    """
    docs = docs.select(F.col("doc_id"), F.col("text").cast("string"))
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, cfg))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        known: Memo = [{}, {}]
        for batch in batches:
            for a, b in chunks(batch.column(1), CHUNK_BYTES):
                words = words_of(batch.column(1).slice(a, b - a))
                n = b - a
                if m.chain is None:
                    found, spans = (np.zeros(n),) * 3, [""] * n
                else:
                    names, which, key = _lookup(words, known, m.chain)
                    p = m.chain.marginals(names[which], _begins(words))
                    found = _by_document(words, p)
                    spans = _spans(words, p >= cfg.span, n)
                score = m.score(*found)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, n), batch.column(2).slice(a, n), pa.array(score), pa.array((score >= cfg.threshold).astype(np.int32)), pa.array(spans, pa.string())],
                    ["doc_id", "held_out", "score", "predicted", "spans"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.withColumn("held_out", held_out("doc_id")).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, spans string")


def drop_toxic(docs: DataFrame, labels: DataFrame, cfg: ToxicityConfig = ToxicityConfig()) -> DataFrame:
    """The rows of docs(doc_id, text, ...) that toxicity_scores would not predict as toxic, with all their columns, in one pass."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, cfg))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        known: Memo = [{}, {}]
        for batch in batches:
            for a, b in chunks(batch.column(at), CHUNK_BYTES):
                part = batch.slice(a, b - a)
                if m.chain is None:
                    score = m.score(*(np.zeros(b - a),) * 3)
                else:
                    words = words_of(part.column(at))
                    emission, which, _ = _lookup(words, known, m.chain)
                    score = m.score(*_by_document(words, m.chain.marginals(emission[which], _begins(words))))
                yield part.filter(pa.array(score < cfg.threshold))

    return docs.mapInArrow(run, docs.schema)


Memo = list[dict[int, float]]


def _lookup(words: Words, memo: Memo, chain: Chain) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Emissions of the distinct words, and which one stands at each position; memo is bounded and by hash."""
    key, first, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
    if len(memo[0]) > MEMO:
        memo[:] = [{}, memo[0]]
    known, older = memo
    out = np.empty(len(key))
    raw = words.data.tobytes()
    for i, (k, at) in enumerate(zip(key.tolist(), first.tolist(), strict=True)):
        e = known.get(k)
        if e is None:
            e = older.get(k)
            if e is None:
                e = chain.emission(raw[words.start[at] : words.end[at]].decode("utf-8", "replace"))
            known[k] = e
        out[i] = e
    return out, which, key


def _spans(words: Words, bad: np.ndarray, n: int) -> list[str]:
    out: list[list[str]] = [[] for _ in range(n)]
    at = np.flatnonzero(bad)
    if len(at):
        point = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
        origin = np.zeros(n, np.int64)
        sized = np.flatnonzero(np.diff(words.first) > 0)
        text_begin = words.text_begin
        origin[sized] = point[text_begin[sized]]
        i = 0
        while i < len(at):
            j = i
            while j + 1 < len(at) and at[j + 1] == at[j] + 1 and words.doc[at[j + 1]] == words.doc[at[i]]:
                j += 1
            d = words.doc[at[i]]
            out[d].append(f"{point[words.start[at[i]]] - origin[d]}:{point[words.end[at[j]]] - origin[d]}")
            i = j + 1
    return [",".join(x) for x in out]
