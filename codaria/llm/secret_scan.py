"""Secrets: base patterns, and values in credential contexts by their guess cost."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codaria.llm.guesses import guess_bits, word_ranks
from codaria.llm.spans import SPAN_SQL, Span, Taken, digests
from codaria.llm.textops import chunks

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "guess")

ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}+")
CONTEXT = re.compile(
    r"""(?ai:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[ _-]?key|access[ _-]?key|auth(?:orization)?|bearer|credentials?|private[ _-]?key)"""
    r"""["']?[\x20\t]{0,8}(?::=|=>|={1,3}|:)[\x20\t]{0,8}(?:(?ai:bearer|basic)[\x20\t]{1,8})?(?:"([^"\n]+)"|'([^'\n]+)'|([^\s"',;<>]+))"""
)


@dataclass(frozen=True)
class SecretConfig:
    #: A value in a credential context is a secret from this many bits of guesses on (about 10^11).
    bits: float = 36.0
    #: Path of a .tiktoken vocabulary whose words guessers know besides the common ones; read on the driver.
    vocabulary: str | None = None


def base_matches(text: str) -> list[tuple[Span, str]]:
    """Base spans and the value that each one gives away."""
    found = []
    if ":" in text or "=" in text:
        found += [(Span(m.start(), m.end(), "assign"), m.group(1)) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        found += [(Span(m.start(), m.end(), "access"), m.group()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return found + [(Span(m.start(), m.end(), "hex"), m.group()) for m in HEX.finditer(text)]


def secret_spans(text: str, cfg: SecretConfig = SecretConfig(), ranks: Mapping[str, int] | None = None) -> list[Span]:
    """Base spans with the bits of their values, and spans of kind guess: values in a credential context, phrases in quotes too, whose guess cost is high and that no base span holds whole."""
    if ranks is None:
        ranks = word_ranks(cfg.vocabulary)
    found = [Span(s.start, s.end, s.kind, False, guess_bits(value, ranks)) for s, value in base_matches(text)]
    if ":" in text or "=" in text:
        taken = Taken((s.start, s.end) for s in found)
        for m in CONTEXT.finditer(text):
            begin, end = m.span(m.lastindex)
            if taken.covers(begin, end):
                continue
            bits = guess_bits(text[begin:end], ranks)
            if bits >= cfg.bits:
                found.append(Span(begin, end, "guess", True, bits))
    return found


def scan_secrets(docs: DataFrame, cfg: SecretConfig = SecretConfig()) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, n_assign, n_access, n_hex, base_sha256, spans, found.

    Offsets are code points, ends exclusive. found lists all spans with kind,
    start, end, added and score, the bits of guesses of the value. Null and empty
    texts have no spans. Repeated rows come back as often, null ids as null;
    other columns are ignored, and an empty table gives an empty one.
    """
    names = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "found"]
    docs, ranks = docs.select("doc_id", F.col("text").cast("string")), word_ranks(cfg.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(batch.column(1)):
                texts = batch.column(1).slice(a, b - a).to_pylist()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *digests(texts, lambda t: secret_spans(t, cfg, ranks), KINDS, BASE)], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in BASE) + f", base_sha256 string, spans string, found {SPAN_SQL}")


def redact_secrets(docs: DataFrame, cfg: SecretConfig = SecretConfig(), mark: str = "[SECRET]") -> DataFrame:
    """docs with the spans of scan_secrets replaced in text; spans that touch or overlap become one mark.

    All rows and columns stay; a column n_chars follows the text's new length.
    """
    at, ranks = docs.columns.index("text"), word_ranks(cfg.vocabulary)

    def clean(text: str | None) -> str | None:
        spans = sorted((s.start, s.end) for s in secret_spans(text, cfg, ranks)) if text else []
        if not spans:
            return text
        out, last, open_end = [], 0, -1
        for start, end in spans:
            if start > open_end:
                out += [text[last:start], mark]
            open_end = last = max(open_end, end)
        return "".join(out) + text[last:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(batch.column(at)):
                part = batch.slice(a, b - a)
                texts = pa.array([clean(t) for t in part.column(at).to_pylist()], part.schema.field(at).type)
                yield part.set_column(at, part.schema.field(at), texts)

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return out.select(*docs.columns)
