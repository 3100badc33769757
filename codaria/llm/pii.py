"""Personal data: base patterns, and boosted trees over generously proposed candidates.

Generators of high recall propose overlapping spans: masked e-mail addresses,
telephone numbers without a country prefix, card-like digits, IPv6 and mapped
addresses, and identity numbers. Trees see each one's format and context, and
calibrated thresholds, one a kind, select. Of overlapping candidates the likeliest
stays. The trees are fitted on the driver on `train_rows` candidates written by
the templates below, with as many again to calibrate; nothing depends on the input.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codaria.llm.boosting import BoostedTrees
from codaria.llm.spans import SPAN_SQL, Span, Taken, digests, emails, luhn
from codaria.llm.textops import chunks

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "id")

IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

# Candidates. All are bounded in length, so none can scan a text more than a few times.
MASKED = re.compile(r"[A-Za-z0-9._%+-]{1,64}\s?(?:\[at\]|\(at\)|\{at\}|@)\s?[A-Za-z0-9-]{1,64}(?:\s?(?:\.|\[dot\]|\(dot\)|\{dot\})\s?[A-Za-z0-9-]{1,64}){1,6}")
NUMBER = re.compile(r"(?<![\w.+/-])(?:\(\d{2,5}\)[ .-]?)?\d{1,5}(?:[ .-]\d{2,5}){1,5}(?![\w/-])")
RUN = re.compile(r"(?<![\w.])\d{9,19}(?![\w.])")
IPV6 = re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")

# Words that stand before each kind, and before numbers that are none.
CONTEXT = {
    "email": "mail email e-mail contact write reach",
    "ip": "ip host address server client ipv6",
    "card": "card visa mastercard amex credit debit payment",
    "phone": "phone tel telephone call mobile fax cell dial ring sms whatsapp",
    "id": "ssn social security iban passport account national identity",
    "none": "order invoice version isbn issn sku page date id ref no number serial build ticket part total lot tracking",
}
WORD_CONTEXT = {w: k for k, ws in CONTEXT.items() for w in ws.split()}
BEFORE = re.compile(r"[A-Za-z-]+")


@dataclass(frozen=True)
class PiiConfig:
    train_rows: int = 4000
    #: Least calibrated probability by kind.
    thresholds: tuple[tuple[str, float], ...] = (("email", 0.8), ("ip", 0.8), ("card", 0.9), ("phone", 0.9), ("id", 0.85))
    seed: int = 11


def base_spans(text: str) -> list[Span]:
    found = [Span(a, b, "email") for a, b in emails(text)]
    if DIGIT.search(text):
        found += [Span(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m.group().split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append(Span(m.start(), m.end(), "card"))
        if "+" in text:
            found += [Span(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return found


def candidates(text: str) -> list[tuple[int, int, str]]:
    """Overlapping spans that may be personal data."""
    out = []
    if "@" in text or "at]" in text or "at)" in text or "at}" in text:
        out += [(m.start(), m.end(), "email") for m in MASKED.finditer(text)]
    if DIGIT.search(text):
        out += [(m.start(), m.end(), "phone") for m in NUMBER.finditer(text)]
        for m in RUN.finditer(text):
            out += [(m.start(), m.end(), "phone"), (m.start(), m.end(), "card")]
        out += [(m.start(), m.end(), "card") for m in CARD.finditer(text) if 13 <= m.end() - m.start() <= 24]
        out += [(m.start(), m.end(), "id") for m in SSN.finditer(text)]
        out += [(m.start(), m.end(), "id") for m in IBAN.finditer(text)]
        if ":" in text:
            out += [(m.start(), m.end(), "ip") for m in IPV6.finditer(text)]
    return out


def _iban_sound(value: str) -> bool:
    s = value.replace(" ", "")
    return s[:2].isalpha() and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    """Format of the span, and what stands around it."""
    value = text[start:end]
    digits = "".join(c for c in value if "0" <= c <= "9")
    groups = [g for g in re.split(r"[^0-9]+", value) if g]
    words = [w.lower() for w in BEFORE.findall(text[max(0, start - 40) : start])][-4:]
    near = [WORD_CONTEXT.get(w.strip("-")) for w in words]
    before, after = text[start - 1 : start], text[end : end + 1]
    date = len(groups) == 3 and sorted(map(len, groups)) in ([2, 2, 4], [1, 2, 4], [2, 2, 2])
    return [
        *(float(kind == k) for k in KINDS),
        len(value), len(digits), len(digits) / max(len(value), 1), len(groups),
        max(map(len, groups), default=0), min(map(len, groups), default=0),
        float(12 <= len(digits) <= 19 and luhn(digits)), float("(" in value), float("." in value), float("-" in value), float(" " in value),
        float(len(set(digits)) <= 2), float(date), float(kind == "id" and value[:2].isalpha() and _iban_sound(value)),
        float(any(t in value for t in ("[at]", "(at)", "{at}"))), float("@" in value),
        *(float(k in near) for k in CONTEXT), float(near[-1] == kind) if near else 0.0,
        float(before.isalnum()), float(after.isalnum()), float(before in "#$€" if before else False), float(after == "%"),
    ]


def _templates(rng: random.Random) -> tuple[str, int, int, str, int]:
    """A text, a candidate in it and its label."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randint(2, 9)))
    kind = rng.choice(KINDS)
    label = int(rng.random() < 0.5)
    lead = " ".join(word() for _ in range(rng.randint(0, 5)))
    hint = rng.choice(CONTEXT[kind].split()) if label and rng.random() < 0.85 else rng.choice(CONTEXT["none"].split()) if not label and rng.random() < 0.4 else word()
    if kind == "email":
        a, t = rng.choice(["[at]", "(at)", "{at}", " [at] ", " (at) "]), rng.choice([".", "[dot]", "(dot)", " [dot] ", " (dot) "])
        value = f"{word()}{a}{word()}{t}{rng.choice(['com', 'org', 'net', 'de', 'fr'])}" if label else f"{word()} @ {d(2)}.{d(2)}"
    elif kind == "phone":
        s = rng.choice("-. ")
        value = rng.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}{s}{d(3)}{s}{d(4)}", f"0{d(3)}{s}{d(3)}{s}{d(3)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}"]) if label else rng.choice([f"{d(4)}-{d(2)}-{d(2)}", f"{d(2)}.{d(2)}.{d(4)}", f"{d(1)}.{d(2)}", f"{d(9)}", f"{d(12)}", f"{d(3)} {d(3)}", f"{d(2)} {d(5)}", f"{d(5)}-{d(4)}"])
    elif kind == "card":
        body = d(15)
        value = body + next(c for c in "0123456789" if luhn(body + c)) if rng.random() < 0.5 else d(16)
        if label and rng.random() < 0.5:
            value = " ".join(value[i : i + 4] for i in range(0, 16, 4))
        elif not label:
            value = d(rng.randint(13, 18))
    elif kind == "ip":
        value = ":".join(f"{rng.randrange(65536):x}" for _ in range(8)) if label else ":".join(d(2) for _ in range(8))
    elif label:
        country, body = rng.choice(["DE", "FR", "GB", "ES"]), d(18)
        check = 98 - int(body + "".join(str(int(c, 36)) for c in country) + "00") % 97
        value = rng.choice([f"{d(3)}-{d(2)}-{d(4)}", f"{country}{check:02d}{body}"])
    else:
        value = f"{rng.choice(['AB', 'XK', 'RF'])}{d(2)}{d(8)}"
    text = f"{lead} {hint}{rng.choice([' ', ': ', ' is '])}{value} {word()}"
    start = text.index(value, len(lead))
    return text, start, start + len(value), kind, label


@lru_cache(maxsize=4)
def trained(cfg: PiiConfig = PiiConfig()) -> BoostedTrees:
    rng = random.Random(cfg.seed)
    rows = [_templates(rng) for _ in range(2 * cfg.train_rows)]
    x = np.array([features(*r[:4]) for r in rows])
    y = np.array([r[4] for r in rows], float)
    n = cfg.train_rows
    return BoostedTrees().fit(x[:n], y[:n]).calibrate(x[n:], y[n:])


def pii_spans(text: str, model: BoostedTrees, cfg: PiiConfig = PiiConfig()) -> list[Span]:
    """Base spans, and the model's spans that overlap none of them or hold those that they overlap whole; all with the model's probability."""
    base = base_spans(text)
    proposed = list(dict.fromkeys(candidates(text)))
    own = [(s.start, s.end, s.kind) for s in base]
    if not own and not proposed:
        return []
    p = model.probability(np.array([features(text, *c) for c in own + proposed]))
    found = [Span(*c, False, float(q)) for c, q in zip(own, p, strict=False)]
    least = dict(cfg.thresholds)
    taken, chosen = Taken(), Taken((s.start, s.end) for s in base)
    edges = [x for s in base for x in (s.start, s.end)]
    for (start, end, kind), score in sorted(zip(proposed, p[len(own) :], strict=True), key=lambda x: (-x[1], x[0])):
        if score < least[kind] or taken.overlaps(start, end) or chosen.covers(start, end):
            continue
        if chosen.overlaps(start, end) and any(a < e < b for e in (start, end) for a, b in zip(edges[::2], edges[1::2], strict=True)):
            continue
        found.append(Span(start, end, kind, True, float(score)))
        taken.add(start, end)
    return found


def find_pii(docs: DataFrame, cfg: PiiConfig = PiiConfig()) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, found.

    Counts and base_sha256 are of base spans; spans and found have the added ones
    too, found with the calibrated probability of each. Offsets are code points, ends exclusive. Null and empty texts have no
    spans. Repeated rows come back as often, null ids as null; other columns are
    ignored, and an empty table gives an empty one.
    """
    model = trained(cfg)
    names = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "found"]
    docs = docs.select("doc_id", F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(batch.column(1)):
                texts = batch.column(1).slice(a, b - a).to_pylist()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *digests(texts, lambda t: pii_spans(t, model, cfg), KINDS, BASE)], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in BASE) + f", base_sha256 string, spans string, found {SPAN_SQL}")


def redact(text: str, spans: list[Span]) -> str:
    """text with each span replaced by its kind in brackets; overlapping spans become one."""
    out, last = [], 0
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if s.start >= last:
            out += [text[last : s.start], f"[{s.kind.upper()}]"]
        last = max(last, s.end)
    return "".join(out) + text[last:]
