"""A two-state linear-chain conditional random field over words.

Many texts are one long chain: at a text's first word the transition is the
start distribution whatever the state before, which cuts the chain exactly.
The chain is folded into segments; their transfer matrices are multiplied in
lockstep, segments are then joined in order, and a second sweep gives each
word's forward (or backward) message. So the cost is a few array operations a
position of a segment, however long the texts are.
"""

from __future__ import annotations

import re
import zlib
from array import array
from dataclasses import dataclass
from functools import cached_property

import numpy as np

SEGMENT = 48
# Letters that other characters stand for.
LEET = str.maketrans("4@83016!57$", "aabeoigists")
OUTER = re.compile(r"[\W_]+")
TWICE = re.compile(r"(.)\1+")
SLOTS = 1 << 18


def _letters(text: str) -> str:
    return text if text.isalnum() else OUTER.sub("", text)


_BIAS, _UPPER, _NONE = (zlib.crc32(n) % SLOTS for n in (b"bias", b"upper", b"none"))
_WORD, _PLAIN, _HEAD, _TAIL = (zlib.crc32(n) for n in (b"w:", b"s:", b"p:", b"x:"))


def word_features(word: str) -> list[int]:
    """Slots of a word's features: its letters, a form without disguise, both ends, capitals."""
    low = word.lower()
    core = _letters(low)
    plain = TWICE.sub(r"\1", core if low.isalpha() else _letters(low.translate(LEET)))
    crc, whole = zlib.crc32, plain.encode()
    head, tail = (whole[:4], whole[-4:]) if len(whole) == len(plain) else (plain[:4].encode(), plain[-4:].encode())
    out = [_BIAS, crc(core.encode(), _WORD) % SLOTS, crc(whole, _PLAIN) % SLOTS, crc(head, _HEAD) % SLOTS, crc(tail, _TAIL) % SLOTS]
    if word.isupper() and len(core) > 1:
        out.append(_UPPER)
    if not core:
        out.append(_NONE)
    return out


def _messages(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised row vectors (x, y) of v_t = v_(t-1) [[a, b], [c, d]]_t from a uniform v."""
    n = len(a)
    width = -(-n // SEGMENT)

    def folded(x: np.ndarray, rest: float) -> np.ndarray:
        # positions first, so that each step reads contiguous rows
        out = np.full(width * SEGMENT, rest)
        out[:n] = x
        return np.ascontiguousarray(out.reshape(width, SEGMENT).T)

    a, b, c, d = folded(a, 1.0), folded(b, 0.0), folded(c, 0.0), folded(d, 1.0)
    m00, m01, m10, m11 = np.ones(width), np.zeros(width), np.zeros(width), np.ones(width)
    for t in range(SEGMENT):
        m00, m01, m10, m11 = m00 * a[t] + m01 * c[t], m00 * b[t] + m01 * d[t], m10 * a[t] + m11 * c[t], m10 * b[t] + m11 * d[t]
        if t % 12 == 11:
            s = m00 + m01 + m10 + m11
            m00, m01, m10, m11 = m00 / s, m01 / s, m10 / s, m11 / s
    first = np.empty((width, 2))
    x, y = 0.5, 0.5
    for k, (p, q, r, s) in enumerate(zip(m00.tolist(), m01.tolist(), m10.tolist(), m11.tolist(), strict=True)):
        first[k] = x, y
        x, y = x * p + y * r, x * q + y * s
        z = x + y
        x, y = x / z, y / z
    x, y = first[:, 0].copy(), first[:, 1].copy()
    left, right = np.empty((SEGMENT, width)), np.empty((SEGMENT, width))
    for t in range(SEGMENT):
        x, y = x * a[t] + y * c[t], x * b[t] + y * d[t]
        z = x + y
        x, y = x / z, y / z
        left[t], right[t] = x, y
    return left.T.reshape(-1)[:n], right.T.reshape(-1)[:n]


@dataclass
class Chain:
    """weights of word features for the toxic state, log transition scores [2, 2] and log start scores [2]."""

    weights: np.ndarray
    trans: np.ndarray
    start: np.ndarray

    @cached_property
    def _scores(self) -> list[float]:
        return self.weights.tolist()

    def emission(self, word: str) -> float:
        scores = self._scores
        return sum([scores[i] for i in word_features(word)])

    def messages(self, emission: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For the clean and the toxic state, forward messages that include each word's emission, then backward ones that don't."""
        toxic = 1 / (1 + np.exp(-np.clip(emission, -30, 30)))
        clean = 1 - toxic
        t, s = np.exp(self.trans), np.exp(self.start)
        a, b = np.where(begins, s[0], t[0, 0]) * clean, np.where(begins, s[1], t[0, 1]) * toxic
        c, d = np.where(begins, s[0], t[1, 0]) * clean, np.where(begins, s[1], t[1, 1]) * toxic
        f0, f1 = _messages(a, b, c, d)
        n = len(emission)
        b0, b1 = np.ones(n), np.ones(n)
        if n > 1:
            after = np.flatnonzero(begins[1:][::-1])
            back = [x[1:][::-1].copy() for x in (a, c, b, d)]
            for x in back:
                x[after] = 1.0  # a text's last word has nothing behind it
            g0, g1 = _messages(*back)
            b0[:-1], b1[:-1] = g0[::-1], g1[::-1]
        return f0, f1, b0, b1

    def marginals(self, emission: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Probability of the toxic state for each word, by forward-backward."""
        out = np.zeros(len(emission))
        for lo, hi in _blocks(begins) if len(emission) else ():
            f0, f1, b0, b1 = self.messages(emission[lo:hi], begins[lo:hi])
            p = f1 * b1
            out[lo:hi] = p / (f0 * b0 + p)
        return out


def _blocks(begins: np.ndarray, size: int = 1 << 16) -> list[tuple[int, int]]:
    """Ranges of whole documents of about size words; a longer document is one."""
    edges = np.append(np.flatnonzero(begins), len(begins))
    out, lo = [], 0
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if a > lo and b - lo > size:
            out.append((lo, int(a)))
            lo = int(a)
    return [*out, (lo, len(begins))]


def _expected(chain: Chain, emission: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of the toxic state, and expected counts of transitions and of first states."""
    f0, f1, b0, b1 = chain.messages(emission, begins)
    p = f1 * b1
    p = p / (f0 * b0 + p)
    toxic = 1 / (1 + np.exp(-np.clip(emission, -30, 30)))
    inner = np.flatnonzero(~begins)
    t = np.exp(chain.trans)
    g0, g1 = ((1 - toxic) * b0)[inner], (toxic * b1)[inner]
    h0, h1 = f0[inner - 1], f1[inner - 1]
    parts = [h0 * g0 * t[0, 0], h0 * g1 * t[0, 1], h1 * g0 * t[1, 0], h1 * g1 * t[1, 1]]
    whole = 1 / (parts[0] + parts[1] + parts[2] + parts[3])
    pair = np.array([(x * whole).sum() for x in parts]).reshape(2, 2)
    return p, pair, np.array([(1 - p[begins]).sum(), p[begins].sum()])


def fit_chain(words: list[str], which: np.ndarray, begins: np.ndarray, labels: np.ndarray, rounds: int = 60, rate: float = 0.3, ridge: float = 2e-4) -> Chain:
    """Maximum likelihood by full-batch Adam. words: distinct ones; which: the index of each position's word."""
    slots, ends = array("i"), array("i")
    for w in words:
        slots.extend(word_features(w))
        ends.append(len(slots))
    flat = np.frombuffer(slots, np.int32)
    owner = np.repeat(np.arange(len(words), dtype=np.int32), np.diff(ends, prepend=0))
    n, y = len(which), labels.astype(np.int64)
    chain = Chain(np.zeros(SLOTS), np.zeros((2, 2)), np.zeros(2))
    seen = np.unique(flat)
    slot_of = np.searchsorted(seen, flat)
    params = np.zeros(len(seen) + 6)
    m, v = np.zeros_like(params), np.zeros_like(params)
    inner = np.flatnonzero(~begins)
    observed_pair = np.bincount(2 * y[inner - 1] + y[inner], minlength=4).reshape(2, 2)
    observed_start = np.bincount(y[begins], minlength=2)
    blocks = _blocks(begins)
    for step in range(1, rounds + 1):
        chain.weights[seen] = params[:-6]
        chain.trans = params[-6:-2].reshape(2, 2)
        chain.start = params[-2:]
        of_word = np.bincount(owner, chain.weights[flat], len(words))
        by_word, pair, start = np.zeros(len(words)), np.zeros((2, 2)), np.zeros(2)
        for lo, hi in blocks:  # whole documents; bounds the messages held at once
            p, own_pair, own_start = _expected(chain, of_word[which[lo:hi]], begins[lo:hi])
            by_word += np.bincount(which[lo:hi], y[lo:hi] - p, len(words))
            pair += own_pair
            start += own_start
        grad = np.concatenate([np.bincount(slot_of, by_word[owner], len(seen)), (observed_pair - pair).ravel(), observed_start - start]) / n
        grad -= ridge * params / len(seen)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        params = params + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    chain.weights[seen] = params[:-6]
    chain.trans, chain.start = params[-6:-2].reshape(2, 2), params[-2:]
    return chain
