"""Whole-text word operations on UTF-8 bytes, vectorised over many documents at once.

A word is a maximal run of characters other than space and U+0009..U+000D.
All separators are ASCII, so words can be found on the bytes of UTF-8 text.
Word hashes are 64-bit polynomials over bytes with a random table and an odd
base, finished by a bijective mixer. Runs of words are polynomials over these
hashes; two of them, over word hashes mixed in two ways and with two bases, give a
run 128 bits, so that runs of different words differ but for words that share
their 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U = np.uint64
GOLD = _U(0x9E3779B97F4A7C15)
MIX1 = _U(0xBF58476D1CE4E5B9)
MIX2 = _U(0x94D049BB133111EB)
#: Bytes of text whose temporary arrays are held at once.
CHUNK_BYTES = 1 << 19
#: Words hashed at once.
HASH_WORDS = 1 << 18


@np.errstate(over="ignore")
def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection on 64-bit words."""
    x = (x ^ (x >> _U(30))) * MIX1
    x = (x ^ (x >> _U(27))) * MIX2
    return x ^ (x >> _U(31))


def _table(seed: int) -> np.ndarray:
    return mix((np.arange(256, dtype=_U) + _U(1 + 256 * seed)) * GOLD)


TABLE = _table(0)
BASE = _U(0x9FB21C651E98DF25)
WORD_BASES = [_U(0xA0761D6478BD642F), _U(0xE7037ED1A0B428DB)]


@np.errstate(over="ignore")
def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


@dataclass
class Words:
    """The words of several documents, one after the other."""

    data: np.ndarray  #: bytes of all texts
    start: np.ndarray  #: first byte of each word
    end: np.ndarray  #: byte after each word
    doc: np.ndarray  #: index of each word's document
    first: np.ndarray  #: words before each document; one entry more than documents
    text_begin: np.ndarray  #: first byte of each document

    def hashes(self) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, _U)
        out = np.empty(len(self.start), _U)
        for lo in range(0, len(out), HASH_WORDS):
            start, length = self.start[lo : lo + HASH_WORDS], (self.end - self.start)[lo : lo + HASH_WORDS]
            at = np.cumsum(length) - length
            within = np.arange(int(length.sum())) - np.repeat(at, length)
            byte = self.data[within + np.repeat(start, length)]
            terms = TABLE[byte] * _powers(BASE, int(length.max()))[within]
            out[lo : lo + HASH_WORDS] = mix(np.add.reduceat(terms, at) + length.astype(_U) * GOLD)
        return out


@np.errstate(over="ignore")
def seeded(hashes: np.ndarray, seed: int) -> np.ndarray:
    """Word hashes as the runs of a seed take them."""
    return mix(hashes + _U(seed) * GOLD) if seed else hashes


def words_of(column: pa.Array, lower: bool = False) -> Words:
    """Words of each text of an Arrow string column; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    data = data[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if lower:
        data = LOWER[data]
    solid = ~SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < len(data)]
    begins[inner] = solid[inner]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    last = inner[inner > 0] - 1
    ends[last] = solid[last]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(column)), np.diff(first))
    return Words(data, start, end, doc, first, offsets[:-1])


def words_by_pieces(column: pa.Array) -> Words:
    """words_of, with temporary arrays of a piece only."""
    parts = [(lo, words_of(column.slice(lo, hi - lo))) for lo, hi in chunks(column)]
    if not parts:
        return words_of(column)
    begin = np.cumsum([0, *(len(w.data) for _, w in parts)])
    count = np.cumsum([0, *(len(w.start) for _, w in parts)])
    joined = lambda f: np.concatenate([f(w, i) for i, (_, w) in enumerate(parts)])
    first = np.append(joined(lambda w, i: w.first[:-1] + count[i]), count[-1])
    return Words(
        joined(lambda w, i: w.data), joined(lambda w, i: w.start + begin[i]), joined(lambda w, i: w.end + begin[i]), joined(lambda w, i: w.doc + parts[i][0]), first, joined(lambda w, i: w.text_begin + begin[i])
    )


@np.errstate(over="ignore")
def runs(hashes: np.ndarray, doc: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of k consecutive words of one document, and each run's first word."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    base = WORD_BASES[seed]
    # value[w] covers w words; widths double, as in binary powers of k
    out, done, width, value, power = None, 0, 1, hashes, base
    rest = k
    while rest:
        if rest & 1:
            if out is None:
                out, done, scale = value, width, power
            else:
                size = min(len(out), len(value) - done)
                out = out[:size] + scale * value[done : done + size]
                scale = scale * power
                done += width
        rest >>= 1
        if rest:
            value = value[: len(value) - width] + power * value[width:]
            power = power * power
            width *= 2
    valid = np.flatnonzero(doc[:n] == doc[k - 1 :])
    return mix(out[:n][valid]), valid


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts together hold at most limit bytes; a longer text comes alone."""
    if not len(column):
        return
    sizes = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    total, begin = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > limit:
            yield begin, i
            begin, total = i, 0
        total += size
    yield begin, len(sizes)


@np.errstate(over="ignore")
def shingle_sets(words: Words, k: int = 5, seeds: tuple[int, ...] = (0,)) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct hashes of each document's k-word runs, sorted by document then hash, and each one's document.

    A document of 1 to k-1 words has its whole sequence as its one shingle.
    With two seeds the second hash is that of the first run with that first hash.
    """
    found = []
    short = np.flatnonzero((np.diff(words.first) > 0) & (np.diff(words.first) < k))
    where = None
    plain = words.hashes()
    for seed in seeds:
        h = seeded(plain, seed)
        value, where = runs(h, words.doc, k, seed)
        extra = np.zeros(len(short), _U)
        for j, d in enumerate(short):
            part = h[words.first[d] : words.first[d + 1]]
            extra[j] = mix((part * _powers(WORD_BASES[seed], len(part))).sum(dtype=_U) + _U(len(part)))[()]
        found.append(np.concatenate([value, extra]))
    doc = np.concatenate([words.doc[where], short]) if len(words.doc) else short
    order = np.lexsort((found[0], doc))
    doc, main = doc[order], found[0][order]
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (main[1:] != main[:-1])
    return [f[order][keep] for f in found], doc[keep]
