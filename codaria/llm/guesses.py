"""Guess cost of a password: the cheapest segmentation by dynamic programming.

best[i] is the least number of bits that guess the first i characters. A step
ends a segment at i: one brute-force character, a word, a date, a keyboard or
alphabet walk, or a repetition of what precedes it. Segments but the
brute-force ones are of bounded length, so the cost is linear in the value's
length, and a long walk or repetition costs as the pieces it is cut into.

Words come with ranks, from which a word's guesses follow. Common passwords come
first; a public tokenizer's vocabulary, whose entries are in order of frequency,
adds thousands of words (word_ranks).
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator, Mapping
from functools import lru_cache
from pathlib import Path

# Common password words, most common first.
WORDS = (
    "password qwerty admin welcome letmein monkey dragon master hello login princess sunshine football baseball "
    "shadow superman batman trustno michael jordan harley hunter ranger buster thomas robert soccer hockey killer "
    "george andrew charlie summer winter spring autumn love secret changeme default root user guest test example "
    "sample dummy demo token key pass code access server system database service account private public internal "
    "company office home computer internet google yahoo orange banana apple cookie chocolate flower pepper ginger "
    "maggie jessica ashley nicole daniel jennifer matthew joshua amanda cheese coffee tiger silver golden purple "
    "your here none null true false placeholder redacted hidden value string"
).split()
# Rows that fingers and alphabets run along.
WALKS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz", "qazwsxedcrfvtgbyhnujm", "0123456789")
# Letters that other characters stand for.
LEET = str.maketrans("4@83016!57$", "aabeoigists")
DATE = re.compile(r"(?:(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d)")

STEPS = {a + b for w in WALKS for row in (w, w[::-1]) for a, b in zip(row, row[1:], strict=False)}
BLOCK = 64
#: Bits that choosing one more segment adds.
CHOICE = 1.5
#: Bits of one sign between words, such as a space or a hyphen.
JOINT = 2.5
JOINTS = " -_."


@lru_cache(maxsize=4)
def word_ranks(vocabulary: str | None = None) -> dict[str, int]:
    """Words and their ranks from 1: the common ones, then those of a .tiktoken file that begin a word and have three letters or more, in its order."""
    words = list(WORDS)
    if vocabulary:
        for line in Path(vocabulary).read_bytes().splitlines():
            token = base64.b64decode(line.split()[0])
            if token[:1] == b" " and len(token) > 3 and token[1:].isalpha():
                words.append(token[1:].decode("ascii", "ignore").lower())
    return {w: i + 1 for i, w in enumerate(dict.fromkeys(w for w in words if w))}


def _alphabet(value: str) -> float:
    size = 0
    size += 26 * any("a" <= c <= "z" for c in value)
    size += 26 * any("A" <= c <= "Z" for c in value)
    size += 10 * any("0" <= c <= "9" for c in value)
    size += 33 * any(not c.isalnum() for c in value)
    size += 100 * any(ord(c) > 127 and c.isalnum() for c in value)
    if not value.strip("0123456789abcdefABCDEF"):
        size = min(size, 16)
    return math.log2(max(size, 2))


def segments(value: str, ranks: Mapping[str, int]) -> Iterator[tuple[int, int, float]]:
    """(start, end, bits) of each segment that a guesser may take, by start."""
    n = len(value)
    char = _alphabet(value)
    low = value.lower()
    if len(low) != n:  # a letter whose lower case is longer
        low = value
    plain = low.translate(LEET)
    longest = max(map(len, ranks), default=0)
    for i in range(n):
        yield i, i + 1, char
        if i and value[i] in JOINTS:
            yield i, i + 1, JOINT
        for size in range(3, min(longest, n - i) + 1):
            word = plain[i : i + size]
            rank = ranks.get(word) or ranks.get(low[i : i + size])
            if rank:
                own = value[i : i + size]
                yield i, i + size, math.log2(rank + 1) + CHOICE + (own.lower() != own) * 1.5 + (low[i : i + size] != word) * 1.5
        if value[i].isdigit() and (m := DATE.match(value, i)):
            yield i, m.end(), math.log2(365 * 120 if m.end() - i > 4 else 120) + CHOICE
        walk = i
        while walk + 1 < n and walk - i < BLOCK and low[walk] + low[walk + 1] in STEPS:
            walk += 1
            if walk - i >= 2:
                yield i, walk + 1, math.log2(len(STEPS) * (walk - i + 1)) + CHOICE
        for size in (1, 2, 3, 4, 6, 8):
            if size > i:
                break
            unit, end = value[i - size : i], i
            while end + size <= n and end - i < BLOCK and value[end : end + size] == unit:
                end += size
                yield i, end, math.log2((end - i) // size + 1) + CHOICE


def guess_bits(value: str, ranks: Mapping[str, int] | None = None) -> float:
    """Base-two logarithm of the guesses that the cheapest segmentation needs; 0 for the empty string."""
    best = [0.0] + [math.inf] * len(value)
    for start, end, bits in segments(value, word_ranks() if ranks is None else ranks):
        best[end] = min(best[end], best[start] + bits)
    return best[-1]
