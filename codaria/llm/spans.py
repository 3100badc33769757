"""Spans of code points in whole texts, shared by the PII and secret operators."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa


@dataclass(frozen=True)
class Span:
    """A half-open range of code points; added spans come from the model, not from the base patterns."""

    start: int
    end: int
    kind: str
    added: bool = False
    score: float = 1.0


#: Anchored searches below start where a match can start and never rescan what
#: can't match, so long runs of one character cost time in proportion to them.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of local@domain: each @ with the run of local characters before it."""
    last, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in LOCAL:
            begin -= 1
        found = DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            yield begin, found.end()
            last = found.end()
        at = text.find("@", max(at + 1, last))


class Taken:
    """Disjoint ranges in order, so that a look-up costs the logarithm of their number."""

    def __init__(self, ranges: Iterable[tuple[int, int]] = ()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end in sorted(ranges):
            if self.ends and start <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def overlaps(self, start: int, end: int) -> bool:
        i = bisect_right(self.ends, start)
        return i < len(self.starts) and self.starts[i] < end

    def covers(self, start: int, end: int) -> bool:
        """Whether one of these holds the whole range."""
        i = bisect_right(self.ends, start)
        return i < len(self.starts) and self.starts[i] <= start and end <= self.ends[i]

    def add(self, start: int, end: int) -> None:
        """Adds a range that overlaps none of these."""
        i = bisect_right(self.starts, start)
        self.starts.insert(i, start)
        self.ends.insert(i, end)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def ordered(spans: Sequence[Span], kinds: Sequence[str]) -> list[Span]:
    rank = {k: i for i, k in enumerate(kinds)}
    return sorted(spans, key=lambda s: (s.start, rank[s.kind], s.end))


def digest_text(spans: Sequence[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def digests(texts: Sequence[str | None], find: Callable[[str], list[Span]], kinds: Sequence[str], base: Sequence[str]) -> list[pa.Array]:
    """Arrays of base counts by kind, base_sha256, spans and the list of span structs."""
    counts: list[list[int]] = [[] for _ in base]
    sha, joined, listed = [], [], []
    for text in texts:
        spans = ordered(find(text or ""), kinds)
        own = [s for s in spans if not s.added]
        for i, kind in enumerate(base):
            counts[i].append(sum(s.kind == kind for s in own))
        sha.append(hashlib.sha256(digest_text(own).encode()).hexdigest())
        joined.append(digest_text(spans))
        listed.append([{"kind": s.kind, "start": s.start, "end": s.end, "added": s.added, "score": s.score} for s in spans])
    return [*(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array(joined, pa.string()), pa.array(listed, SPAN_ARROW)]


SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("added", pa.bool_()), ("score", pa.float64())]))
SPAN_SQL = "array<struct<kind:string,start:long,end:long,added:boolean,score:double>>"
