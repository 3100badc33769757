"""SuperMinHash signatures (Ertl 2017), computed for many sets in lockstep.

Each element draws one random permutation of the signature's slots together
with one uniform number per step; slot p_j gets j + r_j. All first steps are
taken together, then all second ones, and so on. A set stops early: once each
slot holds a value below j + 1, steps from j + 1 on cannot lower any slot.
Values are 64-bit integers, step in the high half and uniform in the low half.
"""

from __future__ import annotations

import numpy as np

from codaria.llm.textops import GOLD, mix

_U = np.uint64
EMPTY = _U(0xFFFFFFFFFFFFFFFF)
#: Elements that take part in later steps together; bounds the permutation matrix.
BLOCK = 1 << 16


def signatures(values: np.ndarray, doc: np.ndarray, n_docs: int, slots: int) -> np.ndarray:
    """Signature matrix [n_docs, slots]; a document without elements keeps EMPTY.

    values: distinct element hashes, doc: ascending document index of each.
    """
    out = np.full((n_docs, slots), EMPTY, _U)
    if not len(values):
        return out
    flat = out.reshape(-1)
    low = _U(0xFFFFFFFF)
    draw = mix(values)
    slot = ((draw & low) * _U(slots)) >> _U(32)
    np.minimum.at(flat, doc * slots + slot.astype(np.int64), draw >> _U(32))
    open_docs = (out == EMPTY).any(axis=1)
    active = np.flatnonzero(open_docs[doc])
    edges = np.flatnonzero(np.diff(doc[active])) + 1
    begins = np.concatenate([[0], edges, [len(active)]])
    i = 0
    while i < len(begins) - 1:  # whole documents, as many as fit a block
        j = i + 1
        while j < len(begins) - 1 and begins[j + 1] - begins[i] <= BLOCK:
            j += 1
        rows = active[begins[i] : begins[j]]
        _later_steps(values[rows], doc[rows], slot[rows].astype(np.int64), out, slots)
        i = j
    return out


@np.errstate(over="ignore")
def _later_steps(values: np.ndarray, doc: np.ndarray, first: np.ndarray, out: np.ndarray, slots: int) -> None:
    low, flat = _U(0xFFFFFFFF), out.reshape(-1)
    perm = np.tile(np.arange(slots, dtype=np.uint16), (len(values), 1))
    row = np.arange(len(values))
    perm[row, first] = 0
    perm[row, 0] = first
    for step in range(1, slots):
        draw = mix(values + _U(step) * GOLD)
        swap = step + (((draw & low) * _U(slots - step)) >> _U(32)).astype(np.int64)
        target = perm[row, swap].astype(np.int64)
        perm[row, swap] = perm[row, step]
        np.minimum.at(flat, doc * slots + target, (_U(step) << _U(32)) | (draw >> _U(32)))
        here = np.unique(doc)
        unfinished = (out[here] >= (_U(step + 1) << _U(32))).any(axis=1)
        if unfinished.all():
            continue
        if not unfinished.any():
            return
        keep = unfinished[np.searchsorted(here, doc)]
        values, doc, perm = values[keep], doc[keep], perm[keep]
        row = np.arange(len(values))
