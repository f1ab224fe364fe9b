"""Words of text columns, found on the bytes of whole Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from imprynt.llm.common import LOWER, byte_view

#: Kinds of bytes: what parts words, what words are made of, and what also ends a piece.
GAP, WORD, END = 0, 1, 2
_LOWER = np.frombuffer(LOWER, np.uint8)


def kinds(gaps: bytes, ends: bytes = b"") -> np.ndarray:
    """A table of byte kinds: gaps and ends part words, everything else is in one."""
    out = np.full(256, WORD, np.uint8)
    out[list(gaps)] = GAP
    out[list(ends)] = END
    return out


#: Words as maximal runs of anything but white space.
PLAIN = kinds(b" \t\n\x0b\x0c\r")


def blocks(column: pa.Array, kind: np.ndarray, most: int, cut: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, n + 1 offsets, n rows) of runs of texts of about `most` bytes, with A-Z lower-cased; nulls are empty. A
    text beyond that is cut behind bytes of the kind `cut`, or stays whole where cut is None or there is none."""
    body, at = byte_view(column)
    n = len(at) - 1
    offsets, rows = [], []
    for i in np.flatnonzero(np.diff(at) > most) if cut is not None else ():
        lo, hi = int(at[i]), int(at[i + 1])
        while hi - lo > most:
            lo += most
            while lo < hi:
                near = np.flatnonzero(kind[body[lo : min(hi, lo + (1 << 16))]] == cut)
                if len(near):
                    lo += int(near[0]) + 1
                    break
                lo = min(hi, lo + (1 << 16))
            if lo < hi:
                offsets.append(lo)
                rows.append(i)
    order = np.argsort(np.concatenate([at[:-1], np.array(offsets, np.int64)]), kind="stable")
    starts = np.concatenate([at[:-1], np.array(offsets, np.int64)])[order]
    rows = np.concatenate([np.arange(n), np.array(rows, np.int64)])[order]
    ends = np.append(starts[1:], at[-1])
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + most, side="right")))
        base = starts[lo]
        yield _LOWER[body[base : ends[hi - 1]]], np.append(starts[lo:hi], ends[hi - 1]) - base, rows[lo:hi]
        lo = hi


def words(body: np.ndarray, at: np.ndarray, kind: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, text, piece): every word in order, the number of its text, and a number that words of one piece share."""
    own = kind[body]
    inside = own == WORD
    start, stop = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    stop[:-1] &= ~inside[1:]
    edge = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(body))]
    start[edge] = inside[edge]
    stop[edge - 1] = inside[edge - 1]
    first, last = np.flatnonzero(start), np.flatnonzero(stop)
    offsets = np.zeros(len(first) + 1, np.int64)
    np.cumsum(last - first + 1, out=offsets[1:])
    found = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(body[inside])])
    text = np.searchsorted(at, first, side="right") - 1
    return found, text, text + np.searchsorted(np.flatnonzero(own == END), first)
