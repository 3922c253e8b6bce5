"""Terms of texts in Arrow blocks: maximal runs of the bytes that a mask allows, A-Z lower-cased, coded exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from workmap.llm.common import Words, ascii_lower


def gaps(*ranges: tuple[int, int]) -> np.ndarray:
    """The bytes that separate terms, from ranges with both ends."""
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


class Terms:
    """The terms of some texts: `codes` into the distinct terms `names`, in order, and `first`, the first term of each text.

    Terms are compared as strings, not by hashes. Bytes from 0x80 on never separate, so characters stay whole.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_gap: np.ndarray):
        lowered = ascii_lower(data)
        found = Words(lowered, offsets, is_gap)
        ends = np.zeros(len(found) + 1, np.int64)
        np.cumsum(found.ends - found.starts, out=ends[1:])
        letters = lowered[~is_gap[lowered]]
        every = pa.Array.from_buffers(pa.large_string(), len(found), [None, pa.py_buffer(ends), pa.py_buffer(letters)])
        coded = every.dictionary_encode()
        self.codes = np.asarray(coded.indices, dtype=np.int64)
        self.names = coded.dictionary
        self.first = found.first

    def by_text(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, code, times) of every distinct term of each text, in the order of text, then code."""
        size = max(len(self.names), 1)
        rows = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        key, times = np.unique(rows * size + self.codes, return_counts=True)
        return key // size, key % size, times
