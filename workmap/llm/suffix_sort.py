"""Suffix order of many short texts by linear grouping, column by column.

Suffixes are grouped by their Lyndon prefix, the longest Lyndon word that they begin with; it ends where the
next smaller suffix of the text starts. The groups are built from the texts' ends on, in all texts at once:
a suffix takes in the groups behind it as long as they are greater, following pointers to next smaller
suffixes (a text's descending groups drained through its pointers, with numpy working on columns of texts
where a scalar program works on a queue of groups). Each group's order then follows from the groups behind
it: a suffix is placed by its group and by the place of the suffix that its pointer names, so nothing is
renamed and sorted again recursively.
"""

from __future__ import annotations

import numpy as np

from workmap.llm.common import U

#: Characters in one packed key, bits of each (a byte plus one, so that an end is smaller than any byte).
CHARS, BITS = 7, 9


class Columns:
    """Texts as columns: packed keys of the CHARS characters from each place on, zero past the end."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.size = np.diff(offsets)
        self.n, self.width = len(self.size), int(self.size.max(initial=0))
        c = np.zeros((self.width + 3 * CHARS, self.n), U)
        text = np.repeat(np.arange(self.n), self.size)
        c[np.arange(len(text)) - np.repeat(offsets[:-1] - offsets[0], self.size), text] = data.astype(U) + U(1)
        two = c[:-1] << U(BITS) | c[1:]
        four = two[:-2] << U(2 * BITS) | two[2:]
        seven = four[:-3] << U(3 * BITS) | (two[4 : 4 + len(four) - 3] << U(BITS)) | c[6 : 6 + len(four) - 3]
        self.keys = np.ascontiguousarray(seven)
        self.flat = self.keys.ravel()

    def greater(self, p: np.ndarray, j: int, text: np.ndarray) -> np.ndarray:
        """Whether the suffixes from p are greater than those from j, for some texts."""
        a, b = self.flat[p * self.n + text], self.keys[j, text]
        out = a > b
        tied = np.flatnonzero(a == b)
        d = CHARS
        while len(tied):
            a, b = self.flat[(p[tied] + d) * self.n + text[tied]], self.keys[j + d, text[tied]]
            out[tied] = a > b
            tied = tied[a == b]
            d += CHARS
        return out

    def next_smaller(self) -> np.ndarray:
        """For each place and text, where the next smaller suffix of the text starts (its length if there is none)."""
        out = np.empty((self.width + 1, self.n), np.int32)
        out[self.width] = self.width
        flat = out.ravel()
        for j in range(self.width - 1, -1, -1):
            to = np.full(self.n, j + 1, np.int64)
            live = np.flatnonzero(self.size > j + 1)
            while len(live):
                live = live[self.greater(to[live], j, live)]
                to[live] = flat[to[live] * self.n + live]
                live = live[to[live] < self.size[live]]
            out[j] = np.minimum(to, np.maximum(self.size, j + 1))
        return out


def _refine(order: np.ndarray, place: np.ndarray, key: np.ndarray, tied: np.ndarray) -> np.ndarray:
    """Sorts by key within tied stretches of an order; place is where an item's stretch starts. Returns which places start a stretch among the sorted ones."""
    items = order[tied]
    again = np.lexsort((key[items], place[items]))
    items = items[again]
    order[tied] = items
    own, k = place[items], key[items]
    cut = np.r_[True, (own[1:] != own[:-1]) | (k[1:] != k[:-1])]
    starts = np.flatnonzero(cut)
    place[items] = np.repeat(tied[starts], np.diff(np.r_[starts, len(items)]))
    return cut


def _ties(order: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Places of the order whose item shares its stretch."""
    p = place[order]
    same = np.r_[False, p[1:] == p[:-1]]
    return np.flatnonzero(same | np.r_[same[1:], False]) if len(p) else np.zeros(0, np.int64)


def sorted_windows(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All places of texts from which `width` bytes go on, in suffix order: (text, place, equal to the one before in those bytes)."""
    c = Columns(data, offsets)
    none = np.zeros(0, np.int64)
    if not c.n or c.width < width:
        return none, none, np.zeros(0, bool)
    smaller = c.next_smaller()
    starts = np.maximum(c.size - width + 1, 0)
    # the suffixes whose groups matter: window starts, and those that pointers lead to from them
    needed = np.arange(c.width)[:, None] < starts
    for j in range(c.width - 1):
        to = smaller[j]
        on = np.flatnonzero(needed[j] & (to < c.size))
        needed[to[on], on] = True
    at, text = np.nonzero(needed)
    word = smaller[at, text] - at  # length of the Lyndon prefix
    number = np.full((c.width + 1, c.n), -1, np.int64)
    number[at, text] = np.arange(len(at))

    def part(d: int, some: np.ndarray) -> np.ndarray:
        """The next CHARS characters of Lyndon prefixes, from their d-th on."""
        left = np.clip(word[some] - d, 0, CHARS)
        return c.flat[np.minimum(at[some] + d, len(c.keys) - 1) * c.n + text[some]] >> (U(BITS) * (CHARS - left).astype(U)) << (U(BITS) * (CHARS - left).astype(U))

    everything = np.arange(len(at))
    key = part(0, everything)
    order = np.argsort(key, kind="stable")
    k = key[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    group = np.empty(len(at), np.int64)
    group[order] = np.repeat(first, np.diff(np.r_[first, len(at)]))
    d = CHARS
    while True:  # longer words: among those that agree so far
        tied = _ties(order, group)
        items = order[tied]
        longer = np.zeros(len(at) + 1, bool)
        longer[group[items[word[items] > d]]] = True  # stretches that have a longer word
        tied = tied[longer[group[items]]]
        if not len(tied):
            break
        items = order[tied]
        key[items] = np.where(word[items] > d, part(d, items), U(0))
        _refine(order, group, key, tied)
        d += CHARS
    # each group's order, from the groups that pointers lead to
    chosen = at < starts[text]
    order = order[chosen[order]]
    place = np.empty(len(at), np.int64)
    g = group[order]
    first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    place[order] = np.repeat(first, np.diff(np.r_[first, len(order)]))
    pointer = smaller[at, text].astype(np.int64)
    behind = np.full(len(at), -1, np.int64)
    while True:
        tied = _ties(order, place)
        items = order[tied]
        open_ = np.zeros(len(at) + 1, bool)
        open_[place[items[pointer[items] - at[items] < width]]] = True
        tied = tied[open_[place[items]]]
        if not len(tied):
            break
        items = order[tied]
        more = pointer[items] < c.size[text[items]]
        behind[items] = -1
        go = items[more]
        behind[go] = group[number[pointer[go], text[go]]]
        _refine(order, place, behind, tied)
        pointer[go] = smaller[pointer[go], text[go]]
        pointer[items[~more]] += width  # at its end: nothing left to tell apart
    a, b = order[:-1], order[1:]
    same = np.ones(len(a), bool)
    for d in range(0, width, CHARS):
        d = min(d, max(width - CHARS, 0))
        x, y = c.flat[(at[a] + d) * c.n + text[a]], c.flat[(at[b] + d) * c.n + text[b]]
        if width < CHARS:
            x, y = x >> U(BITS * (CHARS - width)), y >> U(BITS * (CHARS - width))
        same &= x == y
    return text[order], at[order], np.r_[False, same] if len(order) else np.zeros(0, bool)
