"""A run-length index of strings: the Burrows-Wheeler transform in runs, with text positions sampled at run ends.

Each string ends in a terminator of its own, smaller than every byte and ordered as the strings are. Strings
belong to blocks; a block's bytes are symbols of its own, so no match crosses blocks, though all share one
index. Matching statistics are streamed from right to left: a step either stays in a run, or jumps to the end
of the run before or after it that has the wanted byte, whose sample tells by comparison how much still matches.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BYTES = 257  # symbols of a block: the terminator and 256 bytes


def suffix_order(text: np.ndarray, ends: np.ndarray, string: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The suffixes' positions, sorted by block and bytes; only those that aren't told apart yet are sorted again, by twice as many bytes."""
    n, m = len(text), len(ends)
    left = ends[string] - np.arange(n)  # bytes before the terminator
    used = np.zeros(256, bool)
    used[text[left > 0]] = True
    code = np.where(left > 0, np.cumsum(used)[text], 0).astype(np.uint64)
    bits, own = int(used.sum()).bit_length(), int(block[-1]).bit_length()
    reach = max(1, (64 - own) // bits)
    key, padded = block[string].astype(np.uint64), np.concatenate([code, np.zeros(reach, np.uint64)])
    for k in range(reach):
        key = key << np.uint64(bits) | np.where(left >= k, padded[k : k + n], np.uint64(0))
    order = np.argsort(key)
    key = key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = start
    alone = new & np.append(new[1:], True)
    live = np.flatnonzero(~alone)
    while len(live):
        at = order[live]
        first = rank[at]
        second = np.where(left[at] >= reach, rank[np.minimum(at + reach, n - 1)], string[at] - m)
        by = np.lexsort((second, first))
        at, first, second = at[by], first[by], second[by]
        order[live] = at
        new = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        rank[at] = live[np.maximum.accumulate(np.where(new, np.arange(len(live)), 0))]
        live = live[~(new & np.append(new[1:], True))]
        reach *= 2
    return order


@dataclass
class RunIndex:
    """Runs of the transform, sorted by symbol and place.

    A run has its ``symbol``, its first row ``start``, its ``size``, the row ``target`` to which the LF mapping
    takes its first row, and the text positions of its first and last row, ``first`` and ``last``. ``keys`` are
    symbol and start as one number. ``top`` is the first row of each block and ``rest`` its text position.
    """

    text: np.ndarray
    rows: int
    runs: int
    keys: np.ndarray
    symbol: np.ndarray
    start: np.ndarray
    size: np.ndarray
    target: np.ndarray
    first: np.ndarray
    last: np.ndarray
    top: np.ndarray
    rest: np.ndarray

    @classmethod
    def build(cls, text: np.ndarray, ends: np.ndarray, block: np.ndarray) -> RunIndex:
        """Of strings joined in ``text``, each followed by one byte for its terminator at ``ends``; ``block`` ascends from 0 without gaps."""
        n = len(text)
        string = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=-1))
        order = suffix_order(text, ends, string, block)
        owner = block[string[order]]
        ended, begins = np.zeros(n, bool), np.zeros(n, bool)
        ended[ends] = True
        begins[np.append(0, ends[:-1] + 1)] = True
        own = owner * BYTES + np.where(ended[order], 0, text[order].astype(np.int64) + 1)  # ascends
        before = np.where(begins[order], -1, owner * BYTES + text[order - 1].astype(np.int64) + 1)
        edge = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        size = np.diff(np.append(edge, n))
        by = np.argsort(before[edge], kind="stable")
        by = by[before[edge[by]] >= 0]
        start, size, symbol = edge[by], size[by], before[edge[by]]
        passed = np.cumsum(size) - size
        head = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]])) if len(by) else np.zeros(0, np.int64)
        passed = passed - np.repeat(passed[head], np.diff(np.append(head, len(by))))
        top = np.searchsorted(owner, np.arange(int(block[-1]) + 1))
        return cls(text, n, len(edge), symbol * (n + 1) + start, symbol, start, size, np.searchsorted(own, symbol) + passed, order[start], order[start + size - 1], top, order[top])

    def common(self, places: np.ndarray, text: np.ndarray, at: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal bytes, ``most`` at most, from ``places`` of the index and from ``at`` of ``text``."""
        out, live, done = np.zeros(len(at), np.int64), np.flatnonzero(most > 0), 0
        while len(live):
            column = done + np.arange(16)[None, :]
            use = column < most[live][:, None]
            a = self.text[np.minimum(places[live][:, None] + column, self.rows - 1)]
            same = use & (a == text[np.minimum(at[live][:, None] + column, len(text) - 1)])
            out[live] += np.where(same.all(1), 16, same.argmin(1))
            live = live[same.all(1)]
            done += 16
        return out

    def statistics(self, text: np.ndarray, ends: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each byte of patterns joined as in :meth:`build`, how many bytes from it on match a string of the pattern's block, and where."""
        starts = np.append(0, ends[:-1] + 1)
        length, place = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
        live, at = np.arange(len(ends)), ends.copy()
        row, here, matched = self.top[block], self.rest[block], np.zeros(len(ends), np.int64)
        last = len(self.keys) - 1
        while True:
            more = at > starts[live]
            if not more.all():
                live, at, row, here, matched = live[more], at[more], row[more], here[more], matched[more]
            if not len(live) or last < 0:
                return length, place
            at = at - 1
            wanted = block[live] * BYTES + text[at].astype(np.int64) + 1
            run = np.searchsorted(self.keys, wanted * (self.rows + 1) + row, "right") - 1
            before = (run >= 0) & (self.symbol[run] == wanted)
            inside = before & (row < self.start[run] + self.size[run])
            row = np.where(inside, self.target[run] + row - self.start[run], row)
            here, matched = here - 1, matched + 1
            if not inside.all():
                out = np.flatnonzero(~inside)
                a, c = run[out], np.minimum(run[out] + 1, last)
                had, after = before[out], (run[out] < last) & (self.symbol[c] == wanted[out])
                own, following = matched[out] - 1, at[out] + 1
                low = np.where(had, self.common(self.last[a], text, following, np.where(had, own, 0)), -1)
                high = np.where(after, self.common(self.first[c], text, following, np.where(after, own, 0)), -1)
                up = high > low
                none = ~had & ~after
                kept = live[out]
                row[out] = np.where(none, self.top[block[kept]], np.where(up, self.target[c], self.target[a] + self.size[a] - 1))
                here[out] = np.where(none, self.rest[block[kept]], np.where(up, self.first[c], self.last[a]) - 1)
                matched[out] = np.where(none, 0, np.maximum(low, high) + 1)
            length[at], place[at] = matched, here
