"""Texts as ids through a cache of their pieces, for tokenizers that encode each piece separately."""

from __future__ import annotations

import re
import time
import unicodedata
from collections.abc import Callable

import numpy as np
import regex

from geolith.llm.batches import AT_TASK_END

#: Pieces that a process remembers; then it starts anew, which bounds memory whatever the input.
CACHE_PIECES = 600_000
#: Seconds after which a process that does other work forgets its pieces.
IDLE_SECONDS = 20.0


#: Texts of characters below this one are split by a pattern with explicit classes, in half the time.
NARROW = 0x180
WIDE = re.compile(f"[^\0-{chr(NARROW - 1)}]")


def narrow(pattern: str) -> re.Pattern:
    """The pattern for texts of characters below ``NARROW`` only: letters, numbers and white space are spelled out."""
    kinds = {r"\p{L}": lambda c: unicodedata.category(c)[0] == "L", r"\p{N}": lambda c: unicodedata.category(c)[0] == "N", r"\s": regex.compile(r"\s").match}
    classes = {k: "".join(re.escape(chr(c)) for c in range(NARROW) if holds(chr(c))) for k, holds in kinds.items()}
    classes[r"\S"] = "^" + classes[r"\s"]
    out, inside, i = [], False, 0
    while i < len(pattern):
        name = next((k for k in classes if pattern.startswith(k, i)), "")
        if name:
            if inside and name == r"\S":
                raise ValueError("a negated class inside brackets")
            out.append(classes[name] if inside else f"[{classes[name]}]")
            i += len(name)
            continue
        inside = pattern[i] == "[" or inside and pattern[i] != "]"
        out.append(pattern[i])
        i += 1
    return re.compile("".join(out))


class Numbers(dict):
    """Numbers pieces in the order in which they are first asked for, and lists those as new."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.new.append(piece)
        return n


class PieceCache:
    """Ids of pieces: ``encode`` gives those of pieces not seen before, as one list for each piece."""

    def __init__(self, pattern: str, encode: Callable[[list[str]], list], most: int = CACHE_PIECES):
        self.wide, self.narrow, self.encode, self.most = regex.compile(pattern).findall, narrow(pattern).findall, encode, most
        self.used, self.generation = 0.0, 0
        self.clear()
        AT_TASK_END.append(self.forget_if_idle)

    def forget_if_idle(self) -> None:
        if self.index and time.monotonic() - self.used > IDLE_SECONDS:
            self.clear()

    def find(self, text: str) -> list[str]:
        return self.wide(text) if WIDE.search(text) else self.narrow(text)

    def clear(self) -> None:
        self.generation += 1
        self.index = Numbers()
        self.ids, self.at, self.n_ids = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), 0

    def add(self, pieces: list[str]) -> None:
        found = self.encode(pieces)
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        n, end = len(self.index) - len(pieces), self.n_ids + int(lengths.sum())
        while len(self.ids) < end:
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.at) < n + len(pieces) + 1:
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        self.ids[self.n_ids : end] = np.concatenate([np.asarray(x, np.int32) for x in found]) if found else 0
        self.at[n + 1 : n + 1 + len(pieces)] = self.n_ids + np.cumsum(lengths)
        self.n_ids = end

    def numbers(self, texts: list[str]) -> list[np.ndarray]:
        """The numbers of each text's pieces, whose ids are all known after this call."""
        if len(self.index) > self.most:
            self.clear()
        self.used = time.monotonic()
        number = self.index.__getitem__
        out = [np.fromiter(map(number, p), np.int64, len(p)) for p in map(self.find, texts)]
        if self.index.new:
            self.add(self.index.new)
            self.index.new = []
        return out

    def of(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of the numbered pieces, one after the other."""
        return gather(self.ids, self.at[numbers], self.at[numbers + 1] - self.at[numbers])


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``flat[starts[i] : starts[i] + lengths[i]]`` for all i, joined."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    if not total:
        return flat[:0]
    step = np.repeat(starts - (ends - lengths), lengths)
    step += np.arange(total)
    return flat[step]
