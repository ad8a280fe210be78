"""Byte-level BPE on length-bucketed padded matrices.

Each row of a matrix is one piece. In each round every row that still has a mergeable pair merges its
leftmost pair of minimum rank, found by a hashed pair table, and the matrix is compacted by a column.
A row of a very long piece merges all its pairs of minimum rank in one round, from the left, where that is
the same as merging them one after the other.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from geolith.llm.batches import field, id_and_text, map_batches
from geolith.llm.pieces import PieceCache, gather

NONE = np.int32(2**31 - 1)
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Cells of one matrix, and bytes from which a row merges all its pairs of minimum rank in a round.
CELLS, LONG_PIECE = 1 << 19, 256


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PairTable:
    """(left id, right id) to the rank of their concatenation: open addressing in two arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, rank = [], [], []
        for token, r in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        keys = self.key(np.array(left, np.int64), np.array(right, np.int64))
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.keys, self.ranks = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, NONE)
        values, slots = np.array(rank, np.int32), self.slot(keys)
        while len(keys):
            _, first = np.unique(slots, return_index=True)
            first = first[self.keys[slots[first]] == 0]
            self.keys[slots[first]], self.ranks[slots[first]] = keys[first], values[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values, slots = keys[rest], values[rest], (slots[rest] + 1) & ((1 << self.bits) - 1)

    @staticmethod
    def key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a.astype(np.uint64) + np.uint64(1)) << np.uint64(32)) | b.astype(np.uint64)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * MULTIPLIER) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = self.key(a, b)
        slots = self.slot(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.ranks[slots], NONE)
        left = np.flatnonzero((found != keys) & (found != 0))
        while len(left):
            slots[left] = (slots[left] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slots[left]]
            out[left] = np.where(found == keys[left], self.ranks[slots[left]], NONE)
            left = left[(found != keys[left]) & (found != 0)]
        return out


class Encoder:
    """Byte-level BPE by ranks; a piece that is itself a token is that token."""

    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        self.pairs = PairTable(self.ranks)
        self.bytes = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        lengths = np.array([len(t) for t in tokens], np.int64)
        self.pool, self.lengths, self.starts = np.frombuffer(b"".join(tokens), np.uint8), lengths, np.cumsum(lengths) - lengths

    def __call__(self, pieces: list[str]) -> list[np.ndarray]:
        raw = [p.encode() for p in pieces]
        out: list = [None] * len(raw)
        rows = []
        for i, piece in enumerate(raw):
            if (whole := self.ranks.get(piece)) is not None:
                out[i] = np.array([whole], np.int32)
            elif len(piece) > LONG_PIECE:
                out[i] = self.long(piece)
            else:
                rows.append(i)
        rows.sort(key=lambda i: len(raw[i]))
        start = 0
        while start < len(rows):  # a bucket: lengths that differ by a quarter at most
            width, end = len(raw[rows[start]]), start
            most = width + max(1, width // 4)
            while end < len(rows) and len(raw[rows[end]]) <= most and (end - start) * most < CELLS:
                end += 1
            self.matrix([raw[i] for i in rows[start:end]], rows[start:end], out)
            start = end
        return out

    def matrix(self, pieces: list[bytes], names: list[int], out: list) -> None:
        lengths = np.array([len(p) for p in pieces])
        width, n = int(lengths.max()), len(pieces)
        ids = self.bytes[np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)]
        rows = np.array(names)
        ranks = self.pairs(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        ranks[np.arange(1, width)[None, :] >= lengths[:, None]] = NONE
        while True:
            if ranks.shape[1]:
                at = ranks.argmin(1)
                best = ranks[np.arange(len(rows)), at]
                done = best == NONE
            else:
                done = np.ones(len(rows), bool)
            if done.any():
                for row, line, length in zip(rows[done].tolist(), ids[done], lengths[done].tolist(), strict=True):
                    out[row] = line[:length].copy()
                rows = rows[~done]
                if not len(rows):
                    return
                ids, ranks, lengths, at, best = ids[~done], ranks[~done], lengths[~done], at[~done], best[~done]
            here, every = at[:, None], np.arange(len(rows))
            ids = np.where(np.arange(ids.shape[1] - 1)[None, :] > here, ids[:, 1:], ids[:, :-1])
            ids[every, at] = best
            ranks = np.where(np.arange(ranks.shape[1] - 1)[None, :] >= here, ranks[:, 1:], ranks[:, :-1])
            lengths = lengths - 1
            if (left := np.flatnonzero(at > 0)).size:
                ranks[left, at[left] - 1] = self.pairs(ids[left, at[left] - 1], best[left])
            if (right := np.flatnonzero(at + 1 < lengths)).size:
                ranks[right, at[right]] = self.pairs(best[right], ids[right, at[right] + 1])

    def long(self, piece: bytes) -> np.ndarray:
        """The same merges for a matrix of one row, many in a round.

        Merging a pair makes pairs with the new token. While each of these has a larger rank than the pair, the
        next merges are the other pairs of this rank, from the left; where one hasn't, only the leftmost merges.
        """
        ids = self.bytes[np.frombuffer(piece, np.uint8)]
        ranks = self.pairs(ids[:-1], ids[1:])
        while len(ranks) and (best := ranks.min()) != NONE:
            at = np.flatnonzero(ranks == best)
            run = np.arange(len(at)) - at  # neighbouring pairs overlap: of a run of them every second one merges
            first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
            at = at[(np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))) % 2 == 0]
            merged, after = self.merge(ids, ranks, at, best)
            right = ids[at[:-1] + 2]  # the pairs with what followed, before that merged itself
            if len(at) > 1 and (after.min(initial=NONE) <= best or self.pairs(np.full(len(right), best), right).min() <= best):
                merged, after = self.merge(ids, ranks, at[:1], best)
            ids, ranks = merged, after
        return ids

    def merge(self, ids: np.ndarray, ranks: np.ndarray, at: np.ndarray, best: np.int32) -> tuple[np.ndarray, np.ndarray]:
        """The row with the pairs at ``at`` merged, and the ranks of its pairs."""
        ids = ids.copy()
        ids[at] = best
        keep = np.ones(len(ids), bool)
        keep[at + 1] = False
        out = ids[keep]
        new = at - np.arange(len(at))  # where the merged tokens are now
        after = ranks[keep[1:]] if len(out) > 1 else ranks[:0]
        touched = np.unique(np.concatenate([new - 1, new]))
        touched = touched[(touched >= 0) & (touched < len(out) - 1)]
        after = after[: len(out) - 1].copy()
        after[touched] = self.pairs(out[touched], out[touched + 1])
        return out, after

    def decode(self, ids: np.ndarray) -> bytes:
        return gather(self.pool, self.starts[ids], self.lengths[ids]).tobytes()


_caches: dict[tuple, tuple[Encoder, PieceCache]] = {}


def cache(path: str, pattern: str) -> tuple[Encoder, PieceCache]:
    if (path, pattern) not in _caches:
        encoder = Encoder(path)
        _caches[path, pattern] = encoder, PieceCache(pattern, encoder)
    return _caches[path, pattern]


def encode_bpe(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per input row: the id, ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by spaces), ``decoded_sha256``; with ``keep_ids`` also ``ids``.

    A null or empty text has no ids, and the hashes of no bytes. Repeated rows and ids give repeated
    rows, a null id stays null, other columns are ignored, an empty table gives an empty one. Texts
    are taken whole, whatever their length; equal ranks at several places merge leftmost first.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, pieces = cache(path, pattern)
        strings: list[str] = []
        generation = -1
        for batch in batches:
            ids, shas, decoded, kept = [], [], [], []
            found = pieces.numbers(batch.column(1).fill_null("").to_pylist())
            if generation != pieces.generation:
                strings.clear()
                generation = pieces.generation
            if len(strings) < len(pieces.index):
                at = pieces.at[: len(pieces.index) + 1].tolist()
                flat = list(map(str, pieces.ids[at[len(strings)] : pieces.n_ids].tolist()))
                base = at[len(strings)]
                strings += [" ".join(flat[a - base : b - base]) for a, b in zip(at[len(strings) : -1], at[len(strings) + 1 :], strict=True)]
            for numbers in found:
                own = pieces.of(numbers)
                ids.append(len(own))
                shas.append(hashlib.sha256(" ".join(map(strings.__getitem__, numbers.tolist())).encode()).hexdigest())
                decoded.append(hashlib.sha256(encoder.decode(own)).hexdigest())
                if keep_ids:
                    kept.append(own)
            columns = [batch.column(0), pa.array(ids, pa.int64()), pa.array(shas, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.list_(pa.int32()))][: 4 + keep_ids], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 4 + keep_ids])

    fields = [field(df, id_col), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    return map_batches(id_and_text(df, id_col, text_col), encode, fields[: 4 + keep_ids])
