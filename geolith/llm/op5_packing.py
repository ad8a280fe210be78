"""Cost-balanced packing of token sequences.

A piece of n tokens costs ``linear * n + quadratic * n * n``, as attention within it does. Pieces go in
descending order to the sequence of lowest cost that has room for them; what fits nowhere is cut over
the room that is left. Each task packs its own documents in pools of bounded size, without a shuffle.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from geolith.llm.batches import field, id_and_text, map_batches
from geolith.llm.pieces import PieceCache

_caches: dict[tuple, tuple] = {}


def cache(path: str, pattern: str) -> tuple[PieceCache, list[str]]:
    """A piece cache that asks the tokenizer for new pieces only, and the strings of its special tokens."""
    if (path, pattern) not in _caches:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()

        lengths = np.zeros(tokenizer.get_vocab_size(), np.int64)
        for token, i in tokenizer.get_vocab().items():
            lengths[i] = len(token)  # a byte-level vocabulary spells each byte as one character

        def encode(pieces: list[str]) -> list:
            """Ids of each piece. Words are asked for in lines of many, which the tokenizer splits into the same words."""
            out: list = [None] * len(pieces)
            words = [i for i, x in enumerate(pieces) if x.lstrip(" ").isalpha() and x.count(" ") < 2]
            lines = [words[i : i + 512] for i in range(0, len(words), 512)]
            texts = ["\n".join(pieces[i] for i in line) for line in lines]
            for line, found in zip(lines, tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                ids = np.array(found.ids, np.int32)
                ends = np.cumsum(lengths[ids])
                own = np.array([len(pieces[i].encode()) for i in line])
                stops = np.searchsorted(ends, np.cumsum(own + 1) - 1)  # tokens that end with the word; a newline follows
                for i, a, b in zip(line, [0, *(stops[:-1] + 2).tolist()], (stops + 1).tolist(), strict=True):
                    out[i] = ids[a:b]
            rest = [i for i, x in enumerate(out) if x is None]
            for i, found in zip(rest, tokenizer.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False), strict=True):
                out[i] = found.ids
            return out

        special = [x.content for x in tokenizer.get_added_tokens_decoder().values()]
        _caches[path, pattern] = PieceCache(pattern, encode), special
    return _caches[path, pattern]


def token_ids(texts: list[str], path: str, pattern: str, end_id: int) -> list[np.ndarray]:
    """The ids of each text, and the closing id. A text with special strings goes to the tokenizer whole."""
    pieces, special = cache(path, pattern)
    end = np.array([end_id], np.int32)
    whole = [not any(s in x for s in special) for x in texts]
    plain, out = iter(pieces.numbers([x for x, y in zip(texts, whole, strict=True) if y])), []
    for text, y in zip(texts, whole, strict=True):
        parts = []
        if y:
            parts.append(pieces.of(next(plain)))
        else:
            parts += [np.array(x, np.int32) for x in pieces.encode([text])]
        out.append(np.concatenate([*parts, end]))
    return out


def assign(lengths: np.ndarray, rooms: np.ndarray, linear: float, quadratic: float) -> tuple[np.ndarray, ...]:
    """Pieces of items of these lengths over sequences with this room, all of it: item, start, length, sequence.

    The sum of the lengths is the sum of the rooms. Items longer than the largest room first give full pieces.
    """
    size = int(rooms.max())
    full = np.flatnonzero(rooms == size)
    out: list[tuple[int, int, int, int]] = []
    starts, used = np.zeros(len(lengths), np.int64), 0
    for i in np.flatnonzero(lengths >= size).tolist():
        while lengths[i] - starts[i] >= size and used < len(full):
            out.append((i, int(starts[i]), size, int(full[used])))
            starts[i] += size
            used += 1
    room = rooms.copy()
    room[full[:used]] = 0
    open_, rest = np.flatnonzero(room), lengths - starts
    room, cost = room[open_], np.zeros(len(open_))
    over = []
    for i in np.argsort(-rest, kind="stable").tolist():
        n = int(rest[i])
        if not n:
            break
        costs = np.where(room >= n, cost, np.inf)
        k = int(costs.argmin()) if len(costs) else 0
        if not len(costs) or costs[k] == np.inf:
            over.append(i)
            continue
        out.append((i, int(starts[i]), n, int(open_[k])))
        room[k] -= n
        cost[k] += linear * n + quadratic * n * n
    left = iter(sorted(np.flatnonzero(room).tolist(), key=lambda k: (-room[k], k)))
    k = -1
    for i in over:
        while starts[i] < lengths[i]:
            if k < 0 or not room[k]:
                k = next(left)
            n = int(min(room[k], lengths[i] - starts[i]))
            out.append((i, int(starts[i]), n, int(open_[k])))
            starts[i] += n
            room[k] -= n
    return tuple(np.array(x, np.int64) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4


class Pool:
    """Documents of one task that wait for sequences."""

    def __init__(self, size: int, linear: float, quadratic: float, sequence: int):
        self.size, self.linear, self.quadratic, self.sequence = size, linear, quadratic, sequence
        self.items: list[tuple[int, np.ndarray, int, int]] = []  # row, ids, ids before it in its document, ids of the document
        self.tokens = 0

    def add(self, row: int, ids: np.ndarray) -> None:
        self.items.append((row, ids, 0, len(ids)))
        self.tokens += len(ids)

    def flush(self, last: bool) -> list[tuple]:
        """Full sequences; at the end what is left fills sequences whose lengths are powers of two, so none is padded."""
        n, rest = divmod(self.tokens, self.size)
        kept = []
        if rest and not last:  # the tail of the last documents waits for the next pool
            while rest:
                row, ids, start, total = self.items.pop()
                n_tail = min(rest, len(ids))
                kept.append((row, ids[len(ids) - n_tail :], start + len(ids) - n_tail, total))
                if n_tail < len(ids):
                    self.items.append((row, ids[: len(ids) - n_tail], start, total))
                rest -= n_tail
        rooms = [self.size] * n + [1 << b for b in range(self.size.bit_length() - 1, -1, -1) if rest >> b & 1 and last]
        items, out = self.items, []
        self.items, self.tokens = kept[::-1], sum(len(x[1]) for x in kept)
        if not rooms:
            return out
        used = np.zeros(len(rooms), np.int64)
        for i, start, length, k in zip(*(x.tolist() for x in assign(np.array([len(x[1]) for x in items]), np.array(rooms), self.linear, self.quadratic)), strict=True):
            row, ids, before, total = items[i]
            own = ids[start : start + length]
            out.append((row, before + start, length, zlib.crc32(own.astype("<u4").tobytes()), total, self.sequence + k, int(used[k]), own))
            used[k] += length
        self.sequence += len(rooms)
        return out


def pack(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, end_id: int = 0, linear: float = 1.0, quadratic: float = 1 / 1024, pool_tokens: int = 1 << 20, keep_ids: bool = False) -> DataFrame:
    """One row per piece: the id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``; with ``keep_ids`` also ``ids``.

    ``size`` is a power of two. Every id of every document, its closing ``end_id`` included, lies in one
    piece. A null or empty text is the closing id alone. Repeated rows are packed each for itself, a
    null id stays null, other columns are ignored, an empty table gives an empty one. Equal costs go to
    the sequence that was opened first. Sequences are full but for at most one of each smaller power of
    two at the end of a task. A pool holds about ``pool_tokens`` ids, or one longer document.
    """
    if size & (size - 1):
        raise ValueError("size must be a power of two")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        pool = Pool(size, linear, quadratic, (context.partitionId() if context else 0) << 36)
        ids: list = []
        kind = None

        def rows(last: bool) -> pa.RecordBatch:
            found = pool.flush(last)
            names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: 7 + keep_ids]
            columns = [list(c) for c in zip(*found, strict=True)] if found else [[]] * 8
            values = [pa.array([ids[i] for i in columns[0]], kind), *(pa.array(c, pa.int64()) for c in columns[1:7])]
            out = pa.RecordBatch.from_arrays([*values, pa.array(columns[7], pa.list_(pa.int32()))][: 7 + keep_ids], names=names)
            keep = [i for i, *_ in pool.items]
            pool.items = [(k, *x[1:]) for k, x in enumerate(pool.items)]
            ids[:] = [ids[i] for i in keep]
            return out

        for batch in batches:
            kind = batch.column(0).type
            for name, own in zip(batch.column(0).to_pylist(), token_ids(batch.column(1).fill_null("").to_pylist(), path, pattern, end_id), strict=True):
                pool.add(len(ids), own)
                ids.append(name)
                if pool.tokens >= pool_tokens:
                    yield rows(False)
        if pool.tokens:
            yield rows(True)

    longs = [T.StructField(x, T.LongType()) for x in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    return map_batches(id_and_text(df, id_col, text_col), work, [field(df, id_col), *longs, T.StructField("ids", T.ArrayType(T.IntegerType()))][: 7 + keep_ids])
