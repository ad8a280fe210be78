"""Suffix-array dedup with run-length indexes: bytes of long strings that a document with a smaller id has.

Candidates are found by anchors, positions that any two equal strings of the given length share. A first
exchange finds anchors that several documents have; those, with the bytes around them, are dealt by the
anchor's string, so that equal strings always meet. There equal contexts are kept once. A run-length index is
built of the contexts of smaller documents, and the matching statistics of the others are streamed against it,
for growing groups of documents as in a merge sort, so that every two contexts of an anchor are compared unless
one holds nothing that an earlier one doesn't. Hashes only choose what is compared; bytes decide. What is settled
within a batch or a chunk of documents is not sent, so that a very common passage is sent once for each of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from geolith.llm.anchors import GRAM, anchors, gram_hash
from geolith.llm.batches import map_batches, raw, returned
from geolith.llm.run_index import RunIndex
from geolith.llm.shared import Stored, small
from geolith.llm.tokens import mix

#: An anchor of ``HOT_DOCS`` documents that makes up more than 1 / ``HOT_SHARE`` of all shared anchors is dealt by its
#: windows, so that no task gets all its contexts; there are fewer than ``HOT_SHARE`` of them, whatever the input.
HOT_DOCS, HOT_SHARE = 4096, 1 << 20
#: Bytes of one run-length index, contexts that are searched at once, and bytes of text that a task reads before it sends.
INDEX_BYTES, CONTEXTS, SEND_BYTES = 1 << 20, 1 << 14, 16 << 20


def chunk_of(ids: np.ndarray, chunks: int) -> np.ndarray:
    """The chunks of documents."""
    return np.mod(ids ^ (ids >> 15), chunks).astype(np.int32)


ZSTD = pa.Codec("zstd", compression_level=1)


def planes(values: np.ndarray) -> bytes:
    """The lowest bytes of all values, then the next, which compresses better."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes() if values.itemsize > 1 else values.tobytes()


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed message; see :func:`unpacked`."""
    body = b"".join(planes(np.ascontiguousarray(a)) for a in arrays)
    return np.array([len(body), *(len(a) for a in arrays)], np.int64).tobytes() + ZSTD.compress(body, asbytes=True)


def unpacked(blob: bytes, *kinds) -> list[np.ndarray]:
    sizes = np.frombuffer(blob, np.int64, len(kinds) + 1).tolist()
    body = ZSTD.decompress(memoryview(blob)[8 * len(sizes) :], sizes[0], asbytes=True)
    out, at = [], 0
    for kind, n in zip(kinds, sizes[1:], strict=True):
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(body, np.uint8, n * width, at).reshape(width, n).T).reshape(-1).view(kind))
        at += n * width
    return out


KEY_SHIFT = np.uint64(16)


def halves(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32), (keys >> np.uint64(32)).astype(np.uint16)


def joined(parts: list[np.ndarray]) -> list[np.ndarray]:
    """A message of the first exchange: keys, steps of ids, places, keys known to be shared, their documents."""
    key, known = (low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32) for low, high in (parts[:2], parts[4:6]))
    return [key, parts[2], parts[3], known, parts[6]]


def slices(groups: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Value, start and end of each run of equal values."""
    if len(groups):
        edge = np.concatenate([[0], np.flatnonzero(groups[1:] != groups[:-1]) + 1, [len(groups)]]).tolist()
        yield from ((int(groups[a]), a, b) for a, b in zip(edge[:-1], edge[1:], strict=True))


ROWS = [T.StructField("bucket", T.IntegerType()), T.StructField("chunk", T.IntegerType()), T.StructField("blob", T.BinaryType())]
ENTRY, HOT = -1, -2


def rows_of(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["bucket", "chunk", "blob"])


def by_chunk(ids: np.ndarray, chunks: int, *arrays: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Rows that go to the chunks of their ids."""
    chunk = chunk_of(ids, chunks)
    order = np.argsort(chunk, kind="stable")
    for c, a, b in slices(chunk[order]):
        yield c, c, packed(*(x[order[a:b]] for x in (ids, *arrays)))


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((mix(key) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)


def first_pass(df: DataFrame, length: int, chunks: int) -> DataFrame:
    """Anchors dealt by 48 bits of their strings' hashes; anchors that two documents sent together have go straight to the documents' chunks.

    Strings that agree in these bits only are candidates in vain, no more.
    """

    def sent(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        key, place, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(key)
        key, place, doc = key[order], place[order], doc[order]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.diff(np.concatenate([start, [len(key)]]))
        several = np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start)
        shared = np.repeat(several, count)
        out = list(by_chunk(doc[shared], chunks, place[shared]))
        one, known, docs = ~shared, key[start[several]], count[several].astype(np.uint32)
        key, place, doc = key[one], place[one], doc[one]
        bucket = bucket_of(key, chunks)
        order = np.lexsort((place, doc, bucket))
        key, place, doc, bucket = key[order], place[order], doc[order], bucket[order]
        own = bucket_of(known, chunks)
        order = np.argsort(own, kind="stable")
        own, known, docs = own[order], known[order], docs[order]
        for k in np.union1d(bucket, own).tolist():
            (a, b), (c, d) = (np.searchsorted(x, [k, k + 1]).tolist() for x in (bucket, own))
            out.append((k, ENTRY, packed(*halves(key[a:b]), np.diff(doc[a:b], prepend=0), place[a:b], *halves(known[c:d]), docs[c:d])))
        return rows_of(out)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            data, at = raw(batch.column(1))
            for name, a, b in zip(batch.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                p, h = anchors(data[a:b], length)
                if len(p):
                    parts.append((h >> KEY_SHIFT, p.astype(np.uint32), np.full(len(p), name)))
            held += len(data)
            if parts and held >= SEND_BYTES:
                yield sent(parts)
                parts, held = [], 0
        if parts:
            yield sent(parts)

    return map_batches(df, work, ROWS)


def repeated(dealt: DataFrame, chunks: int) -> DataFrame:
    """Positions, by chunk, of the anchors that several documents have; and the frequent ones."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            ready = [(b, c, x) for b, c, x in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)]
            yield rows_of([r for r in ready if r[1] != ENTRY])
            parts += [joined(unpacked(x, np.uint32, np.uint16, np.int64, np.uint32, np.uint32, np.uint16, np.uint32)) for _, c, x in ready if c == ENTRY]
        if not parts:
            return
        key = np.concatenate([p[0] for p in parts] + [p[3] for p in parts])
        n = sum(len(p[0]) for p in parts)
        doc = np.concatenate([np.cumsum(p[1]) for p in parts] + [np.zeros(len(key) - n, np.int64)])
        place = np.concatenate([p[2] for p in parts])
        docs = np.concatenate([np.ones(n, np.int64)] + [p[4].astype(np.int64) for p in parts])
        order = np.argsort(key)
        key, doc, docs = key[order], doc[order], docs[order]
        single = order < n
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.diff(np.concatenate([start, [len(key)]]))
        least, most = np.minimum.reduceat(np.where(single, doc, np.iinfo(np.int64).max), start), np.maximum.reduceat(np.where(single, doc, np.iinfo(np.int64).min), start)
        several = (least < most) | ~np.logical_and.reduceat(single, start)
        use = np.repeat(several, count) & single
        out = list(by_chunk(doc[use], chunks, place[order[use]]))
        total = np.add.reduceat(docs, start)
        hot = several & (total >= HOT_DOCS)
        if several.any():
            out.append((0, HOT, packed(key[start[hot]], total[hot], np.array([total[several].sum()]))))
        yield rows_of(out)

    return map_batches(dealt, work, ROWS)


def distinct_rows(names: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Number of each row among the rows with its id, in the order of their texts."""
    sub = np.zeros(len(names), np.int32)
    if len(np.unique(names)) < len(names):
        seen: dict[int, int] = {}
        for i in sorted(range(len(names)), key=lambda i: (names[i], texts[i])):
            sub[i] = seen.get(int(names[i]), 0)
            seen[int(names[i])] = int(sub[i]) + 1
    return sub


def same_before(rows: np.ndarray, *others: np.ndarray) -> np.ndarray:
    """Whether each row has the bytes, and the values of ``others``, of the row before it."""
    out = np.zeros(len(rows), bool)
    for a in range(1, len(rows), CONTEXTS):
        b = min(len(rows), a + CONTEXTS)
        out[a:b] = (rows[a:b] == rows[a - 1 : b - 1]).all(1)
    for x in others:
        out[1:] &= x[1:] == x[:-1]
    return out


def settled(hashes: np.ndarray, doc: np.ndarray, rows: np.ndarray, *others: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order in which rows of equal bytes stand together; where such a class begins; and whether a smaller document is in it.

    Rows are brought together by their hashes and compared by their bytes; where different rows share a hash, they are sorted by bytes.
    """
    order = np.lexsort((doc, hashes))
    h = hashes[order]
    new = ~same_before(rows[order], *(x[order] for x in others))
    group = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else new
    new |= group
    if (mixed := np.flatnonzero(new & ~group)).size:
        starts = np.flatnonzero(group)
        for g in np.unique(np.searchsorted(starts, mixed, "right") - 1).tolist():
            a, b = int(starts[g]), int(starts[g + 1]) if g + 1 < len(starts) else len(order)
            name = lambda i: (*(int(x[i]) for x in others), rows[i].tobytes())
            order[a:b] = sorted(order[a:b].tolist(), key=lambda i: (name(i), doc[i]))
            names = [name(i) for i in order[a:b].tolist()]
            new[a:b] = [i == 0 or names[i] != names[i - 1] for i in range(b - a)]
    first = np.flatnonzero(new)
    least = np.repeat(doc[order[first]], np.diff(np.append(first, len(order))))
    return order, first, doc[order] > least


def window_sums(rows: np.ndarray, length: int) -> np.ndarray:
    """A hash of each string of ``length`` neighbouring columns, for each row."""
    width = rows.shape[1]
    weights = np.cumprod(np.full(width, 0x9E3779B97F4A7C15 | 1, np.uint64))
    sums = np.zeros((len(rows), width + 1), np.uint64)
    np.cumsum((rows.astype(np.uint64) + np.uint64(1)) * weights, axis=1, out=sums[:, 1:])
    return mix(sums[:, length:] - sums[:, : width + 1 - length])


def shared_by_two(values: np.ndarray) -> np.ndarray:
    """Whether another row has the same value."""
    order = np.argsort(values)
    same = values[order][1:] == values[order][:-1]
    out = np.zeros(len(values), bool)
    out[order] = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    return out


def fitting(left: np.ndarray, right: np.ndarray, length: int) -> np.ndarray:
    """Which strings of ``length`` neighbouring columns lie within each context."""
    before = length - GRAM
    o = np.arange(before + 1)[None, :]
    return (o >= before - left.astype(np.int64)[:, None]) & (o + length <= before + right.astype(np.int64)[:, None])


def joined_strings(rows: np.ndarray, todo: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The part of each row that its windows in question cover, each followed by a terminator; the ends; and each part's first column."""
    first, last = todo.argmax(1), todo.shape[1] - 1 - todo[:, ::-1].argmax(1)
    column = np.arange(rows.shape[1] + 1)[None, :]
    use = (column >= first[:, None]) & (column <= (last + length)[:, None])
    padded = np.concatenate([rows, np.zeros((len(rows), 1), np.uint8)], 1)
    ends = np.cumsum(last + length - first + 1) - 1
    flat = padded[use]
    flat[ends] = 0
    return flat, ends, first


def streamed(rows: np.ndarray, group: np.ndarray, doc: np.ndarray, todo: np.ndarray, length: int) -> np.ndarray:
    """Which windows (row, column) a row of the same group with a smaller document has; ``todo``: the windows in question.

    The documents of a group are numbered. In round b, those whose number has bit b are streamed against a
    run-length index of those that agree with them in all higher bits and lack bit b. A row of which every window
    is found has nothing that an earlier row lacks, and is neither indexed nor streamed any more.
    """
    found, todo = np.zeros_like(todo), todo.copy()
    order = np.lexsort((doc, group))
    g, d = group[order], doc[order]
    head = np.concatenate([[True], g[1:] != g[:-1]])
    number = np.cumsum(np.concatenate([[True], d[1:] != d[:-1]]) | head)
    rank = np.empty(len(order), np.int64)
    rank[order] = number - np.maximum.accumulate(np.where(head, number, 0))
    bit = 0
    while True:
        live = np.flatnonzero(todo.any(1))
        if not len(live) or not (rank[live] >> bit).any():
            return found
        block = np.unique(np.stack([group[live], rank[live] >> (bit + 1)]), axis=1, return_inverse=True)[1].reshape(-1)
        high = (rank[live] >> bit & 1).astype(bool)
        both = np.intersect1d(block[high], block[~high])
        use = np.isin(block, both)
        live, block, high = live[use], np.searchsorted(both, block[use]), high[use]
        by = np.argsort(block, kind="stable")
        live, block, high = live[by], block[by], high[by]
        low, own = live[~high], block[~high]
        size = np.cumsum((todo[low].shape[1] - todo[low].argmax(1) - todo[low][:, ::-1].argmax(1)) + length) if len(low) else np.zeros(0, np.int64)
        for part in np.split(np.arange(len(low)), np.flatnonzero(np.diff(size // INDEX_BYTES)) + 1):
            if not len(part):
                continue
            a, b = int(own[part[0]]), int(own[part[-1]])
            flat, ends, _ = joined_strings(rows[low[part]], todo[low[part]], length)
            index = RunIndex.build(flat, ends, own[part] - a)
            rest = np.flatnonzero(high & (block >= a) & (block <= b) & todo[live].any(1))
            for c in range(0, len(rest), CONTEXTS):
                some = live[rest[c : c + CONTEXTS]]
                flat, ends, first = joined_strings(rows[some], todo[some], length)
                matched, _ = index.statistics(flat, ends, block[rest[c : c + CONTEXTS]] - a)
                at = np.flatnonzero(matched >= length)
                string = np.searchsorted(ends, at)
                column = at - np.append(0, ends[:-1] + 1)[string] + first[string]
                found[some[string], column] = True
        todo &= ~found
        bit += 1


def surroundings(ids: np.ndarray, texts: list[bytes], wanted: dict[int, np.ndarray], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Bytes around the wanted anchors: document, number among rows of its id, place, bytes to the left and right, the bytes."""
    before, width = length - GRAM, 2 * length - GRAM
    sub = distinct_rows(ids, texts)
    for i, text in enumerate(texts):
        p = wanted.get(int(ids[i]))
        if p is None or len(text) < length:
            continue
        p = np.unique(p[p <= len(text) - GRAM]).astype(np.int64)
        flat = np.concatenate([np.zeros(before, np.uint8), np.frombuffer(text, np.uint8), np.zeros(length, np.uint8)])
        yield np.full(len(p), ids[i]), np.full(len(p), sub[i], np.int32), p, np.minimum(before, p), np.minimum(length, len(text) - p), np.lib.stride_tricks.sliding_window_view(flat, width)[p]


def contexts(ids: np.ndarray, texts: list[bytes], wanted: dict[int, np.ndarray], hot: np.ndarray, length: int, chunks: int) -> list[tuple[int, int, bytes]]:
    """The rows that a chunk of documents sends: contexts by their anchors, windows of hot anchors, and what is settled here."""
    before = length - GRAM
    parts = list(surroundings(ids, texts, wanted, length))
    if not sum(len(p[0]) for p in parts):
        return []
    doc, own, place, left, right, matrix = (np.concatenate(x) for x in zip(*parts, strict=True))
    parts.clear()
    key = gram_hash(*(np.ascontiguousarray(matrix[:, before + k : before + k + 8]).view("<u8").ravel() for k in (0, 8, GRAM - 8)))
    out: list[tuple[int, int, bytes]] = []
    order, _, later = settled(key ^ mix(whole_hash(matrix)), doc, matrix, left, right)
    gone = order[later]
    done = [(doc[gone], own[gone], place[gone] - left[gone], place[gone] + right[gone])]
    order = order[~later]
    is_hot = np.isin(key[order] >> KEY_SHIFT, hot) if len(hot) else np.zeros(len(order), bool)
    send, spread = order[~is_hot], order[is_hot]
    bucket = bucket_of(key[send] ^ np.uint64(0x5DEECE66D), chunks)
    by = np.argsort(bucket, kind="stable")
    send = send[by]
    for b, i, j in slices(bucket[by]):
        s = send[i:j]
        out.append((b, ENTRY, packed(doc[s], own[s], place[s].astype(np.uint32), left[s].astype(np.uint16), right[s].astype(np.uint16), matrix[s].ravel())))
    spread = spread[np.argsort(key[spread], kind="stable")]
    for a in range(0, len(spread), CONTEXTS):
        some = spread[a : a + CONTEXTS]
        row, column = np.nonzero(fitting(left[some], right[some], length))
        h = window_sums(matrix[some], length)[row, column] ^ mix(key[some[row]] + column.astype(np.uint64))
        windows = np.lib.stride_tricks.sliding_window_view(matrix[some], length, axis=1)[row, column]
        row, at = some[row], place[some[row]] - before + column
        by, _, later = settled(h, doc[row], windows)
        gone = by[later]
        done.append((doc[row[gone]], own[row[gone]], at[gone], at[gone] + length))
        kept = by[~later]
        bucket = bucket_of(h[kept], chunks)
        kept = kept[np.lexsort((column[kept], row[kept], bucket))]
        for b, i, j in slices(bucket_of(h[kept], chunks)):
            s = kept[i:j]
            out.append((b, HOT, packed(h[s], doc[row[s]], own[row[s]], at[s].astype(np.uint32), windows[s].ravel())))
    doc, own, a, b = (np.concatenate(x) for x in zip(*done, strict=True))
    out += by_chunk(doc, chunks, own, a.astype(np.uint32), b.astype(np.uint32))
    return out


def whole_hash(rows: np.ndarray) -> np.ndarray:
    """A hash of each row's bytes."""
    padded = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    padded[:, : rows.shape[1]] = rows
    out = np.zeros(len(rows), np.uint64)
    for column in padded.view(np.uint64).T:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return out


def carried(batch: pa.RecordBatch, rows: np.ndarray) -> np.ndarray:
    """The columns from the fourth on of some rows, as bytes."""
    if batch.num_columns < 4:
        return np.zeros(0, np.uint8)
    out = pa.BufferOutputStream()
    columns = pa.RecordBatch.from_arrays([c.take(pa.array(rows)) for c in batch.columns[3:]], names=batch.schema.names[3:])
    with pa.ipc.new_stream(out, columns.schema) as stream:
        stream.write_batch(columns)
    return np.frombuffer(out.getvalue(), np.uint8)


def dealt_texts(docs: DataFrame, chunks: int) -> DataFrame:
    """Texts by chunk, many in a message; ``docs`` has an id, a text, whether it is a later copy, and columns to carry along."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = raw(batch.column(1))
            ids, known = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            copy = batch.column(2).to_numpy(zero_copy_only=False)
            chunk = np.where(known, chunk_of(ids, chunks), np.arange(len(ids)) % chunks)
            order = np.argsort(chunk, kind="stable")
            rows = []
            for c, a, b in slices(chunk[order]):
                own = order[a:b]
                rows.append((c, c, packed(ids[own], known[own], copy[own], np.diff(at)[own], np.concatenate([data[at[i] : at[i + 1]] for i in own.tolist()]), carried(batch, own))))
            yield rows_of(rows)

    return map_batches(docs, work, ROWS).select("chunk", "blob")


def texts_of(blobs: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes], list[pa.Table]]:
    """Ids, whether they are known, whether the row is a copy, texts, and the columns carried along."""
    parts = [unpacked(x, np.int64, np.bool_, np.bool_, np.int64, np.uint8, np.uint8) for x in blobs.to_pylist()]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, bool), [], []
    texts = []
    for *_, sizes, data, _ in parts:
        flat, ends = data.tobytes(), np.cumsum(sizes)
        texts += [flat[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
    ids, known, copy = (np.concatenate([p[i] for p in parts]) for i in range(3))
    return ids, known, copy, texts, [pa.ipc.open_stream(pa.py_buffer(p[5])).read_all() for p in parts if len(p[5])]


def second_pass(docs: DataFrame, places: DataFrame, hot: np.ndarray, length: int, chunks: int) -> DataFrame:
    """Contexts of the repeated anchors of each chunk's documents."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        wanted: dict[int, list[np.ndarray]] = {}
        for blob in right.column(1).to_pylist():
            ids, p = unpacked(blob, np.int64, np.uint32)
            order = np.argsort(ids, kind="stable")
            for i, a, b in slices(ids[order]):
                wanted.setdefault(i, []).append(p[order[a:b]])
        ids, _, _, texts, _ = texts_of(left.column(1))
        return pa.Table.from_batches([rows_of(contexts(ids, texts, {k: np.concatenate(v) for k, v in wanted.items()}, shared.value, length, chunks))])

    return docs.groupBy("chunk").cogroup(places.groupBy("chunk")).applyInArrow(lambda a, b: returned(work, a.select(["chunk", "blob"]), b.select(["chunk", "blob"])), T.StructType(ROWS))


def later_windows(key: np.ndarray, doc: np.ndarray, left: np.ndarray, right: np.ndarray, rows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each window of contexts, sorted by key, that a smaller document's context of the same key has."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    cuts = [*start[np.flatnonzero(np.diff(start // CONTEXTS, prepend=-1))].tolist(), len(key)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):  # whole keys, so that a very large one is a part of its own
        group = np.searchsorted(start, np.arange(a, b), "right")
        todo = fitting(left[a:b], right[a:b], length)
        row, column = np.nonzero(todo)
        sums = np.concatenate([window_sums(rows[c : min(b, c + CONTEXTS)], length) for c in range(a, b, CONTEXTS)])[row, column]
        todo[row, column] = shared_by_two(sums + mix((group[row] * rows.shape[1] + column).astype(np.uint64)))
        some = np.flatnonzero(todo.any(1))
        if len(some):
            row, column = np.nonzero(streamed(rows[a + some], group[some], doc[a + some], todo[some], length))
            out.append((a + some[row], column))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def matched(dealt: DataFrame, length: int, chunks: int) -> DataFrame:
    """Ranges of bytes to remove, by chunk."""
    before, width = length - GRAM, 2 * length - GRAM

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, windows = [], []
        for batch in batches:
            ready = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            yield rows_of([r for r in ready if r[1] >= 0])
            parts += [unpacked(x, np.int64, np.int32, np.uint32, np.uint16, np.uint16, np.uint8) for _, c, x in ready if c == ENTRY]
            windows += [unpacked(x, np.uint64, np.int64, np.int32, np.uint32, np.uint8) for _, c, x in ready if c == HOT]
        ranges = []
        if parts:
            doc, own, place, left, right, text = (np.concatenate(x) for x in zip(*parts, strict=True))
            parts.clear()
            place, text = place.astype(np.int64), text.reshape(-1, width)
            key = gram_hash(*(np.ascontiguousarray(text[:, before + k : before + k + 8]).view("<u8").ravel() for k in (0, 8, GRAM - 8)))
            order, first, later = settled(key ^ mix(whole_hash(text)), doc, text, left, right)
            gone = order[later]
            ranges.append((doc[gone], own[gone], place[gone] - left[gone], place[gone] + right[gone]))
            size = np.add.reduceat((~later).astype(np.int64), first)  # the smallest document's places, which share their windows
            some = np.flatnonzero(shared_by_two(key[order[first]]))
            some = some[np.argsort(key[order[first[some]]], kind="stable")]
            chosen = order[first[some]]
            rows, columns = later_windows(key[chosen], doc[chosen], left[chosen], right[chosen], text[chosen], length)
            if len(rows):
                counts = size[some][rows]
                where = np.repeat(first[some][rows] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
                hit = order[where]
                at = place[hit] + np.repeat(columns, counts) - before
                ranges.append((doc[hit], own[hit], at, at + length))
        if windows:
            h, doc, own, place, text = (np.concatenate(x) for x in zip(*windows, strict=True))
            order, _, later = settled(h, doc, text.reshape(-1, length))
            gone = order[later]
            ranges.append((doc[gone], own[gone], place[gone].astype(np.int64), place[gone].astype(np.int64) + length))
        if ranges:
            d, o, a, b = (np.concatenate(x) for x in zip(*ranges, strict=True))
            yield rows_of(list(by_chunk(d, chunks, o, a.astype(np.uint32), b.astype(np.uint32))))

    return map_batches(dealt, work, ROWS)


def removed_runs(ranges: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs that the ranges cover."""
    a, b = ranges
    order = np.argsort(a, kind="stable")
    a, b = a[order].astype(np.int64), np.maximum.accumulate(np.minimum(b[order].astype(np.int64), n))
    new = np.concatenate([[True], a[1:] > b[:-1]])
    return a[new], b[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(a) - 1]])]


def result(docs: DataFrame, ranges: DataFrame, length: int, keep_text: bool, extra: list[T.StructField]) -> DataFrame:
    """The kept bytes of each document."""
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"][: 5 + keep_text]

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        cut: dict[int, list] = {}
        for blob in right.column(0).to_pylist():
            ids, own, a, b = unpacked(blob, np.int64, np.int32, np.uint32, np.uint32)
            order = np.argsort(ids, kind="stable")
            for i, x, y in slices(ids[order]):
                cut.setdefault(i, []).append((own[order[x:y]], a[order[x:y]], b[order[x:y]]))
        ids, known, copies, texts, extras = texts_of(left.column(0))
        unknown = (~known).tolist()
        rows, sub = [], distinct_rows(ids, texts)
        for k, (i, text, copy) in enumerate(zip(ids.tolist(), texts, copies.tolist(), strict=True)):
            n = len(text)
            if copy:
                starts, ends = (np.array([0]), np.array([n])) if n >= length else (np.zeros(0, np.int64),) * 2
            elif i in cut and not unknown[k]:
                own, a, b = (np.concatenate(x) for x in zip(*cut[i], strict=True))
                use = own == sub[k]
                starts, ends = removed_runs([a[use], b[use]], n) if use.any() else (np.zeros(0, np.int64),) * 2
            else:
                starts, ends = (np.zeros(0, np.int64),) * 2
            kept = b"".join(text[a:b] for a, b in zip([0, *ends.tolist()], [*starts.tolist(), n], strict=True))
            rows.append((None if unknown[k] else i, n, n - len(kept), len(starts), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore"))[: 5 + keep_text])
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        own = [pa.array(c, k) for c, k in zip(columns, kinds, strict=False)]
        if extra:
            carried_ = pa.concat_tables(extras) if extras else extra_schema.empty_table()
            own += [carried_.column(i) for i in range(len(extra))]
        return pa.Table.from_arrays(own, names=[*names, *(f.name for f in extra)])

    fields = [T.StructField("id", T.LongType()), *(T.StructField(x, T.LongType()) for x in names[1:4]), *(T.StructField(x, T.StringType()) for x in names[4:]), *extra]
    extra_schema = to_arrow_schema(T.StructType([T.StructField(f"extra_{f.name}", f.dataType) for f in extra]))
    return docs.groupBy("chunk").cogroup(ranges.groupBy("chunk")).applyInArrow(lambda a, b: returned(work, a.select(["blob"]), b.select(["blob"])), T.StructType(fields))


def hot_anchors(places: DataFrame) -> np.ndarray:
    """Sorted keys of the anchors to be dealt by windows: fewer than ``HOT_SHARE``."""
    rows = places.where(F.col("chunk") == HOT).select("blob")

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int(unpacked(x, np.uint64, np.int64, np.int64)[2][0]) for x in batch.column(0).to_pylist()], pa.int64())], names=["n"])

    every = map_batches(rows, totals, [T.StructField("n", T.LongType())]).agg(F.sum("n")).first()[0] or 0
    least = max(HOT_DOCS, every // HOT_SHARE + 1)

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0).to_pylist():
                keys, counts, _ = unpacked(x, np.uint64, np.int64, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys[counts >= least].view(np.int64))], names=["key"])

    found = [r[0] for r in map_batches(rows, frequent, [T.StructField("key", T.LongType())]).collect()]
    return np.sort(np.array(found, np.int64).view(np.uint64))


def dedup_bytes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, keep_text: bool = False, extra: tuple[str, ...] = (), chunk_bytes: int = 64 << 20) -> DataFrame:
    """One row per input row: the id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``; with ``keep_text`` also ``kept_text``; and the columns ``extra``.

    Removed is each byte covered by a string of ``length`` bytes that also begins in a document with a
    smaller id; strings are judged on the input. A null or empty text has no bytes. Rows with one id are
    neither smaller nor larger than each other. A row with a null id keeps all its bytes and removes no
    others. Other columns are ignored, an empty table gives an empty one. Texts are taken whole.
    ``kept_text`` leaves out characters of which only some bytes are kept. ``length`` is at least 32 and
    ids are integers; anything else is an error. There are as many chunks and buckets as shuffle partitions,
    and more where they would get over ``chunk_bytes`` of text.
    """
    if length < 32:
        raise ValueError("length must be 32 or more")
    if not isinstance(df.schema[id_col].dataType, T.IntegralType):
        raise ValueError(f"{id_col} must be an integer column")
    spark = df.sparkSession
    stored = Stored(spark)
    own = [F.col(c).alias(f"extra_{c}") for c in extra]
    every = df.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *own)
    sha = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    digests = stored(every.select("id", sha.alias("h"), F.octet_length("text").alias("n")))
    n_bytes = digests.agg(F.sum("n")).first()[0] or 0
    chunks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // chunk_bytes)) | 1
    same = digests.where("id is not null").where(F.col("n") >= length).select("id", "h")
    firsts = stored(same.groupBy("h").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("h", "least"))
    copies = same.join(small(firsts), "h").where("id > least").groupBy("id").agg(F.collect_set("h").alias("copied"))
    copies = small(stored(copies))
    stored.drop(digests, firsts)
    # the texts of ids with a copy are hashed again, no others
    flagged = every.join(copies, "id", "left").withColumn("copy", F.when(F.col("copied").isNull(), False).otherwise(F.array_contains("copied", sha)))
    flagged = flagged.select("id", "text", "copy", *(f"extra_{c}" for c in extra))
    unique = flagged.where("id is not null and not copy").select("id", "text")
    dealt = lambda rows: rows.repartitionById(chunks, "bucket")
    places = stored(repeated(dealt(first_pass(unique, length, chunks)), chunks))
    stored.release()
    hot = hot_anchors(places)
    texts = dealt_texts(unique.withColumn("copy", F.lit(False)), chunks)
    ranges = stored(matched(dealt(second_pass(texts, places.where("chunk >= 0").select("chunk", "blob"), hot, length, chunks)), length, chunks))
    stored.drop(places)
    stored.release()
    out = result(dealt_texts(flagged, chunks), ranges.select("chunk", "blob"), length, keep_text, [df.schema[c] for c in extra])
    return out.withColumn("id", F.col("id").cast(df.schema[id_col].dataType)).withColumnRenamed("id", id_col)
