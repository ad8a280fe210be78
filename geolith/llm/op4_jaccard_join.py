"""N-gram Jaccard join: size-banded tiles, bitmap signatures, exact intersections.

Documents with equal shingle sets form a class, and classes are joined. Under one order of all shingles
two sets of Jaccard similarity t or more share one of their first n - ceil(t n) + 1 shingles; a tile is
the classes that share such a shingle and have sizes within the band that t allows. In a first round each
tile's classes are compared with the tile's leader; what is linked then needs no more comparisons, so a
large group of near copies costs its size, not its square. In a second round, tiles that still hold
several components compare pairs across components. Pairs are first bounded by bit counts of hashed
bitmaps, whose width grows with the size band, and then intersected exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geolith.llm.batches import field, map_batches, raw, runs
from geolith.llm.shared import Stored, components, grouped, small
from geolith.llm.tokens import LOWER, NOT_SPACE, mix, span_hashes, words

RUN = 1 << 19
#: Rows of a tile's block: a ``PARTS``-th of the tile, but ``LEAST`` at least and ``TILE`` at most. Larger tiles are compared block by block.
LEAST, TILE, PARTS = 64, 1024, 16
#: Prefix shingles that one partition gets, and buckets at least.
BUCKET, BUCKETS = 1 << 22, 128
#: Frequent shingles that come last in the order, so that they rarely make a tile; the order changes no result.
FREQUENT = 4096
FACTORS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingle_sets(texts: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct shingle hashes of each text with a word."""
    data, at = raw(texts)
    for first, last in runs(at, RUN):
        base = int(at[first])
        own, cut = LOWER[data[base : int(at[last])]], at[first : last + 1] - base
        starts, ends = words(own, cut, NOT_SPACE)
        if not len(starts):
            continue
        (h,) = span_hashes(own, starts, ends)
        edge = np.searchsorted(starts, cut)
        n = len(h) - size + 1
        joined = np.zeros(max(0, n), np.uint64)
        for i in range(size):
            joined += h[i : i + n] * FACTORS[i % 5] if n > 0 else np.zeros(0, np.uint64)
        joined = mix(joined)
        for row, (a, b) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)):
            if b - a >= size:
                s = np.sort(joined[a : b - size + 1])
                yield first + row, s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) > 1 else s
            elif b > a:
                short = (h[a:b] * FACTORS[np.arange(b - a) % 5]).sum(dtype=np.uint64)
                yield first + row, mix(np.array([short + np.uint64(b - a)], np.uint64) ^ np.uint64(0x5851F42D4C957F2D))


def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over a set."""
    n = np.uint64(len(shingles))
    both = mix(np.array([mix(shingles ^ FACTORS[0]).sum(dtype=np.uint64) + n, mix(shingles ^ FACTORS[1]).sum(dtype=np.uint64) + n], np.uint64)).view(np.int64)
    return int(both[0]), int(both[1])


def summaries(df: DataFrame, size: int) -> DataFrame:
    """A row per document: id, n, and two fingerprints; and rows with a null id flag, ``hot``, for shingles frequent in a batch."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, one, two = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            found: dict[int, np.ndarray] = {}
            for row, s in shingle_sets(batch.column(1).fill_null(""), size):
                n[row] = len(s)
                one[row], two[row] = fingerprint(s)
                found[int(one[row])] = s
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(one), pa.array(two), pa.array(np.zeros(len(n), bool))], names=["id", "n", "h1", "h2", "hot"])
            if found:
                value, count = np.unique(np.concatenate(list(found.values())), return_counts=True)
                often = count >= 3
                k = int(often.sum())
                yield pa.RecordBatch.from_arrays([pa.nulls(k, batch.column(0).type), pa.array(count[often].astype(np.int64)), pa.array(value[often].view(np.int64)), pa.array(np.zeros(k, np.int64)), pa.array(np.ones(k, bool))], names=["id", "n", "h1", "h2", "hot"])

    longs = [T.StructField(x, T.LongType()) for x in ("n", "h1", "h2")]
    return map_batches(df, work, [field(df, "id"), *longs, T.StructField("hot", T.BooleanType())])


def least_overlap(n: np.ndarray | int, percent: int):
    """Shingles of a set of n that a partner has at least: ceil(percent / 100 * n)."""
    return (percent * n + 99) // 100


def shared_least(n: np.ndarray | int | Column):
    """Prefix shingles that linked sets share at least, if prefixes are longer by one less: a 25th of the set."""
    return 1 + (F.floor(n / 25) if isinstance(n, Column) else n // 25)


def tile_members(df: DataFrame, size: int, percent: int, hot: np.ndarray, partitions: int) -> DataFrame:
    """``key``, ``cls`` and ``n`` for each prefix shingle that two classes or more have; as many buckets for each partition."""
    buckets = partitions * -(-BUCKETS // partitions)
    shared = df.sparkSession.sparkContext.broadcast(hot)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = shared.value
        seen: set[int] = set()
        for batch in batches:
            keys, classes, sizes = [], [], []
            for _, s in shingle_sets(batch.column(1).fill_null(""), size):
                h = fingerprint(s)[0]
                if h in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(h)
                prefix = prefix_length(len(s), percent)
                own = s[:prefix]
                if len(last):
                    frequent = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s
                    if frequent.any():
                        own = np.concatenate([s[~frequent], s[frequent]])[:prefix]
                keys.append(own)
                classes.append(h)
                sizes.append((len(s), len(own)))
            if not keys:
                continue
            key, repeat = np.concatenate(keys), [p for _, p in sizes]
            cls, n = np.repeat(np.array(classes, np.int64), repeat), np.repeat(np.array([n for n, _ in sizes], np.int32), repeat)
            bucket = ((mix(key ^ FACTORS[2]) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            key, cls, n, bucket = key[order], cls[order], n[order], bucket[order]
            edge = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]]).tolist()
            blobs = [key[a:b].tobytes() + cls[a:b].tobytes() + n[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[edge[:-1]]), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, classes, sizes = [], [], []
        for batch in batches:
            for blob in batch.column(1).to_pylist():
                k = len(blob) // 20
                keys.append(np.frombuffer(blob, np.uint64, k))
                classes.append(np.frombuffer(blob, np.int64, k, 8 * k))
                sizes.append(np.frombuffer(blob, np.int32, k, 16 * k))
        if not keys:
            return
        key = np.concatenate(keys)
        order = np.argsort(key)
        key = key[order]
        same = key[1:] == key[:-1]
        again = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        order, key = order[again], key[again]
        cls, n = np.concatenate(classes)[order], np.concatenate(sizes)[order]
        order = np.lexsort((cls, key))
        key, cls, n = key[order], cls[order], n[order]
        if not len(key):
            return
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])])
        key, cls, n = key[new], cls[new], n[new]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.diff(np.concatenate([start, [len(key)]]))
        use = np.repeat(count > 1, count)
        yield pa.RecordBatch.from_arrays([pa.array(key[use].view(np.int64)), pa.array(cls[use]), pa.array(n[use])], names=["key", "cls", "n"])

    dealt = map_batches(df, deal, [T.StructField("bucket", T.IntegerType()), T.StructField("blob", T.BinaryType())]).repartitionById(partitions, "bucket")
    return map_batches(dealt, gather, [T.StructField("key", T.LongType()), T.StructField("cls", T.LongType()), T.StructField("n", T.IntegerType())])


def prefix_length(n, percent: int):
    """Shingles of a set of n that come into tiles."""
    if isinstance(n, Column):
        return n - F.ceil(n * percent / 100) + shared_least(n)
    return n - least_overlap(n, percent) + shared_least(n)


def tiles(members: DataFrame, percent: int, stored: Stored) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of a leader and a member to compare first, and the members (tile, b) of each leader's tile.

    A class whose smallest possible partner would share more prefix shingles with it than it shares with
    anyone has no link and leaves its tiles. A shingle's leader is the class that shares most of its own
    prefix with others, as an original does with its copies; all tiles of one leader are one tile.
    """
    counts = members.groupBy("cls", "n").agg(F.count("*").alias("shared"))
    least = shared_least(F.ceil(F.col("n") * percent / 100))
    rank = F.floor(1e6 * F.col("shared") / prefix_length(F.col("n"), percent)).cast("int").alias("rank")
    chosen = stored(counts.where(F.col("shared") >= least).select("cls", rank))
    own = stored(members.join(small(chosen), "cls"))
    firsts = stored(own.groupBy("key").agg(F.max(F.struct("rank", "cls", "n")).alias("first"), F.count("*").alias("m")).where("m > 1").select("key", F.col("first.cls").alias("tile"), F.col("first.n").alias("size")))
    rows = stored(own.join(firsts, "key").where(F.col("cls") != F.col("tile")).groupBy("tile", "size", "cls", "n").agg(F.lit(1).alias("one")))
    fits = F.least("n", "size") * 100 >= F.greatest("n", "size") * percent
    pairs = stored(rows.where(fits).select(F.col("tile").alias("a"), F.col("cls").alias("b")))
    rest = stored(rows.select("tile", F.col("cls").alias("b")))
    stored.drop(own, firsts, chosen, rows)
    return pairs, rest


def signature(shingles: np.ndarray) -> np.ndarray:
    """A bitmap with eight bits or more for each shingle of the size band, as bytes."""
    bits = max(64, 1 << (8 * len(shingles) - 1).bit_length())
    out = np.zeros(bits, np.uint8)
    out[(mix(shingles ^ FACTORS[3]) & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little")


def fold(bitmap: np.ndarray, size: int) -> np.ndarray:
    """The bitmap of the same set with fewer bits."""
    return np.bitwise_or.reduce(bitmap.reshape(-1, size), axis=0)


def overlap_bound(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> int:
    """No intersection is larger: each bit that only one bitmap has stands for a shingle that only one set has."""
    width = min(len(a), len(b))
    a, b = fold(a, width), fold(b, width)
    return min(n_a - int(np.bitwise_count(a & ~b).sum()), n_b - int(np.bitwise_count(b & ~a).sum()))


def linked(overlap: int, n_a: int, n_b: int, percent: int) -> bool:
    return 100 * overlap >= percent * (n_a + n_b - overlap)


def set_table(df: DataFrame, size: int) -> DataFrame:
    """``cls``, ``node``, ``n``, the bitmap and the sorted shingles of the given documents."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            rows = [(fingerprint(s)[0], names[i], len(s), signature(s).tobytes(), s.tobytes()) for i, s in shingle_sets(batch.column(1).fill_null(""), size)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = [pa.int64(), batch.column(0).type, pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["cls", "node", "n", "bitmap", "shingles"])

    fields = [T.StructField("cls", T.LongType()), field(df, "id", "node"), T.StructField("n", T.LongType()), T.StructField("bitmap", T.BinaryType()), T.StructField("shingles", T.BinaryType())]
    return map_batches(df, work, fields)


def bounded(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs of classes whose bitmaps allow a link."""
    left = sets.select(F.col("cls").alias("a"), F.col("n").alias("x"), F.col("bitmap").alias("i"))
    right = sets.select(F.col("cls").alias("b"), F.col("n").alias("y"), F.col("bitmap").alias("j"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y", "i", "j")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in range(2, 6))
            keep = [k for k, (n, m, i, j) in enumerate(zip(*columns, strict=True)) if linked(overlap_bound(np.frombuffer(i, np.uint8), np.frombuffer(j, np.uint8), n, m), n, m, percent)]
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in (0, 1)], names=["a", "b"])

    return map_batches(rows, work, [T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Nodes ``a`` and ``b`` of the pairs of classes that link, by intersecting their sorted shingles."""
    left = sets.select(F.col("cls").alias("a"), F.col("node").alias("x"), F.col("shingles").alias("s"))
    right = sets.select(F.col("cls").alias("b"), F.col("node").alias("y"), F.col("shingles").alias("t"))
    rows = pairs.join(left, "a").join(right, "b").select("x", "y", "s", "t")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k, (s, t) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(2, 4)), strict=True)):
                both = np.sort(np.concatenate([np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)]))
                if linked(int((both[1:] == both[:-1]).sum()), len(s) // 8, len(t) // 8, percent):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in (0, 1)], names=["a", "b"])

    return map_batches(rows, work, [field(rows, "x", "a"), field(rows, "y", "b")])


def tile_pairs(maps: list[np.ndarray], sizes: np.ndarray, labels: np.ndarray, blocks: np.ndarray, crossing: bool, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Member and partners of other components that its bitmap allows, of sizes at most its own; members ascend by size.

    ``crossing``: only pairs of different blocks count.
    """
    widths = np.array([len(m) for m in maps])
    by_width = {w: (np.flatnonzero(widths == w), np.stack([maps[i] for i in np.flatnonzero(widths == w)])) for w in np.unique(widths).tolist()}
    for k in range(1, len(maps)):
        n = int(sizes[k])
        first = int(np.searchsorted(sizes, least_overlap(n, percent)))
        for w in (int(widths[k]), int(widths[k]) // 2):
            if w not in by_width:
                continue
            rows, matrix = by_width[w]
            a, b = int(np.searchsorted(rows, first)), int(np.searchsorted(rows, k))
            use = np.arange(a, b)[labels[rows[a:b]] != labels[k]]
            if crossing:
                use = use[blocks[rows[use]] != blocks[k]]
            if not len(use):
                continue
            own, others, m = fold(maps[k], w), matrix[use], sizes[rows[use]]
            bound = np.minimum(n - np.bitwise_count(own & ~others).sum(1, dtype=np.int64), m - np.bitwise_count(others & ~own).sum(1, dtype=np.int64))
            if (fits := linked(bound, n, m, percent)).any():
                yield k, rows[use[fits]]


def blocked(own: DataFrame, percent: int, stored: Stored) -> DataFrame:
    """The rows of mixed tiles, once for each pair of blocks that they have to be compared in: tile, low, high, b, n, label, block.

    A large tile is cut by size bands, of which only neighbours can link, and into blocks. A component with more
    rows than a block has blocks of its own, which need no comparison with each other.
    """
    labels = own.groupBy("tile", "label").agg(F.count("*").alias("c"))
    mixed = labels.groupBy("tile").agg(F.count("*").alias("labels"), F.sum("c").alias("m"), F.collect_list(F.when(F.col("c") > LEAST, F.struct("c", "label"))).alias("large"))
    block = F.least(F.lit(TILE), F.greatest(F.lit(LEAST), F.ceil(F.col("m") / PARTS))).cast("int")
    mixed = mixed.where("labels > 1").withColumn("size", block)
    mixed = mixed.select("tile", "m", "size", F.transform(F.filter("large", lambda x: x["c"] > F.col("size")), lambda x: x["label"]).alias("large"))
    rows = own.join(small(stored(mixed)), "tile")
    band = F.when(F.col("m") > F.col("size"), F.floor(F.log(F.col("n") * 1.0) / float(np.log(100 / percent)))).otherwise(0).cast("int")
    part = F.when(F.array_contains("large", F.col("label")), F.col("label"))
    rows = stored(rows.select("tile", "b", "n", "label", "size", part.alias("part"), band.alias("band")))
    counts = rows.groupBy("tile", "part", "band").agg(F.ceil(F.count("*") / F.first("size")).cast("int").alias("subs"))
    rows = rows.join(small(stored(counts.groupBy("tile").agg(F.collect_list(F.struct("part", "band", "subs")).alias("kinds")))), "tile")
    name = lambda part, band, sub: F.concat_ws(":", F.coalesce(part.cast("string"), F.lit("")), band.cast("string"), sub.cast("string"))
    same = lambda x: x["part"].eqNullSafe(F.col("part")) & (x["band"] == F.col("band"))
    fits = lambda x: (F.abs(x["band"] - F.col("band")) <= 1) & ~F.coalesce(x["part"] == F.col("part"), F.lit(False))
    rows = rows.withColumn("block", name(F.col("part"), F.col("band"), F.pmod(F.xxhash64("b"), F.filter("kinds", same)[0]["subs"])))
    others = F.transform(F.filter("kinds", fits), lambda x: F.transform(F.sequence(F.lit(0), x["subs"] - 1), lambda sub: name(x["part"], x["band"], sub)))
    rows = rows.withColumn("other", F.explode(F.flatten(others)))
    return rows.select("tile", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "b", "n", "label", "block")


def across(members: DataFrame, sets: DataFrame, labels: DataFrame, percent: int, stored: Stored) -> DataFrame:
    """Pairs of classes of one tile in different components whose bitmaps allow a link."""
    info = sets.select(F.col("cls").alias("b"), "node", "n").join(labels, "node", "left").select("b", "n", F.coalesce("component", "node").alias("label"))
    rows = blocked(members.join(info, "b"), percent, stored).join(sets.select(F.col("cls").alias("b"), "bitmap"), "b")
    rows = rows.select("tile", "low", "high", "b", "n", "label", "block", "bitmap")
    rows = rows.repartition("tile", "low", "high").sortWithinPartitions("tile", "low", "high", "n", "b")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in grouped(batches, 3):
            names, sizes, labels_, blocks = (np.array(tile.column(c).to_pylist()) for c in (3, 4, 5, 6))
            maps = [np.frombuffer(x, np.uint8) for x in tile.column(7).to_pylist()]
            crossing = tile.column(1)[0] != tile.column(2)[0]
            for k, partners in tile_pairs(maps, sizes, labels_, blocks, crossing, percent):
                a, b = np.minimum(names[partners], names[k]), np.maximum(names[partners], names[k])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return map_batches(rows, work, [T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: the id, ``n_shingles``, ``component_id``.

    Words are runs of anything but space and bytes 9 to 13, with A-Z in lower case; a text of fewer than
    ``size`` words has one shingle, a null or empty one or one without words none, and is linked with nothing.
    Two documents link if ``percent`` of the union of their shingles is in both. ``component_id`` is the
    smallest id reachable by links. A null id has a null component and links nothing; rows with one id
    are one node. Equal texts of any number are one class. Other columns are ignored, an empty table
    gives an empty one. Texts are taken whole; shingles are compared by 64-bit hashes.
    """
    spark = df.sparkSession
    stored = Stored(spark)
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    all_rows = every = stored(summaries(docs, size))
    hot = every.where("hot").groupBy("h1").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h1").limit(FREQUENT).collect()
    last = np.sort(np.array([r["h1"] for r in hot], np.int64).view(np.uint64))
    entries = every.where("not hot").agg(F.sum(prefix_length(F.col("n"), percent))).first()[0] or 0
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(entries) // BUCKET))
    members = stored(tile_members(docs.where(F.col("id").isNotNull()), size, percent, last, partitions))
    stored.release()
    pairs, rest = tiles(members, percent, stored)
    stored.drop(members)
    every = every.where("not hot")
    classes = stored(every.where("n > 0 and id is not null").groupBy("h1", "h2").agg(F.min("id").alias("node"), F.count("*").alias("rows")))
    used = pairs.select(F.col("a").alias("h1")).union(pairs.select("b")).union(rest.select("b")).distinct()
    nodes = stored(classes.join(used, "h1").select(F.col("node").alias("id")).distinct())
    stored.release()
    sets = stored(set_table(docs.join(small(nodes), "id"), size))
    likely = stored(bounded(pairs, sets, percent))
    edges = stored(verified(likely, sets, percent))
    stored.release()
    labels = stored(components(edges, stored))
    left = stored(across(rest, sets, labels, percent, stored).distinct().join(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"))
    more = stored(verified(left, sets, percent))
    if more.limit(1).count():
        links = labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)
        before, labels = labels, stored(components(links, stored))
        stored.drop(before)
    stored.drop(pairs, likely, sets, edges, rest, left, nodes, more)
    stored.release()
    copies = stored(classes.where("rows > 1").select("h1", "h2", "node"))
    stored.drop(classes)
    out = every.join(small(copies), ["h1", "h2"], "left").withColumn("node", F.when(F.col("n") > 0, F.coalesce("node", "id")).otherwise(F.col("id")))
    out = out.join(small(labels.where("node <> component")), "node", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "node"))
    out = stored(out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id")))
    stored.drop(all_rows, copies, labels)
    return out
