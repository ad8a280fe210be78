"""Tagged objects of OpenStreetMap: a data source for PBF files, and areas from ways and relations by joins.

The driver reads only the headers between a file's blobs; each partition is a range of blobs, which its task inflates and decodes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from geolith.functions.geo import contains, inner_point
from geolith.operators.tables import Stored

OBJECTS = "osm_type STRING, osm_id BIGINT, lon DOUBLE, lat DOUBLE, tags MAP<STRING, STRING>, refs ARRAY<BIGINT>, members ARRAY<STRUCT<type: STRING, ref: BIGINT, role: STRING>>"
#: Fixed values of the format: largest header and blob, units of coordinates, and the kinds of members.
MOST_HEADER, MOST_BLOB, NANO, KINDS = 64 << 10, 32 << 20, 1e-9, ("node", "way", "relation")
#: Bytes of blobs that make a partition.
PARTITION_BYTES = 32 << 20


def varints(data: bytes) -> np.ndarray:
    """The packed numbers in ``data``, unsigned."""
    b = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(b < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    out, n = np.zeros(len(ends), np.uint64), ends - starts + 1
    for k in range(int(n.max(initial=0))):
        use = n > k
        out[use] |= (b[starts[use] + k] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * k)
    return out


def zigzag(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(1)).astype(np.int64) ^ -(values & np.uint64(1)).astype(np.int64)


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a message's fields: a number, or bytes."""
    at, end = 0, len(data)

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < end:
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = number() if kind == 2 else {1: 8, 5: 4}[kind]
        if at + size > end:
            raise ValueError("a field is cut off")
        yield key >> 3, data[at : at + size]
        at += size


def one(data: bytes) -> dict:
    """The last value of each field."""
    return dict(fields(data))


def signed(value: int) -> int:
    """A whole number of 64 bits as it is written."""
    return value - (1 << 64) if value >> 63 else value


def inflated(blob: bytes) -> bytes:
    found = one(blob)
    if 1 in found:
        return found[1]
    if 3 not in found:
        raise ValueError("a blob is neither raw nor deflated")
    data = zlib.decompress(found[3])
    if len(data) != found.get(2, len(data)):
        raise ValueError("a blob has another size than it says")
    return data


def objects(block: bytes) -> Iterator[tuple]:
    """The rows of ``OBJECTS`` in a block: dense and single nodes, ways and relations."""
    parts = list(fields(block))
    own = dict(parts)
    strings = [s.decode("utf-8", "replace") for k, s in fields(own.get(1, b"")) if k == 1]
    unit, lat0, lon0 = own.get(17, 100), signed(own.get(19, 0)), signed(own.get(20, 0))
    tags = lambda m: {strings[k]: strings[v] for k, v in zip(varints(m.get(2, b"")).tolist(), varints(m.get(3, b"")).tolist(), strict=True)}
    running = lambda data: np.cumsum(zigzag(varints(data)))
    for kind, group in parts:
        if kind != 2:
            continue
        for what, data in fields(group):
            m = one(data)
            if what == 1:
                number = lambda k, m=m: int(zigzag(np.array([m[k]], np.uint64))[0])
                yield "node", number(1), (lon0 + unit * number(9)) * NANO, (lat0 + unit * number(8)) * NANO, tags(m), None, None
            elif what == 2:
                ids, lats, lons = (running(m.get(k, b"")) for k in (1, 8, 9))
                pairs, at = varints(m.get(10, b"")).tolist(), 0
                for i, lat, lon in zip(ids.tolist(), lats.tolist(), lons.tolist(), strict=True):
                    own_tags = {}
                    while at < len(pairs) and pairs[at]:
                        own_tags[strings[pairs[at]]] = strings[pairs[at + 1]]
                        at += 2
                    at += 1
                    yield "node", i, (lon0 + unit * lon) * NANO, (lat0 + unit * lat) * NANO, own_tags, None, None
            elif what == 3:
                yield "way", signed(m[1]), None, None, tags(m), running(m.get(8, b"")).tolist(), None
            elif what == 4:
                roles, kinds = varints(m.get(8, b"")).tolist(), varints(m.get(10, b"")).tolist()
                members = [{"type": KINDS[k], "ref": r, "role": strings[s]} for k, r, s in zip(kinds, running(m.get(9, b"")).tolist(), roles, strict=True)]
                yield "relation", signed(m[1]), None, None, tags(m), None, members


def _opened(path: str):
    """A file by its address; any store that Arrow knows."""
    system, name = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return system.open_input_file(name)


def blob_headers(file) -> Iterator[tuple[str, int, int]]:
    """Kind, place and size of each blob; nothing of the blobs themselves is read."""
    size, at = file.size(), 0
    while at < size:
        n = int.from_bytes(file.read_at(4, at), "big")
        if not 0 < n <= MOST_HEADER:
            raise ValueError("not a header of a blob")
        header = one(file.read_at(n, at + 4))
        at += 4 + n
        if at + header[3] > size or header[3] > MOST_BLOB:
            raise ValueError("a blob is cut off or too large")
        yield header[1].decode(), at, header[3]
        at += header[3]


@dataclass
class Blobs(InputPartition):
    path: str
    places: tuple[tuple[int, int], ...]


class PbfReader(DataSourceReader):
    def __init__(self, path: str, partition_bytes: int):
        self.path, self.partition_bytes = path, partition_bytes

    def partitions(self) -> Sequence[InputPartition]:
        out, held, size = [], [], 0
        with _opened(self.path) as file:
            for kind, at, n in blob_headers(file):
                if kind != "OSMData":  # the header block, and what a reader has to skip
                    continue
                held.append((at, n))
                size += n
                if size >= self.partition_bytes:
                    out.append(Blobs(self.path, tuple(held)))
                    held, size = [], 0
        return [*out, Blobs(self.path, tuple(held))]

    def read(self, partition: Blobs) -> Iterator[pa.RecordBatch]:
        with _opened(partition.path) as file:
            for at, n in partition.places:
                rows = list(objects(inflated(file.read_at(n, at))))
                columns = list(zip(*rows, strict=True)) if rows else [()] * len(ARROW)
                yield pa.RecordBatch.from_arrays([pa.array([list(x.items()) for x in c] if f.name == "tags" else c, f.type) for f, c in zip(ARROW, columns, strict=True)], schema=ARROW)


ARROW = pa.schema([("osm_type", pa.string()), ("osm_id", pa.int64()), ("lon", pa.float64()), ("lat", pa.float64()), ("tags", pa.map_(pa.string(), pa.string())), ("refs", pa.list_(pa.int64())), ("members", pa.list_(pa.struct([("type", pa.string()), ("ref", pa.int64()), ("role", pa.string())])))])


class PbfSource(DataSource):
    """``spark.read.format("osm_pbf").load(path)``; option ``partitionBytes``."""

    @classmethod
    def name(cls) -> str:
        return "osm_pbf"

    def schema(self) -> str:
        return OBJECTS

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return PbfReader(self.options["path"], int(self.options.get("partitionbytes", self.options.get("partitionBytes", PARTITION_BYTES))))


def pbf(spark: SparkSession, path: str, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """The objects of a PBF file: osm_type, osm_id; lon, lat of nodes; tags; refs of ways; members of relations. A damaged file is an error."""
    spark.dataSource.register(PbfSource)
    return spark.read.format("osm_pbf").option("partitionBytes", str(partition_bytes)).load(path)


def way_lines(objects: DataFrame, ways: DataFrame) -> DataFrame:
    """osm_id, refs and ``line``, the points of ways' nodes in order; null where a node is missing."""
    nodes = objects.where("osm_type = 'node'").select(F.col("osm_id").alias("_ref"), F.array("lon", "lat").alias("_at"))
    steps = ways.select("osm_id", F.posexplode("refs").alias("_k", "_ref"))
    found = steps.join(nodes, "_ref", "left").groupBy("osm_id").agg(F.array_sort(F.collect_list(F.struct("_k", "_at"))).alias("_p"))
    whole = F.forall("_p", lambda p: p["_at"].isNotNull())
    return ways.select("osm_id", "refs").join(found.select("osm_id", F.when(whole, F.transform("_p", lambda p: p["_at"])).alias("line")), "osm_id")


def joined_rings(ways: list[tuple[list[int], list]]) -> list[list] | None:
    """Rings of ways that meet end to end, each turned as needed; null if something stays open."""
    left, out = [(list(r), [list(map(float, p)) for p in line]) for r, line in ways], []
    ends: dict[int, set[int]] = {}
    for k, (refs, _) in enumerate(left):
        for e in {refs[0], refs[-1]} if refs[0] != refs[-1] else ():
            ends.setdefault(e, set()).add(k)
    unused = dict.fromkeys(range(len(left)))
    while unused:
        k = next(iter(unused))
        del unused[k]
        refs, line = left[k]
        ring, first, last = list(line), refs[0], refs[-1]
        while last != first:
            k = next((i for i in sorted(ends.get(last, ())) if i in unused), None)
            if k is None:
                return None
            del unused[k]
            refs, line = left[k]
            ring += line[1:] if refs[0] == last else line[-2::-1]
            last = refs[-1] if refs[0] == last else refs[0]
        out.append(ring)
    return out


def areas(objects: DataFrame, tag: str | None = None) -> DataFrame:
    """osm_type, osm_id, tags and ``ring`` (polygons, each a shell and its holes) of closed ways of four nodes or more and of multipolygon and boundary relations.

    With ``tag``, only objects that have it. Shells are a relation's outer members and holes its inner ones, put together where they meet;
    an area with a missing or open member has a null ``ring``, so that it can be counted. A relation's ways meet in one row, as its shape does.
    """
    stored = Stored(objects.sparkSession)
    wanted = objects.where(F.map_contains_key("tags", F.lit(tag))) if tag else objects
    shape = T.ArrayType(T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType()))))
    closed = wanted.where("osm_type = 'way' and size(refs) >= 4 and refs[0] = refs[size(refs) - 1]")
    relations = stored(wanted.where("osm_type = 'relation' and tags['type'] in ('multipolygon', 'boundary')").select("osm_id", "tags", "members"))
    parts = stored(relations.select(F.col("osm_id").alias("_r"), F.explode("members").alias("m")).where("m.type = 'way'").select("_r", F.col("m.ref").alias("osm_id"), F.when(F.col("m.role") == "inner", "inner").otherwise("outer").alias("role")))
    members = objects.where("osm_type = 'way'").join(parts.select("osm_id").distinct(), "osm_id", "left_semi")
    lines = stored(way_lines(objects, closed.select("osm_id", "refs").union(members.select("osm_id", "refs")).distinct()))
    own = closed.select("osm_type", "osm_id", "tags").join(lines.select("osm_id", F.when(F.col("line").isNotNull(), F.array(F.array("line"))).alias("ring")), "osm_id").select("osm_type", "osm_id", "tags", "ring")
    ways = parts.join(lines, "osm_id", "left").groupBy("_r").agg(F.collect_list(F.struct("osm_id", "role", "refs", "line")).alias("ways"))
    made = T.StructType([T.StructField("_r", T.LongType()), T.StructField("ring", shape)])

    def built(ways) -> list | None:
        if any(w["line"] is None or not len(w["line"]) for w in ways):
            return None
        rings = {role: joined_rings([(w["refs"], w["line"]) for w in sorted(ways, key=lambda w: w["osm_id"]) if w["role"] == role]) for role in ("outer", "inner")}
        if not rings["outer"] or rings["inner"] is None:
            return None
        out = [[r] for r in rings["outer"]]
        for hole in rings["inner"]:
            x, y = (np.array([v]) for v in inner_point(np.array(hole)))
            around = [p for p in out if contains([np.array(p[0])], x, y)[0]]
            if not around:
                return None
            around[-1].append(hole)
        return out

    def rings(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"_r": frame["_r"], "ring": pd.Series([built(list(w)) for w in frame["ways"]], dtype=object, index=frame.index)})

    found = relations.join(ways.mapInPandas(rings, made), F.col("osm_id") == F.col("_r"), "left").select(F.lit("relation").alias("osm_type"), "osm_id", "tags", "ring")
    return own.union(found)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def inside_point(shape: pd.Series) -> pd.Series:
    """A point inside each shape of any number of rings: the middle of the widest stretch inside at about half height; null for null."""

    def of(value) -> list[float] | None:
        rings = [np.array([np.asarray(p, float) for p in r], float).reshape(-1, 2) for part in value for r in part] if value is not None and len(value) else []
        if not rings:
            return None
        ys = np.unique(np.concatenate([r[:, 1] for r in rings]))
        if len(ys) < 2:
            return rings[0][0].tolist()
        heights = (ys[1:] + ys[:-1]) / 2
        for y in heights[np.argsort(abs(heights - (ys[0] + ys[-1]) / 2), kind="stable")].tolist():  # between parts there is nothing
            xs = sorted(float((b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0]) for r in rings for a, b in zip(r, np.roll(r, -1, 0), strict=True) if (a[1] > y) != (b[1] > y))
            if xs:
                a, b = max(zip(xs[::2], xs[1::2], strict=True), key=lambda s: s[1] - s[0])
                return [(a + b) / 2, y]
        return rings[0][0].tolist()

    return pd.Series([of(s) for s in shape], dtype=object)


def extracted(objects: DataFrame, region: DataFrame, tag: str = "building", size: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """The tagged areas whose inner point a region's polygons (``region``: name, ``ring``) cover, with ``name``, ``x`` and ``y``; and the number of areas that couldn't be built."""
    from geolith.operators.spatial import points_in_polygons

    every = Stored(objects.sparkSession)(areas(objects, tag).withColumn("_at", inside_point("ring")))
    name = F.concat_ws("/", "osm_type", F.col("osm_id").cast("string"))
    points = every.where("_at is not null").select(name.alias("name"), "osm_type", "osm_id", "tags", "ring", F.col("_at")[0].alias("x"), F.col("_at")[1].alias("y"))
    hits = points_in_polygons(points.select("name", "x", "y"), region.select(F.col(region.columns[0]).alias("_region"), "ring"), "name", "_region", size).select("name").distinct()
    return points.join(hits, "name", "left_semi"), every.where("ring is null").agg(F.count("*").alias("errors"))
