"""PBF files written here, and areas of ways and relations."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from geolith.functions import geo
from geolith.sources import osm


def varint(n):
    n &= (1 << 64) - 1
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


zig = lambda n: (n << 1) ^ (n >> 63)
num = lambda k, n: varint(k << 3) + varint(n)
data = lambda k, b: varint(k << 3 | 2) + varint(len(b)) + b
packed = lambda k, values: data(k, b"".join(map(varint, values)))


def deltas(values):
    return [zig(b - a) for a, b in zip([0, *values], values)]


def blob(kind, content, raw=False):
    body = data(1, content) if raw else num(2, len(content)) + data(3, zlib.compress(content))
    header = data(1, kind.encode()) + num(3, len(body))
    return len(header).to_bytes(4, "big") + header + body


class Strings(list):
    def __call__(self, s):
        if s not in self:
            self.append(s)
        return self.index(s)


def block(nodes=(), dense=(), ways=(), relations=(), offset=(0, 0)):
    """Nodes: (id, lon, lat, tags) in hundreds of nano-degrees; ways: (id, refs, tags); relations: (id, [(kind, ref, role)], tags)."""
    s = Strings([""])
    tags = lambda t: packed(2, map(s, t)) + packed(3, map(s, t.values())) if t else b""
    groups = [b"".join(data(1, num(1, zig(i)) + tags(t) + num(8, zig(lat)) + num(9, zig(lon))) for i, lon, lat, t in nodes)]
    if dense:
        pairs = [x for *_, t in dense for x in [*(s(y) for kv in t.items() for y in kv), 0]]
        groups.append(data(2, packed(1, deltas([d[0] for d in dense])) + packed(8, deltas([d[2] for d in dense])) + packed(9, deltas([d[1] for d in dense])) + packed(10, pairs)))
    groups.append(b"".join(data(3, num(1, i) + tags(t) + packed(8, deltas(refs))) for i, refs, t in ways))
    groups.append(b"".join(data(4, num(1, i) + tags(t) + packed(8, [s(r) for *_, r in m]) + packed(9, deltas([r for _, r, _ in m])) + packed(10, [osm.KINDS.index(k) for k, *_ in m])) for i, m, t in relations))
    made = b"".join(data(2, g) for g in groups if g)
    return data(1, b"".join(data(1, x.encode()) for x in s)) + made + num(19, offset[1]) + num(20, offset[0])


def test_varints():
    values = [0, 1, 127, 128, 300, 2**35, 2**63, 2**64 - 1]
    assert osm.varints(b"".join(map(varint, values))).tolist() == values and osm.varints(b"").tolist() == []
    assert osm.zigzag(osm.varints(b"".join(varint(zig(n)) for n in (0, -1, 1, -(2**62), 2**62)))).tolist() == [0, -1, 1, -(2**62), 2**62]


def test_pbf_objects(spark, tmp_path):
    at = 1_320_000_000
    blocks = [block(nodes=[(-5, at, -at // 3, {"name": "é"})], dense=[(k, at + 7 * k, 43 * k, {"addr:housenumber": str(k)} if k % 3 == 0 else {}) for k in range(1, 200)], offset=(1000, -500)), block(ways=[(7, [5, 3, 900, 5], {"building": "yes"}), (8, [], {})]), block(relations=[(9, [("way", 7, "outer"), ("node", -5, "")], {"type": "multipolygon"})]), block()]
    path = tmp_path / "o.osm.pbf"
    path.write_bytes(blob("OSMHeader", b"") + b"".join(blob("OSMData", b, raw=k == 1) for k, b in enumerate(blocks)) + blob("OSMFuture", b"xx"))
    for most in (1, 1 << 25):
        df = osm.pbf(spark, str(path), most)
        rows = {(r["osm_type"], r["osm_id"]): r for r in df.collect()}
        assert len(rows) == 203 and df.rdd.getNumPartitions() == (5 if most == 1 else 1)
        one = rows["node", -5]
        assert (one["lon"], one["lat"]) == pytest.approx((at * 1e-7 + 1e-6, -(at // 3) * 1e-7 - 5e-7), abs=1e-12) and one["tags"] == {"name": "é"}
        assert all(rows["node", k]["lat"] == pytest.approx(43e-7 * k - 5e-7, abs=1e-12) and rows["node", k]["lon"] == pytest.approx((at + 7 * k) * 1e-7 + 1e-6, abs=1e-12) and rows["node", k]["tags"] == ({"addr:housenumber": str(k)} if k % 3 == 0 else {}) for k in range(1, 200))
        assert rows["way", 7]["refs"] == [5, 3, 900, 5] and rows["way", 8]["refs"] == [] and rows["way", 7]["tags"] == {"building": "yes"}
        assert [tuple(m) for m in rows["relation", 9]["members"]] == [("way", 7, "outer"), ("node", -5, "")]
    path.write_bytes(path.read_bytes()[:-1])
    with pytest.raises(Exception, match="cut off"):
        osm.pbf(spark, str(path)).collect()
    (tmp_path / "bad").write_bytes(b"not a file of this kind")
    with pytest.raises(Exception, match="not a header"):
        osm.pbf(spark, str(tmp_path / "bad")).collect()


def test_areas_of_ways_and_relations(spark, tmp_path):
    """Closed ways, an outer ring of three ways in any direction with a hole, two shells, missing nodes, open rings."""
    square = lambda first, x, y, d: [(first + k, int(1e7 * (x + d * a)), int(1e7 * (y + d * b)), {}) for k, (a, b) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1)])]
    nodes = square(10, 132, 43, 0.1) + square(20, 132.02, 43.02, 0.01) + square(30, 133, 44, 0.1) + square(40, 140, 50, 0.1)
    ways = [(1, [10, 11, 12], {}), (2, [10, 13], {}), (3, [12, 13], {}), (4, [20, 21, 22, 23, 20], {"building": "yes"}), (5, [30, 31, 32, 33, 30], {}), (6, [30, 31, 99, 30], {"building": "yes"}), (7, [30, 31, 30], {"building": "yes"}), (8, [40, 41, 42, 43, 40], {"building": "yes"}), (9, [30, 31, 32, 33], {"building": "yes"})]
    relations = [(1, [("way", 3, "outer"), ("way", 1, "outer"), ("way", 4, "inner"), ("way", 2, ""), ("way", 5, "outer"), ("node", 10, "label")], {"type": "multipolygon", "building": "yes"}), (2, [("way", 1, "outer")], {"type": "multipolygon", "building": "yes"}), (3, [("way", 77, "outer")], {"type": "boundary", "building": "yes"}), (4, [("way", 5, "outer")], {"type": "route", "building": "yes"})]
    path = tmp_path / "a.osm.pbf"
    path.write_bytes(blob("OSMHeader", b"") + blob("OSMData", block(dense=nodes)) + blob("OSMData", block(ways=ways)) + blob("OSMData", block(relations=relations)))
    found = {(r["osm_type"], r["osm_id"]): r["ring"] for r in osm.areas(osm.pbf(spark, str(path)), "building").collect()}
    assert set(found) == {("way", 4), ("way", 6), ("way", 8), ("relation", 1), ("relation", 2), ("relation", 3)}
    assert [found[k] for k in (("way", 6), ("relation", 2), ("relation", 3))] == [None] * 3
    assert sorted(len(p) for p in found["relation", 1]) == [1, 2]
    area = sum(abs(geo.area(np.array(p[0]))) - sum(abs(geo.area(np.array(h))) for h in p[1:]) for p in found["relation", 1])
    assert area == pytest.approx(0.01 - 0.0001 + 0.01, rel=1e-9)
    region = spark.createDataFrame([("r", [[131.0, 42.0], [134.0, 42.0], [134.0, 45.0], [131.0, 45.0]])], "region STRING, ring ARRAY<ARRAY<DOUBLE>>")
    kept, errors = osm.extracted(osm.pbf(spark, str(path)), region)
    assert sorted(r["name"] for r in kept.collect()) == ["relation/1", "way/4"] and errors.first()["errors"] == 3
    for r in kept.collect():
        assert geo.contains([np.array(x) for p in r["ring"] for x in p], np.array([r["x"]]), np.array([r["y"]]))[0]
    assert osm.areas(osm.pbf(spark, str(path)).where(F.lit(False))).count() == 0
