"""Near copies, repeated passages, and the pipeline, against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from geolith.llm import op2_run_length_dedup as dedup
from geolith.llm import op4_jaccard_join as jaccard
from geolith.llm.run_index import RunIndex
from geolith.llm.shared import Stored, components
from tests.llm.cases import COLUMNS, WORDS, documents, empty, odd, row, sample

LOWER = {i: i + 32 for i in range(65, 91)}


def mutated(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"m{rng.randrange(10**6)}"
    return words


def planted(n_groups=12, size=12):
    """Groups of near copies of several distances, exact copies, and passages in many documents."""
    rng = random.Random(7)
    rows, name = [], 0
    passage = " ".join(f"p{k}" for k in range(40))
    for g in range(n_groups):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.randrange(30, 200))]
        for k in range(size):
            words = mutated(rng, base, rng.choice([0, 0, 1, 2, 3, 5, 8]))
            if k % 5 == 4:
                words[3:3] = passage.split()
            rows.append((name, " ".join(words)))
            name += 1
    rng.shuffle(rows)
    return [(i, t) for i, (_, t) in enumerate(rows)]


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    names = sorted(sets)
    for a, i in enumerate(names):
        for j in names[a + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("tile", [1024, 4])
def test_jaccard_is_exact(spark, monkeypatch, tile):
    monkeypatch.setattr(jaccard, "TILE", tile)
    monkeypatch.setattr(jaccard, "LEAST", min(tile, jaccard.LEAST))
    for rows in (planted(), [(r["doc_id"], r["text"]) for r in sample(spark).collect()]):
        found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(documents(spark, rows)).collect()}
        assert found == brute_components(rows)


def test_jaccard_odd_rows(spark):
    found = Counter((r["doc_id"], r["component_id"]) for r in jaccard.near_duplicates(odd(spark)).collect())
    assert found[4, 4] == 1 and found[8, 8] == 1 and found[6, 6] == 1 and sum(found.values()) == odd(spark).count()
    assert found[5, 5] == 2 and found[7, 5] == 1 and found[None, None] == 1 and found[1, 1] == found[2, 2] == found[3, 3] == found[10, 10] == 1
    assert jaccard.near_duplicates(empty(spark)).count() == 0


def test_large_tiles_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 4)
    monkeypatch.setattr(jaccard, "LEAST", 4)
    rng = random.Random(2)
    rows = [(1, k, rng.choice([60, 61, 70, 75, 80, 95, 100, 120, 400]), 0 if k < 60 else rng.randrange(1, 9)) for k in range(90)] + [(2, k, 50, k % 2) for k in range(3)] + [(3, k, 50, 7) for k in range(9)]
    own = spark.createDataFrame(rows, "tile BIGINT, b BIGINT, n BIGINT, label BIGINT")
    groups = defaultdict(list)
    for r in jaccard.blocked(own, 80, Stored(spark)).collect():
        groups[r["tile"], r["low"], r["high"]].append((r["b"], r["block"]))
    met = Counter((t, *sorted((x, y))) for (t, low, high), g in groups.items() for i, (x, p) in enumerate(g) for y, q in g[:i] if low == high or p != q)
    info = {(t, b): (n, y) for t, b, n, y in rows}
    wanted = {(t, a, b) for (t, a), (n, y) in info.items() for (u, b), (m, z) in info.items() if t == u and a < b and y != z and 100 * min(n, m) >= 80 * max(n, m)}
    assert wanted <= set(met) and max(met.values()) == 1 and all(k[0] < 3 for k in groups)
    assert max(len(g) for k, g in groups.items()) < 40 and len(met) < 90 * 89 / 2


def test_overlap_bound_is_never_below():
    rng = np.random.default_rng(2)
    for _ in range(200):
        pool = rng.integers(0, 2**63, 400).astype(np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 300))) for _ in range(2))
        assert jaccard.overlap_bound(jaccard.signature(a), jaccard.signature(b), len(a), len(b)) >= len(np.intersect1d(a, b))


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 340)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a BIGINT, b BIGINT"), Stored(spark)).collect()}
    around = defaultdict(set)
    for a, b in edges:
        if a != b:
            around[a].add(b)
            around[b].add(a)
    for node in around:
        seen, todo = {node}, [node]
        while todo:
            for x in around[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        assert found[node] == min(seen)


def brute_removed(rows, length=50):
    first = {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            first.setdefault(b[k : k + length], i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        mask = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                mask[k : k + length] = True
        mask = mask[: len(b)]
        spans = int((mask[1:] & ~mask[:-1]).sum() + mask[:1].sum())
        kept = np.frombuffer(b, np.uint8)[~mask].tobytes()
        out.append((i, len(b), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def digests(df):
    return Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect())


PASSAGES = planted(6, 10) + [(1000 + k, "é" * k + "ab" * 60 + "q" * (k % 7)) for k in range(12)] + [(2000, "x" * 49), (2001, "x" * 49), (2002, "y" * 50), (2003, "zy" + "y" * 50)]


@pytest.mark.parametrize(("hot", "index", "chunk"), [(4096, 1 << 20, 1 << 26), (2, 1 << 20, 1 << 26), (4096, 200, 1 << 26), (4096, 1 << 20, 4000)])
def test_removal_is_exact(spark, monkeypatch, hot, index, chunk):
    monkeypatch.setattr(dedup, "HOT_DOCS", hot)
    monkeypatch.setattr(dedup, "INDEX_BYTES", index)
    assert digests(dedup.dedup_bytes(documents(spark, PASSAGES), chunk_bytes=chunk)) == brute_removed(PASSAGES)
    rows = [(r["doc_id"], r["text"]) for r in sample(spark).collect()]
    assert digests(dedup.dedup_bytes(sample(spark), chunk_bytes=chunk * 100)) == brute_removed(rows)


def later_windows(texts, docs, length):
    before, width = length - dedup.GRAM, 2 * length - dedup.GRAM
    rows = np.stack([np.frombuffer(x.encode().ljust(width, b"\0"), np.uint8) for x in texts])
    n, left = len(texts), np.full(len(texts), before)
    row, column = dedup.later_windows(np.zeros(n, np.uint64), np.array(docs), left, np.full(n, length), rows, length)
    return {*zip(row.tolist(), column.tolist(), strict=True)}


@pytest.mark.parametrize("index", [1 << 20, 300])
def test_later_windows_are_those_of_smaller_documents(monkeypatch, index):
    monkeypatch.setattr(dedup, "INDEX_BYTES", index)
    rng = random.Random(9)
    pool = ["".join(rng.choices("ab", k=60)) for _ in range(6)]
    texts = [(lambda x, k, m: x[k : k + m] + "#" * (k % 3) + x[k + m : k + 60])(rng.choice(pool), 0, rng.randrange(20, 60)).ljust(60, rng.choice("ab"))[:60] for _ in range(70)]
    docs = sorted(rng.choices(range(40), k=70))
    expected = {(i, k) for i in range(70) for k in range(21) if any(docs[j] < docs[i] and texts[j][k : k + 40] == texts[i][k : k + 40] for j in range(70))}
    found = later_windows(texts, docs, 40)
    assert expected <= found  # a window may also stand elsewhere in an earlier context
    assert all(any(docs[j] < docs[i] and texts[i][k : k + 40] in texts[j] for j in range(70)) for i, k in found)


def test_bytes_decide_when_hashes_collide(spark, monkeypatch):
    monkeypatch.setattr(dedup, "whole_hash", lambda rows: np.zeros(len(rows), np.uint64))
    monkeypatch.setattr(dedup, "window_sums", lambda rows, length: np.zeros((len(rows), rows.shape[1] - length + 1), np.uint64))
    h, rows = np.zeros(40, np.uint64), np.random.default_rng(0).integers(0, 2, (40, 3)).astype(np.uint8)
    order, first, later = dedup.settled(h, np.arange(40)[::-1], rows)
    assert [rows[order[i]].tolist() for i in first] == sorted({tuple(r) for r in rows.tolist()}, key=bytes) or len(first) == len({tuple(r) for r in rows.tolist()})
    assert (~later).sum() == len(first)
    texts = ["x" * k + "common words " * 5 + "y" * (40 - k) for k in range(9)]
    texts = [t.ljust(110, "z")[:110] for t in texts]
    assert later_windows(texts, list(range(9)), 60) == {(i, k) for i in range(9) for k in range(41) if any(texts[i][k : k + 60] in texts[j] for j in range(i))}


def test_removal_odd_rows(spark):
    df = odd(spark)
    rows = [(r["doc_id"], r["text"]) for r in df.where("doc_id is not null").collect()]
    found = digests(dedup.dedup_bytes(df))
    unknown = [k for k in found if k[0] is None]
    assert len(unknown) == 1 and unknown[0][2] == 0
    assert {k: v for k, v in found.items() if k[0] is not None} == brute_removed(rows)
    assert dedup.dedup_bytes(empty(spark)).count() == 0
    twice = [(1, WORDS * 2), (1, WORDS + "more"), (2, WORDS)]
    assert {k[:3] for k in digests(dedup.dedup_bytes(documents(spark, twice)))} == {(1, len(WORDS) * 2, 0), (1, len(WORDS) + 4, 0), (2, len(WORDS), len(WORDS))}
    with pytest.raises(ValueError):
        dedup.dedup_bytes(df.withColumn("doc_id", F.col("doc_id").cast("string")))


def test_removal_of_long_strings(spark):
    rows = [(1, "a" * 5 + WORDS * 6), (2, "b" * 9 + WORDS * 6), (3, WORDS * 2)]
    expected = brute_removed(rows, 300)
    assert digests(dedup.dedup_bytes(documents(spark, rows), length=300)) == expected


def test_matching_statistics():
    rng = np.random.default_rng(4)
    for blocks in (1, 3):
        pool = bytes(rng.integers(97, 99 + blocks, 300).astype(np.uint8))
        cut = lambda n: [pool[a : a + int(rng.integers(1, 60))] for a in rng.integers(0, 240, n)]
        flat = lambda x: (np.frombuffer(b"\0".join(x) + b"\0", np.uint8), np.cumsum([len(s) + 1 for s in x]) - 1)
        strings, own = cut(40), np.sort(np.append(np.arange(blocks), rng.integers(0, blocks, 40 - blocks)))
        patterns, theirs = [x[:9] + b"?" * (k % 2) + x[9:] for k, x in enumerate(cut(30))], rng.integers(0, blocks, 30)
        text, ends = flat(strings)
        index = RunIndex.build(text, ends, own)
        assert index.runs < len(text)
        flat_patterns, stops = flat(patterns)
        length, place = index.statistics(flat_patterns, stops, theirs)
        for x, stop, b in zip(patterns, stops.tolist(), theirs.tolist(), strict=True):
            others = [s for s, o in zip(strings, own.tolist(), strict=True) if o == b]
            for k in range(len(x)):
                n, at = int(length[stop - len(x) + k]), int(place[stop - len(x) + k])
                assert n == max(m for m in range(len(x) - k + 1) if any(x[k : k + m] in s for s in others))
                assert text[at : at + n].tobytes() == x[k : k + n] and (not n or own[np.searchsorted(ends, at)] == b)


def test_pipeline_stages_work_on_what_is_left(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    seen = docs
    for name, stage in corpus_pipeline.STAGES:
        before = seen
        out = stage(spark, before, "/root/testdata/sf0.001")
        out.write.parquet(str(tmp_path / name))
        seen = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert seen.columns == docs.columns and seen.join(before, "doc_id", "left_anti").count() == 0
        if name == "n-gram Jaccard join":
            expected = brute_components([(r["doc_id"], r["text"]) for r in before.collect()])
            assert {r["doc_id"] for r in seen.collect()} == {i for i, (_, c) in expected.items() if i == c}
        if name == "suffix-array dedup":
            removed = {k[0]: k[2] for k in brute_removed([(r["doc_id"], r["text"]) for r in before.collect()])}
            now = {r["doc_id"]: r for r in seen.collect()}
            for r in before.collect():
                if removed[r["doc_id"]] == 0:
                    assert now[r["doc_id"]] == r
                elif r["doc_id"] in now:
                    assert len(now[r["doc_id"]]["text"].encode()) <= len(r["text"].encode()) - removed[r["doc_id"]]
    assert seen.agg(F.sum("length")).first()[0] > 0


@pytest.mark.parametrize("make", [odd, empty])
def test_pipeline_stages_take_odd_rows(spark, make):
    docs = make(spark).select(*corpus_pipeline.COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.count() <= docs.count() or name == "packing"


def test_pipeline_removes_frequent_lines_of_large_hosts(spark):
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    docs = documents(spark, [(i, own(i) + "\nsame line" * (i < 25)) for i in range(400)]).select(*corpus_pipeline.COLUMNS)
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.quality_stage(spark, docs, "").collect()}
    assert len(out) == 400 and out[0] == own(0) + "\nsame line" and all(out[i] == own(i) for i in range(1, 400))


def test_pipeline_keeps_different_texts_of_an_id(spark):
    text = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    docs = documents(spark, [(1, text(1)), (1, text(2)), (1, text(2)), (2, text(1)), (3, text(3)), (None, text(1)), (None, text(1))]).select(*corpus_pipeline.COLUMNS)
    out = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.near_copies_stage(spark, docs, "").collect())
    assert out == {(1, text(1)): 1, (1, text(2)): 1, (3, text(3)): 1, (None, text(1)): 2}


def test_case_table(spark):
    assert odd(spark).columns == [c.split()[0] for c in COLUMNS.split(", ")] and len(row(1, "a")) == len(odd(spark).columns)
