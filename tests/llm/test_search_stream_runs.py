"""Ranked search, stream dedup and periodic runs against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from geolith.llm import op11_ranked_search as search
from geolith.llm import op13_period_runs as periods
from geolith.llm.op12_stream_dedup import dedup_files
from geolith.llm.registry import looped
from tests.llm.cases import COLUMNS, LONG, WORDS, documents, empty, odd, row, sample

SPACE = re.compile(r"[\x20\x09-\x0D]+")


# --- ranked search


def best(docs, queries, most):
    """Of (id, text) and (item, text): rows (item, rank, id, score)."""
    find = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    counted = [(i, Counter(find(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    wanted = defaultdict(set)
    for item, text in queries:
        wanted[item] |= set(find(text))
    out = []
    for item, terms in wanted.items():
        scores = []
        for i, c in counted:
            m = 50 + 50 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if score:
                scores.append((-score, i is None, i or 0))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scores)[:most])]
    return Counter(out)


@pytest.mark.parametrize("make", [odd, empty, sample])
@pytest.mark.parametrize("shard_bytes,block_pairs", [(1 << 25, 1 << 20), (3000, 40)])
def test_search_equals_brute_force(spark, make, shard_bytes, block_pairs):
    docs = make(spark)
    words = WORDS.split()
    items = [(1, "the CAT and alpha; é漢字 漢字"), (2, None), (3, ""), (4, " ".join(words)), (4, "zeta eta cat"), (5, "unknownword"), (None, "omega mat"), (6, "That and th erblest on lytion " + LONG[:200])]
    queries = spark.createDataFrame([(i, t, "x", 1.0) for i, t in items], "item_id INT, text STRING, doc_id STRING, score DOUBLE")
    found = search.ranked_search(docs, queries, shard_bytes=shard_bytes, block_pairs=block_pairs, most=5)
    assert found.columns == ["item_id", "rank", "doc_id", "score"] and dict(found.dtypes)["rank"] == "int"
    assert Counter(map(tuple, found.collect())) == best([(r["doc_id"], r["text"]) for r in docs.collect()], items, 5)


def test_search_without_queries(spark):
    assert search.ranked_search(sample(spark), spark.createDataFrame([], "item_id INT, text STRING")).count() == 0


def test_max_score_skips_and_stays_exact():
    rng = random.Random(3)
    for _ in range(40):
        size, lists = rng.randrange(1, 400), rng.randrange(1, 9)
        docs = [sorted(rng.sample(range(size), rng.randrange(1, size + 1))) for _ in range(lists)]
        scores = [[rng.randrange(1, 4) * 10 ** rng.randrange(3) for _ in d] for d in docs]
        shard = search.Shard(np.arange(lists), np.array([len(d) for d in docs]), np.concatenate(docs), np.concatenate(scores), size)
        total = Counter()
        for d, s in zip(docs, scores, strict=True):
            total.update(dict(zip(d, s, strict=True)))
        expected = sorted(((-s, d) for d, s in total.items()))[:10]
        for demand in (1, -expected[-1][0]):
            found, given = shard.top([*range(lists), 99], 10, demand, block=37)
            assert [(-int(s), int(d)) for d, s in zip(found, given, strict=True)] == expected
        assert len(shard.top(list(range(lists)), 10, -expected[0][0] + 1)[0]) == 0


def test_long_lengths_do_not_overflow():
    n = np.array([10**12, 7], np.int64)
    assert search.mean_lengths(n, 10**10, 10**18).tolist() == [50 + 50 * x * 10**10 // 10**18 for x in n.tolist()]


# --- stream dedup


def kept(rows):
    """Of (id, text): the rows of the result, with repeated ones counted."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[SPACE.sub("", t or "")].append((i, t or ""))
    out = Counter()
    for norm, own in groups.items():
        own.sort(key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))
        for k, (i, _) in enumerate(own):
            out[i, own[0][0], len(own), k == 0, hashlib.sha256(norm.encode()).hexdigest()] += 1
    return out


def files(spark, path, *parts):
    for part in parts:
        spark.createDataFrame([row(*r) for r in part], COLUMNS).coalesce(1).write.mode("append").parquet(path)
    return path


@pytest.mark.parametrize("key_chars", [64, 1])
def test_stream_dedup_equals_brute_force(spark, tmp_path, key_chars):
    """Also when keys collide: then the texts tell rows apart."""
    own = [(r["doc_id"], r["text"]) for r in odd(spark).collect()] + [(r["doc_id"] + 100, r["text"][:2000]) for r in sample(spark).limit(40).collect()]
    own += [(300 + k, f"copy {k % 3}" + " " * (k % 7)) for k in range(60)] + [(400, "a\x0bb"), (401, "a\x85b"), (402, "a b"), (403, " ab")]
    path = files(spark, str(tmp_path / "docs"), own[::2], own[1::2])
    found = dedup_files(spark, path, key_chars=key_chars, files_a_batch=1)
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(map(tuple, found.collect())) == kept(own)


def test_stream_goes_on_with_its_state(spark, tmp_path):
    first, more = [(5, "one two"), (7, "other"), (8, None)], [(3, "one  two "), (4, "onetwo"), (9, " "), (10, "third")]
    path, folder = files(spark, str(tmp_path / "docs"), first), str(tmp_path / "state")
    assert Counter(map(tuple, dedup_files(spark, path, folder=folder).collect())) == kept(first)
    files(spark, path, more)
    assert Counter(map(tuple, dedup_files(spark, path, folder=folder).collect())) == kept(first + more)
    assert Counter(map(tuple, dedup_files(spark, path, folder=folder).collect())) == kept(first + more)  # nothing new


def test_stream_without_rows_leaves_settings(spark, tmp_path):
    empty(spark).write.parquet(str(tmp_path / "docs"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.streaming.stateStore.providerClass")}
    assert dedup_files(spark, str(tmp_path / "docs")).count() == 0
    assert {k: spark.conf.get(k) for k in before} == before


def test_stream_reads_one_file(spark):
    found = dedup_files(spark, "/root/testdata/sf0.001/documents.parquet")
    assert Counter(map(tuple, found.collect())) == kept([(r["doc_id"], r["text"]) for r in sample(spark).collect()])


# --- periodic runs


def runs_of(w, repeats=4, shortest=6):
    out, n = [], len(w)
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(shortest, repeats * q) and not any(w[i : j + q - p] == w[i + p : j + q] for p in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def told(i, text, order=None):
    w = [x for x in SPACE.split(text or "") if x]
    places = order(i, len(w)) if order and w else None
    w = w if places is None else [w[k] for k in places]
    runs = runs_of(w)
    top = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    stay = [x for k, x in enumerate(w) if not any(a + q <= k < a + n for a, n, q in runs)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (i, len(runs), *((*top, 1000 * top[1] // top[2]) if top else (None,) * 4), sha("".join(f"{a},{n},{q}\n" for a, n, q in runs)), sha(" ".join(stay)))


@pytest.mark.parametrize("lags", [1 << 15, 30])
@pytest.mark.parametrize("make", [odd, empty, sample])
def test_runs_equal_brute_force(spark, make, lags):
    docs = make(spark).withColumn("text", F.substring("text", 1, 6000))
    found = periods.period_runs(docs, order=looped, lags=lags)
    assert Counter(map(tuple, found.collect())) == Counter(told(r["doc_id"], r["text"], looped) for r in docs.collect())


def test_runs_of_few_words(spark):
    rng = random.Random(11)
    rows = [(k, " ".join(rng.choice("abc"[: rng.randrange(1, 4)]) for _ in range(rng.randrange(0, 90)))) for k in range(150)]
    rows += [(1000 + k, " \t".join((unit * 9)[: rng.randrange(20, 60)] + tail) + "\n") for k, (unit, tail) in enumerate([(["a", "b"], ["a", "a"] * 9), (["x"] * 4 + ["y"], []), (["a", "b", "a", "b", "c"], ["c"] * 8), ([""], ["", "q"])])]
    found = periods.period_runs(documents(spark, rows))
    assert Counter(map(tuple, found.collect())) == Counter(told(i, t) for i, t in rows)


def test_every_lag_and_long_texts(spark):
    """A run of each period, and a text of one word, whose lags all match, in ranges."""
    rng = np.random.default_rng(5)
    for q in (*range(1, 40), 997, 4001):
        x = rng.integers(0, 1 << 20, 9 * q + 50).astype(np.int32)
        x[20 : 20 + 4 * q + 6] = np.resize(x[20 : 20 + q], 4 * q + 6)
        assert (20, 4 * q + 6, q) in periods.scan(x, np.array([0, len(x)]), np.array([1]), np.array([len(x) // 4]), 4, 6)[0]
    docs = documents(spark, [(1, "same " * 40_000), (2, LONG), (2, LONG)])
    found = sorted(map(tuple, periods.period_runs(docs, lags=2000).select("doc_id", "n_runs", "start", "length", "period").collect()))
    assert found == [(1, 1, 0, 40_000, 1), (2, 1, 0, 40_000, 10), (2, 1, 0, 40_000, 10)]


def test_word_numbers():
    texts = pa.array([" a\tb\x0b\x0ca ", None, "", "b\x1cb \x85 é", "a"])
    x, at, words = periods.word_numbers(texts)
    assert at.tolist() == [0, 3, 3, 3, 6, 7]
    assert [words[i].as_py() for i in x.tolist()] == ["a", "b", "a", "b\x1cb", "\x85", "é", "a"]
