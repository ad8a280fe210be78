"""Toxicity from the nearest labelled examples, by exact TF-IDF cosine over a block-max inverted index.

Terms are words and their prefixes. All terms of a bounded sample of labelled documents span the vector
space; their document frequencies are counted over all documents, and a term's weight grows smoothly with
what it tells about the labels, never below its TF-IDF. Examples lie in blocks of an inverted index whose
largest weights bound a block's cosines, so blocks that can't hold a nearer example are never scored.
Votes weighted by closeness are calibrated on the examples themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geolith.llm.batches import field, map_batches, raw, runs
from geolith.llm.shared import small
from geolith.llm.tokens import ALPHANUMERIC, span_hashes, words

#: Prefixes in bytes that are terms beside the words themselves.
PREFIXES = (4, 5, 6)
RUN = 1 << 19
#: Blocks that a search scores first; each further step takes twice as many.
FIRST_BLOCKS = 4
#: Texts that are compared with a block at once.
QUERIES = 256
#: Examples with a term from which on its weights lie in tiles, not in postings.
COMMON = 64
#: Weight of the share of toxic documents in a vote, in examples at cosine 1/2.
PRIOR = 4.0


class Vocabulary:
    """Sorted term hashes, found by a table of their leading bits."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.shift = np.uint64(64 - max(8, min(22, 2 + len(hashes).bit_length())))
        self.starts = np.searchsorted(hashes >> self.shift, np.arange((1 << (64 - int(self.shift))) + 1, dtype=np.uint64)).astype(np.int32)

    def __len__(self) -> int:
        return len(self.hashes)

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, or -1."""
        bucket = (h >> self.shift).astype(np.int64)
        at, end = self.starts[bucket], self.starts[bucket + 1]
        live = np.flatnonzero(at < end)
        out = np.full(len(h), -1, np.int64)
        while len(live):
            own = self.hashes[at[live]]
            hit = own == h[live]
            out[live[hit]] = at[live[hit]]
            live = live[own < h[live]]
            at[live] += 1
            live = live[at[live] < end[live]]
        return out


def terms(texts: pa.Array, only: Vocabulary | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row, distinct term hashes and counts of each text with any; with a vocabulary its numbers stand for the hashes."""
    data, at = raw(pc.utf8_lower(texts))
    for first, last in runs(at, RUN):
        base = int(at[first])
        own, cut = data[base : int(at[last])], at[first : last + 1] - base
        starts, ends = words(own, cut, ALPHANUMERIC)
        if not len(starts):
            continue
        rows = np.searchsorted(cut, starts, "right") - 1
        length = ends - starts
        found = span_hashes(own, starts, ends, *(np.minimum(ends, starts + n) for n in PREFIXES))
        longer = [slice(None), *(length > n for n in PREFIXES)]
        h, r = (np.concatenate(x) for x in ([x[use] for x, use in zip(found, longer, strict=True)], [rows[use] for use in longer]))
        if only is not None:
            number = only.numbers(h)
            key = np.sort((r << 32 | number)[number >= 0])
            if not len(key):
                continue
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            counts, h, r = np.diff(np.append(new, len(key))), key[new] & 0xFFFFFFFF, key[new] >> 32
        else:
            order = np.lexsort((h, r))
            h, r = h[order], r[order]
            new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])]))
            counts, h, r = np.diff(np.append(new, len(h))), h[new], r[new]
        edge = np.append(np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]])), len(r))
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            yield first + int(r[a]), h[a:b], counts[a:b]


def spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of some ranges one after the other, and the range of each."""
    sizes = ends - starts
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(owner)) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes), owner


@dataclass
class Index:
    """Labelled examples as an inverted index in blocks of like examples.

    Block ``b`` holds the examples ``place[b]`` (-1: none). A term in ``COMMON`` examples or more has a
    ``row``: its weights in a block are ``tiles[b, row]``, the largest of them is ``most[row, b]``. Any other
    term ``t`` has the postings ``at[t]`` to ``at[t + 1]`` of ``slots``, numbers in ``place``, and ``weights``.
    """

    vocabulary: Vocabulary
    term_weight: np.ndarray
    names: np.ndarray
    labels: np.ndarray
    class_weight: np.ndarray
    block: int
    k: int
    place: np.ndarray | None = None
    row: np.ndarray | None = None
    tiles: np.ndarray | None = None
    most: np.ndarray | None = None
    at: np.ndarray | None = None
    slots: np.ndarray | None = None
    weights: np.ndarray | None = None
    slope: float = 1.0
    shift: float = 0.0
    base: float = 0.0

    def vector(self, numbers: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = (1 + np.log(counts)) * self.term_weight[numbers]
        return (w / np.linalg.norm(w)).astype(np.float32)

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], without: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the ``k`` examples of largest cosine over 0, ties by number.

        They are exact, as a block is left out only if its bound is below all of them. ``without`` has an
        example for each query that doesn't count.
        """
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for a in range(0, len(queries), QUERIES):
            out += self.some_nearest(queries[a : a + QUERIES], without[a : a + QUERIES] if without is not None else np.full(len(queries[a : a + QUERIES]), -2))
        return out

    def some_nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], without: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        n, (blocks, block) = len(queries), self.place.shape
        common, exact = np.zeros((n, len(self.most)), np.float32), np.zeros((n, blocks, block), np.float32)
        for i, (numbers, counts) in enumerate(queries):
            q, row = self.vector(numbers, counts), self.row[numbers]
            use = row >= 0
            common[i, row[use]] = q[use]
            rare = numbers[~use]
            postings, owner = spans(self.at[rare], self.at[rare + 1])
            exact[i] = np.bincount(self.slots[postings], self.weights[postings] * q[~use][owner], blocks * block).reshape(blocks, block)
        bounds = common @ self.most + exact.max(2)
        order = np.argsort(-bounds, axis=1, kind="stable")
        best, which, done, step = np.zeros((n, self.k), np.float32), np.full((n, self.k), -1), 0, FIRST_BLOCKS
        while done < blocks:
            todo = order[:, done : done + step]
            bound = np.take_along_axis(bounds, todo, 1)
            live = (bound > 0) & (bound >= best[:, -1:] - 1e-5)
            if not live.any():
                break
            cosines = np.zeros((n, todo.shape[1], block), np.float32)
            rows, columns = np.nonzero(live)
            own = todo[rows, columns]
            for b in np.unique(own).tolist():
                r, c = rows[own == b], columns[own == b]
                cosines[r, c] = common[r] @ self.tiles[b] + exact[r, b]
            names = self.place[todo]
            cosines[(names < 0) | (names == without[:, None, None])] = 0
            cosines, names = np.concatenate([best, cosines.reshape(n, -1)], 1), np.concatenate([which, names.reshape(n, -1)], 1)
            least = np.partition(cosines, -self.k, 1)[:, -self.k]
            for i in range(n):
                use = np.flatnonzero(cosines[i] >= least[i]) if least[i] > 0 else np.flatnonzero(cosines[i] > 0)
                top = use[np.lexsort((names[i, use], -cosines[i, use]))[: self.k]]
                best[i, : len(top)], which[i, : len(top)] = cosines[i, top], names[i, top]
            done, step = done + todo.shape[1], step * 2
        return [(w[c > 0], c[c > 0]) for w, c in zip(which, best, strict=True)]

    def vote(self, which: np.ndarray, cosines: np.ndarray) -> float:
        """Share of toxic examples among the nearest, by closeness and by how many documents an example stands for.

        The weight, cosine / distance, is almost nothing for far examples; then the share of all documents prevails.
        """
        cosines = np.minimum(1.0, cosines)
        weight = self.class_weight[which] * cosines / (1.0001 - cosines)
        prior = PRIOR * self.class_weight.mean()
        common = float((self.labels * self.class_weight).sum() / self.class_weight.sum())
        return float((weight[self.labels[which] == 1].sum() + prior * common) / (weight.sum() + prior))

    def score(self, which: np.ndarray, cosines: np.ndarray) -> float:
        if not len(which):
            return self.base
        p = min(1 - 1e-3, max(1e-3, self.vote(which, cosines)))
        return float(1 / (1 + np.exp(-(self.slope * np.log(p / (1 - p)) + self.shift))))


def alike(rows: np.ndarray, vectors: np.ndarray, block: int) -> list[np.ndarray]:
    """Blocks of rows that point the same way: halves along their main direction, halved again."""
    if len(rows) <= block:
        return [rows]
    x = vectors[rows] - vectors[rows].mean(0)
    way = x[np.argmax((x * x).sum(1))]
    for _ in range(6):
        way = x.T @ (x @ way)
        way /= max(1e-12, float(np.linalg.norm(way)))
    order = rows[np.argsort(x @ way, kind="stable")]
    half = -(-len(rows) // block) // 2 * block
    return alike(np.sort(order[:half]), vectors, block) + alike(np.sort(order[half:]), vectors, block)


def build(examples: list[tuple[int, np.ndarray, np.ndarray]], labels: np.ndarray, names: np.ndarray, class_weight: np.ndarray, vocabulary: np.ndarray, term_weight: np.ndarray, block: int, k: int) -> Index:
    """The index of examples, each a row with term numbers and counts, and its calibration by leaving each one out."""
    index = Index(Vocabulary(vocabulary), term_weight, names, labels, class_weight, block, k)
    term = np.concatenate([numbers.astype(np.int64) for _, numbers, _ in examples])
    example = np.concatenate([np.full(len(numbers), r) for r, numbers, _ in examples])
    weight = np.concatenate([index.vector(numbers.astype(np.int64), counts) for _, numbers, counts in examples])
    often = np.bincount(term, minlength=len(vocabulary)) >= COMMON
    index.row = np.where(often, np.cumsum(often) - 1, -1).astype(np.int32)
    dense = np.zeros((len(labels), int(often.sum())), np.float32)
    use = often[term]
    dense[example[use], index.row[term[use]]] = weight[use]
    blocks = alike(np.arange(len(labels)), dense, block)
    index.place = np.full((len(blocks), block), -1)
    for line, rows in zip(index.place, blocks, strict=True):
        line[: len(rows)] = rows
    index.tiles = np.where((index.place >= 0)[:, None, :], dense[index.place].transpose(0, 2, 1), np.float32(0))
    index.most = np.ascontiguousarray(index.tiles.max(2).T)
    slot = np.empty(len(labels), np.int64)
    slot[index.place[index.place >= 0]] = np.flatnonzero(index.place.ravel() >= 0)
    term, slots, weight = term[~use], slot[example[~use]], weight[~use]
    order = np.lexsort((slots, term))
    index.at, index.slots, index.weights = np.searchsorted(term[order], np.arange(len(vocabulary) + 1)), slots[order], weight[order]
    votes, truth, weight, empty = [], [], [], np.ones(len(labels), bool)
    nearest = index.nearest([(numbers.astype(np.int64), counts) for _, numbers, counts in examples], np.array([row for row, *_ in examples]))
    for (row, *_), (which, cosines) in zip(examples, nearest, strict=True):
        if len(which):
            empty[row] = False
            votes.append(index.vote(which, cosines))
            truth.append(labels[row])
            weight.append(class_weight[row])
    weighted = class_weight * empty
    index.base = float(((labels == 1) * weighted).sum() / weighted.sum()) if weighted.sum() else float((labels * class_weight).sum() / max(1e-9, class_weight.sum()))
    p = np.clip(votes, 1e-3, 1 - 1e-3)
    x, y, w = np.log(p / (1 - p)), np.array(truth, float), np.array(weight, float)
    a, c = 1.0, 0.0
    for _ in range(50 if len(x) else 0):  # logistic regression on one variable by Newton's method
        chance = 1 / (1 + np.exp(-(a * x + c)))
        g, h = w * (chance - y), w * chance * (1 - chance) + 1e-9
        gradient = np.array([(g * x).sum() + 1e-3 * (a - 1), g.sum() + 1e-3 * c])
        hessian = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(hessian, gradient)
        a, c = a - float(np.clip(step[0], -1, 1)), c - float(np.clip(step[1], -1, 1))
    index.slope, index.shift = max(0.05, a), c
    return index


def unlike(examples: list[tuple[int, np.ndarray, np.ndarray]], shared: int = 3, kept: int = 8, rare: int = 50) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Examples that don't have ``shared`` of their ``kept`` rare terms of least hash in common with an earlier one.

    Copies of one document would make each of its words look like evidence.
    """
    if not examples:
        return []
    value, count = np.unique(np.concatenate([e[1] for e in examples]), return_counts=True)
    out, seen = [], {}
    for row, hashes, counts in examples:
        own = hashes[count[np.searchsorted(value, hashes)] <= rare][:kept].tolist()
        met: dict[int, int] = {}
        for h in own:
            for other in seen.get(h, ()):
                met[other] = met.get(other, 0) + 1
        if max(met.values(), default=0) < min(shared, max(1, len(own))):
            out.append((row, hashes, counts))
            for h in own:
                seen.setdefault(h, []).append(row)
    return out


def label_evidence(vocabulary: np.ndarray, examples: list[tuple[int, np.ndarray, np.ndarray]], labels: np.ndarray) -> np.ndarray:
    """How much the presence of each vocabulary term tells about the labels: the likelihood ratio statistic, 0 or more."""
    h = np.concatenate([e[1] for e in examples])
    y = np.concatenate([np.full(len(e[1]), labels[e[0]]) for e in examples])
    unique, inverse = np.unique(h, return_inverse=True)
    used = labels[[e[0] for e in examples]]
    n1, n0 = float((used == 1).sum()), float((used == 0).sum())
    in1 = np.bincount(inverse, y == 1, len(unique))
    in0 = np.bincount(inverse, y == 0, len(unique))
    total = n1 + n0

    def part(observed: np.ndarray, row: np.ndarray | float, column: float) -> np.ndarray:
        return observed * np.log(np.maximum(observed, 1e-12) * total / np.maximum(1e-12, row * column))

    present = in1 + in0
    g = 2 * (part(in1, present, n1) + part(in0, present, n0) + part(n1 - in1, total - present, n1) + part(n0 - in0, total - present, n0))
    out = np.zeros(len(vocabulary))
    out[np.searchsorted(vocabulary, unique)] = np.maximum(0.0, g)
    return out


def document_frequencies(df: DataFrame, vocabulary: Vocabulary, text_col: str) -> tuple[np.ndarray, int]:
    """In how many of all documents each vocabulary term occurs, and how many documents there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            total += batch.num_rows
            for _, numbers, _ in terms(batch.column(0).fill_null(""), vocabulary):
                n[numbers] += 1
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(n[used], total))], names=["term", "n"])

    rows = map_batches(df.select(text_col), count, [T.StructField("term", T.LongType()), T.StructField("n", T.LongType())]).groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = (rows.column(c).to_numpy() for c in ("term", "n"))
    out = np.zeros(len(vocabulary), np.int64)
    out[term[term >= 0]] = n[term >= 0]
    return out, int(n[term < 0].sum())


def learn_index(docs: DataFrame, labels: DataFrame, learn: Column, most: int = 1500, evidence: float = 24.0, block: int = 64, k: int = 15, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Index | None:
    """The index of about ``most`` examples of either label among labelled documents where ``learn`` holds.

    The sample are the documents with the smallest hashes of their ids; each of their terms is indexed. A
    term's weight is its IDF times 1 + G / ``evidence``, where G is how much it tells about the labels. A
    document that is labelled several times has its largest label; of several texts of one id one counts,
    whatever their order.
    """
    known = labels.where(learn & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("label")).where("label in (0, 1)")
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    part = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30)) / (1 << 30)
    rate = {y: min(1.0, most / n) for y, n in counts.items()}
    sampled = known.where(part < F.when(F.col("label") == 1, rate[1]).otherwise(rate[0]))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {r: (h, n) for r, h, n in terms(batch.column(2).fill_null(""))}
            none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            blobs = [found.get(i, none) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([h.tobytes() for h, _ in blobs], pa.binary()), pa.array([n.astype("<u4").tobytes() for _, n in blobs], pa.binary())], names=["id", "label", "terms", "counts"])

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(small(sampled.withColumnRenamed(id_col, "id")), "id").select("id", "label", "text")
    fields = [field(chosen, "id"), T.StructField("label", T.IntegerType()), T.StructField("terms", T.BinaryType()), T.StructField("counts", T.BinaryType())]
    found = sorted(map_batches(chosen, extract, fields).collect(), key=lambda r: (r["id"], r["terms"], r["counts"]))
    rows = [r for i, r in enumerate(found) if not i or r["id"] != found[i - 1]["id"]]
    if not rows:
        return None
    names, y = [r["id"] for r in rows], np.array([r["label"] for r in rows])
    examples = [(i, np.frombuffer(r["terms"], np.uint64), np.frombuffer(r["counts"], "<u4").astype(np.int64)) for i, r in enumerate(rows) if r["terms"]]
    if not examples:
        return None
    vocabulary = np.unique(np.concatenate([h for _, h, _ in examples]))
    frequency, total = document_frequencies(docs, Vocabulary(vocabulary), text_col)
    term_weight = (np.log((total + 1) / (frequency + 1)) + 1e-3) * (1 + label_evidence(vocabulary, unlike(examples), y) / evidence)
    kept = [(i, np.searchsorted(vocabulary, h), n) for i, h, n in examples]
    weight = np.where(y == 1, 1 / rate[1], 1 / rate[0])
    return build(kept, y, np.array(names, dtype=object), weight, vocabulary, term_weight, block, k)


def score_toxicity(df: DataFrame, index: Index | None, id_col: str = "doc_id", text_col: str = "text", extra: tuple[Column, ...] = (), shown: int = 5) -> DataFrame:
    """One row per input row: the id, the ``extra`` columns, ``score``, ``predicted``, and the ``shown`` nearest examples as ``evidence`` and ``cosines``.

    A null or empty text, and one without any vocabulary term, has the share of toxic examples among
    those without one as its score, and no evidence; with nothing to learn from the score is 0. Repeated
    rows and ids give repeated rows, a null id stays null, other columns are ignored, an empty table gives
    an empty one. Texts are scored whole. Equal cosines count in the order of the examples' ids.
    """
    shared = df.sparkSession.sparkContext.broadcast(index)
    id_type = df.schema[id_col].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            n = batch.num_rows
            scores = np.full(n, own.base if own else 0.0)
            names: list[list] = [[] for _ in range(n)]
            cosines: list[list] = [[] for _ in range(n)]
            if own:
                found = list(terms(batch.column(batch.num_columns - 1).fill_null(""), own.vocabulary))
                for (row, *_), (which, near) in zip(found, own.nearest([(numbers, counts) for _, numbers, counts in found]), strict=True):
                    scores[row] = own.score(which, near)
                    names[row] = own.names[which[:shown]].tolist()
                    cosines[row] = near[:shown].tolist()
            evidence = pa.array(names, pa.list_(batch.column(0).type))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), evidence, pa.array(cosines, pa.list_(pa.float32()))], names=[*batch.schema.names[:-1], "score", "predicted", "evidence", "cosines"])

    rows = df.select(F.col(id_col), *extra, F.col(text_col).alias("\0text"))
    fields = [*(field(rows, c) for c in rows.columns[:-1]), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("evidence", T.ArrayType(id_type)), T.StructField("cosines", T.ArrayType(T.FloatType()))]
    return map_batches(rows, work, fields)
