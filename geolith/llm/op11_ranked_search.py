"""Ranked lexical search: MaxScore over the shards of an inverted index.

A shard holds the postings of some megabytes of documents, made where the documents are read. For each shard and
query the terms' lists are ordered by the largest score that one of their postings has. The lists whose bounds
together can't reach the score in demand are non-essential: documents come from the essential lists only, and the
others are probed, largest bound first, while a document can still qualify. What is in demand rises as a shard's
documents are gone through in blocks; it starts with what an early part of the shards has shown to be needed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from geolith.llm.batches import field, id_and_text, map_batches, raw, record
from geolith.llm.shared import Stored

#: Bytes of text whose postings make a shard, and documents that are scored at a time.
SHARD_BYTES, BLOCK = 32 << 20, 2048
#: Pairs of a query and a term that the driver and each task hold at a time; more queries are searched in several blocks.
BLOCK_PAIRS = 500_000
#: One of so many shards is searched first, for scores that the others have to reach.
EARLY = 16
#: Fixed values of the score.
WEIGHT, TF_SCALE, TF_UNIT, LENGTH_UNIT, FLAT, SLOPE = 1000, 1_000_000_000, 1000, 20, 50, 50

#: Bytes to bytes: A-Z in lower case, everything but digits, letters and bytes beyond ASCII a space.
_TABLE = np.full(256, 32, np.uint8)
for _first, _last in (b"09", b"az", b"AZ", b"\x80\xff"):
    _TABLE[_first : _last + 1] = np.arange(_first, _last + 1)
_TABLE[ord("A") : ord("Z") + 1] += 32


class Numbers(dict):
    """Numbers of terms; -1 for any other."""

    def __missing__(self, term: bytes) -> int:
        return -1


def terms(texts: pa.Array) -> Iterator[list[bytes]]:
    """The terms of each text."""
    flat, at = raw(texts)
    data = _TABLE[flat].tobytes()
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield data[a:b].split()


class Shard:
    """Postings by term: ascending documents and the score that each gives."""

    def __init__(self, numbers: np.ndarray, counts: np.ndarray, docs: np.ndarray, scores: np.ndarray, size: int):
        ends = np.cumsum(counts)
        self.size = size
        self.lists = {t: (docs[a:b], scores[a:b]) for t, a, b in zip(numbers.tolist(), (ends - counts).tolist(), ends.tolist(), strict=True)}
        self.bounds = dict(zip(numbers.tolist(), np.maximum.reduceat(scores, ends - counts).tolist() if len(counts) else [], strict=True))

    def top(self, query: list[int], most: int, demand: int = 1, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
        """The ``most`` documents of highest score, of ``demand`` at least, and their scores; smaller documents first among equals."""
        found = sorted((self.bounds[t], t) for t in query if t in self.bounds)
        lists, reach = [self.lists[t] for _, t in found], np.cumsum([b for b, _ in found])
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        demand = max(demand, 1)
        for low in range(0, self.size, block):
            essential = int(np.searchsorted(reach, demand, "left"))  # what the lists before reach together is less
            if essential == len(lists):
                break
            total = np.zeros(min(block, self.size - low), np.int64)
            for own, given in lists[essential:]:
                a, b = np.searchsorted(own, (low, low + block))
                total[own[a:b] - low] += given[a:b]
            some = np.flatnonzero(total)
            for k in range(essential - 1, -1, -1):
                some = some[total[some] + reach[k] >= demand]
                if not len(some):
                    break
                own, given = lists[k]
                place = np.minimum(np.searchsorted(own, some + low), len(own) - 1)
                hit = own[place] == some + low
                total[some[hit]] += given[place[hit]]
            some = some[total[some] >= demand]
            if len(some):
                docs, scores = np.concatenate([docs, some + low]), np.concatenate([scores, total[some]])
                best = np.lexsort((docs, -scores))[:most]
                docs, scores = docs[best], scores[best]
                if len(docs) == most:
                    demand = max(demand, int(scores[-1]))
        return docs, scores


def _packed(values: np.ndarray, kind: str) -> bytes:
    return values.astype(kind).tobytes()


def make_shards(docs: DataFrame, vocabulary, id_col: str, text_col: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row for each shard: its documents' ids and lengths, and the postings of the terms in ``vocabulary``, a broadcast :class:`Numbers`."""
    kind = docs.schema[id_col].dataType
    fields = [T.StructField("ids", T.ArrayType(kind)), *(T.StructField(n, T.BinaryType()) for n in ("lengths", "postings", "tfs")), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.IntegerType())), T.StructField("n_docs", T.LongType()), T.StructField("n_terms", T.LongType())]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value.__getitem__
        ids: list[pa.Array] = []
        lengths: list[int] = []
        keys: list[np.ndarray] = []
        size = 0

        def shard() -> pa.RecordBatch:
            names = pa.chunked_array(ids).combine_chunks()
            order = pc.sort_indices(names, null_placement="at_end").to_numpy()
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            n = np.array(lengths, np.int64)
            every = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            every, tfs = np.unique((every & 0xFFFFFFFF) << 32 | place[every >> 32], return_counts=True)
            found, counts = np.unique(every >> 32, return_counts=True)
            listed = pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names.take(pa.array(order)))
            return record(
                ids=listed, lengths=[_packed(n[order], "<i8")], postings=[_packed(every & 0xFFFFFFFF, "<i4")], tfs=[_packed(tfs, "<i4")],
                terms=pa.array([found.astype(np.int32)], pa.list_(pa.int32())), counts=pa.array([counts.astype(np.int32)], pa.list_(pa.int32())), n_docs=[int((n > 0).sum())], n_terms=[int(n.sum())],
            )

        for batch in batches:
            texts = batch.column("text")
            ids.append(batch.column("id"))
            for words in terms(texts):
                own = np.fromiter(map(number, words), np.int64, len(words))
                keys.append(own[own >= 0] | len(lengths) << 32)
                lengths.append(len(words))
            size += texts.nbytes
            if size >= shard_bytes:
                yield shard()
                ids, lengths, keys, size = [], [], [], 0
        if lengths:
            yield shard()

    return map_batches(id_and_text(docs, id_col, text_col), work, fields)


def mean_lengths(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a document's length counts in its scores."""
    if FLAT * int(n.max(initial=0)) * n_docs < 1 << 63:
        share = (FLAT * n * n_docs) // max(n_terms, 1)
    else:
        share = np.array([FLAT * int(x) * n_docs // n_terms for x in n], np.int64)
    return 100 - SLOPE + share


def _searched(shards: DataFrame, queries, item: T.StructField, doc: T.StructField, most: int) -> DataFrame:
    """The best documents of each shard for each query: item, doc, score. ``queries``: broadcast ids, terms, demands, weights and totals."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, wanted, demands, weights, n_docs, n_terms = queries.value
        for batch in batches:
            for k in range(batch.num_rows):
                value = lambda c, k=k, batch=batch: batch.column(c)[k]
                flat = lambda c, kind: np.frombuffer(value(c).as_buffer(), kind).astype(np.int64)
                ids, docs, tfs = value("ids").values, flat("postings", "<i4"), flat("tfs", "<i4")
                m = mean_lengths(flat("lengths", "<i8"), n_docs, n_terms)
                numbers, counts = (value(c).values.to_numpy().astype(np.int64) for c in ("terms", "counts"))
                scores = np.repeat(weights[numbers], counts) * ((TF_SCALE * tfs) // (TF_UNIT * tfs + LENGTH_UNIT * m[docs]))
                shard = Shard(numbers, counts, docs, scores, len(ids))
                items, best, given = [], [], []
                for i, (query, demand) in enumerate(zip(wanted, demands, strict=True)):
                    found, score = shard.top(query, most, demand)
                    items += [i] * len(found)
                    best.append(found)
                    given.append(score)
                found = np.concatenate(best) if best else np.zeros(0, np.int64)
                yield record(item=pa.array([names[i] for i in items], arrow), doc=ids.take(pa.array(found)), score=np.concatenate(given) if given else np.zeros(0, np.int64))

    arrow = to_arrow_type(item.dataType)
    return map_batches(shards, work, [item, doc, T.StructField("score", T.LongType())])


def _ranked(rows: DataFrame, most: int) -> DataFrame:
    by = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most)


def ranked_search(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text", most: int = 50, shard_bytes: int = SHARD_BYTES, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """The ``most`` documents of highest score above 0 for each query: item, rank (int, from 1), id, score.

    Terms are runs of digits, letters and characters beyond ASCII, with A-Z in lower case. N counts the documents with a
    term, L all their terms, n one document's, df a term's documents, tf its occurrences in one. A query's score of a document
    sums floor(1000 ln((2N + 2) / (2df + 1))) * (10^9 tf div (1000 tf + 20 m)) over its different terms, with m = 50 + 50 n N div L.
    Equal scores rank by ascending id, null ids last. Each row of ``docs`` is a document, also if its id or text occurs again;
    rows of one item are one query of all their terms. Null texts have no terms; queries without a term in the documents get no row.

    All rows of ``docs`` are searched for every query. Queries are held by the driver and the tasks in blocks of about ``block_pairs``
    terms; each block reads the documents once.
    """
    spark = docs.sparkSession
    stored = Stored(spark)
    item, doc = field(queries, item_col, "item"), field(docs, id_col, "doc")

    def of_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [sorted(set(words)) for words in terms(batch.column("text"))]
            rows = pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own]))
            yield record(item=batch.column("id").take(rows), term=pa.array([t for x in own for t in x], pa.binary()))

    pairs = map_batches(id_and_text(queries, item_col, query_col), of_queries, [item, T.StructField("term", T.BinaryType())]).distinct()
    pairs = stored(pairs)
    blocks = max(1, -(-pairs.count() // block_pairs))
    out = None
    for block in range(blocks):
        own = pairs.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).groupBy("item").agg(F.collect_list("term").alias("terms")).collect()
        vocabulary = Numbers()
        for row in own:
            for term in row["terms"]:
                vocabulary.setdefault(bytes(term), len(vocabulary))
        shared = spark.sparkContext.broadcast(vocabulary)
        shards = stored(make_shards(docs, shared, id_col, text_col, shard_bytes), rows_a_file=4)
        n_docs, n_terms = (x or 0 for x in shards.agg(F.sum("n_docs"), F.sum("n_terms")).first())
        df = np.zeros(len(vocabulary), np.int64)
        for row in shards.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy("t.terms").agg(F.sum("t.counts").alias("n")).toLocalIterator():
            df[row[0]] = row[1]
        weights = np.array([math.floor(WEIGHT * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        names, wanted = [row["item"] for row in own], [sorted(vocabulary[bytes(t)] for t in row["terms"]) for row in own]
        demand = dict.fromkeys(names, 1)

        def search(part: DataFrame, names=names, wanted=wanted, weights=weights, totals=(n_docs, n_terms), demand=demand) -> DataFrame:
            told = spark.sparkContext.broadcast((names, wanted, [demand[n] for n in names], weights, *totals))
            return stored(_ranked(_searched(part, told, item, doc, most), most))

        early = F.pmod(F.xxhash64("lengths"), F.lit(EARLY)) == 0
        first = search(shards.where(early))
        demand |= {r["item"]: r["score"] for r in first.where(F.col("rank") == most).select("item", "score").toLocalIterator()}
        rest = search(shards.where(~early))
        stored.drop(shards)
        found = _ranked(first.drop("rank").union(rest.drop("rank")), most)
        out = found if out is None else out.union(found)
    return out.select(F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("doc").alias(id_col), "score")
