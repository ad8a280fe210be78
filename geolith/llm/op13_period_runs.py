"""Periodic runs of words: every lag's comparison of a text's word numbers with themselves, run-length encoded.

A run of period q and length L >= max(shortest, repeats * q) is a stretch of L - q consecutive words that equal the
words q further on. All lags up to n / repeats are scanned, for a whole batch of texts at once: as such a stretch
is long, it holds three of the places that lie a third of its least length apart, so the words are compared at
those places first, and only where three of them in a row are equal is the whole stretch found. That makes all
lags of a text cost n log n comparisons, without leaving any out.

Texts with few lags are done where they are read. Those with more are dealt over the cluster by ranges of lags;
a text's runs then meet in one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geolith.llm.batches import field, id_and_text, map_batches, record
from geolith.llm.shared import Stored

#: Lags of a text that one task compares; a text with more is dealt by ranges of this many.
LAGS = 1 << 15


def word_numbers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Numbers of all texts' words, equal for equal words; len + 1 offsets; and the words by number. Null: no words."""
    parts = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
    flat, at = parts.flatten(), parts.offsets.to_numpy()
    some = pc.not_equal(flat, "")  # a text that begins or ends with a space has empty words there
    before = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
    coded = flat.filter(some).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int32, copy=False), before[at - at[0]].astype(np.int64), coded.dictionary


def stretches(equal: np.ndarray, least: int) -> np.ndarray:
    """Starts and ends of the stretches of at least ``least`` true values."""
    change = np.flatnonzero(np.diff(np.concatenate([[False], equal, [False]]).view(np.int8)))
    found = change.reshape(-1, 2)
    return found[found[:, 1] - found[:, 0] >= least]


def smallest_period(x: np.ndarray, q: int) -> int:
    """The smallest period of ``x``, which has period q and at least 2 q values: it divides q."""
    rest, prime = q, 2
    while rest > 1:
        if prime * prime > rest:
            prime = rest
        if rest % prime == 0:
            while q % prime == 0 and bool((x[q // prime :] == x[: len(x) - q // prime]).all()):
                q //= prime
            while rest % prime == 0:
                rest //= prime
        prime += 1
    return q


class Text:
    """The runs of one text's words."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.runs: list[tuple[int, int, int]] = []
        self.known = np.zeros((0, 3), np.int64)  # start, end, smallest period of stretches met at any lag

    def look(self, q: int, places: np.ndarray, least: int) -> None:
        """Find the stretches of lag q around some places that are equal there."""
        x = self.x
        for start, end, period in self.known[(self.known[:, 1] - self.known[:, 0] >= least + q) & (q % self.known[:, 2] == 0)].tolist():
            inside = (places >= start) & (places < end - q)
            # A stretch that ends where one of a smaller period does has that period.
            if inside.any() and not (start and x[start - 1] == x[start - 1 + q]) and not (end < len(x) and x[end - q] == x[end]):
                places = places[~inside]
        if not len(places):
            return
        for a, b in stretches(x[:-q] == x[q:], least).tolist():
            b += q
            period = smallest_period(x[a:b], q)
            if period == q:
                self.runs.append((a, b - a, q))
            else:  # another lag's run, which reaches further
                more = x[:-period] == x[period:]
                same = np.flatnonzero(~more[:a])
                left = int(same[-1]) + 1 if len(same) else 0
                same = np.flatnonzero(~more[a:])
                a, b = left, (a + int(same[0]) if len(same) else len(more)) + period
            if not ((self.known == (a, b, period)).all(1)).any():
                self.known = np.vstack([self.known, [(a, b, period)]])


def scan(x: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, repeats: int, shortest: int) -> list[list[tuple[int, int, int]]]:
    """Start, length and period of each text's runs with a period from its ``low`` to its ``high``.

    The texts are laid out by descending last lag, so that those which a lag concerns stand together.
    """
    order = np.argsort(-high, kind="stable")
    sizes = np.diff(at)[order]
    ends = np.cumsum(sizes)
    flat = np.concatenate([x[at[k] : at[k + 1]] for k in order.tolist()]) if len(order) else x[:0]
    starts, tops = ends - sizes, high[order]
    texts: dict[int, Text] = {}
    for q in range(int(low.min(initial=1)), int(tops.max(initial=0)) + 1):
        n = int(np.searchsorted(-tops, -q, "right"))  # texts whose last lag is q or more
        end, least = int(ends[n - 1]), max(shortest, repeats * q) - q
        step = max(1, least // 3)
        equal = flat[0 : end - q : step] == flat[q:end:step]
        found = np.flatnonzero(equal[:-2] & equal[1:-1] & equal[2:] if least > 2 else equal) * step
        if not len(found):
            continue
        owners = np.searchsorted(ends, found, "right")
        first = np.concatenate([[True], owners[1:] != owners[:-1]])
        bounds = [*np.flatnonzero(first).tolist(), len(found)]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            k = int(owners[a])
            if low[order[k]] <= q and sizes[k] > q:
                if k not in texts:
                    texts[k] = Text(flat[starts[k] : ends[k]])
                texts[k].look(q, found[a:b] - starts[k], least)
    out: list[list[tuple[int, int, int]]] = [[] for _ in order]
    for k, text in texts.items():
        out[int(order[k])] = sorted(text.runs, key=lambda r: (r[0], r[2]))
    return out


def summary(runs: list[tuple[int, int, int]], words: np.ndarray, dictionary: pa.Array) -> tuple:
    """What is told about a text: number of runs, the one repeated most often, and the digests of the runs and of the words that stay."""
    best = None
    for run in runs:  # by start, then period: the first of equals stays
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    kept = words[np.cumsum(drop[:-1]) == 0]
    listed = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), dictionary.take(pa.array(kept)).cast(pa.string())), " ")[0].as_py() if len(kept) else ""
    row = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *row, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


NAMES = ("n_runs", "start", "length", "period", "exponent_milli")
DIGESTS = ("runs_sha256", "collapsed_sha256")


def _columns(rows: list[tuple]) -> dict:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 7
    return {n: pa.array(c, pa.int64()) for n, c in zip(NAMES, columns, strict=False)} | {n: pa.array(c, pa.string()) for n, c in zip(DIGESTS, columns[5:], strict=True)}


def period_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repeats: int = 4, shortest: int = 6, order: Callable[[object, int], np.ndarray | None] | None = None, lags: int = LAGS) -> DataFrame:
    """One row for each row of ``docs`` with the runs of its words, which are separated by spaces and the control characters 9 to 13.

    A run is a maximal stretch with smallest period q and length of at least ``shortest`` and ``repeats`` * q; ``repeats`` is
    2 or more. ``order`` may give, for an id and a number of words, the positions to be read instead, one for each word.

    Columns: id, n_runs; start, length, period, exponent_milli of the run with the greatest length / period (the first, then
    that of the smallest period, among equals), null without runs; runs_sha256 of all runs' lines ``start,length,period``;
    collapsed_sha256 of the words outside of all runs' repeats, joined by spaces. A null text has no words; ids may be
    null or repeated, each row is judged by itself.
    """
    if repeats < 2:
        raise ValueError("repeats has to be 2 or more")
    stored = Stored(docs.sparkSession)
    kind = field(docs, id_col, "id")
    rows = id_and_text(docs, id_col, text_col)
    # A text of b bytes has (b + 1) / 2 words at most.
    long = F.octet_length("text") > 2 * repeats * lags
    told = [*(T.StructField(n, T.LongType()) for n in NAMES), *(T.StructField(n, T.StringType()) for n in DIGESTS)]
    names = [id_col, *NAMES, *DIGESTS]

    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        x, at, dictionary = word_numbers(batch.column("text"))
        if order is not None:
            for k, name in enumerate(batch.column("id").to_pylist()):
                places = order(name, int(at[k + 1] - at[k])) if at[k + 1] > at[k] else None
                if places is not None:
                    if x.flags.writeable is False:
                        x = x.copy()
                    x[at[k] : at[k + 1]] = x[at[k] : at[k + 1]][places]
        return x, at, dictionary

    def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, at, dictionary = read(batch)
            runs = scan(x, at, np.ones(len(at) - 1, np.int64), np.diff(at) // repeats, repeats, shortest)
            yield record(id=batch.column("id"), **_columns([summary(r, x[at[k] : at[k + 1]], dictionary) for k, r in enumerate(runs)]))

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, at, _ = read(batch)
            first = batch.column("range").to_numpy() * lags + 1
            last = np.minimum(np.diff(at) // repeats, first + lags - 1)
            runs = [scan(x[at[k] : at[k + 1]], np.array([0, at[k + 1] - at[k]]), first[k : k + 1], last[k : k + 1], repeats, shortest)[0] for k in range(len(first))]
            flat = np.array([r for own in runs for r in own], np.int64).reshape(-1, 3)
            yield record(row=np.repeat(batch.column("row").to_numpy(), [len(r) for r in runs]), start=flat[:, 0], length=flat[:, 1], period=flat[:, 2])

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, at, dictionary = read(batch)
            runs = [[(r["start"], r["length"], r["period"]) for r in own or []] for own in batch.column("runs").to_pylist()]
            yield record(id=batch.column("id"), **_columns([summary(r, x[at[k] : at[k + 1]], dictionary) for k, r in enumerate(runs)]))

    done = map_batches(rows.where(~F.coalesce(long, F.lit(False))), here, [kind, *told])
    rest = stored(rows.where(long).withColumn("row", F.monotonically_increasing_id()))
    if rest.isEmpty():
        return done.toDF(*names)
    last = F.floor((F.octet_length("text") + 1) / (2 * repeats * lags))
    dealt = rest.withColumn("range", F.explode(F.sequence(F.lit(0), last)))
    parts = int(rest.agg(F.sum(last + 1)).first()[0])
    dealt = dealt.repartition(parts, "row", "range")  # a range takes its task about a second for each megabyte of text
    found = map_batches(dealt.select("row", "id", "text", "range"), ranged, [T.StructField(n, T.LongType()) for n in ("row", "start", "length", "period")])
    runs = stored(found).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    rest = rest.join(runs, "row", "left").select("id", "text", "runs")
    return done.union(map_batches(rest, ended, [kind, *told])).toDF(*names)
