"""Hierarchical language identification: the family first, then one-versus-one linear SVMs within it.

A text is the mean of its hashed byte trigrams, so a linear decision is a mean of weights looked up at
each position, and whole texts of any length are scored in one pass over their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geolith.llm.batches import field, map_batches, raw, runs

# Families of language codes. A language not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "uralic": ("fi", "et", "hu"),
    "baltic": ("lt", "lv"),
    "turkic": ("tr", "az", "kk"),
}
UNDETERMINED = "und"
BITS, BLOCK, SCALE = 12, 1 << 18, 100.0


def family(lang: str) -> str:
    return next((name for name, members in FAMILIES.items() if lang in members), lang)


def trigrams(data: np.ndarray) -> np.ndarray:
    """Hash of the trigram that begins at each byte but the last two."""
    x = data.astype(np.uint32)
    x = x[:-2] | x[1:-1] << np.uint32(8) | x[2:] << np.uint32(16)
    return (x * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)


def frequencies(data: np.ndarray) -> np.ndarray:
    """The vector of one text."""
    out = np.zeros(1 << BITS)
    for start in range(0, max(0, len(data) - 2), BLOCK):
        out += np.bincount(trigrams(data[start : start + BLOCK + 2]), minlength=1 << BITS)
    return (out / max(1.0, out.sum())).astype(np.float32)


def train_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the squared hinge loss, by accelerated gradient steps; both classes count the same."""
    x = np.hstack([x * SCALE, np.ones((len(x), 1), np.float32)]).astype(np.float32)
    y, weight = y.astype(np.float32), np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    # products without BLAS threads, which would contend with Spark's tasks for the machine's cores
    ahead, back = (lambda u: np.einsum("ij,j->i", x, u)), (lambda u: np.einsum("i,ij->j", u, x))
    w, before, momentum = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32), 1.0
    v = np.ones(x.shape[1], np.float32)
    for _ in range(12):  # the largest curvature, by power iteration
        v = back(weight * ahead(v / np.linalg.norm(v)))
    step = 1 / (2 * np.linalg.norm(v) * 1.1 + penalty)
    for _ in range(rounds):
        short = np.maximum(0, 1 - y * ahead(w))
        new = w - step * (penalty * w - 2 * back(weight * y * short))
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        w, before, momentum = new + np.float32((momentum - 1) / following) * (new - before), new, following
    return (before[:-1] * SCALE).astype(np.float32), float(before[-1])


@dataclass
class Model:
    """Columns of ``weights``: one family against the rest, for each; then each pair of one family's languages."""

    families: list[str]
    members: dict[str, list[str]]
    pairs: list[tuple[str, str]]
    weights: np.ndarray
    biases: np.ndarray

    def decide(self, margins: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of each row of margins."""
        chance = 1 / (1 + np.exp(-3 * np.clip(margins, -20, 20)))
        n = len(self.families)
        first = margins[:, :n].argmax(1) if n > 1 else np.zeros(len(margins), int)
        langs, scores = [], np.zeros(len(margins))
        for row, f in enumerate(first.tolist()):
            own = self.members[self.families[f]]
            base = chance[row, f] if n > 1 else 1.0
            if len(own) == 1:
                langs.append(own[0])
                scores[row] = base
                continue
            votes = {x: [0, 0.0, 0.0] for x in own}
            for k, (a, b) in enumerate(self.pairs, n):
                if a in votes and b in votes:
                    won, p = (a, chance[row, k]) if margins[row, k] >= 0 else (b, 1 - chance[row, k])
                    votes[won][0] += 1
                    votes[a][1] += chance[row, k]
                    votes[b][1] += 1 - chance[row, k]
                    votes[won][2] = min(p, votes[won][2] or 1.0)
            best = min(own, key=lambda x: (-votes[x][0], -votes[x][1], x))
            langs.append(best)
            scores[row] = base * (votes[best][2] or 0.5)
        return langs, scores


def fit(vectors: np.ndarray, langs: list[str]) -> Model | None:
    if not langs:
        return None
    known = sorted(set(langs))
    families = sorted({family(x) for x in known})
    members = {f: [x for x in known if family(x) == f] for f in families}
    pairs = [p for f in families for p in combinations(members[f], 2)]
    own, groups = np.array(langs), np.array([family(x) for x in langs])
    fits = []
    for f in families:
        fits.append(train_svm(vectors, np.where(groups == f, 1.0, -1.0)) if len(families) > 1 else (np.zeros(vectors.shape[1], np.float32), 1.0))
    for a, b in pairs:
        use = (own == a) | (own == b)
        fits.append(train_svm(vectors[use], np.where(own[use] == a, 1.0, -1.0)))
    return Model(families, members, pairs, np.stack([w for w, _ in fits], 1), np.array([b for _, b in fits]))


def margins(data: np.ndarray, offsets: np.ndarray, model: Model) -> np.ndarray:
    """Decisions of all classifiers for each text."""
    out = np.zeros((len(offsets) - 1, model.weights.shape[1]))
    for start, end in runs(offsets, BLOCK):
        a, b = int(offsets[start]), int(offsets[end])
        starts, ends = offsets[start:end], np.maximum(offsets[start:end], offsets[start + 1 : end + 1] - 2)
        for block in range(a, max(a + 1, b - 2), BLOCK):
            hashes = trigrams(data[block : min(b, block + BLOCK + 2)])
            if not len(hashes):
                continue
            sums = np.zeros(len(hashes) + 1)
            lo, hi = np.clip(starts - block, 0, len(hashes)), np.clip(ends - block, 0, len(hashes))
            for k in range(out.shape[1]):
                np.cumsum(model.weights[:, k][hashes], out=sums[1:])
                out[start:end, k] += sums[hi] - sums[lo]
    return out / np.maximum(1, np.diff(offsets) - 2)[:, None] + model.biases


def has_letter(texts: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    lower = data | 32
    found = np.concatenate([[0], np.cumsum((lower >= 97) & (lower <= 122))])
    out = found[offsets[1:]] > found[offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)).tolist():
        out[i] = any(c.isalpha() for c in texts[i].as_py())
    return out


def sample(df: DataFrame, learn: Column, most: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """About ``most`` different texts of each language, those with the smallest hashes, and never over twice as many.

    Rows with a null id are not learned from; equal texts of a language count once, whatever their ids.
    """
    rows = df.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    part = F.pmod(F.xxhash64(F.col(lang_col), F.col(text_col)), F.lit(1 << 30)) / (1 << 30)
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), part.alias("part"))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("part").alias("n")).collect()  # a row for each language
    keep = F.lit(False)
    for lang, n in counts:
        keep = keep | ((F.col("lang") == lang) & (F.col("part") < most / max(1, n)))
    order = Window.partitionBy("lang").orderBy("part", "text")
    return rows.where(keep).dropDuplicates(["lang", "text"]).withColumn("k", F.row_number().over(order)).where(F.col("k") <= 2 * most).select("lang", "text")


def learn_model(df: DataFrame, learn: Column, most: int = 300, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """The model fitted on about ``most`` documents of each language among those where ``learn`` holds; null without any.

    Null texts, languages and ids are not learned from, and equal texts once.
    """

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = raw(pc.utf8_lower(batch.column(1)))
            rows = [frequencies(data[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            used = [np.flatnonzero(r) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([u.astype("<u2").tobytes() for u in used], pa.binary()), pa.array([r[u].tobytes() for r, u in zip(rows, used, strict=True)], pa.binary())], names=["lang", "at", "value"])

    rows = map_batches(sample(df, learn, most, id_col, text_col, lang_col), vectors, [T.StructField("lang", T.StringType()), T.StructField("at", T.BinaryType()), T.StructField("value", T.BinaryType())]).collect()
    rows.sort()
    x = np.zeros((len(rows), 1 << BITS), np.float32)
    for line, (_, at, value) in zip(x, rows, strict=True):
        line[np.frombuffer(at, "<u2")] = np.frombuffer(value, np.float32)
    return fit(x, [r[0] for r in rows])


def identify(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", extra: tuple[Column, ...] = ()) -> DataFrame:
    """One row per input row: the id, the ``extra`` columns, ``lang_pred`` and ``score``.

    ``lang_pred`` is ``und``, with score 0, for a null text, a text without letters, or if no labelled
    document was there to learn from. Repeated rows and ids give repeated rows, a null id stays null,
    other columns are ignored, an empty table gives an empty one. Texts are scored whole. Ties go to the
    first family and to the first language in alphabetical order.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).fill_null("")
            data, at = raw(texts)
            known = has_letter(texts, data, at)
            langs, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            if own is not None and known.any():
                found, chance = own.decide(margins(*raw(pc.utf8_lower(texts)), own))
                langs = [x if k else UNDETERMINED for x, k in zip(found, known.tolist(), strict=True)]
                scores = np.where(known, chance, 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores)], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    rows = df.select(F.col(id_col), *extra, F.col(text_col).alias("\0text"))
    return map_batches(rows, work, [*(field(rows, c) for c in rows.columns[:-1]), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
