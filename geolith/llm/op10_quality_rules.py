"""Quality rules and cross-document line frequency, in DataFrame functions only.

Normalised lines are hashed and counted over distinct documents of each host. A line above the limit is
removed from all of the host's documents but the one of smallest id, and a document that loses more
than half of its words so is rejected, as is one that fails the rules on the text alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolith.llm.shared import Stored, small

#: White space, and the characters that count as symbols.
SPACE, SPACES, SYMBOLS = r"[\x20\x09-\x0D]+", " \t\n\x0b\f\r", "#*$%&|<>"


@dataclass(frozen=True)
class Limits:
    """A line is frequent if over ``line_docs`` documents of its host have it, however many the host has."""

    min_words: int = 50
    repeat_share: float = 0.5
    line_docs: int = 20
    depleted_share: float = 0.5


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def n_repeat_words(w: Column, hashes: Column) -> Column:
    """Words in 3-word windows whose hash occurs twice or more among ``hashes``, one for each window."""

    def covered(rows: Column) -> Column:
        twice = lambda x, i: F.coalesce(F.get(rows, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(rows, i + 1)["h"] == x["h"], F.lit(False))
        starts = F.array_sort(F.transform(F.filter(rows, twice), lambda x: x["i"]))
        zero = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("n"))
        step = lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"))
        return F.aggregate(starts, zero, step, lambda a: a["n"])

    rows = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    once = F.size(F.array_distinct(hashes)) == F.size(hashes)
    return F.when(once, F.lit(0).cast("bigint")).otherwise(F.element_at(F.transform(F.array(rows), covered), 1))


def text_of(df: DataFrame, id_col: str, text_col: str, host_col: str, *extra: Column) -> DataFrame:
    """Id, text and host of each row, and the lines of the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    host = F.xxhash64(F.coalesce(F.col(host_col).cast("string"), F.lit(""))).alias("host")
    df = df.select(F.col(id_col).alias("id"), text.alias("text"), host, F.monotonically_increasing_id().alias("row"), *extra)
    return df.withColumn("lines", F.split(F.col("text"), "\n"))


def measured(df: DataFrame, limits: Limits) -> DataFrame:
    """The rules on each text alone, beside the columns of ``df``."""
    w, has_word = F.col("w"), lambda x: F.btrim(x, F.lit(SPACES)) != ""
    window = F.when(F.size(w) >= 3, F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>"))
    own = df.columns
    df = df.withColumn("w", words(F.col("text"))).withColumn("own", F.filter("lines", has_word))
    df = df.withColumn("hashes", window)
    df = df.select(
        *own, F.xxhash64("text").alias("text_key"),
        F.size(w).cast("bigint").alias("n_words"),
        F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.translate(F.col("text"), SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("own") - F.size(F.array_distinct("own"))).cast("bigint").alias("n_dup_lines"),
        n_repeat_words(w, F.col("hashes")).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > round(100 * limits.repeat_share) * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def normalised(line: Column) -> Column:
    """A line for comparison: lower case, single spaces, none at the ends."""
    return F.btrim(F.lower(F.regexp_replace(line, SPACE, " ")))


def line_keys() -> Column:
    """The keys of a host's lines; a line without a word has none."""
    return F.transform("lines", lambda x: F.when(F.btrim(x, F.lit(SPACES)) != "", F.xxhash64(F.col("host"), normalised(x))))


def frequent_lines(rows: DataFrame, limits: Limits) -> DataFrame:
    """``key`` of each line above the limit in a host, and ``first``, the smallest id that has it.

    A line and a document count once, whatever rows have them.
    """
    pairs = rows.select("id", F.explode(F.array_compact(F.array_distinct(line_keys()))).alias("key")).where("id is not null").distinct()
    return pairs.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first")).where(F.col("n") > limits.line_docs).select("key", "first")



def removals(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """``places`` of the frequent lines that go from a text, by its id and ``text_key``, and how many words they have."""
    lines = rows.select("row", "id", F.xxhash64("text").alias("text_key"), F.posexplode(F.arrays_zip("lines", line_keys().alias("keys"))).alias("at", "line"))
    lines = lines.select("row", "id", "text_key", "at", F.col("line.lines").alias("line"), F.col("line.keys").alias("key")).where("key is not null")
    lines = lines.join(hot, "key").where(~F.col("id").eqNullSafe(F.col("first")))
    found = lines.groupBy("row", "id", "text_key").agg(F.sum(F.size(words(F.col("line")))).alias("removed_words"), F.collect_set("at").alias("places"))
    return found.groupBy("id", "text_key").agg(F.first("removed_words").alias("removed_words"), F.first("places").alias("places"))  # equal rows lose the same


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limits: Limits = Limits(), keep_text: bool = False, extra: tuple[str, ...] = ()) -> DataFrame:  # noqa: B008
    """One row per input row: the id, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``base_failed``, ``removed_words``, ``kept``; with ``keep_text`` also ``clean_text`` and ``row``; and the columns ``extra``.

    A null or empty text has no words and fails. A null host is a host of its own, together with the
    empty one. Rows of one id are one document, of which a line counts once; a row with a null id is no
    document when lines are counted, and loses the lines that are frequent without it. Of ties the smallest id
    keeps the line. Other columns are ignored, an empty table gives an empty one. Texts are taken
    whole. ``clean_text`` is the text without its frequent lines. ``row`` is different for each row.
    """
    stored = Stored(df.sparkSession)
    rows = text_of(df, id_col, text_col, host_col)
    hot = stored(frequent_lines(rows, limits))
    gone = stored(removals(rows, small(hot)))
    stored.drop(hot)
    rules = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    found = measured(text_of(df, id_col, text_col, host_col, *(F.col(c).alias(f"extra_{c}") for c in extra)), limits)
    # a row number made here keeps filters that use it above the rules, which would otherwise be computed twice
    found = found.select(F.monotonically_increasing_id().alias("row"), "id", "text_key", *rules, *(["lines"] if keep_text else []), *(f"extra_{c}" for c in extra))
    own = small(gone.select(F.col("id").alias("own_id"), F.col("text_key").alias("own_key"), "removed_words", "places"))
    found = found.join(own, F.col("id").eqNullSafe(F.col("own_id")) & (F.col("text_key") == F.col("own_key")), "left")
    removed = F.coalesce("removed_words", F.lit(0)).cast("bigint")
    kept = ~F.col("base_failed") & (removed <= limits.depleted_share * F.col("n_words"))
    left = F.when(F.col("places").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x, i: ~F.array_contains("places", i))) if keep_text else None
    text = [F.array_join(left, "\n").alias("clean_text"), F.col("row")] if keep_text else []
    return found.select(F.col("id").alias(id_col), *rules, removed.alias("removed_words"), kept.alias("kept"), *text, *(F.col(f"extra_{c}").alias(c) for c in extra))
