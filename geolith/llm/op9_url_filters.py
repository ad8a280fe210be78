"""URL filters: host rules first, then word segmentation by unigram Viterbi and multinomial naive Bayes.

Host labels and path segments are split into names at punctuation and digits, and a name that runs words
together is split by the most probable sequence of dictionary words. The dictionary is counted over the names
of all URLs. Each distinct name is segmented once, with those dictionary words that it contains, which a join
brings to it; so neither names nor words have to fit one process. Naive Bayes learns from all URLs that a rule
decides, whose verdict is their label, or from a table of labelled URLs, and every word of them counts. What a rule
itself looks at, its host and the start of the path, says nothing about other URLs and is no evidence.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geolith.llm.batches import map_batches
from geolith.llm.shared import Stored, small

#: The default rules (verdict, host, path prefix), in the order given.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: What each letter of an unknown run costs beside the run itself, in log probability.
LETTER = 4.0
#: Letters of names up to which a table of them may be broadcast.
LIGHT_LETTERS = 8 << 20


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path: both empty for a null URL or one without ``://``."""
    after = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1))
    rest = F.when(after.isNotNull(), F.substring(url, F.length(after) + 4, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"(?s)^[^?#]*", 0)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits the host or a parent of it and the start of the path, or null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, own, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(start)
        name, verdict = F.when(fits, F.lit(own + start)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def beyond_rule(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """Host and path without the host and the start of the path that the longest fitting rule looks at; whole where none fits."""
    left, rest = host, path
    for _, own, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(start)
        left = F.when(fits, F.substring(host, F.lit(1), F.length(host) - len(own))).otherwise(left)
        after = F.substring(path, F.lit(len(start) + 1), F.length(path))
        rest = F.when(fits, F.regexp_replace(after, "(?i)^[a-z]+", "") if start[-1:].isalpha() else after).otherwise(rest)
    return left, rest


def names_of(host: Column, path: Column) -> Column:
    """The names of a URL in order: runs of the letters a to z, in lower case, of its host and path."""
    return F.filter(F.split(F.lower(F.concat_ws("/", host, path)), "[^a-z]+"), lambda x: x != "")


def segment(name: str, words: dict[str, float], unknown: float) -> list[str]:
    """The most probable words, given log probabilities; an unknown run costs by its length, so it stays whole where nothing fits. Ties go to the longer last word."""
    best, back = [0.0] + [-math.inf] * len(name), [0] * (len(name) + 1)
    lengths = sorted({len(w) for w in words})
    free, free_from = -math.inf, 0  # the best start of an unknown run, whatever its length
    for end in range(1, len(name) + 1):
        if best[end - 1] + LETTER * (end - 1) > free:
            free, free_from = best[end - 1] + LETTER * (end - 1), end - 1
        best[end], back[end] = free + unknown - LETTER * end, free_from
        for size in lengths:
            if size > end:
                break
            start = end - size
            value = best[start] + words.get(name[start:end], -math.inf)
            if value > best[end] or value == best[end] and start < back[end]:
                best[end], back[end] = value, start
    out, end = [], len(name)
    while end:
        out.append(name[back[end] : end])
        end = back[end]
    return out[::-1]


def compound(word: str, counts: dict[str, int], least: int = 3) -> bool:
    """Whether a word is two or more others of ``least`` letters that are at least as frequent."""
    whole, n, ends = counts.get(word, 0), len(word), {0}
    for end in range(least, n + 1):
        for start in [s for s in ends if end - s >= least and end - s < n]:
            if counts.get(word[start:end], 0) >= whole:
                ends.add(end)
                break
    return n in ends


def name_counts(*urls: DataFrame) -> DataFrame:
    """How often each name occurs, over tables with a column ``names``, and its number."""
    rows = [df.select(F.explode("names").alias("name")) for df in urls]
    out = rows[0]
    for df in rows[1:]:
        out = out.union(df)
    return out.groupBy("name").agg(F.count("*").alias("n")).withColumn("number", F.monotonically_increasing_id())


def with_words(names: DataFrame, words: DataFrame, longest: int, piece: int = 256) -> DataFrame:
    """Each name and, as ``known``, the words (``name``, ``n``) of up to ``longest`` letters that it contains.

    Names go in overlapping pieces, so that a long one costs by its length; ``names`` is a stored table.
    """
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length("name") - 1) / piece)), lambda k: F.substring("name", k.cast("int") * piece + 1, F.lit(piece + longest - 1)))
    cut = names.where(F.length("name") > 1).select("number", F.explode(pieces).alias("piece")).where(F.length("piece") > 1)
    inside = F.expr(f"array_distinct(flatten(transform(sequence(1, least({piece}, length(piece) - 1)), i -> transform(sequence(2, least({longest}, length(piece) - i + 1)), k -> substring(piece, i, k)))))")
    parts = cut.select("number", F.explode(inside).alias("part"))
    found = parts.join(words.select(F.col("name").alias("part"), "n"), "part").groupBy("number").agg(F.collect_set(F.struct("part", "n")).alias("known"))
    return names.select("number", "name").join(found, "number", "left").select("name", "known")


def light(df: DataFrame) -> DataFrame:
    """A stored table of names, marked for broadcast if it has few of them and few letters."""
    return small(df) if (df.agg(F.sum(F.length("name"))).first()[0] or 0) <= LIGHT_LETTERS else df


def per_name(rows: DataFrame, function, kind: T.DataType, arrow: pa.DataType) -> DataFrame:
    """``name`` and ``value``: the function of each name and the counts of its words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [function(name, {k["part"]: k["n"] for k in known or ()}) for name, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, arrow)], names=["name", "value"])

    return map_batches(rows, work, [T.StructField("name", T.StringType()), T.StructField("value", kind)])


def segmented(names: DataFrame, stored: Stored, longest: int) -> DataFrame:
    """``name`` and its ``words``, for each of the counted names.

    Words are the names of 2 to ``longest`` letters that are not made of others at least as frequent.
    """
    short = names.where(F.length("name").between(2, longest))
    made = per_name(with_words(short, small(short), longest), compound, T.BooleanType(), pa.bool_())
    words = stored(short.join(stored(made.where("value").select("name")), "name", "left_anti"))
    total = words.agg(F.sum("n")).first()[0] or 1

    def split(name: str, known: dict[str, int]) -> list[str]:
        return segment(name, {w: math.log(n / total) for w, n in known.items()}, math.log(1 / (total + 1)))

    return per_name(with_words(names, small(words), longest), split, T.ArrayType(T.StringType()), pa.list_(pa.string())).withColumnRenamed("value", "words")


def word_odds(labelled: DataFrame, segments: DataFrame, stored: Stored, prior: float) -> tuple[DataFrame, float]:
    """``word`` and its ``odds``, by multinomial naive Bayes with one added to each count; and the log odds of blocked URLs.

    ``labelled`` has ``names`` and ``y``, 1 for blocked and 0 for allowed. Without both labels all odds are 0 and
    the log odds those of ``prior``.
    """
    n, bad = labelled.agg(F.count("*"), F.sum("y")).first()
    if not n or not bad or bad == n:
        return labelled.sparkSession.createDataFrame([], "word STRING, odds DOUBLE"), math.log(prior / (1 - prior))
    tokens = labelled.select("y", F.explode("names").alias("name")).groupBy("name").agg(F.sum("y").alias("bad"), F.count("*").alias("n"))
    tokens = tokens.join(segments, "name").select(F.explode("words").alias("word"), "bad", "n").groupBy("word").agg(F.sum("bad").alias("bad"), (F.sum("n") - F.sum("bad")).alias("good"))
    tokens = stored(tokens)
    p, q, v = (x or 0 for x in tokens.agg(F.sum("bad"), F.sum("good"), F.count("*")).first())
    odds = F.log((F.col("bad") + 1) / F.lit(float(p + v))) - F.log((F.col("good") + 1) / F.lit(float(q + v)))
    return tokens.select("word", odds.alias("odds")), math.log((bad + 1) / (n - bad + 1))


def filter_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple = RULES, labelled: DataFrame | None = None, longest: int = 24, prior: float = 0.4) -> DataFrame:
    """One row per input row: the id, ``host``, ``path``, ``rule``, ``verdict``, ``score``, ``words``.

    A null URL and one without ``://`` have an empty host and path, fit no rule, and get the score of no
    words. The longest rule wins. Repeated rows and ids give repeated rows, a null id stays null, other
    columns are ignored, an empty table gives an empty one. ``score`` is the method's chance that the URL is to be
    blocked, whatever rule fits, and 0.5 or more blocks; words of no labelled URL count for neither side.
    ``labelled`` has a ``url`` and whether it is ``blocked``; rows without either don't count. Without it the URLs
    that a rule decides are the labels, by what the rule doesn't look at. A dictionary word has ``longest`` letters at most; names of any length
    are split.
    """
    stored = Stored(df.sparkSession)
    host, path = url_parts(F.col(url_col))
    rows = df.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("id", "host", "path", name.alias("rule"), verdict.alias("verdict"), names_of(F.col("host"), F.col("path")).alias("names"))
    if labelled is None:
        known = rows.where("verdict is not null").select(names_of(*beyond_rule(F.col("host"), F.col("path"), rules)).alias("names"), (F.col("verdict") == "block").cast("bigint").alias("y"))
    else:
        own, rest = url_parts(F.col("url"))
        known = labelled.where("url is not null and blocked is not null").select(names_of(own, rest).alias("names"), F.col("blocked").cast("int").cast("bigint").alias("y")).where("y in (0, 1)")
    names = stored(name_counts(rows, *([known] if labelled is not None else [])))
    segments = stored(segmented(names, stored, longest).withColumn("number", F.monotonically_increasing_id()))
    odds, base = word_odds(known, light(segments), stored, prior)
    sums = segments.select("number", F.explode("words").alias("word")).join(small(odds), "word", "left").groupBy("number").agg(F.sum(F.coalesce("odds", F.lit(0.0))).alias("odds"))
    scored = stored(segments.join(small(stored(sums)), "number", "left").select("name", "words", F.coalesce("odds", F.lit(0.0)).alias("odds")))
    stored.drop(names, segments)
    tokens = rows.withColumn("row", F.monotonically_increasing_id()).select("*", F.posexplode_outer("names").alias("at", "name")).drop("names")
    tokens = tokens.join(light(scored), "name", "left")
    found = tokens.groupBy("row").agg(*(F.first(c).alias(c) for c in ("id", "host", "path", "rule", "verdict")), F.sort_array(F.collect_list(F.when(F.col("words").isNotNull(), F.struct("at", "words", "odds")))).alias("all"))
    total = F.aggregate("all", F.lit(float(base)), lambda a, x: a + x["odds"])  # in the order of the names, so that equal URLs have equal scores
    score = 1 / (1 + F.exp(-F.least(F.lit(50.0), F.greatest(F.lit(-50.0), total))))
    verdict = F.coalesce("verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    found = found.withColumn("score", score)
    return found.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "score", F.flatten(F.transform("all", lambda x: x["words"])).alias("words"))
