"""Tables that every operator has to take."""

from pyspark.sql import DataFrame, SparkSession

COLUMNS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, id INT, chunk STRING, score STRING, n_bytes STRING, copy STRING, label STRING"
LONG = "the cat sat on a mat and then it ran " * 4000
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega "


def row(name, text, lang="en", source="s"):
    return (name, text, lang, source, None if text is None else len(text), 7, "x", "y", "z", "c", "l")


def documents(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame([row(*r) for r in rows], COLUMNS)


def odd(spark: SparkSession) -> DataFrame:
    """Nulls in every column, empty and very long texts, repeated rows and ids, ties, columns with clashing names."""
    rows = [(1, None), (2, ""), (3, "   \n\t "), (4, LONG), (5, WORDS * 3), (5, WORDS * 3), (6, "only four words here"), (7, WORDS * 3), (8, "é" * 700 + " 漢字 \U0001f600"), (None, WORDS * 3), (9, "x\0y<|endoftext|>z")]
    return documents(spark, rows).union(spark.createDataFrame([(10, None, None, None, None, None, None, None, None, None, None)], COLUMNS))


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], COLUMNS)


def sample(spark: SparkSession, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
