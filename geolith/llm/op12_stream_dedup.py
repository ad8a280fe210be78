"""Exact dedup of a stream of files, with keyed state on disk that never expires.

Two streaming queries follow each other. The first reads new files and notes for each row a digest of its normalised
text, its id, its length and where it lies (file and row). The second keeps a state for each digest in a RocksDB store:
the number of its rows, and the row that stays with its id and place. Contents aren't kept: on hits, the texts at both
places are read again and compared in full. Rows whose digest is equal but whose text is not are state of their own.

Everything is built-in expressions. The state of a digest that many rows have is summed up before it is exchanged, and
its texts are compared with copies of the one that stays, some hundred to each.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geolith.llm.shared import Stored, shared_dir, small
from geolith.shipping import ship

#: Fixed value: what is deleted before texts are compared.
SPACES = r"[\x20\x09-\x0D]+"
#: Rows that are compared with one copy of the text that stays.
ROWS_A_COPY = 200
#: Bytes of new files that one batch of the stream takes.
BATCH_BYTES = 1 << 40
PLACE = ("file", "row")


def normal(text) -> F.Column:
    """The text that has to be equal, as bytes."""
    return F.encode(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, ""), "UTF-8")


def _session(spark: SparkSession) -> SparkSession:
    """A session with its own settings, so that the caller's stay as they are."""
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")  # else each partition's store takes megabytes before it has a row
    return own


def _folder(spark: SparkSession, path: str) -> str:
    """A folder that is there also if nothing is ever written to it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(hadoop)
    return path


def _ended(writer, folder: str) -> None:
    writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def noted(spark: SparkSession, path: str, folder: str, id_col: str, text_col: str, key_chars: int, batch_bytes: int) -> DataFrame:
    """What is known of each row of the files in ``path``, those that came since the last call included."""
    schema = spark.read.parquet(path).schema
    every = f"{path.rstrip('/')[:-1]}[{path.rstrip('/')[-1]}]"  # as a pattern, so that a path to one file is taken too
    source = _session(spark).readStream.schema(schema).option("maxBytesPerTrigger", batch_bytes).parquet(every)
    digest = F.sha2(normal(F.col(text_col)), 256)
    rows = source.select(F.col(id_col).alias("id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("n_chars"), digest.alias("sha"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    rows, out = rows.withColumn("key", F.substring("sha", 1, key_chars)), _folder(spark, f"{folder}/rows")
    _ended(rows.writeStream.format("parquet").option("path", out), folder)
    return spark.read.schema(rows.schema).parquet(out)


def states(spark: SparkSession, rows: str, schema: T.StructType, folder: str, files_a_batch: int) -> DataFrame:
    """The state of each key after all rows: ``keep``, the id and place of the row that stays, and ``n``."""
    source = _session(spark).readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(rows)
    # Most characters first, then the smallest id, null ids last; of repeated ids the first place.
    best = F.min(F.struct((-F.col("n_chars")).alias("shorter"), F.isnull("id").alias("no_id"), "id", *PLACE)).alias("keep")
    kept = source.groupBy("key").agg(best, F.count("*").alias("n"))

    def note(batch: DataFrame, number: int) -> None:
        batch.select("key", "keep", "n").write.mode("overwrite").parquet(f"{folder}/states/batch={number}")

    _ended(kept.writeStream.outputMode("update").foreachBatch(note), folder)
    made = T.StructType([T.StructField("key", T.StringType()), T.StructField("keep", kept.schema["keep"].dataType), T.StructField("n", T.LongType())])
    found = spark.read.schema(T.StructType([*made.fields, T.StructField("batch", T.LongType())])).parquet(_folder(spark, f"{folder}/states"))
    return found.groupBy("key").agg(F.max_by("keep", "batch").alias("keep"), F.max("n").alias("n"))


def unequal(spark: SparkSession, path: str, hits: DataFrame, text_col: str) -> DataFrame:
    """The rows among ``hits`` (file, row, key, stays, n) whose text is not byte for byte that of the row of their key that stays."""
    texts = spark.read.parquet(path).select(normal(F.col(text_col)).alias("bytes"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    copies = F.ceil(F.col("n") / ROWS_A_COPY).cast("int")
    own = F.pmod(F.xxhash64(*PLACE), copies).cast("int")
    found = texts.join(small(hits), list(PLACE)).withColumn("copy", F.explode(F.when(F.col("stays"), F.sequence(F.lit(0), copies - 1)).otherwise(F.array(own))))
    side = found.select("key", "copy", "bytes", "stays", *PLACE)
    left, right = side.where(~F.col("stays")), side.where("stays").select("key", "copy", F.col("bytes").alias("kept"))
    return left.join(right, ["key", "copy"]).where(F.col("bytes") != F.col("kept")).select(*PLACE)


def dedup_files(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, key_chars: int = 64, batch_bytes: int = BATCH_BYTES, files_a_batch: int = 100_000) -> DataFrame:
    """One row for each row of the Parquet files in ``path``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are without spaces and the control characters 9 to 13; null counts as empty, and empty texts
    are equal. Of equal texts the row with the most code points stays, then that of the smallest id, null ids last, then
    the first by file and row: repeated rows are different rows, one of which stays.

    ``folder`` is where the streams' checkpoints and state are; a later call with the same folder reads only files that are
    new in ``path`` and goes on with the state. Without it, a new folder in the shared one is taken. Keys are the first
    ``key_chars`` hexadecimal digits of the SHA-256; rows with equal keys and different texts are told apart by the texts.
    """
    ship(spark)
    folder, stored = folder or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}", Stored(spark)
    rows = noted(spark, path, f"{folder}/noted", id_col, text_col, key_chars, batch_bytes)
    place, told, out, turn = f"{folder}/noted/rows", f"{folder}/state", None, 0
    while True:
        known = states(spark, place, rows.schema, told, files_a_batch)
        groups = stored(known.where("n > 1").select("key", F.col("keep.id").alias("keep_id"), F.col("keep.file").alias("keep_file"), F.col("keep.row").alias("keep_row"), "n"))
        stays = (F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))
        hits = stored(rows.join(small(groups), "key").select(*PLACE, "key", stays.alias("stays"), "n"))
        wrong = stored(unequal(spark, path, hits, text_col))
        none = wrong.isEmpty()
        own = rows if none else rows.join(small(wrong), list(PLACE), "left_anti")
        if not none:  # fewer rows of their keys are equal
            fewer = rows.join(small(wrong), list(PLACE)).groupBy("key").agg(F.count("*").alias("less"))
            groups = stored(groups.join(fewer, "key", "left").withColumn("n", F.col("n") - F.coalesce("less", F.lit(0))).drop("less"))
        settled = own.join(small(groups), "key", "left").select(
            F.col("id").alias(id_col), F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).alias("group_size"), F.coalesce(stays, F.lit(True)).alias("kept"), F.col("sha").alias("text_sha256"))
        out = settled if out is None else out.union(settled)
        if none:
            return out
        turn += 1
        place, told = f"{folder}/more-{uuid.uuid4().hex}", f"{folder}/state-{uuid.uuid4().hex}"
        rows.join(small(wrong), list(PLACE), "left_semi").write.parquet(place)
        rows = spark.read.schema(rows.schema).parquet(place)
