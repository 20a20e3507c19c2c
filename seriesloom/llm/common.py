"""Helpers shared by the operators: reading, written intermediate tables, fixed splits, Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.session import scratch_path

_ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below the shared folder and read back.

    It cuts the lineage, survives lost executors, keeps column pruning, and gives Spark the size for its joins.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as make it different from all columns of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        found.append(name)
    return found


def shuffle_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


BATCH_ROWS = 1000


def short_batches(spark: SparkSession) -> None:
    """Let Spark hand texts to Python in batches of at most ``BATCH_ROWS`` rows: its usual 10,000 texts are a few hundred MB at both ends of the pipe."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def give_back() -> None:
    """Return free memory to the system: Python workers live on between tasks, and the idle ones' peaks would add up in an executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into short ones, so that Python copies of long texts stay few at a time; at the end free memory is given back."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    give_back()


def ascii_lower(text: str) -> str:
    return text.translate(_ASCII_LOWER)


def ascii_lower_col(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``: the fixed split into learned and held-out rows; NULL ids are held out of learning."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(parts)


def held_out(doc_id: Column, parts: int, rest: int) -> Column:
    return F.coalesce(remainder(doc_id, parts) == F.lit(rest), F.lit(False))


_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalised 64-bit hashes: every input bit reaches every output bit."""
    h = h ^ (h >> _S)
    h = h * _M1
    h = h ^ (h >> _S)
    h = h * _M2
    return h ^ (h >> _S)


def labelled(docs: DataFrame, labels: DataFrame, mark: str, parts: int, rest: int, most: int) -> DataFrame:
    """At most ``most`` labelled (text, y) rows outside the held-out part, chosen by a hash of the id.

    A document's rows join labels of the same id; labels that are NULL or not 0/1 are left out, as are rows with a NULL id.
    """
    marks = labels.select(F.col("doc_id").alias("_id"), F.col(mark).cast("int").alias("y")).where(F.col("y").isin(0, 1) & (remainder(F.col("doc_id"), parts) != rest))
    marks = marks.groupBy("_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("_id"), "_id").limit(most)
    texts = docs.select(F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(marks), "_id").select("_id", "text", "y")  # at most ``most`` rows of two numbers
