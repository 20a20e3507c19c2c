"""Sinks: tables in one or several formats, records, and a keyed store that is swapped, never overwritten in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.operators.joins import upsert
from seriesloom.session import checkpointed


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> str:
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)
    return path


def write_formats(df: DataFrame, path: str, formats: tuple[str, ...] = ("parquet", "csv")) -> dict[str, str]:
    """The same table in several formats below one folder."""
    return {f: write_table(df, f"{path}/{f}", f) for f in formats}


def to_records(df: DataFrame, name: str = "record") -> DataFrame:
    """Each row as one JSON object."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias(name))


def params_json(c: Column) -> Column:
    return F.to_json(c)


class KeyedStore:
    """A small-write table kept as numbered versions; readers see the newest finished one.

    An upsert reads version n and writes n+1, so a failed or lost job never harms what is read.
    One writer at a time is assumed.
    """

    def __init__(self, spark: SparkSession, base: str, key: str | list[str]):
        self.spark, self.base, self.key = spark, base.rstrip("/"), key

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.base)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def version(self) -> int:
        """Number of the newest version with a success marker, 0 when the store is empty."""
        fs, path = self._fs()
        if not fs.exists(path):
            return 0
        done = 0
        for entry in fs.listStatus(path):
            name = entry.getPath().getName()
            marker = self.spark._jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS")
            if name.startswith("version=") and fs.exists(marker):
                done = max(done, int(name.split("=")[1]))
        return done

    def read(self) -> DataFrame | None:
        v = self.version()
        return self.spark.read.parquet(f"{self.base}/version={v:06d}") if v else None

    def put(self, rows: DataFrame) -> int:
        """Replace rows with the same key, append the others, and publish a new version."""
        old = self.read()
        rows = checkpointed(rows)  # read by both the anti join and the union
        merged = rows if old is None else upsert(old, rows, self.key)
        v = self.version() + 1
        merged.write.mode("overwrite").parquet(f"{self.base}/version={v:06d}")
        return v


def save_model(coefs: DataFrame, path: str) -> str:
    """A model is its coefficient table: one row per series."""
    return write_table(coefs, path)


def load_model(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def report_lines(df: DataFrame, cells: list[Column], order: list[Column]) -> DataFrame:
    """One text line per row, already formatted, in report order."""
    from seriesloom.functions.text import table_row

    return df.orderBy(*order).select(table_row(*cells).alias("line"))
