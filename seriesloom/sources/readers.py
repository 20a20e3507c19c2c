"""Table readers. Schemas are declared, never inferred, so a read needs no extra pass over the files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from seriesloom.operators.shaping import apply_aliases, keep_available


def read_csv(spark: SparkSession, path: str, schema: str, date_format: str = "yyyy-MM-dd") -> DataFrame:
    """CSV with a header; a malformed row fails the read instead of turning into NULLs."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("dateFormat", date_format)
        .option("mode", "FAILFAST")
        .csv(path)
    )


def read_measure(spark: SparkSession, path: str, value_name: str, fmt: str = "csv") -> DataFrame:
    """A two-column (year, measure) table with the measure under a standard name, whatever its heading was."""
    if fmt == "csv":
        return read_csv(spark, path, f"year int, {value_name} double")
    return spark.read.format(fmt).load(path).toDF("year", value_name)


def read_optional(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame | None:
    """The table, or None when it does not exist, so that the caller can skip the feature."""
    reader = spark.read.schema(schema) if schema else spark.read
    try:
        return reader.format(fmt).load(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def first_available(candidates: list[tuple[DataFrame | None, dict[str, list[str]]]], columns: list[str]) -> DataFrame:
    """First source that is present and, after column aliases, has all the columns wanted."""
    for df, aliases in candidates:
        if df is None:
            continue
        shaped = apply_aliases(df, aliases)
        if set(columns) <= set(shaped.columns):
            return keep_available(shaped, columns)
    raise ValueError(f"no source provides the columns {columns}")


def table_or_pages(spark: SparkSession, csv_path: str | None, schema: str, from_pages: DataFrame | None) -> DataFrame:
    """The user's own export when a path is given, otherwise the table taken from pages."""
    if csv_path:
        return read_csv(spark, csv_path, schema)
    if from_pages is None:
        raise ValueError("neither a table export nor pages were given")
    return from_pages


def rows_to_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)
