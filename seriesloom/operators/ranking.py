"""Ordering, top-k, de-duplication and rank operators that hold for any group size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.operators.joins import keep_best
from seriesloom.operators.keys import as_list
from seriesloom.session import checkpointed

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in its low 33 bits


def _offsets(rows: DataFrame, size: Column) -> DataFrame:
    """Total size of all earlier partitions, one row per shuffle partition.

    Partition numbers bound both the running window and the table that is broadcast.
    """
    sizes = rows.groupBy("_part").agg(size.alias("_size"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(sizes.select("_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before")))


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """1..n over the whole table without a single-task window.

    Rows are range-partitioned and sorted on the full order, and materialised. Partition sizes give
    each partition's offset, and the position inside the partition is the low part of the
    row id. ``order`` should end in a unique column.
    """
    done = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order))
    rows = done.withColumn("_id", F.monotonically_increasing_id()).withColumns(
        {"_part": F.shiftright("_id", _ROW_BITS), "_pos": F.col("_id").bitwiseAND((1 << _ROW_BITS) - 1)}
    )
    ranked = rows.join(_offsets(rows, F.count(F.lit(1))), "_part")
    return ranked.withColumn(name, F.col("_before") + F.col("_pos") + 1).drop("_id", "_part", "_pos", "_before")


def exact_median(df: DataFrame, value: str) -> DataFrame:
    """Exact median of a whole column of any size.

    Equal values collapse to one counted row before the shuffle, so a value held by a third of the rows is no
    hot spot. The counted values are range-partitioned, and running counts inside a partition
    plus the partition's offset locate the middle.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    done = checkpointed(counted.repartitionByRange(value).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.col("_before") + F.sum("_n").over(inside)
    rows = done.join(_offsets(done, F.sum("_n")), "_part").withColumn("_upto", upto)
    total = done.select(F.sum("_n").alias("v")).scalar()

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("_upto") >= place) & (F.col("_upto") - F.col("_n") < place), F.col(value)))

    return rows.agg(((at(F.floor((total + 1) / 2)) + at(F.ceil((total + 1) / 2))) / 2).alias("median"))


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """First k rows of an order; every task keeps only k rows."""
    return df.orderBy(*order).limit(k)


def top_k_per_group(df: DataFrame, group: str | list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """First k rows of each group. The rank limit is also applied before the shuffle, so a hot group arrives cut down."""
    w = Window.partitionBy(*as_list(group)).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def first_per_group(df: DataFrame, group: str | list[str], order: Column) -> DataFrame:
    """The whole first row of each group (never a mix of rows), by a map-side combined aggregate."""
    return keep_best(df, as_list(group), F.min_by, order)


def last_per_group(df: DataFrame, group: str | list[str], order: Column) -> DataFrame:
    return keep_best(df, as_list(group), F.max_by, order)


def dedupe_keep_last(df: DataFrame, key: str | list[str], priority: Column) -> DataFrame:
    return last_per_group(df, key, priority)


def distinct_sorted(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct().orderBy(*columns)
