"""Join shapes that are not a plain equi-join call: chains, as-of lookups, fallbacks, upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.operators.keys import as_list, series_window
from seriesloom.session import checkpointed


def join_chain(first: DataFrame, others: list[DataFrame], on: str | list[str], how: str) -> DataFrame:
    """Left or full outer chain on shared key columns; the full form keeps one coalesced key."""
    return reduce(lambda a, b: a.join(b, as_list(on), how), others, first)


def _micros(c: Column, kind: T.DataType) -> Column:
    """Time as whole microseconds (dates: at midnight), so that times of any precision compare and subtract as numbers."""
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long") * F.lit(_DAY)
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)
    return F.unix_micros(c) if isinstance(kind, T.TimestampType) else c.cast("long")


_DAY = 86_400_000_000


def _intervals(data: DataFrame, key: list[str], ts: str, values: list[str], nearest: bool, else_first: bool) -> DataFrame:
    """Every data row with the span of times [from, until) that it answers; the first and last spans are open to that side (NULL).

    Several rows of one time count as one, the one with the largest values.
    """
    kept = data.where(F.col(ts).isNotNull()).groupBy(*key, ts).agg(F.max(F.struct(*values)).alias("_row"))
    w = series_window(key, "_at")
    rows = kept.withColumn("_at", _micros(F.col(ts), data.schema[ts].dataType)).withColumns({"_before": F.lag("_at").over(w), "_after": F.lead("_at").over(w)})
    if nearest:  # up to the middle between two rows, which belongs to the earlier one
        start = F.floor((F.col("_before") + F.col("_at")) / 2) + 1
        until = F.floor((F.col("_at") + F.col("_after")) / 2) + 1
    else:
        start = F.when(F.col("_before").isNotNull() | F.lit(not else_first), F.col("_at"))
        until = F.col("_after")
    return rows.select(*key, F.col(ts).alias("matched_ts"), "_row", start.cast("long").alias("_from"), until.cast("long").alias("_until"))


def _asof(points: DataFrame, data: DataFrame, key: list[str], ts: str, values: list[str], nearest: bool, else_first: bool) -> DataFrame:
    """Requests joined to the spans of their series: equality on (series, time bucket), then the test of the range.

    A span is exploded over the buckets that it touches. There are as many buckets as an average series has rows, so the spans make at most one row per data row and one per bucket and
    series, whatever the precision or length of the time axis; requests outside the data go to the nearest bucket. Nothing is made per day, and requests are read once.
    """
    if type(points.schema[ts].dataType) is not type(data.schema[ts].dataType):  # dates against timestamps: both as timestamps of the session's zone
        matched = _asof(points.withColumn(ts, F.col(ts).cast("timestamp")), data.withColumn(ts, F.col(ts).cast("timestamp")), key, ts, values, nearest, else_first)
        return matched.withColumn(ts, F.col(ts).cast(points.schema[ts].dataType))
    spans = checkpointed(_intervals(data, key, ts, values, nearest, else_first))
    place = _micros(F.col("matched_ts"), data.schema[ts].dataType)
    range_ = spans.agg(F.min(place).alias("low"), F.max(place).alias("high"), F.count("*").alias("n"), F.count(F.when(F.col("_until").isNull(), 1)).alias("series")).first()
    picked = [F.col("matched_ts"), *(F.col(f"_row.{v}").alias(v) for v in values)]
    low, high = range_["low"] or 0, range_["high"] or 0
    count = max(1, -(-range_["n"] // max(1, range_["series"])))
    width = max(1, -(-(high - low + 1) // count))

    def bucket(t: Column) -> Column:
        return F.floor((F.least(F.greatest(t, F.lit(low)), F.lit(high)) - F.lit(low)) / F.lit(width)).cast("long")

    first = bucket(F.coalesce("_from", F.lit(low)))
    last = bucket(F.coalesce(F.col("_until") - 1, F.lit(high)))
    right = spans.withColumn("_bucket", F.explode(F.sequence(first, F.greatest(first, last)))).select(*key, "_bucket", "_from", "_until", *(c.alias(f"_hit_{i}") for i, c in enumerate(picked)))
    asked = _micros(F.col(ts), points.schema[ts].dataType)
    left = points.withColumn("_t", asked).withColumn("_bucket", bucket(F.col("_t")))
    inside = (F.coalesce(F.col("l._t") >= F.col("r._from"), F.col("r._from").isNull())) & (F.coalesce(F.col("l._t") < F.col("r._until"), F.col("r._until").isNull())) & F.col("l._t").isNotNull()
    same = F.col("l._bucket") == F.col("r._bucket")
    for k in key:
        same = same & (F.col(f"l.`{k}`") == F.col(f"r.`{k}`"))
    joined = left.alias("l").join(right.alias("r"), same & inside, "left")
    names = ["matched_ts", *values]
    return joined.select(*(F.col(f"l.`{c}`") for c in points.columns), *(F.col(f"r._hit_{i}").alias(n) for i, n in enumerate(names)))


def asof_backward(
    points: DataFrame, data: DataFrame, key: str | list[str], ts: str, values: list[str], else_first: bool = True
) -> DataFrame:
    """Last data row at or before each requested time; with ``else_first`` the earliest row when there is none. A NULL time has no match."""
    return _asof(points, data, as_list(key), ts, values, False, else_first)


def asof_nearest(points: DataFrame, data: DataFrame, key: str | list[str], ts: str, values: list[str]) -> DataFrame:
    """Data row closest in time to each request; the earlier row wins at equal distance. A NULL time has no match."""
    return _asof(points, data, as_list(key), ts, values, True, True)


def upsert(store: DataFrame, rows: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows of ``store`` whose key is replaced give way to ``rows``; other keys are appended."""
    kept = store.join(rows.select(*as_list(key)), as_list(key), "left_anti")
    return kept.unionByName(rows, allowMissingColumns=True)


def latest_source_wins(sources: list[DataFrame], key: str | list[str]) -> DataFrame:
    """Union in which the later source replaces the earlier one on equal keys.

    ``max_by`` keeps one row per key inside the map-side aggregate, so duplicates of a hot key
    are dropped before the shuffle.
    """
    key = as_list(key)
    tagged = [df.withColumn("_prio", F.lit(i)) for i, df in enumerate(sources)]
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return keep_best(merged, key, F.max_by, F.col("_prio")).drop("_prio")


_FIXED_WIDTH = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def keep_best(df: DataFrame, key: list[str], pick, order: Column) -> DataFrame:
    """One whole row per key, chosen by ``max_by``/``min_by`` on ``order``.

    Where all columns and the order have a fixed width, every column is picked by itself: such an aggregate hashes, one over structs sorts its rows. All columns follow the same
    comparisons, so the row is whole also at a tie.
    """
    rest = [c for c in df.columns if c not in key]
    kinds = [df.schema[c].dataType for c in rest] + [df.select(order.alias("o")).schema["o"].dataType]
    if rest and all(isinstance(k, _FIXED_WIDTH) for k in kinds):
        return df.groupBy(*key).agg(*(pick(c, order).alias(c) for c in rest)).select(*key, *rest)
    return df.groupBy(*key).agg(pick(F.struct(*rest), order).alias("_r")).select(*key, "_r.*")


def unpivot(df: DataFrame, ids: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(ids, columns, name, value)
