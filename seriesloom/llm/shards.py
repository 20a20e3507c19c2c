"""Sharding by minimax contiguous partition, in DataFrame functions only.

Equal texts are atomic groups, ordered by the hash of their text. The shards are contiguous in that order; their capacity is the smallest for which
cutting greedily gives no more than the asked number of shards. It is found by binary search over exact prefix sums, and the cuts are made at it: a group above the even
share fills a shard of its own, and between such groups every cut is as near to an even share as the capacity allows, so that a group of a third of all bytes does not leave shards empty.

Rows are sorted once by (hash, id) over all partitions, so a group of any size is spread over tasks; running sums inside a partition plus the
partition's offset are the prefix sums. The search itself runs on a ladder: the first and last prefix sum of ``BINS`` ranges of bytes. Where a decision falls between
two of them, only those ranges are read again, cut into as many finer ones, until all decisions are exact. The driver holds ``BINS`` rows a reading.

NULL and empty texts are one group of size 1 a row. Repeated rows, equal and NULL ids are rows of their own; within a group, rows are ordered by id (NULL first). An empty table has no
shards. Other columns of any name are not read. With fewer groups than shards, the last shards stay empty.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm import common
from seriesloom.session import checkpointed

SHARDS = 16
BINS = 16_384


def identity(text: Column) -> Column:
    """128-bit hash that stands for a text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def in_order(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, size, text_crc32, group, part, rows_before, bytes_before, bytes_upto, ends): rows in the order of the groups with their running sums inside a partition.

    ``ends`` marks the last row of a group.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    slim = common.stored(
        docs.select(F.col(key).alias("id"), size_of(F.col(text)).alias("size"), F.crc32(body).alias("text_crc32"), identity(F.col(text)).alias("group")).withColumn(
            "row", F.monotonically_increasing_id()
        ),
        "sizes",
    )
    order = ["group", "id", "row"]
    done = checkpointed(slim.repartitionByRange(common.shuffle_count(docs.sparkSession), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part").orderBy(*order)
    upto = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = done.withColumns({"upto": upto, "before": F.row_number().over(inside).cast("long") - 1, "after": F.lead("group").over(inside)})
    parts = done.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.min("group").alias("first"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        "part", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes0"), F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows0"),
        F.lead("first").over(Window.orderBy("part")).alias("following"),
    )
    joined = rows.join(F.broadcast(offsets), "part")  # one row per shuffle partition
    return joined.select(
        "id", "size", "text_crc32", "group", (F.col("rows0") + F.col("before")).alias("rows_before"), (F.col("bytes0") + F.col("upto") - F.col("size")).alias("bytes_before"),
        (F.col("bytes0") + F.col("upto")).alias("bytes_upto"), (~F.coalesce(F.col("group") == F.coalesce("after", "following"), F.lit(False))).alias("ends"),
    )


@dataclass
class Ladder:
    """Known ends of groups as prefix sums, from 0 to the total; ``open[i]``: there may be more between points i and i + 1."""

    points: list[int]
    open: list[bool]
    asked: set[tuple[int, int]] = field(default_factory=set)

    def _gap(self, i: int) -> None:
        self.asked.add((self.points[i], self.points[i + 1]))

    def below(self, x: int) -> tuple[int, int]:
        """Bounds of the largest end of at most ``x``."""
        i = bisect_right(self.points, x) - 1
        if self.points[i] < x and self.open[i]:
            self._gap(i)
            return self.points[i], x
        return self.points[i], self.points[i]

    def above(self, x: int) -> tuple[int, int]:
        """Bounds of the smallest end of at least ``x``."""
        i = bisect_left(self.points, x)
        if self.points[i] > x and self.open[i - 1]:
            self._gap(i - 1)
            return x, self.points[i]
        return self.points[i], self.points[i]

    def reach(self, capacity: int, shards: int) -> tuple[int, int]:
        """Bounds of the bytes that ``shards`` greedy shards of this capacity hold."""
        low = high = 0
        total = self.points[-1]
        for _ in range(shards):
            low, high = self.below(min(total, low + capacity))[0], self.below(min(total, high + capacity))[1]
        return low, high

    def refined(self, found: dict[tuple[int, int], list[tuple[int, int, int]]]) -> Ladder:
        """With the ends found inside asked gaps: (first, last, number) of each finer range."""
        points, opened = [self.points[0]], []
        for i in range(len(self.open)):
            left, right = self.points[i], self.points[i + 1]
            if (left, right) in found:
                for first, last, number in found[left, right]:
                    points.append(first)
                    opened.append(False)
                    if last > first:
                        points.append(last)
                        opened.append(number > 2)
                opened.append(False)
            else:
                opened.append(self.open[i])
            points.append(right)
        return Ladder(points, opened)


def capacity_bounds(ladder: Ladder, shards: int) -> tuple[int, int]:
    """Largest capacity known to be too small and smallest known to do."""
    total = ladder.points[-1]
    low, high = total // shards - 1, total
    wrong, right = low, high
    while right - wrong > 1:  # smallest that surely does
        middle = (wrong + right) // 2
        wrong, right = (wrong, middle) if ladder.reach(middle, shards)[0] >= total else (middle, right)
    does, wrong, right = right, low, right
    while right - wrong > 1:  # largest that surely does not
        middle = (wrong + right) // 2
        wrong, right = (middle, right) if ladder.reach(middle, shards)[1] < total else (wrong, middle)
    return wrong, does


def large_groups(ladder: Ladder, shards: int) -> list[tuple[int, int]]:
    """(start, end) of the groups above an even share of the bytes in all smaller groups: each fills a shard of its own."""
    gaps = [(b - a, a, b) for a, b in zip(ladder.points, ladder.points[1:], strict=False)]
    total = ladder.points[-1]
    share, before = total // shards, -1
    while share != before:
        before = share
        for i, ((size, _, _), opened) in enumerate(zip(gaps, ladder.open, strict=True)):
            if opened and size > share:
                ladder._gap(i)
        large = [g for g, opened in zip(gaps, ladder.open, strict=True) if g[0] > share and not opened]
        rest = total - sum(size for size, _, _ in large)
        if len(large) < shards and rest:
            share = rest // (shards - len(large))
    return [(a, b) for _, a, b in large]


def even_cuts(ladder: Ladder, capacity: int, shards: int) -> list[int]:
    """Ends of all shards but the last: nearest to an even share of what lies before the next large group, none above ``capacity``, and no shard so short that the rest does not fit."""
    total = ladder.points[-1]
    large = large_groups(ladder, shards)
    least = [total]  # from the right: the earliest end that leaves a rest which fits
    for _ in range(shards - 1):
        least.append(ladder.above(max(0, least[-1] - capacity))[1])
    least.reverse()
    cuts, at = [], 0
    for k in range(shards - 1):
        ahead = [g for g in large if g[0] >= at]
        free = shards - k - len(ahead)
        small = total - at - sum(b - a for a, b in ahead)
        until = ahead[0][0] if ahead else total
        if until == at:
            until = ahead[0][1] if ahead else total
            pieces = 1
        else:
            pieces = max(1, (2 * (until - at) * free + small) // (2 * small)) if free > 0 else 1
        share = at + -(-(until - at) // pieces)
        low, high = ladder.below(share)[0], ladder.above(share)[1]
        best = high if high <= at + capacity and (low == at or high - share < share - low) else low
        at = max(best, least[k])
        cuts.append(at)
    return cuts


def _finer(ends: DataFrame, gaps: list[tuple[int, int]], bins: int) -> dict[tuple[int, int], list[tuple[int, int, int]]]:
    """First, last and number of ends in each of the ranges that every gap is cut into, ends of the gaps left out. Other ranges of the table are skipped by its statistics."""
    each = max(2, bins // len(gaps))
    wide = [(right - left) // each + 1 for left, right in gaps]
    inside = F.lit(False)
    place = F.lit(None).cast("long")
    for g in range(len(gaps) - 1, -1, -1):
        (left, right), width = gaps[g], wide[g]
        here = (F.col("upto") > left) & (F.col("upto") < right)
        inside = inside | here
        place = F.when(here, F.lit(g * (each + 1)) + F.floor((F.col("upto") - F.lit(left)) / F.lit(width))).otherwise(place)
    rows = ends.where(inside).groupBy(place.alias("place")).agg(F.min("upto").alias("a"), F.max("upto").alias("b"), F.count("*").alias("n")).collect()
    found: dict[tuple[int, int], list[tuple[int, int, int]]] = {gap: [] for gap in gaps}
    for r in sorted(rows, key=lambda r: r["a"]):
        found[gaps[r["place"] // (each + 1)]].append((r["a"], r["b"], r["n"]))
    return found


MOST_GAPS = 128


def minimax_cuts(ends: DataFrame, total: int, shards: int = SHARDS, bins: int = BINS) -> tuple[int, list[int]]:
    """(smallest feasible capacity, ends of all shards but the last) over the prefix sums ``upto`` of ordered groups."""
    ladder = Ladder([0, total], [True]).refined(_finer(ends, [(0, total)], bins))
    while True:
        wrong, does = capacity_bounds(ladder, shards)
        ladder.asked.clear()
        for capacity in {wrong + 1, (wrong + does) // 2, does} if does - wrong > 1 else ():
            ladder.reach(capacity, shards)
        cuts = even_cuts(ladder, does, shards)
        if not ladder.asked:
            return does, cuts
        ladder = ladder.refined(_finer(ends, sorted(ladder.asked)[:MOST_GAPS], bins))


@dataclass(frozen=True)
class Plan:
    """Capacity, the shards' ends in bytes, the rows before each shard, and the first group of each shard after the first non-empty one."""

    capacity: int
    cuts: list[int]
    firsts: list[bytes | None]


def shard_column(cuts: list[int], before: Column) -> Column:
    """Number of ends at or before a row's first byte."""
    return F.size(F.filter(F.array(*(F.lit(c).cast("long") for c in cuts)), lambda c: c <= before)).cast("int") if cuts else F.lit(0)


def assigned(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text", bins: int = BINS) -> tuple[DataFrame, Plan]:
    """(key, size, text_crc32, law, shard, slot, grown_shard) of every row, and the plan."""
    names = [F.col("id").alias(key), "size", "text_crc32", F.lit("bytes").alias("law")]
    rows = common.stored(in_order(docs, key, text), "ordered")
    total = rows.agg(F.sum("size")).first()[0]
    if not total:
        empty = rows.select(*names, F.lit(0).alias("shard"), F.col("rows_before").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
        return empty, Plan(0, [], [])
    ends = rows.where("ends").select(F.col("bytes_upto").alias("upto"))
    capacity, cuts = minimax_cuts(ends, total, shards, bins)
    placed = rows.withColumn("shard", shard_column(cuts, F.col("bytes_before")))
    starts = {r["shard"]: r for r in placed.groupBy("shard").agg(F.min("rows_before").alias("rows"), F.min("group").alias("group")).collect()}
    first = F.element_at(F.array(*(F.lit(starts[s]["rows"] if s in starts else 0).cast("long") for s in range(shards))), F.col("shard") + 1)
    out = placed.select(*names, "shard", (F.col("rows_before") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    return out, Plan(capacity, cuts, [bytes(starts[s]["group"]) if s in starts else None for s in range(shards)])


def with_shard(docs: DataFrame, plan: Plan, name: str = "shard", text: str = "text") -> DataFrame:
    """``docs`` with their shard, without a join or shuffle: a text's shard is the last one whose first group is not above it.

    A column called ``name`` is replaced.
    """
    firsts = [(s, g) for s, g in enumerate(plan.firsts) if g is not None]
    if not firsts:
        return docs.withColumn(name, F.lit(0))
    known = F.array(*(F.struct(F.lit(g).alias("g"), F.lit(s).alias("s")) for s, g in firsts))
    own = identity(F.col(text))
    return docs.withColumn(name, F.array_max(F.transform(F.filter(known, lambda x: x["g"] <= own), lambda x: x["s"])))


def write_shards(docs: DataFrame, plan: Plan, path: str, text: str = "text") -> None:
    """Files of ``docs`` below ``path``, one folder per shard (column ``shard``)."""
    with_shard(docs, plan, "shard", text).write.partitionBy("shard").parquet(path)


def summary(docs: DataFrame) -> DataFrame:
    return assigned(docs)[0]


#: Groups by hash, their prefix sums, binary search with a greedy check, ends from the right, then the even cuts.
SQL = """
WITH RECURSIVE d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, md5(coalesce(text, '')) AS g, coalesce(text, '') AS t FROM documents),
ends AS (SELECT list(upto ORDER BY upto) AS p, list({'a': upto - bytes, 'b': upto} ORDER BY upto) AS z, max(upto) AS total
  FROM (SELECT sum(size)::BIGINT AS bytes, sum(sum(size)) OVER (ORDER BY g)::BIGINT AS upto FROM d GROUP BY g)),
level AS (
  SELECT 0 AS i, total::BIGINT // 16 AS share FROM ends
  UNION ALL
  SELECT i + 1, CASE WHEN n < 16 AND rest > 0 THEN rest // (16 - n) ELSE share END FROM (
    SELECT i, share, len(l) AS n, (total - coalesce(list_sum(list_transform(l, lambda x: x.b - x.a)), 0))::BIGINT AS rest
    FROM (SELECT i, share, total, list_filter(z, lambda x: x.b - x.a > share) AS l FROM level, ends WHERE i < 20))
),
large AS (SELECT list_filter(z, lambda x: x.b - x.a > share) AS l FROM level, ends WHERE i = 20),
search AS (
  SELECT (total // 16 - 1)::BIGINT AS wrong, total::BIGINT AS does, (total // 16 - 1 + total)::BIGINT // 2 AS mid, 0 AS k, 0::BIGINT AS pos FROM ends
  UNION ALL
  SELECT CASE WHEN k = 16 AND pos < total THEN mid ELSE wrong END, CASE WHEN k = 16 AND pos >= total THEN mid ELSE does END,
    CASE WHEN k < 16 THEN mid WHEN pos >= total THEN (wrong + mid) // 2 ELSE (mid + does) // 2 END, CASE WHEN k < 16 THEN k + 1 ELSE 0 END,
    CASE WHEN k < 16 THEN coalesce(list_max(list_filter(p, lambda x: x <= pos + mid)), 0) ELSE 0 END
  FROM search, ends WHERE does - wrong > 1
),
cap AS (SELECT min(does) AS c FROM search),
back AS (
  SELECT 16 AS k, total::BIGINT AS e FROM ends
  UNION ALL SELECT k - 1, CASE WHEN e <= c THEN 0 ELSE list_min(list_filter(p, lambda x: x >= e - c)) END::BIGINT FROM back, ends, cap WHERE k > 1
),
cuts AS (
  SELECT 0 AS k, 0::BIGINT AS cut
  UNION ALL
  SELECT k + 1, greatest(e, CASE WHEN high <= cut + c AND (low = cut OR high - share < share - low) THEN high ELSE low END) FROM (
    SELECT v.k, cut, c, e, share, coalesce(list_max(list_filter(p, lambda x: x <= share)), 0)::BIGINT AS low, list_min(list_filter(p, lambda x: x >= share))::BIGINT AS high
    FROM (SELECT k, cut, p, cut + (until - cut + pieces - 1) // pieces AS share FROM (
        SELECT k, cut, p, CASE WHEN until = cut THEN edge ELSE until END AS until,
          CASE WHEN until = cut OR free <= 0 THEN 1 ELSE greatest(1, (2 * (until - cut) * free + small) // (2 * small)) END AS pieces
        FROM (SELECT k, cut, p, 16 - k - len(ahead) AS free, (total - cut - coalesce(list_sum(list_transform(ahead, lambda x: x.b - x.a)), 0))::BIGINT AS small,
            coalesce(ahead[1].a, total)::BIGINT AS until, coalesce(ahead[1].b, total)::BIGINT AS edge
          FROM (SELECT k, cut, p, total, list_filter(l, lambda x: x.a >= cut) AS ahead FROM cuts, ends, large WHERE k < 15) x) y) w) v, cap, back b WHERE b.k = v.k + 1)
),
placed AS (SELECT *, sum(size) OVER (ORDER BY g, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING)::BIGINT - size AS before FROM d),
counted AS (SELECT *, (SELECT count(*) FROM cuts WHERE k > 0 AND cut <= before)::INT AS shard FROM placed),
byte AS (
  SELECT list(v ORDER BY i) AS crc FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))
)
SELECT doc_id, size::BIGINT AS size, 'bytes' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY before) - 1)::BIGINT AS slot, CAST(NULL AS INT) AS grown_shard,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h: ('0x' || h)::BIGINT)),
    lambda c, n: xor(c >> 8, crc[(xor(c, n) & 255) + 1])), 4294967295::BIGINT) AS text_crc32
FROM counted, byte
"""
