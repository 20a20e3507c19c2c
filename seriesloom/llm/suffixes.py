"""Removal of repeated byte strings by a partitioned sort of suffixes.

Every byte covered by a string of ``length`` bytes that also starts anywhere else, in the same text or another, is removed; strings never cross texts.

Suffixes are sorted not at every byte but at anchors that any two equal strings share: of a string's 32-byte tokens the one with the smallest hash, the leftmost of
equals. All strings with one anchor are read from one stretch of text around it, its context. Anchors are dealt by their leading
token; a stretch that occurs twice there covers all its strings. What differs is fetched as bytes, range-partitioned by leading token with sampled
splitters, and each bucket sorts the strings by multikey quicksort (token, offset, hashes of the two halves); equal neighbours repeat. The strings of a
token with very many different contexts do not meet in one task: they are counted map-side by the same four values, and the counts are joined back.

Texts are known by a 64-bit hash; NULL and empty texts have no bytes, texts shorter than ``length`` lose none. Repeated rows repeat each other in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.llm import common

LENGTH = 200
TOKEN = 32
SEGMENT = 1 << 20
MOST_CONTEXTS = 50_000  # different contexts of one token that are sorted in one task
HOT_COPIES = 10_000  # strings with more copies are joined by broadcast: fewer than 1 in so many
CHUNK_WINDOWS = 250_000
CROWD_PART = 16  # one in so many anchors is looked at for crowded tokens
MOST_CROWDED = 10_000
LEAST_CROWD = 50

_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = common.mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    found = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        row = np.ones(size, np.uint64)
        row[1:] = np.uint64(base)
        found.append(np.multiply.accumulate(row))
    return found[0], found[1]


class Rolling:
    """Hashes of all substrings of a buffer."""

    def __init__(self, data: np.ndarray):
        size = 1 << max(17, int(len(data)).bit_length())
        self.up, down = _powers(size)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * down[: len(data)], out=self.sums[1:])

    def at(self, start: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        return common.mixed((self.sums[start + length] - self.sums[start]) * self.up[start])

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return common.mixed((self.sums[length:] - self.sums[:n]) * self.up[:n])


def least_positions(values: np.ndarray, width: int) -> np.ndarray:
    """Leftmost position of the least value in every window of ``width``, from running minima inside blocks."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    table = padded.reshape(blocks, width)
    index = np.arange(blocks * width, dtype=np.int64).reshape(blocks, width)
    ahead = np.minimum.accumulate(table, axis=1)
    fresh = np.ones_like(table, bool)
    fresh[:, 1:] = table[:, 1:] < ahead[:, :-1]
    ahead_at = np.maximum.accumulate(np.where(fresh, index, 0), axis=1).ravel()
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1]
    fresh[:, -1] = True
    fresh[:, :-1] = table[:, :-1] <= back[:, 1:]
    back_at = np.minimum.accumulate(np.where(fresh, index, blocks * width)[:, ::-1], axis=1)[:, ::-1].ravel()
    left, right = np.arange(n - width + 1), np.arange(width - 1, n)
    return np.where(back.ravel()[left] <= ahead.ravel()[right], back_at[left], ahead_at[right])


def anchors(data: np.ndarray, length: int = LENGTH, token: int = TOKEN):
    """(first string, strings, anchor, token hash, context hash) of every anchor; all strings of ``length`` are covered once.

    Long texts are read in segments; an anchor at a seam may serve two runs of strings.
    """
    found: list[tuple[np.ndarray, ...]] = []
    strings = len(data) - length + 1
    for at in range(0, max(0, strings), SEGMENT):
        part = data[at : min(len(data), at + SEGMENT + length - 1)]
        rolling = Rolling(part)
        tokens = rolling.all(token)
        chosen = least_positions(tokens, length - token + 1)
        first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
        count = np.diff(np.append(first, len(chosen)))
        anchor = chosen[first]
        context = common.mixed(rolling.at(first, count - 1 + length) + ((anchor - first) * 65536 + count).astype(np.uint64) * np.uint64(_BASE))
        found.append((first + at, count, anchor + at, tokens[anchor], context))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _merged(starts: list[int], stops: list[int]) -> list[tuple[int, int]]:
    runs: list[tuple[int, int]] = []
    for start, stop in sorted(zip(starts, stops, strict=True)):
        if runs and start <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(stop, runs[-1][1]))
        else:
            runs.append((start, stop))
    return runs


def _bytes(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.uint8) if value.is_valid else np.zeros(0, np.uint8)


def _large(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(name).cast(pa.large_binary())


FOUND = "text_key long, token long, context long, first long, strings short, back short, inside boolean, stop long"


def found_anchors(texts: DataFrame, length: int) -> DataFrame:
    """Anchors of (text_key, text) rows, one for each different context of a text; ``inside``: the text holds that context twice.

    What such contexts cover is known without any other text and comes as rows of its own: no token, but ``first`` and ``stop``.
    """

    def of_text(key: int, data: np.ndarray) -> list[np.ndarray]:
        first, count, anchor, token, context = anchors(data, length)
        _, one, times = np.unique(context, return_index=True, return_counts=True)
        order = np.argsort(context, kind="stable")
        again = np.zeros(len(first), bool)
        again[order] = np.repeat(times, times) > 1
        spans = _merged(first[again].tolist(), (first[again] + count[again] - 1 + length).tolist())
        n, m = len(one), len(spans)
        starts, stops = np.array([x for x, _ in spans], np.int64), np.array([y for _, y in spans], np.int64)
        zero = np.zeros(m, np.int64)
        return [
            np.full(n + m, key, np.int64), np.concatenate([token[one].view(np.int64), zero]), np.concatenate([context[one].view(np.int64), zero]), np.concatenate([first[one], starts]),
            np.concatenate([count[one], zero]).astype(np.int16), np.concatenate([(anchor - first)[one], zero]).astype(np.int16), np.concatenate([times > 1, zero > 0]), np.concatenate([np.full(n, -1), stops]),
        ]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches):
            columns = [of_text(key, _bytes(value)) for key, value in zip(batch.column("text_key").to_pylist(), _large(batch, "text"), strict=True)]
            joined = [np.concatenate(c) for c in zip(*columns, strict=True)]
            if joined:
                yield pa.record_batch([*map(pa.array, joined[:7]), pa.array(joined[7], mask=joined[7] < 0)], names=["text_key", "token", "context", "first", "strings", "back", "inside", "stop"])

    common.short_batches(texts.sparkSession)
    return texts.mapInArrow(cut, FOUND)


def crowded_tokens(found: DataFrame, part: int = CROWD_PART, most: int = MOST_CROWDED) -> DataFrame:
    """Tokens that hold more than 1 in ``most`` of a sample of anchors; fewer than ``most`` by that rule. Every copy of a text is drawn for itself."""
    sample = found.sample(1 / part, seed=7)
    total = sample.count()
    return found.sparkSession.createDataFrame(
        sample.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > max(LEAST_CROWD, total // most)).select("token").collect(), "token long"
    )


def meeting_anchors(found: DataFrame) -> DataFrame:
    """Anchors of a written table whose token occurs again, with ``copies`` of their context, ``contexts`` of their token, and ``lead`` for one row of each context.

    Most tokens have a few anchors, and one shuffle by token brings these together. The anchors of crowded tokens are counted map-side,
    first the copies of a text, which become one row, then by context and by token, and the counts are joined back.
    """
    crowded = F.broadcast(crowded_tokens(found))
    dealt = found.join(crowded, "token", "left_anti").repartition(common.shuffle_count(found.sparkSession), "token")
    alike = Window.partitionBy("token", "context")
    numbered = dealt.withColumn("lead", F.row_number().over(alike.orderBy("text_key", "first")) == 1).withColumn("copies", F.count("*").over(alike) + F.max(F.col("inside").cast("long")).over(alike))
    together = Window.partitionBy("token")
    counted = numbered.withColumn("contexts", F.sum(F.col("lead").cast("long")).over(together)).withColumn("_all", F.count("*").over(together))
    few = counted.where("_all > 1").drop("_all")
    same = [F.first(c).alias(c) for c in ("first", "strings", "back")]
    many = found.join(crowded, "token", "left_semi").groupBy("text_key", "token", "context").agg(*same, F.max("inside").alias("inside"), F.count("*").alias("_rows"))
    many = common.stored(many, "crowds")
    twice = F.sum("_rows") + F.max(F.col("inside").cast("long"))
    contexts = common.stored(many.groupBy("token", "context").agg(twice.alias("copies"), F.min(F.struct("text_key", "first")).alias("_lead")), "contexts_of_crowds")
    tokens = contexts.groupBy("token").agg(F.count("*").alias("contexts"), F.sum("copies").alias("_all")).where("_all > 1").drop("_all")
    back = many.drop("_rows").join(contexts.join(tokens, "token"), ["token", "context"])
    lead = (F.col("text_key") == F.col("_lead.text_key")) & (F.col("first") == F.col("_lead.first"))
    return few.unionByName(back.withColumn("lead", lead).drop("_lead"))


def _asked(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(text_key, text, asked) of the texts that hold wanted anchors."""
    asked = wanted.groupBy("text_key").agg(F.collect_list(F.struct("token", "first", "strings", "back", (F.col("copies") > 1).alias("whole"))).alias("asked"))
    return texts.join(asked, "text_key").select("text_key", "text", "asked")


def _context_rows(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Bytes around the wanted anchors."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, 128):
            rows: list[tuple] = []
            for key, value, asked_here in zip(batch.column("text_key").to_pylist(), _large(batch, "text"), batch.column("asked").to_pylist(), strict=True):
                data = value.as_py()
                for x in asked_here:
                    rows.append((x["token"], key, x["first"], x["strings"], -x["back"], x["whole"], data[x["first"] : x["first"] + x["strings"] - 1 + length]))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["token", "text_key", "start", "strings", "offset", "whole", "bytes"])

    return _asked(texts, wanted).mapInArrow(cut, "token long, text_key long, start long, strings int, offset int, whole boolean, bytes binary")


def _string_rows(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Every string at the wanted anchors: token, offset from the anchor, and the hashes of its halves."""
    half = length // 2
    names = ["token", "offset", "high", "low", "text_key", "start", "whole"]

    def hashed(held: list[tuple]) -> pa.RecordBatch:
        token, key, first, count, offset, whole, data = ([x[i] for x in held] for i in range(7))
        size = np.array(count) - 1 + length
        row = np.repeat(np.arange(len(held)), count)
        within = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        at = np.repeat(np.cumsum(size) - size, count) + within
        rolling = Rolling(np.frombuffer(b"".join(data), np.uint8))
        columns = [np.array(token, np.int64)[row], (np.array(offset)[row] + within).astype(np.int32), rolling.at(at, half).view(np.int64), rolling.at(at + half, length - half).view(np.int64)]
        columns += [np.array(key, np.int64)[row], np.array(first, np.int64)[row] + within, np.array(whole, bool)[row]]
        return pa.record_batch([pa.array(c) for c in columns], names=names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        windows = 0
        for batch in common.pieces(batches, 128):
            for key, value, asked_here in zip(batch.column("text_key").to_pylist(), _large(batch, "text"), batch.column("asked").to_pylist(), strict=True):
                data = value.as_py()
                for x in asked_here:
                    held.append((x["token"], key, x["first"], x["strings"], -x["back"], x["whole"], data[x["first"] : x["first"] + x["strings"] - 1 + length]))
                    windows += x["strings"]
                    if windows >= CHUNK_WINDOWS:
                        yield hashed(held)
                        held, windows = [], 0
        if held:
            yield hashed(held)

    return _asked(texts, wanted).mapInArrow(cut, "token long, offset int, high long, low long, text_key long, start long, whole boolean")


def counted_strings(strings: DataFrame, length: int, hot: int = HOT_COPIES) -> DataFrame:
    """Spans of the strings of a written table that occur twice. No task holds the copies of one string: they are counted map-side, and those of frequent ones stay where they are."""
    alike = ["token", "offset", "high", "low"]
    twice = common.stored(strings.groupBy(*alike).agg(F.count("*").alias("n")).where("n > 1"), "repeated_strings")
    frequent = F.broadcast(twice.where(F.col("n") > hot).drop("n"))
    left = strings.where("NOT whole")
    hits = left.join(frequent, alike, "left_semi").union(left.join(frequent, alike, "left_anti").join(twice.where(F.col("n") <= hot).drop("n"), alike, "left_semi"))
    return hits.select("text_key", "start", (F.col("start") + length).alias("stop"))


def multikey_order(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by several keys, and which rows equal their predecessor in all of them.

    The rows are parted by the first key; a later key is read only for rows that tie in all keys before it.
    """
    order = np.argsort(keys[0], kind="stable")
    tied = np.zeros(len(order), bool)
    tied[1:] = keys[0][order][1:] == keys[0][order][:-1]
    for key in keys[1:]:
        inside = tied.copy()
        inside[:-1] |= tied[1:]
        at = np.flatnonzero(inside)
        if not len(at):
            break
        run = np.cumsum(~tied)[at]
        rows = order[at]
        again = np.lexsort((key[rows], run))
        order[at] = rows[again]
        values = key[order[at]]
        equal = np.zeros(len(at), bool)
        equal[1:] = (run[1:] == run[:-1]) & (values[1:] == values[:-1])
        tied[:] = False
        tied[at] = equal
    return order, tied


def _repeated(tokens: np.ndarray, offsets: np.ndarray, data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Which strings (token, offset from the anchor, place in ``data``) occur twice."""
    rolling, half = Rolling(data), length // 2
    order, tied = multikey_order([tokens, offsets, rolling.at(starts, half), rolling.at(starts + half, length - half)])
    twice = tied.copy()
    twice[:-1] |= tied[1:]
    result = np.zeros(len(order), bool)
    result[order] = twice
    return result


def _spans(keys: np.ndarray, begin: np.ndarray, length: int) -> pa.RecordBatch:
    """Runs of strings that start next to each other, as (text_key, start, stop)."""
    if not len(begin):
        return pa.record_batch([pa.array(np.zeros(0, np.int64))] * 3, names=["text_key", "start", "stop"])
    first = np.flatnonzero(np.concatenate([[True], (begin[1:] != begin[:-1] + 1) | (keys[1:] != keys[:-1])]))
    last = np.append(first[1:], len(begin)) - 1
    return pa.record_batch([pa.array(keys[first]), pa.array(begin[first]), pa.array(begin[last] + length)], names=["text_key", "start", "stop"])


def sorted_buckets(contexts: DataFrame, length: int) -> DataFrame:
    """Spans of the strings that occur in two contexts of a token."""
    dealt = contexts.repartitionByRange(common.shuffle_count(contexts.sparkSession), "token").sortWithinPartitions("token")

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Whole groups of a token, some at a time; a group that is not whole yet is looked at again when it has doubled."""
        held: list[pa.RecordBatch] = []
        windows, due = 0, CHUNK_WINDOWS
        for batch in common.pieces(batches, 2048):
            held.append(batch)
            windows += int(np.sum(batch.column("strings").to_numpy()))
            if windows >= due:
                table = pa.Table.from_batches(held).combine_chunks()
                tokens = table["token"].to_numpy()
                cut = int(np.argmax(tokens == tokens[-1]))
                if cut:
                    yield table.slice(0, cut)
                held = table.slice(cut).combine_chunks().to_batches()
                windows = int(np.sum(table["strings"].to_numpy()[cut:]))
                due = max(CHUNK_WINDOWS, 2 * windows)
        if held:
            yield pa.Table.from_batches(held).combine_chunks()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches):
            count = table["strings"].to_numpy().astype(np.int64)
            size = count - 1 + length
            data = np.frombuffer(b"".join(table["bytes"].to_pylist()), np.uint8)
            base = np.concatenate([[0], np.cumsum(size)[:-1]])
            row = np.repeat(np.arange(len(count)), count)
            within = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            token, offset, key, start, whole = (table[c].to_numpy() for c in ("token", "offset", "text_key", "start", "whole"))
            repeated = np.zeros(len(row), bool)
            least, most = int(offset.min()), int((offset + count).max())
            bands = max(1, -(-len(row) // (4 * CHUNK_WINDOWS)))  # strings at different offsets never meet
            for low in range(least, most, max(1, -(-(most - least) // bands))):
                high = low + max(1, -(-(most - least) // bands))
                at = np.flatnonzero((offset[row] + within >= low) & (offset[row] + within < high))
                if len(at):
                    repeated[at] = _repeated(token[row[at]], offset[row[at]] + within[at], data, base[row[at]] + within[at], length)
            hit = np.flatnonzero(repeated & ~whole[row])
            yield _spans(key[row[hit]], start[row[hit]] + within[hit], length)

    return dealt.mapInArrow(compare, "text_key long, start long, stop long")


def repeated_spans(texts: DataFrame, length: int = LENGTH, most: int = MOST_CONTEXTS) -> tuple[DataFrame, DataFrame]:
    """(spans, candidates): (text_key, start, stop) in bytes, which may overlap, and the (text_key, text) that spans can lie in.

    ``texts``: (text_key, text), one row per document, equal texts having equal keys.
    """
    found = common.stored(found_anchors(texts, length), "found")
    own = found.where("stop IS NOT NULL").select("text_key", F.col("first").alias("start"), "stop")
    hits = common.stored(meeting_anchors(found.where("stop IS NULL").drop("stop")), "anchors")
    once = texts.groupBy("text_key").agg(F.first("text").alias("text"))
    candidates = common.stored(once.join(hits.select("text_key").union(own.select("text_key")).distinct(), "text_key", "left_semi"), "texts")
    full = hits.where("copies > 1").select("text_key", F.col("first").alias("start"), (F.col("first") + F.col("strings") - 1 + length).alias("stop")).union(own).distinct()
    leads = hits.where("lead AND contexts > 1")
    contexts = common.stored(_context_rows(candidates, leads.where(F.col("contexts") <= most), length), "contexts")
    spans = full.union(sorted_buckets(contexts, length))
    crowds = leads.where(F.col("contexts") > most)
    if not crowds.isEmpty():
        spans = spans.union(counted_strings(common.stored(_string_rows(candidates, crowds, length), "strings"), length))
    return spans, candidates


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def kept_bytes(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """(text_key, removed, kept, text) of every different text that loses bytes: spans as an array of (start, stop), the remaining bytes,
    and these as text, without the characters that a span cut in two."""
    texts = docs.select(text_key(F.col(text)).alias("text_key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    spans, candidates = repeated_spans(texts, length)
    runs = spans.groupBy("text_key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, 256):
            removed, kept = [], []
            for value, found in zip(_large(batch, "text"), batch.column("spans").to_pylist(), strict=True):
                data = value.as_py()
                merged = _merged([x["start"] for x in found], [x["stop"] for x in found])
                edges = [0, *(e for run in merged for e in run), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                removed.append([{"start": a, "stop": b} for a, b in merged])
            spans = pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
            yield pa.record_batch([batch.column("text_key"), spans, pa.array(kept, pa.binary()), pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())], names=["text_key", "removed", "kept", "text"])

    return candidates.join(runs, "text_key").select("text_key", "text", "spans").mapInArrow(drop, "text_key long, removed array<struct<start: long, stop: long>>, kept binary, text string")


def summary(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every document."""
    taken = kept_bytes(docs, "text", length).select(
        "text_key", F.octet_length("kept").cast("long").alias("_left"), F.size("removed").cast("long").alias("_spans"), F.sha2("kept", 256).alias("_sha")
    )
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("_whole"))
    return rows.join(common.stored(taken, "taken"), "text_key", "left").select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.coalesce("_left", "n_bytes")).alias("n_removed"), F.coalesce("_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("_sha", "_whole").alias("kept_sha256")
    )


def without_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated bytes taken out of their texts; a character cut in two goes as a whole. All rows stay, also those left empty."""
    key, kept = common.unused(docs, "_text_key", "_kept")
    left = common.stored(kept_bytes(docs, text, length).select(F.col("text_key").alias(key), F.col("text").alias(kept)), "left")
    joined = docs.withColumn(key, text_key(F.col(text))).join(left, key, "left")
    return joined.withColumn(text, F.when(F.col(kept).isNotNull(), F.col(kept)).otherwise(F.col(text))).select(*docs.columns)


#: The same in SQL, over the hexadecimal digits of the bytes; ids are unique in the table.
SQL = r"""
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
p AS (SELECT doc_id, h, unnest(range(greatest(0, len(h) // 2 - 199))) AS p FROM d),
k AS (SELECT doc_id, p, md5_number(substr(h, CAST(2 * p + 1 AS BIGINT), 400)) AS k FROM p),
rep AS (SELECT doc_id, p FROM (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM k) WHERE n > 1),
runs AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 200 THEN 0 ELSE 1 END AS new FROM rep)),
spans AS (SELECT doc_id, min(p) AS s, max(p) + 200 AS e FROM runs GROUP BY doc_id, run),
edges AS (SELECT doc_id, e AS s, lead(s, 1, 1000000000) OVER (PARTITION BY doc_id ORDER BY s) AS e FROM (SELECT doc_id, s, e FROM spans UNION ALL SELECT doc_id, -1, 0 FROM d)),
kept AS (SELECT doc_id, string_agg(substr(h, CAST(2 * s + 1 AS BIGINT), CAST(2 * (least(e, len(h) // 2) - s) AS BIGINT)), '' ORDER BY s) AS h FROM edges JOIN d USING (doc_id) WHERE least(e, len(h) // 2) > s GROUP BY 1)
SELECT d.doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, CAST(len(d.h) // 2 - coalesce(len(kept.h), 0) // 2 AS BIGINT) AS n_removed, (SELECT count(*) FROM spans s WHERE s.doc_id = d.doc_id) AS n_spans,
  sha256(unhex(coalesce(kept.h, ''))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
