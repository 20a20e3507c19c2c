"""Near-duplicate documents by an exact Jaccard join of their word n-grams, with set-relation skipping.

A document is the set of hashes of its distinct 5-word shingles. Equal sets are one set from the start. Sets meet in inverted lists of their prefix
tokens: with all tokens in one global order, frequent ones last, two sets that reach the threshold share a token among their first
n - ceil(t n) + 1. Lists are skipped by size and position: a pair in a list is looked at only if what follows the two positions can
still reach the overlap asked for. Answers are derived from similar sets: every list first compares its members with one pivot, the set that shares
most, and what is linked to it is one class; only sets of different classes are compared further, at first as few as could join the classes,
then all that are left. A parity bitmap per set bounds the symmetric difference from below and so clears most pairs without their texts.

The order of tokens comes from a bounded sample of documents; it decides the work, not the result. Texts without words have no set and link with
nothing; texts of fewer than five words are one shingle. NULL ids have no say in a class's smallest id; repeated rows share a set.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.llm import common
from seriesloom.llm.components import components

WORDS = 5
PERCENT = 80
LEAST_BITS, MOST_BITS = 1 << 10, 1 << 15
SAMPLE_DOCS = 20_000
FREQUENT = 8  # documents of the sample
MOST_FREQUENT = 200_000
PLACE_BITS = 32
FILTER_BITS = 20  # of a text's hash: at most 2 ** 20 values are broadcast to leave out texts that no pair needs
LEAST_CROWD = 50
MOST_CROWDED = 10_000
BLOCK_ROWS = 2048
PAIRS_AT_ONCE = 1 << 16
CACHE_WORDS = 150_000


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, seed=9)
        return value


_WORD_HASHES = WordHashes()
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct shingles, as unsigned 64-bit numbers."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(_WORD_HASHES.__getitem__, found), np.uint64, len(found))
    width = min(words, len(hashes))
    total = np.full(len(hashes) - width + 1, width, np.uint64)
    for k in range(width):
        total = common.mixed(total * _ODD + hashes[k : len(hashes) - width + 1 + k])
    return np.unique(total)


def set_number(tokens: np.ndarray) -> int:
    """64-bit identity of a set."""
    mixed = common.mixed(tokens ^ np.uint64(0xD6E8FEB86659FD93))
    return int(common.mixed(np.array([mixed.sum() + np.uint64(len(tokens))], np.uint64)).view(np.int64)[0])


def bitmap(tokens: np.ndarray) -> bytes:
    """Parity of the tokens that fall on each bit: two bitmaps differ in at most as many bits as the sets do in tokens.

    There are about twice as many bits as tokens, a power of two, so that few differences cancel out.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << int(2 * len(tokens) - 1).bit_length()))
    counts = np.bincount((common.mixed(tokens + _ODD) % np.uint64(bits)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def _folded(bitmaps: list[bytes], size: int) -> np.ndarray:
    """Bitmaps of equal length brought to ``size`` bytes, as rows of words; the parities of halves add up."""
    table = np.frombuffer(b"".join(bitmaps), np.uint8).reshape(len(bitmaps), -1)
    while table.shape[1] > size:
        half = table.shape[1] // 2
        table = table[:, :half] ^ table[:, half:]
    return np.ascontiguousarray(table).view(np.uint64)


def _least_overlap(n_a, n_b, percent: int):
    """Smallest intersection of sets of these sizes that reaches the threshold: 100 i >= percent (n_a + n_b - i)."""
    return -(-percent * (n_a + n_b) // (100 + percent))


def frequent_tokens(docs: DataFrame, text: str, words: int, sample: int = SAMPLE_DOCS, least: int = FREQUENT, most: int = MOST_FREQUENT) -> np.ndarray:
    """Sorted hashes of shingles in ``least`` or more documents of a sample, at most ``most``; only the order of tokens rests on them."""
    common.short_batches(docs.sparkSession)
    total = docs.count()
    part = docs.select(F.col(text).alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(max(1, total // max(1, sample)))) == 0)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches):
            found = [shingles(t, words) for t in batch.column("text").to_pylist()]
            if found:
                tokens, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.record_batch([pa.array(tokens.view(np.int64)), pa.array(n)], names=["token", "n"])

    counts = part.distinct().mapInArrow(cut, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rows = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "token").limit(most).select("token").toArrow()
    return np.sort(rows["token"].to_numpy().astype(np.int64).view(np.uint64))


def document_sets(docs: DataFrame, kept: list[str], text: str, frequent: np.ndarray, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``kept`` columns with n, set, bits, prefix (the tokens that go into lists, in the global order) and rare, how many of
    these are not frequent; set is NULL without words."""
    schema = T.StructType([*[docs.schema[c] for c in kept], *T._parse_datatype_string("n long, set long, bits binary, prefix array<long>, rare int").fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches):
            n, sets, bits, prefix, rare = [], [], [], [], []
            for t in batch.column(text).to_pylist():
                tokens = shingles(t, words)
                n.append(len(tokens))
                if not len(tokens):
                    sets.append(None)
                    bits.append(None)
                    prefix.append(None)
                    rare.append(0)
                    continue
                sets.append(set_number(tokens))
                bits.append(bitmap(tokens))
                size = len(tokens) + percent * -len(tokens) // 100 + 1  # n - ceil(t n) + 1
                late = np.zeros(len(tokens), bool)
                if len(frequent):
                    late = frequent[np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)] == tokens
                early = tokens[~late][:size]
                prefix.append(np.concatenate([early, tokens[late]])[:size].view(np.int64))
                rare.append(len(early))
            columns = [pa.array(n, pa.int64()), pa.array(sets, pa.int64()), pa.array(bits, pa.binary()), pa.array(prefix, pa.list_(pa.int64())), pa.array(rare, pa.int32())]
            yield pa.record_batch([*[batch.column(c) for c in kept], *columns], names=schema.names)

    return docs.select(*dict.fromkeys([*kept, text])).mapInArrow(cut, schema)


def inverted_lists(sets: DataFrame) -> DataFrame:
    """(token, set, n, pos) of all lists with two sets or more. ``sets`` is a written table with a row number ``_row``.

    Copies in great number are left out before anything is dealt: a set with more than 1 in ``MOST_CROWDED`` of all rows, of which there are fewer
    than ``MOST_CROWDED``, keeps its first row. Rare tokens meet in one shuffle by token; frequent ones are counted map-side.
    """
    total = sets.count()
    copied = sets.where("set IS NOT NULL").groupBy("set").agg(F.count("*").alias("_n"), F.min("_row").alias("_first")).where(F.col("_n") > max(LEAST_CROWD, total // MOST_CROWDED))
    first = sets.join(F.broadcast(copied), "set", "left").where("set IS NOT NULL AND (_first IS NULL OR _first = _row)")
    spread = first.select("set", "n", "rare", F.posexplode("prefix").alias("pos", "token"))
    placed = (F.shiftleft("n", PLACE_BITS) + F.col("pos")).alias("place")  # one number to deal instead of two

    def once(rows: DataFrame) -> DataFrame:
        return rows.groupBy("token", "set").agg(F.min("place").alias("place"))  # copies have one place in a list

    dealt = once(spread.where("pos < rare").select("token", "set", placed).repartition(common.shuffle_count(sets.sparkSession), "token"))
    few = dealt.withColumn("_members", F.count("*").over(Window.partitionBy("token"))).where("_members > 1").drop("_members")
    crowd = common.stored(once(spread.where("pos >= rare").select("token", "set", placed)), "frequent")
    shared = crowd.groupBy("token").agg(F.count("*").alias("_members")).where("_members > 1").select("token")
    both = few.unionByName(crowd.join(shared, "token"))
    return both.select("token", "set", F.shiftright("place", PLACE_BITS).alias("n"), F.col("place").bitwiseAND((1 << PLACE_BITS) - 1).alias("pos"))


def different_lists(lists: DataFrame) -> DataFrame:
    """(token, set, n, pos): lists of the same members become one, with each member's first position in any of them.

    Near copies share a hundred lists; a pair that an earlier position lets through in one of them is let through here.
    """
    members = lists.groupBy("token").agg(F.bit_xor(F.xxhash64("set")).alias("_x"), F.bit_xor(F.xxhash64("set", F.lit(1))).alias("_y"), F.count("*").alias("_n"))
    named = lists.join(members.select("token", F.xxhash64("_x", "_y", "_n").alias("_list")), "token")
    return named.groupBy(F.col("_list").alias("token"), "set").agg(F.min("n").alias("n"), F.min("pos").alias("pos"))


def _open_pairs(table: pa.Table, percent: int, forest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (i, j) of pairs of different classes in a block of a list whose bitmaps do not rule them out.

    ``forest``: only as many as join the classes that such pairs connect.
    """
    n, pos, part = (table[c].to_numpy() for c in ("n", "pos", "part"))
    low, high = table["low"][0].as_py(), table["high"][0].as_py()
    bits = table["bits"].to_pylist()
    sizes = np.array([len(b) for b in bits])
    label = np.unique(table["class"].to_numpy(), return_inverse=True)[1]
    found_i: list[np.ndarray] = [np.zeros(0, np.int32)]
    found_j: list[np.ndarray] = [np.zeros(0, np.int32)]
    for size in np.unique(sizes[part == low]).tolist():
        first = np.flatnonzero((part == low) & (sizes == size))
        for other in (size // 2, size, size * 2):  # sets of further lengths cannot reach the threshold
            second = np.flatnonzero((part == high) & (sizes == other))
            if not len(second):
                continue
            one, two = (_folded([bits[i] for i in at], min(size, other)) for at in (first, second))
            step = max(1, (1 << 21) // (len(second) * two.shape[1]))
            for at in range(0, len(first), step):
                rows = first[at : at + step]
                need = _least_overlap(n[rows][:, None], n[second][None], percent)
                reach = np.minimum((n - pos)[rows][:, None], (n - pos)[second][None]) >= need
                differ = np.bitwise_count(one[at : at + step][:, None] ^ two[None]).sum(axis=2, dtype=np.int64)
                open_ = reach & (differ <= n[rows][:, None] + n[second][None] - 2 * need)
                if low == high:
                    open_ &= rows[:, None] < second[None]
                for k in np.flatnonzero(open_.any(axis=1)).tolist():
                    i = int(rows[k])
                    near = second[open_[k]]
                    near = near[label[near] != label[i]]
                    if forest and len(near):
                        groups, single = np.unique(label[near], return_index=True)
                        near = near[single]
                        label[np.isin(label, groups)] = label[i]
                    if len(near):
                        found_i.append(np.full(len(near), i, np.int32))
                        found_j.append(near.astype(np.int32))
    return np.concatenate(found_i), np.concatenate(found_j)


def _can_reach(n_a: Column, n_b: Column, pos_a: Column, pos_b: Column, percent: int) -> Column:
    """Block and position skip: the smaller rest after the two places still holds the overlap the sizes ask for."""
    need = F.ceil((n_a + n_b) * F.lit(percent) / F.lit(100 + percent) - F.lit(1e-9))
    return (F.least(n_a, n_b) >= need) & (F.least(n_a - pos_a, n_b - pos_b) >= need)


class Join:
    """State of one join: lists, the sets in them, the pairs tested so far and the classes."""

    def __init__(self, docs: DataFrame, sets: DataFrame, key: Column, text: str, words: int, percent: int):
        self.words, self.percent = words, percent
        self.lists = common.stored(different_lists(common.stored(inverted_lists(sets), "lists")), "different")
        sizes = self.lists.groupBy("token").agg(F.count("*").alias("members"))
        shared = self.lists.join(sizes, "token").groupBy("set").agg(F.avg("members").alias("score"))
        first = F.min(F.struct("_key", "_text")).alias("first")
        self.members = common.stored(
            sets.where("set IS NOT NULL").groupBy("set").agg(first, F.min("n").alias("n"), F.min("bits").alias("bits")).join(shared, "set").select("set", "n", "bits", "score", "first.*"), "members"
        )
        self.source = docs.select(key.alias("_key"), F.xxhash64(text).alias("_text"), F.col(text).alias("text"))
        self.links: DataFrame | None = None
        self.tested: DataFrame | None = None
        self.classes: DataFrame | None = None

    def with_class(self, lists: DataFrame) -> DataFrame:
        if self.classes is None:
            return lists.withColumn("class", F.col("set"))
        named = self.classes.select(F.col("id").alias("set"), F.col("root").alias("class"))
        return lists.join(named, "set", "left").withColumn("class", F.coalesce("class", "set"))

    def texts_of(self, pairs: DataFrame) -> DataFrame:
        """(set, text) of the sets in pairs, one text each. A short hash, with a bounded number of values, keeps most other texts out of the shuffle."""
        sets = pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct()
        wanted = common.stored(self.members.select("set", F.col("_key").alias("_k"), F.col("_text").alias("_t")).join(sets, "set"), "wanted")

        def short(c: str) -> Column:
            return F.shiftrightunsigned(c, 64 - FILTER_BITS).cast("int").alias("_short")

        few = self.source.withColumn("_short", short("_text")).join(F.broadcast(wanted.select(short("_t")).distinct()), "_short", "left_semi")
        found = few.join(wanted, (F.col("_text") == F.col("_t")) & F.col("_key").eqNullSafe(F.col("_k")))
        return common.stored(found.select("set", "text").dropDuplicates(["set"]), "texts")

    def bounded(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that their bitmaps do not rule out."""
        percent = self.percent
        bits = self.members.select("set", "n", "bits")
        one = bits.select(F.col("set").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"))
        two = bits.select(F.col("set").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"))

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, y = batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist()
                n_a, n_b = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
                differ = np.zeros(batch.num_rows, np.int64)
                kinds: dict[tuple[int, int], list[int]] = {}
                for i, (u, v) in enumerate(zip(x, y, strict=True)):
                    kinds.setdefault((len(u), len(v)), []).append(i)
                for (u, v), at in kinds.items():
                    differ[at] = np.bitwise_count(_folded([x[i] for i in at], min(u, v)) ^ _folded([y[i] for i in at], min(u, v))).sum(axis=1, dtype=np.int64)
                yield batch.select(["a", "b"]).filter(pa.array(differ <= n_a + n_b - 2 * _least_overlap(n_a, n_b, percent)))
            common.give_back()

        return pairs.join(one, "a").join(two, "b").mapInArrow(check, "a long, b long")

    def test(self, pairs: DataFrame) -> None:
        """Compare the sets of pairs (a, b), a < b, by their texts, and bring the classes up to date."""
        percent, words = self.percent, self.words
        fresh = common.stored(pairs if self.tested is None else pairs.join(self.tested, ["a", "b"], "left_anti"), "pairs")
        texts = self.texts_of(fresh)
        left, right = (texts.select(F.col("set").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")

        def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept: dict[int, np.ndarray] = {}

            def of(number: int, value) -> np.ndarray:
                if number not in kept:
                    if len(kept) > 256:
                        kept.clear()
                    kept[number] = shingles(value.as_py(), words)
                return kept[number]

            for batch in common.pieces(batches):
                a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
                linked = []
                for i in range(batch.num_rows):
                    x, y = of(a[i], batch.column("text_a")[i]), of(b[i], batch.column("text_b")[i])
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    linked.append(100 * both >= percent * (len(x) + len(y) - both))
                yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

        exact = common.stored(fresh.join(left, "a").join(right, "b").mapInArrow(compared, "a long, b long, linked boolean"), "compared")
        found = exact.where("linked").select("a", "b")
        self.links = found if self.links is None else self.links.union(found)
        self.tested = fresh if self.tested is None else self.tested.union(fresh)
        if found.take(1):
            self.classes = common.stored(components(self.links), "classes")

    def against_pivots(self) -> None:
        """Test every set with the pivot that it shares most lists with; a list's pivot is the set whose lists are longest."""
        rated = self.lists.join(self.members.select("set", "score"), "set")
        pivots = rated.groupBy("token").agg(F.max(F.struct("score", "set", "n", "pos")).alias("head"))
        met = self.lists.join(pivots, "token").where((F.col("set") != F.col("head.set")) & _can_reach(F.col("n"), F.col("head.n"), F.col("pos"), F.col("head.pos"), self.percent))
        shares = met.groupBy("set", F.col("head.set").alias("pivot")).agg(F.count("*").alias("shared"))
        best = shares.groupBy("set").agg(F.max(F.struct("shared", "pivot")).alias("best"))
        self.test(self.bounded(best.select(F.least("set", "best.pivot").alias("a"), F.greatest("set", "best.pivot").alias("b")).distinct()))

    def across_classes(self, forest: bool) -> None:
        """Test pairs of different classes that meet in a list: with ``forest`` only what could join the classes, else all that are left.

        A list is compared in blocks of bounded size by its bitmaps, and only pairs that these leave open come out.
        """
        percent = self.percent
        named = self.with_class(self.lists)
        mixed = named.groupBy("token").agg(F.min("class").alias("_low"), F.max("class").alias("_high"), F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("_blocks")).where("_low < _high")
        rows = named.join(mixed.select("token", "_blocks"), "token").join(self.members.select("set", "bits"), "set")
        parted = rows.withColumn("part", F.pmod(F.xxhash64("set"), F.col("_blocks")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        paired = parted.select("token", F.least("part", "_other").alias("low"), F.greatest("part", "_other").alias("high"), "part", "set", "class", "n", "pos", "bits")
        key = ["token", "low", "high"]
        dealt = paired.repartition(common.shuffle_count(self.lists.sparkSession), *key).sortWithinPartitions(*key, "set")

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
            held: list[pa.RecordBatch] = []
            for batch in batches:
                if not batch.num_rows:
                    continue
                columns = [batch.column(c).to_numpy() for c in key]
                edges = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
                if held and any(held[-1].column(c)[-1].as_py() != batch.column(c)[0].as_py() for c in key):
                    yield pa.Table.from_batches(held)
                    held = []
                for start, stop in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                    held.append(batch.slice(start, stop - start))
                    if stop < batch.num_rows:
                        yield pa.Table.from_batches(held)
                        held = []
            if held:
                yield pa.Table.from_batches(held)

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in blocks(batches):
                i, j = _open_pairs(table, percent, forest)
                sets = table["set"].to_numpy()
                for at in range(0, len(i), PAIRS_AT_ONCE):
                    x, y = sets[i[at : at + PAIRS_AT_ONCE]], sets[j[at : at + PAIRS_AT_ONCE]]
                    yield pa.record_batch([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])
            common.give_back()

        self.test(dealt.mapInArrow(compare, "a long, b long").distinct())


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, set, component_id, text_hash) for every row; set and component's other members are NULL without words."""
    frequent = frequent_tokens(docs, text, words)
    rows = docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_text"), F.col(text).alias("text"))
    sets = common.stored(document_sets(rows, ["_key", "_text"], "text", frequent, words, percent).withColumn("_row", F.monotonically_increasing_id()), "sets")
    join = Join(docs, sets, F.col(key), text, words, percent)
    join.against_pivots()
    join.across_classes(forest=True)
    join.across_classes(forest=False)
    named = sets.select("_key", "_text", "n", "set")
    if join.classes is None:
        named = named.withColumn("root", F.col("set"))
    else:
        named = named.join(join.classes.withColumnRenamed("id", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    least = named.where("root IS NOT NULL").groupBy("root").agg(F.min("_key").alias("_least"))
    return named.join(least, "root", "left").select(
        F.col("_key").alias(key), F.col("n").alias("n_shingles"), "set", F.when(F.col("root").isNull(), F.col("_key")).otherwise(F.coalesce("_least", "_key")).alias("component_id"), F.col("_text").alias("text_hash"), "root"
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each class: that of the smallest id, of its texts the one with the smallest hash; texts without words all stay."""
    names = common.unused(docs, "_text_hash", "_copy", "_stay_key", "_stay_text", "_stay_all")
    hashed, copied, own, own_text, whole = names
    found = common.stored(near_duplicates(docs, key, text), "classes_of_rows")
    alone = found.where("root IS NULL").select(F.col(key).alias(own), F.col("text_hash").alias(own_text), F.lit(True).alias(whole))
    first = found.where("root IS NOT NULL").groupBy("root").agg(F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col("text_hash").alias("text"))).alias("f"))
    stay = first.select(F.col("f.key").alias(own), F.col("f.text").alias(own_text), F.lit(False).alias(whole)).union(alone).distinct()
    marked = docs.withColumn(hashed, F.xxhash64(text))
    joined = marked.join(stay, (F.col(hashed) == F.col(own_text)) & F.col(key).eqNullSafe(F.col(own)))
    copy = F.row_number().over(Window.partitionBy(F.col(hashed), F.col(key)).orderBy(F.lit(0)))
    return joined.withColumn(copied, copy).where(F.col(whole) | (F.col(copied) == 1)).select(*docs.columns)


def query_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id)."""
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id")


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - math.ceil(percent * n / 100) + 1


#: The same in SQL; ids are unique in the table.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS g FROM d),
t AS (SELECT doc_id, unnest(g) AS g FROM s),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * i >= 80 * (len(x.g) + len(y.g) - i)),
reach(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT s.doc_id, CAST(len(any_value(s.g)) AS BIGINT) AS n_shingles, min(r.b) AS component_id FROM s JOIN reach r ON r.a = s.doc_id GROUP BY 1
"""
