"""Prefix trie of conversations, built from adaptive radix trees.

A turn (role, text) is a 16-byte id, a hash, followed for counting by its number of words. A conversation's key is the concatenation of its turn ids, so that byte depths divisible by 16 are whole turns.
Keys are cut into segments of ``SEGMENT`` turns: a segment's trie hangs on the node that the segment before ends in, so that a very long conversation is many short
rows. Equal segments below the same node are counted first, hence a conversation that a third of all others repeat is one row.

The counted segments are range-partitioned by their keys. Each task reads its keys in order, ``CHUNK`` at a time, inserts them into an adaptive radix tree (nodes of 4, 16, 48 and 256
children, compressed paths) and emits one row per whole turn. What a node shares with the chunk before or after follows from the common prefix of the two keys at the border: a
node, its words or a child are counted in the first chunk that holds them, and a key that the next chunk continues is no leaf. So all figures of a node are sums over chunks, and only
nodes on the borders are summed by Spark. Segments are done from the deepest to the first, each handing its totals to the nodes that it hangs on.

NULL role or text is empty; a NULL conv_id is no conversation. Turns are ordered by turn (NULL first), equal turn numbers by the hash of role and text; repeated rows are turns of their own. Positions come from one range-partitioned
sort with carried counts, so a conversation with a third of all turns is not one task. Extra columns are not read. An empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm import common
from seriesloom.session import checkpointed

ID = 16
SEGMENT = 512
CHUNK = 4096
FAMILY = 20
MOST_SHARED = 4  # a conversation shares fewer turns than this with the first of its family
WORD = r"[^\x20\x09-\x0D]+"
BLOB = 8192

PLACED = "conv long, pos long, id binary, words int"
NODE = "id binary, parent binary, depth long, conv long, parent_conv long, n long, children long, leaves long, passed decimal(38,0), fresh decimal(38,0), border boolean"


def turn_id(role: Column, text: Column) -> Column:
    """Hash of a turn; the length of the role keeps ('a', 'bc') and ('ab', 'c') apart."""
    r, t = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.md5(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t).cast("binary")))


def shared_turns(conv: Column) -> Column:
    """How many first turns a conversation takes from the first of its family."""
    return F.crc32(conv.cast("string").cast("binary")) % F.lit(MOST_SHARED)


def with_positions(turns: DataFrame) -> DataFrame:
    """(conv, pos, id, words): every turn's place in its conversation, from 0."""
    spark = turns.sparkSession
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("id")]
    done = checkpointed(turns.repartitionByRange(common.shuffle_count(spark), *order).sortWithinPartitions(*order)).withColumn("part", F.spark_partition_id())

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, last, rows, at_last = None, None, None, 0, 0
        for batch in batches:
            if batch.num_rows:
                conv = batch.column("conv").to_numpy()
                part, first = batch.column("part")[0].as_py(), conv[0] if first is None else first
                tail = int((conv == conv[-1]).sum())
                at_last = tail + (at_last if last == conv[-1] and tail == len(conv) else 0)
                last, rows = conv[-1], rows + len(conv)
        if rows:
            yield pa.record_batch([pa.array([int(x)]) for x in (part, first, last, at_last)], names=["part", "first", "last", "at_last"])

    found = done.select("conv", "part").mapInArrow(ends, "part long, first long, last long, at_last long").collect()  # one row per partition
    carry, before = {}, None
    for r in sorted(found):
        held = before[1] if before and before[0] == r["first"] else 0
        carry[r["part"]] = held
        before = (r["last"], r["at_last"] + (held if r["first"] == r["last"] else 0))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count = None, 0
        for batch in batches:
            if batch.num_rows:
                conv = batch.column("conv").to_numpy()
                if last is None:
                    last, count = conv[0], carry[batch.column("part")[0].as_py()]
                place_in_batch = np.arange(len(conv))
                new = np.concatenate([[conv[0] != last], conv[1:] != conv[:-1]])
                start = np.maximum.accumulate(np.where(new, place_in_batch, -1))
                pos = place_in_batch + np.where(start < 0, count, -start)
                last, count = conv[-1], int(pos[-1]) + 1
                yield pa.record_batch([batch.column("conv"), pa.array(pos), batch.column("id"), batch.column("words")], names=["conv", "pos", "id", "words"])

    return done.select("conv", "id", "words", "part").mapInArrow(place, PLACED)


def rebuilt(turns: DataFrame, family: int = FAMILY) -> DataFrame:
    """(conv, pos, id, words) of the rebuilt conversations: shared first turns, then the own ones after as many. Each has one more row with pos -1, also without turns."""
    placed = common.stored(with_positions(turns), "turns")
    base = F.col("conv") - F.col("conv") % F.lit(family)
    heads = common.stored(placed.where((F.col("conv") == base) & (F.col("pos") < MOST_SHARED - 1)).select(F.col("conv").alias("base"), "pos", "id", "words"), "heads")
    convs = placed.where("pos = 0").select("conv", base.alias("base"), shared_turns(F.col("conv")).alias("h"))
    taken = convs.join(heads, "base").where("pos < h").select("conv", "pos", "id", "words")
    sizes = heads.groupBy("base").agg(F.count("*").alias("size"))
    missing = F.col("h") - F.least("h", F.coalesce("size", F.lit(0)))
    short = common.stored(convs.where("h > 0").join(sizes, "base", "left").select("conv", missing.alias("missing")).where("missing > 0"), "short")
    own = placed.where(F.col("pos") >= shared_turns(F.col("conv"))).join(short, "conv", "left").select("conv", (F.col("pos") - F.coalesce("missing", F.lit(0))).alias("pos"), "id", "words")
    marks = convs.select("conv", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("binary").alias("id"), F.lit(0).alias("words"))
    return taken.union(own).union(marks)


def segments(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv, seg, ids, words): ids and word counts of every ``segment`` turns, concatenated."""
    number = F.floor(F.greatest("pos", F.lit(0)) / F.lit(segment)).cast("long")
    turns = F.sort_array(F.collect_list(F.when(F.col("pos") >= 0, F.struct("pos", F.hex("id").alias("id"), F.lpad(F.hex("words"), 8, "0").alias("words")))))
    grouped = rows.groupBy("conv", number.alias("seg")).agg(turns.alias("t"))
    return grouped.select("conv", "seg", F.unhex(F.array_join("t.id", "")).alias("ids"), F.unhex(F.array_join("t.words", "")).alias("words"))


class Node:
    """A radix tree node: compressed path, children by their next byte in one of four layouts, and the row of the key that ends here."""

    __slots__ = ("path", "layout", "keys", "children", "row")

    def __init__(self, path: bytes):
        self.path, self.layout, self.keys, self.children, self.row = path, 4, bytearray(), [], -1

    def find(self, byte: int) -> Node | None:
        if self.layout <= 16:
            at = self.keys.find(byte)
            return self.children[at] if at >= 0 else None
        if self.layout == 48:
            at = self.keys[byte]
            return self.children[at - 1] if at else None
        return self.children[byte]

    def add(self, byte: int, child: Node) -> None:
        """New child; a full node moves to the next layout."""
        if self.layout <= 16:
            if len(self.children) < self.layout:
                at = bisect_left(self.keys, byte)
                self.keys.insert(at, byte)
                self.children.insert(at, child)
                return
            if self.layout == 4:
                self.layout = 16
                return self.add(byte, child)
            index = bytearray(256)  # 48: one byte per key that says where the child is
            for i, key in enumerate(self.keys):
                index[key] = i + 1
            self.layout, self.keys = 48, index
        if self.layout == 48:
            if len(self.children) < 48:
                self.children.append(child)
                self.keys[byte] = len(self.children)
                return
            direct: list[Node | None] = [None] * 256
            for key, at in enumerate(self.keys):
                if at:
                    direct[key] = self.children[at - 1]
            self.layout, self.keys, self.children = 256, bytearray(), direct
        self.children[byte] = child

    def replace(self, byte: int, child: Node) -> None:
        if self.layout <= 16:
            self.children[self.keys.find(byte)] = child
        elif self.layout == 48:
            self.children[self.keys[byte] - 1] = child
        else:
            self.children[byte] = child

    def in_order(self) -> list[Node]:
        if self.layout == 48:
            return [self.children[at - 1] for at in self.keys if at]
        return [c for c in self.children if c is not None]


def common_length(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle)
    return low


class RadixTree:
    """Adaptive radix tree over byte keys."""

    def __init__(self):
        self.root = Node(b"")

    def insert(self, key: bytes, row: int) -> None:
        node, at = self.root, 0
        while True:
            if at == len(key):
                node.row = row
                return
            child = node.find(key[at])
            if child is None:
                leaf = Node(key[at:])
                leaf.row = row
                node.add(key[at], leaf)
                return
            same = common_length(child.path, key[at:] if len(child.path) >= len(key) - at else key[at : at + len(child.path)])
            if same < len(child.path):  # the compressed path is cut where the keys part
                fork = Node(child.path[:same])
                child.path = child.path[same:]
                fork.add(child.path[0], child)
                node.replace(key[at], fork)
                child = fork
            node, at = child, at + same


@dataclass
class Below:
    """Figures of what hangs below the end of a key in later segments."""

    children: int = 0
    leaves: int = 0
    passed: int = 0
    fresh: int = 0


@dataclass
class Row:
    """A distinct segment: its key, words by turn, number and smallest id of its conversations, and what hangs below."""

    key: bytes
    words: bytes
    n: int
    conv: int
    below: Below | None


def trie_nodes(top: bytes, rows: list[Row], before: int, after: int) -> list[tuple]:
    """Nodes of the trie of one chunk of sorted keys below the node ``top``, itself first, as tuples after ``NODE``.

    ``before`` and ``after`` are the turns that the first key shares with the key before it and the last with the one after it; -1 where there is none.
    """
    tree = RadixTree()
    for i, r in enumerate(rows):
        tree.insert(r.key, i)
    first, last = rows[0].key, rows[-1].key
    out: list[tuple] = []
    # Depth first with a stack of open tree nodes; each open turn is [id, conv, n, children, leaves, passed, fresh, words, new, border] and is emitted when its tree node closes.
    opened: list[list] = []
    hashes = [hashlib.md5(top)]

    def open_turn(key: bytes, words: bytes) -> None:
        depth = len(opened)
        if depth == 0:
            node_id, count = top, 0
        else:
            h = hashes[-1].copy()
            h.update(key[(depth - 1) * ID : depth * ID])
            hashes.append(h)
            node_id, count = h.digest(), int.from_bytes(words[(depth - 1) * 4 : depth * 4], "big")
        on_first = depth <= before and first[: depth * ID] == key[: depth * ID]
        on_last = depth <= after and last[: depth * ID] == key[: depth * ID]
        opened.append([node_id, None, 0, 0, 0, 0, 0, count, not on_first, on_first or on_last, on_last])

    def close_turn() -> None:
        node_id, conv, n, children, leaves, passed, fresh, words, new, border, goes_on = opened.pop()
        if len(opened):
            hashes.pop()
        passed += n * words
        if new:
            fresh += words
            if not children and not goes_on and not leaves:
                leaves = 1
        depth = len(opened)
        up = opened[-1] if opened else None
        out.append((node_id, up[0] if up else None, depth, conv, None, n, children, leaves, passed, fresh, border))
        if up:
            up[1] = conv if up[1] is None else min(up[1], conv)
            up[2] += n
            up[3] += new
            up[4] += leaves
            up[5] += passed
            up[6] += fresh

    def enter(node: Node, start: int) -> None:
        key_row = node
        while key_row.row < 0:  # any key below tells the path's bytes and words
            key_row = key_row.in_order()[0]
        sample = rows[key_row.row]
        for depth in range(start // ID + 1, (start + len(node.path)) // ID + 1):
            assert len(opened) == depth
            open_turn(sample.key, sample.words)

    def arrive(node: Node) -> None:
        if node.row >= 0:
            r, here = rows[node.row], opened[-1]
            here[1] = r.conv if here[1] is None else min(here[1], r.conv)
            here[2] += r.n
            if r.below:
                here[3] += r.below.children
                here[4] += r.below.leaves
                here[5] += r.below.passed
                here[6] += r.below.fresh

    open_turn(first, rows[0].words)
    arrive(tree.root)
    stack: list[tuple[Node, int, Iterator[Node]]] = [(tree.root, 0, iter(tree.root.in_order()))]
    while stack:
        node, end, children = stack[-1]
        child = next(children, None)
        if child is None:
            stack.pop()
            start = end - len(node.path)
            for _ in range(start // ID, end // ID):
                close_turn()
        else:
            enter(child, end)
            if child.row >= 0:
                arrive(child)
            stack.append((child, end + len(child.path), iter(child.in_order())))
    close_turn()
    parents = {t[0]: (t[3], t[10]) for t in out}
    named = []
    for t in reversed(out):
        conv, border = parents.get(t[1], (None, True))
        named.append((*t[:4], None if border else conv, *t[5:]))
    return named


def _turns_shared(a: tuple[bytes, bytes], b: tuple[bytes, bytes] | None) -> int:
    """Whole turns that two (top, key) pairs share; -1 below different nodes."""
    if b is None or a[0] != b[0]:
        return -1
    return common_length(a[1], b[1]) // ID


def _border_turns(groups: DataFrame) -> dict[int, tuple[int, int]]:
    """By partition: turns shared with the last key of the partition before and with the first key of the one after; -1 for none."""
    key = F.struct("top", "ids")
    edges = groups.groupBy("part").agg(F.min(key).alias("a"), F.max(key).alias("b"))
    ranked = edges.select("part", "a", "b")
    found: dict[int, tuple[int, int]] = {}
    held = None
    for r in ranked.orderBy("part").toLocalIterator():  # one row per partition, read one after the other
        a, b = ((bytes(x["top"]), bytes(x["ids"])) for x in (r["a"], r["b"]))
        shared = _turns_shared(a, held[1] if held else None)
        if held:
            found[held[0]] = (found[held[0]][0], shared)
        found[r["part"]] = (shared, -1)
        held = (r["part"], b)
    return found


def _level(groups: DataFrame, chunk: int) -> DataFrame:
    """Nodes of all tries of one level of segments; those on the borders of chunks come once per chunk."""
    done = checkpointed(groups.repartitionByRange(common.shuffle_count(groups.sparkSession), "top", "ids").sortWithinPartitions("top", "ids")).withColumn("part", F.spark_partition_id())
    shared = _border_turns(done)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Row] = []
        top, before, part = b"", -1, None

        def chunked(after: int) -> pa.RecordBatch:
            found = list(zip(*trie_nodes(top, held, before, after), strict=True))
            types = [pa.binary(), pa.binary(), *[pa.int64()] * 6, pa.decimal128(38, 0), pa.decimal128(38, 0), pa.bool_()]
            names = [f.split()[0] for f in NODE.split(", ")]
            return pa.record_batch([_column(c, t) for c, t in zip(found, types, strict=True)], names=names)

        for batch in batches:
            for r in batch.to_pylist():
                if part is None:
                    part = r["part"]
                    before = shared[part][0]
                elif held and (r["top"] != top or len(held) >= chunk):
                    after = _turns_shared((top, held[-1].key), (r["top"], r["ids"]))
                    yield chunked(after)
                    held, before = [], after
                top = r["top"]
                below = Below(r["below_children"], r["below_leaves"], int(r["below_passed"]), int(r["below_fresh"])) if r["below_leaves"] is not None else None
                held.append(Row(r["ids"], r["words"], r["n"], r["conv"], below))
        if held:
            yield chunked(shared[part][1])

    return done.mapInArrow(build, NODE)


def _column(values: tuple, kind: pa.DataType) -> pa.Array:
    return pa.array([int(v) for v in values], pa.int64()).cast(pa.decimal128(38, 0)) if pa.types.is_decimal(kind) else pa.array(values, kind)


def _summed(nodes: DataFrame) -> DataFrame:
    """Nodes on borders, once each: all figures are sums over chunks."""
    sums = [F.sum(c).cast(t).alias(c) for c, t in (("n", "long"), ("children", "long"), ("leaves", "long"), ("passed", "decimal(38,0)"), ("fresh", "decimal(38,0)"))]
    return nodes.where("border").groupBy("id", "parent", "depth").agg(F.min("conv").alias("conv"), *sums)


def _hash_of_ends(ends: DataFrame) -> DataFrame:
    """(id, ends_sha256) from (id, conv): the ids of each node's conversations in ascending order, hashed as text.

    Ids are sorted over all partitions and joined to texts of ``BLOB`` ids there; a node's texts then stream through one hash, which no cluster can split, in constant memory.
    """
    spark = ends.sparkSession
    parts = common.shuffle_count(spark)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, ids = None, 0, []
        rows: list[tuple] = []
        for batch in batches:
            for key, conv in zip(batch.column("id").to_pylist(), batch.column("conv").to_pylist(), strict=True):
                if key != node or len(ids) >= BLOB:
                    if ids:
                        rows.append((node, first, ",".join(ids)))
                    node, first, ids = key, conv, []
                ids.append(str(conv))
                if len(rows) >= 512:
                    yield _blobs(rows)
                    rows = []
        if ids:
            rows.append((node, first, ",".join(ids)))
        if rows:
            yield _blobs(rows)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done: list[tuple[bytes, str]] = []
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if key != node:
                    if state:
                        done.append((node, state.hexdigest()))
                    node, state = key, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            yield pa.record_batch([pa.array([k for k, _ in done], pa.binary()), pa.array([h for _, h in done], pa.string())], names=["id", "ends_sha256"])
        if state:
            yield pa.record_batch([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], names=["id", "ends_sha256"])

    texts = common.stored(ends.repartitionByRange(parts, "id", "conv").sortWithinPartitions("id", "conv").mapInArrow(joined, "id binary, first long, text string"), "ends")
    return texts.repartition(parts, "id").sortWithinPartitions("id", "first").mapInArrow(hashed, "id binary, ends_sha256 string")


def _blobs(rows: list[tuple]) -> pa.RecordBatch:
    ids, firsts, texts = zip(*rows, strict=True)
    return pa.record_batch([pa.array(ids, pa.binary()), pa.array(firsts, pa.int64()), pa.array(texts, pa.string())], names=["id", "first", "text"])


def trie(turns: DataFrame, family: int = FAMILY, segment: int = SEGMENT, chunk: int = CHUNK) -> DataFrame:
    """One row per node: id, parent (16-byte names), conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    known = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", turn_id(F.col("role"), F.col("text")).alias("id"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).alias("words")
    )
    cut = common.stored(segments(rebuilt(known, family), segment), "segments")
    levels = (cut.agg(F.max("seg")).first()[0] or 0) + 1
    tops = cut.where("seg = 0").select("conv", F.lit(b"").alias("top"), "seg", "ids", "words")
    held = []
    for level in range(levels):  # from the first segments down: the node that the next ones hang on
        end = F.when(F.octet_length("ids") == 0, F.col("top")).otherwise(F.unhex(F.md5(F.concat("top", "ids"))))
        rows = tops.withColumn("end", end)
        if level + 1 < levels:
            rows = common.stored(rows, "level")
            later = cut.where(F.col("seg") == level + 1)
            tops = later.join(rows.select("conv", F.col("end").alias("top")), "conv").select("conv", "top", "seg", "ids", "words")
            rows = rows.join(later.select("conv", F.lit(True).alias("goes_on")), "conv", "left").fillna(False, "goes_on")
        else:
            rows = rows.withColumn("goes_on", F.lit(False))
        held.append(rows)
    below, nodes = None, []
    for level in range(levels - 1, -1, -1):
        groups = held[level].groupBy("top", "ids", "words", "end").agg(F.count("*").alias("n"), F.min("conv").alias("conv"))
        figures = ("children", "leaves", "passed", "fresh")
        if below is not None:
            groups = groups.join(below, "end", "left")
        else:
            groups = groups.select("*", *(F.lit(None).cast("decimal(38,0)" if f in ("passed", "fresh") else "long").alias(f"below_{f}") for f in figures))
        emitted = common.stored(_level(groups.drop("end"), chunk), "nodes")
        merged = _summed(emitted).withColumns({"parent_conv": F.lit(None).cast("long"), "border": F.lit(True)})
        whole = emitted.where("NOT border").unionByName(merged)
        base = level * segment
        at_top = whole.where("depth = 0")
        if level:
            below = at_top.select(F.col("id").alias("end"), *(F.col(f).alias(f"below_{f}") for f in figures))
            known = F.when(F.col("depth") > 1, F.col("parent_conv"))  # the first nodes' parent is the end of the segment before, which has more members
            whole = whole.where("depth > 0").withColumn("parent_conv", known)
        nodes.append(whole.withColumn("depth", F.col("depth") + base))
    every = common.stored(_union(nodes), "trie")
    ends = _union([rows.where("NOT goes_on").select(F.col("end").alias("id"), "conv") for rows in held])
    parents = every.where(F.col("border") | (F.col("depth") % segment == 0)).select(F.col("id").alias("parent"), F.col("conv").alias("found_conv"))
    inner, outer = every.where("parent_conv IS NOT NULL OR depth = 0"), every.where("parent_conv IS NULL AND depth > 0")
    outer = outer.join(parents, "parent").withColumn("parent_conv", F.col("found_conv")).select(*inner.columns)
    hashes = _hash_of_ends(ends)
    return inner.union(outer).join(hashes, "id", "left").select(
        "id", "parent", F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), (F.col("passed") - F.col("fresh")).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def summary(turns: DataFrame) -> DataFrame:
    return trie(turns).drop("id", "parent")


#: Every prefix by its turns; subtrees by the pairs of nodes that a conversation passes.
SQL = r"""
WITH byte AS (
  SELECT list(v ORDER BY i) AS crc FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))
),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(octet_length(encode(r)) || ':' || r || x)) - 1 AS p, md5(octet_length(encode(r)) || ':' || r || x) AS id,
    len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS w
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
    lambda a, n: xor(a >> 8, crc[(xor(a, n) & 255) + 1])), 4294967295::BIGINT) % 4 AS h FROM (SELECT DISTINCT conv_id FROM t), byte),
turns AS (
  SELECT c.conv_id, t.p, t.id, t.w, 0 AS own FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND t.p < c.h
  UNION ALL SELECT c.conv_id, t.p, t.id, t.w, 1 FROM c JOIN t ON t.conv_id = c.conv_id AND t.p >= c.h),
paths AS (
  SELECT conv_id, row_number() OVER o AS depth, array_to_string(list(id) OVER (PARTITION BY conv_id ORDER BY own, p ROWS UNBOUNDED PRECEDING), '') AS node, w
  FROM turns WINDOW o AS (PARTITION BY conv_id ORDER BY own, p)
  UNION ALL SELECT conv_id, 0, '', 0 FROM c),
nodes AS (SELECT node, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n, any_value(w) AS w, CASE WHEN any_value(depth) > 0 THEN node[:-33] END AS parent FROM paths GROUP BY node),
kids AS (SELECT parent, count(*) AS k FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
figures AS (SELECT a.*, coalesce(k, 0) AS k FROM nodes a LEFT JOIN kids ON kids.parent = a.node),
under AS (SELECT DISTINCT a.node, b.node AS inner_node FROM paths a JOIN paths b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
sums AS (SELECT u.node, sum((f.k = 0)::INT)::BIGINT AS leaves, sum((f.n - 1) * f.w)::BIGINT AS saved FROM under u JOIN figures f ON f.node = u.inner_node GROUP BY u.node),
lasts AS (SELECT conv_id, arg_max(node, depth) AS node FROM paths GROUP BY conv_id),
ends AS (SELECT node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS s FROM lasts GROUP BY node)
SELECT f.conv_id, f.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, f.n::BIGINT AS n_convs, f.k::BIGINT AS n_children, s.leaves AS n_leaves, s.saved AS saved_tokens, coalesce(e.s, sha256('')) AS ends_sha256
FROM figures f JOIN sums s USING (node) LEFT JOIN nodes q ON q.node = f.parent LEFT JOIN ends e ON e.node = f.node
"""
