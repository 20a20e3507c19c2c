import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from seriesloom.llm import tries

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows, family=20):
    """Node rows as a Counter-ready list of tuples, from every prefix."""
    own = {}
    for c, n, r, t in rows:
        if c is not None:
            own.setdefault(c, []).append((n is not None, n or 0, hashlib.md5(f"{len((r or '').encode())}:{r or ''}{t or ''}".encode()).digest(), (r or "", t or "")))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(own.get(c - c % family, [])[:h]) + tuple(own[c][h:])
    members, ends = {}, {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
        ends.setdefault(turns, []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves[node] = sum(leaves[b] for b in below) or 1
        saved[node] = (len(members[node]) - 1) * words + sum(saved[b] for b in below)
    return [
        (min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children.get(node, [])), leaves[node], saved[node],
         hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest())
        for node, m in members.items()
    ]


def compare(spark, rows, **settings):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).withColumns({c: F.lit("clash") for c in ("conv", "pos", "id", "words", "seg", "depth", "n")})
    got = [tuple(r) for r in tries.trie(df, **settings).drop("id", "parent").collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain(rows)))
    return got


def conversations(rnd, count, texts=6, longest=7):
    rows = []
    for c in range(count):
        for t in range(rnd.randrange(1, longest)):
            rows.append((c, t, rnd.choice(["user", "assistant"]), f"text {rnd.randrange(texts)} of  some\twords"))
    return rows


@pytest.mark.parametrize(("segment", "chunk"), [(512, 4096), (2, 3), (1, 2), (3, 1)])
def test_equals_every_prefix(spark, segment, chunk):
    compare(spark, conversations(random.Random(segment), 130, texts=2, longest=9), segment=segment, chunk=chunk)


def test_hot_conversation_and_hot_sequence(spark):
    rnd = random.Random(4)
    rows = conversations(rnd, 60)
    rows += [(500, n, "user", f"long {n % 5}") for n in range(300)]  # one conversation with many turns
    rows += [(2000 + c, n, "user", f"hello {n}") for c in range(200) for n in range(2)]  # one sequence in many conversations
    rows += [(2000 + c, n, "user", f"hello {n}") for c in range(200, 240) for n in range(4)]
    compare(spark, rows, segment=16, chunk=50)


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "no conversation"), (1, None, "user", "first"), (1, 0, None, None), (1, 0, "", ""), (1, 3, "user", "x" * 20000), (1, 3, "user", "x" * 20000),
        (2, 0, "a", "bc"), (3, 0, "ab", "c"), (20, 5, "user", "  \t\n"), (21, 5, "user", "é ü"), (21, 5, "user", "b"), (40, 0, "user", "only"), (41, 0, "user", "only"), (-21, 1, "u", "below"), (-20, 1, "u", "zero"),
        (2**40, 1, "u", "far"), (60, 1, "u", "a"), (60, 2, "u", "b"), (60, 3, "u", "c"), (60, 4, "u", "d"),
    ] + [(60 + k, n, "u", f"own {n}") for k in range(1, 20) for n in range(k % 5)]
    rows = [r for r in rows if r[0] is None or r[0] >= 0]  # the plain version's remainder differs below zero
    compare(spark, rows)
    compare(spark, rows, segment=2, chunk=2)


def test_single_and_empty(spark):
    compare(spark, [(7, 0, "user", "alone")])
    assert tries.summary(spark.createDataFrame([], SCHEMA)).collect() == []


def test_node_layouts_grow(spark):
    tree = tries.RadixTree()
    keys = sorted({bytes([a, b]) * 8 for a in range(0, 256, 3) for b in (1, 7)} | {bytes([5]) * 16 + bytes([a]) * 16 for a in range(256)})
    layouts = set()
    for i, key in enumerate(keys):
        tree.insert(key, i)
        layouts.add(tree.root.layout)
    assert layouts == {4, 16, 48, 256}

    def walk(node, path):
        path += node.path
        if node.row >= 0:
            yield path, node.row
        for child in node.in_order():
            yield from walk(child, path)

    assert list(walk(tree.root, b"")) == [(k, i) for i, k in enumerate(keys)]
