import math
import random

import numpy as np
import pytest
from brute import classes

from seriesloom.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, node int, copies string"


@pytest.fixture(scope="module")
def rows():
    rnd = np.random.default_rng(3)
    made = []
    for _group in range(12):
        centre = rnd.normal(size=16)
        for _ in range(9):
            made.append((centre + rnd.normal(size=16) * rnd.choice([0.02, 0.1, 0.2])).astype(np.float32))
    made += [rnd.normal(size=16).astype(np.float32) for _ in range(150)]
    random.Random(1).shuffle(made)
    table = [(1000 - i, [float(x) for x in v], i % 3) for i, v in enumerate(made)]
    table += [table[0], table[0], (5000, table[1][1], table[1][2]), (None, table[2][1], table[2][2])]
    table += [(5001, [2.0 * x for x in table[3][1]], table[3][2]), (5002, table[4][1], None), (5003, None, 1), (5004, [0.0] * 16, 1), (5005, [0.0] * 16, 1)]
    table += [(5006, [math.nan] + [1.0] * 15, 1), (5007, [math.inf] + [1.0] * 15, 1), (5008, [None] + [1.0] * 15, 1), (5009, [1.0, 2.0], 1), (5010, [1.0, 2.0], 1), (5011, [], 1)]
    return [(*r, 7, "x") for r in table]


def brute(rows):
    def usable(v, label):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    links, n = [], [0] * len(rows)
    for i, a in enumerate(rows):
        for j in range(i):
            b = rows[j]
            if usable(a[1], a[2]) and usable(b[1], b[2]) and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1]), np.array(b[1])
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                    links.append((i, j))
                    n[i] += 1
                    n[j] += 1
    root = classes(len(rows), links)
    least = {}
    for r, c in zip(rows, root, strict=True):
        if r[0] is not None:
            least[c] = min(r[0], least.get(c, r[0]))
    return [(r[0], k, least.get(c, r[0]), r[0] is not None and least.get(c) == r[0]) for r, k, c in zip(rows, n, root, strict=True)]


@pytest.mark.parametrize(("cell", "block"), [(4096, 4096), (20, 4096), (30, 25)])
def test_equals_brute_force(spark, rows, cell, block, monkeypatch):
    linked = vectors.linked
    monkeypatch.setattr(vectors, "linked", lambda nodes, least: linked(nodes, least, cell, 2048, block))
    got = vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows)))


def test_empty_table(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
