"""Near-duplicate vectors by an exact metric range join.

Equal vectors of a label are first taken together. Pivots from a bounded sample part each label into cells of the nearest pivot. On the unit sphere a cosine of
at least c is a distance of at most r = sqrt(2 - 2c); by the triangle inequality a vector can reach a vector of another cell only if
it lies within r of the plane between the two pivots, so it is copied there as a guest, towards the lower-numbered cell only. Cells are joined independently, in
blocks of bounded size; a block returns link counts and one link per vector to the smallest of its local class, never pairs.

Vectors that are NULL, zero, or hold NULL or non-finite components, and vectors without a label, link with nothing. Vectors of different lengths never link. Repeated rows are
vectors of their own, linked with each other; NULL ids have no say in a class's smallest id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.llm import common
from seriesloom.llm.components import components

LEAST_COSINE = 0.98
CELL_ROWS = 4096
MOST_PIVOTS = 2048
BLOCK_ROWS = 4096


def _unit(values: pa.Array, length: int) -> np.ndarray:
    """Unit rows in double precision; scaled by the largest component first, so that no square overflows or vanishes."""
    table = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), length)
    table = table / np.abs(table).max(axis=1, keepdims=True)
    return table / np.linalg.norm(table, axis=1, keepdims=True)


def distinct_vectors(rows: DataFrame, vector: str, label: str, key: str) -> DataFrame:
    """(node, label, size, v, copies, first): usable vectors, equal ones of a label taken together."""
    v = F.col(vector).cast("array<double>")
    usable = F.col(label).isNotNull() & F.col(vector).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf))) & F.exists(v, lambda x: x != 0)
    grouped = rows.where(usable).select(F.col(label).alias("label"), v.alias("v"), F.col(key).alias("_key")).groupBy("label", "v").agg(F.count("*").alias("copies"), F.min("_key").alias("first"))
    return common.stored(grouped.select(F.monotonically_increasing_id().alias("node"), "label", F.size("v").alias("size"), "v", "copies", "first"), "vectors")


def chosen_pivots(nodes: DataFrame, cell_rows: int, most: int) -> dict[tuple, np.ndarray]:
    """Unit pivots by (label, length): a sample by hash, one for every ``cell_rows`` vectors and at most ``most`` in all."""
    wanted = min(most, -(-nodes.count() // cell_rows))
    sample = nodes.orderBy(F.xxhash64("node"), "node").limit(wanted).select("label", "size", "v").toArrow()
    found: dict[tuple, list[np.ndarray]] = {}
    for label, size, v in zip(sample["label"].to_pylist(), sample["size"].to_pylist(), sample["v"].to_pylist(), strict=True):
        found.setdefault((label, size), []).append(_unit(pa.array([v], pa.list_(pa.float64())), size)[0])
    return {k: np.stack(v) for k, v in found.items()}


def _with_cells(nodes: DataFrame, pivots: dict[tuple, np.ndarray], reach: float) -> DataFrame:
    """Every vector in its home cell, and as guest in the lower-numbered cells that it can reach."""
    schema = T.StructType([*nodes.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("home", T.BooleanType())])

    def deal(batches):
        for batch in common.pieces(batches, 2048):
            labels, sizes = batch.column("label").to_pylist(), batch.column("size").to_pylist()
            by_kind: dict[tuple, list[int]] = {}
            for i, kind in enumerate(zip(labels, sizes, strict=True)):
                by_kind.setdefault(kind, []).append(i)
            rows, cells, homes = [], [], []
            for kind, members in by_kind.items():
                at = pivots.get(kind)
                if at is None or len(at) == 1:
                    rows += members
                    cells += [0] * len(members)
                    homes += [True] * len(members)
                    continue
                unit = _unit(batch.column("v").take(pa.array(members)), kind[1])
                square = np.maximum(0, 2 - 2 * unit @ at.T)  # squared distances to the pivots
                home = np.argmin(square, axis=1)
                apart = np.sqrt(np.maximum(0, 2 - 2 * at @ at.T))[home]
                plane = (square - square[np.arange(len(members)), home][:, None]) / np.maximum(2 * apart, 1e-9)
                guests = ((plane <= reach + 1e-7) | (apart < 1e-7)) & (np.arange(len(at))[None] < home[:, None])
                who, where = np.nonzero(guests)
                rows += [*members, *(members[i] for i in who)]
                cells += [*home.tolist(), *where.tolist()]
                homes += [True] * len(members) + [False] * len(who)
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(rows, pa.int64())).columns, pa.array(cells, pa.int32()), pa.array(homes, pa.bool_())], schema=None, names=[*batch.schema.names, "cell", "home"])

    return nodes.mapInArrow(deal, schema)


def _local_links(left: np.ndarray, right: np.ndarray, allowed, least: float, step: int = 1024):
    """Linked index pairs (i of left, j of right), in bands of rows."""
    for at in range(0, len(left), step):
        i, j = np.nonzero(left[at : at + step] @ right.T >= least)
        i = i + at
        keep = allowed(i, j)
        yield i[keep], j[keep]


def _block_links(table: pa.Table, size: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Link counts (copies counted) and local roots of a block pair's rows."""
    unit = _unit(table["v"].combine_chunks(), size)
    home, part, copies = (table[c].to_numpy() for c in ("home", "part", "copies"))
    low, high = table["low"][0].as_py(), table["high"][0].as_py()
    counts, parent = np.zeros(len(unit), np.int64), np.arange(len(unit))

    first, second = np.flatnonzero(part == low), np.flatnonzero(part == high)
    same = low == high

    def allowed(i, j):
        a, b = first[i], second[j]
        return (home[a] | home[b]) & (a < b if same else True)

    for i, j in _local_links(unit[first], unit[second], allowed, least):
        a, b = first[i], second[j]
        np.add.at(counts, a, copies[b])
        np.add.at(counts, b, copies[a])
        while len(a):  # hang roots on smaller roots until all pairs agree
            ra, rb = parent[a], parent[b]
            differ = ra != rb
            if not differ.any():
                break
            np.minimum.at(parent, np.maximum(ra, rb)[differ], np.minimum(ra, rb)[differ])
            while not np.array_equal(up := parent[parent], parent):
                parent = up
    return counts, parent


def linked(nodes: DataFrame, least: float, cell_rows: int = CELL_ROWS, most_pivots: int = MOST_PIVOTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(node, n_links, root): partial link counts and the local root of every vector with a link, one row per block it is in."""
    reach = math.sqrt(max(0.0, 2 - 2 * least))
    dealt = common.stored(_with_cells(nodes.select("node", "label", "size", "v", "copies"), chosen_pivots(nodes, cell_rows, most_pivots), reach), "cells")
    blocks = dealt.groupBy("label", "size", "cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    parted = dealt.join(blocks, ["label", "size", "cell"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = parted.withColumn("_other", other).select("*", F.least("part", "_other").alias("low"), F.greatest("part", "_other").alias("high")).drop("_other", "blocks")

    def join(table: pa.Table) -> pa.Table:
        counts, parent = _block_links(table, table["size"][0].as_py(), least)
        ids = table["node"].to_numpy()
        some = counts > 0
        return pa.table({"node": ids[some], "n_links": counts[some], "root": ids[parent[some]]})

    return paired.groupBy("label", "size", "cell", "low", "high").applyInArrow(join, "node long, n_links long, root long")


def near_duplicates(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = LEAST_COSINE) -> DataFrame:
    """(key, n_links, component_id, kept) for every row."""
    nodes = distinct_vectors(rows, vector, label, key)
    found = common.stored(linked(nodes, least), "near")
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    held = nodes.select("node", "label", "v", "copies", "first").join(counts, "node", "left").join(roots.withColumnRenamed("id", "node"), "node", "left")
    held = common.stored(held.withColumn("root", F.coalesce("root", "node")), "held")
    least_id = held.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = held.join(least_id, "root").select("label", "v", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    keyed = rows.select(F.col(key).alias("_key"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    return keyed.join(classes, ["label", "v"], "left").select(
        F.col("_key").alias(key),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "_key").alias("component_id"),
        F.coalesce(F.col("_key") == F.coalesce("component_id", "_key"), F.lit(False)).alias("kept"),
    )


#: The same in SQL; ids are unique in the table.
SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings),
usable AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98::DOUBLE),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS c FROM reach GROUP BY 1),
n AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least.c AS component_id, v.vec_id = least.c AS kept FROM v JOIN least ON least.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""
