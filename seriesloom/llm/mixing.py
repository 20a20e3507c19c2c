"""Mixing of sources to target weights by iterative proportional fitting.

Documents are counted in cells (source, language, topic). The cells' tokens are raked: in turn each margin's factors are set so that the margin meets its target
shares, until all meet them. Every document of a cell is then sampled with one probability, the cell's raked tokens over its tokens, scaled so that the
expected tokens are the asked share of all; probabilities end at 1, and what they cannot take is given to the other cells by the common scale.

NULL categories are a category of their own. Documents without tokens carry no weight and are not sampled. Target shares of categories without tokens are spread over
the others. Targets that no weights of the given cells can meet (a topic that only one source has, say) are met as nearly as raking gets; a warning names the largest miss. Sampling is a hash of the id and the text
against the probability, so a rerun samples alike and repeated rows are sampled together. Columns of ``docs`` may have any names.

Tokens and marks are counted on the bytes of whole Arrow batches; a text is read once for its counts, and once more only where the sampled texts themselves are returned.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.llm.common import pieces, stored

#: Power of a category's own share that its target share is proportional to, by margin.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.9}
KEPT_TOKENS = 0.75
TOLERANCE = 1e-6
MOST_SWEEPS = 40
MOST_COMBINATIONS = 20_000  # of the margins that the driver holds; more are raked by joins
REPORTED_GAP = 0.01
GRID = 48


def tokens_of(text: Column) -> Column:
    """Blank-separated tokens."""
    clean = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(clean == "", 0).otherwise(F.length(clean) - F.length(F.replace(clean, F.lit(" "), F.lit(""))) + 1).cast("long")


def topic_of(text: Column) -> Column:
    """Kind of writing, from the text's marks: tables, marked, shouting, notes (short) or prose."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)

    def share(chars: str) -> Column:
        return (n - F.length(F.translate(t, chars, ""))) / F.greatest(n, F.lit(1))

    return (
        F.when(share("|") > 0.03, "tables")
        .when(share("*#&$%") > 0.1, "marked")
        .when(share("ABCDEFGHIJKLMNOPQRSTUVWXYZ") > 0.35, "shouting")
        .when(n < 400, "notes")
        .otherwise("prose")
    )


SPACE, BAR, MARK, UPPER, FOLLOWING = 1, 2, 4, 8, 16
KINDS = np.zeros(256, np.uint8)
for _sign, _kind in ((b" \t\n\x0b\x0c\r", SPACE), (b"|", BAR), (b"*#&$%", MARK), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", UPPER), (bytes(range(0x80, 0xC0)), FOLLOWING)):
    KINDS[list(_sign)] = _kind
TOPICS = ("tables", "marked", "shouting", "notes", "prose")


def counted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of every text and its topic's place in ``TOPICS``, as ``tokens_of`` and ``topic_of`` have them, from the bytes of all texts at once."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    kinds = KINDS[np.frombuffer(body, np.uint8)[at[0] : at[-1]]] if body is not None else np.zeros(0, np.uint8)
    at = at - at[0]

    def number(where: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(np.flatnonzero(where), at))

    solid = kinds != SPACE
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    first = at[:-1][at[1:] > at[:-1]]
    begins[first] = solid[first]
    signs = np.diff(at) - number(kinds == FOLLOWING)
    share = {k: number(kinds == k) / np.maximum(signs, 1) for k in (BAR, MARK, UPPER)}
    topic = np.select([share[BAR] > 0.03, share[MARK] > 0.1, share[UPPER] > 0.35, signs < 400], [0, 1, 2, 3], 4)
    return number(begins), topic


def with_features(docs: DataFrame, text: str = "text", kept: list[str] | None = None) -> DataFrame:
    """``row`` (a struct of the ``kept`` columns, all by default), tokens and topic."""
    kept = docs.columns if kept is None else kept
    fields = T.StructType([docs.schema[c] for c in kept])
    schema = T.StructType([T.StructField("row", fields), T.StructField("tokens", T.LongType()), T.StructField("topic", T.StringType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            tokens, topic = counted(batch.column("text"))
            yield pa.record_batch([batch.column("row"), pa.array(tokens), pa.array(np.array(TOPICS, object)[topic], pa.string())], names=["row", "tokens", "topic"])

    return docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.col(text).alias("text")).mapInArrow(count, schema)


def own_targets(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """(margin, target): shares in proportion to a power of the tokens' own shares."""
    raised = stored(cells.groupBy(margin).agg(F.sum("tokens").alias("t")).select(margin, F.pow("t", F.lit(power)).alias("t")), "raised")
    total = raised.agg(F.sum("t")).first()[0] or 1.0
    return raised.select(margin, (F.col("t") / F.lit(total)).alias("target"))


def raked(cells: DataFrame, targets: dict[str, DataFrame], wide: str = "source", tolerance: float = TOLERANCE, sweeps: int = MOST_SWEEPS) -> DataFrame:
    """``cells`` (margins, tokens) with share: raked shares that meet the targets of every margin.

    The ``wide`` margin may have any number of categories: its factors stay in Spark, one row per category with its tokens by the
    combinations of the other margins. A sweep sets these factors in one pass, which also sums the combinations; the other margins' factors follow from
    these sums on the driver, which holds one number per combination (at most ``MOST_COMBINATIONS``). ``targets`` need not sum to 1 over what occurs.
    """
    narrow = [m for m in targets if m != wide]
    combinations = sorted(tuple(r) for r in cells.select(*narrow).distinct().limit(MOST_COMBINATIONS + 1).collect())
    if len(combinations) > MOST_COMBINATIONS:
        return raked_by_joins(cells, targets, tolerance, sweeps)
    place = {c: i for i, c in enumerate(combinations)}
    size = len(combinations)
    gathered = cells.groupBy(wide).agg(F.collect_list(F.struct(*narrow, "tokens")).alias("cells")).join(targets[wide].where("target > 0"), wide)

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.zeros((batch.num_rows, size))
            for i, found in enumerate(batch.column("cells").to_pylist()):
                for c in found:
                    table[i, place[tuple(c[m] for m in narrow)]] = c["tokens"]
            yield pa.record_batch([batch.column(wide), batch.column("target"), pa.array(list(table), pa.list_(pa.float64()))], names=[wide, "target", "tokens"])

    rows = stored(gathered.mapInArrow(dense, f"{wide} string, target double, tokens array<double>"), "margin")
    margins = []
    for m in narrow:
        at = narrow.index(m)
        wanted = {r[m]: r["target"] for r in targets[m].where("target > 0").collect()}
        margins.append((np.array([wanted.get(c[at], 0.0) for c in combinations]), [c[at] for c in combinations]))
    factor = np.ones(size)

    def factors_of(batch: pa.RecordBatch, now: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        table = batch.column("tokens").flatten().to_numpy().reshape(batch.num_rows, size)
        weight = table @ now
        return table, np.divide(batch.column("target").to_numpy(), weight, out=np.zeros(len(weight)), where=weight > 0)

    for _ in range(sweeps if size else 0):
        now = factor

        def sums(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for batch in batches:
                table, own = factors_of(batch, now)
                total += own @ table
            yield pa.record_batch([pa.array(np.arange(size)), pa.array(total)], names=["place", "total"])

        found = rows.mapInArrow(sums, "place long, total double").groupBy("place").agg(F.sum("total").alias("total")).collect()
        present = np.zeros(size)
        for r in found:
            present[r["place"]] = r["total"]
        for wanted, names in margins:
            held = {name: 0.0 for name in names}
            for name, value in zip(names, present * factor, strict=True):
                held[name] += value
            total = sum(w for w, name in {name: (w, name) for w, name in zip(wanted, names, strict=True)}.values() if held[name] > 0) or 1.0
            factor = factor * np.array([w / total / held[name] if held[name] > 0 else 0.0 for w, name in zip(wanted, names, strict=True)])
        factor = factor / max(factor.max(), 1e-300)
        if np.abs(factor - now).max() < tolerance:
            break
    final = factor

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table, own = factors_of(batch, final)
            share = table * own[:, None] * final[None]
            row, column = np.nonzero(table)
            yield pa.record_batch(
                [batch.column(wide).take(pa.array(row)), *(pa.array([combinations[c][k] for c in column], pa.string()) for k in range(len(narrow))), pa.array(table[row, column].astype(np.int64)), pa.array(share[row, column])],
                names=[wide, *narrow, "tokens", "share"],
            )

    return stored(rows.mapInArrow(shares, ", ".join([f"{wide} string", *(f"{m} string" for m in narrow), "tokens long", "share double"])), "raked")


def raked_by_joins(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = TOLERANCE, sweeps: int = MOST_SWEEPS) -> DataFrame:
    """The same for margins of any size: every margin's factors are a table, and each setting of one is a join."""
    margins = list(targets)
    now = cells.select(*margins, "tokens")
    for m in margins:
        now = now.join(targets[m].where("target > 0").select(m), m, "left_semi")
    now = stored(now.select(*margins, "tokens", F.col("tokens").cast("double").alias("share")), "raked")
    for _ in range(sweeps):
        for m in margins:
            held = stored(now.groupBy(m).agg(F.sum("share").alias("held")).join(targets[m], m).where("held > 0"), "held")
            total = held.agg(F.sum("target")).first()[0]
            factor = held.select(m, (F.col("target") / F.lit(total or 1.0) / F.col("held")).alias("factor"))
            now = now.join(factor, m).select(*margins, "tokens", (F.col("share") * F.col("factor")).alias("share"))
        now = stored(now, "raked")
        if margin_gap(now, targets) < tolerance:
            break
    return now


def margin_gap(shares: DataFrame, targets: dict[str, DataFrame]) -> float:
    """Largest relative miss of a margin's target by raked shares, over the categories that have tokens."""
    worst = 0.0
    for m, wanted in targets.items():
        met = shares.groupBy(m).agg(F.sum("share").alias("held")).join(wanted.where("target > 0"), m)
        sums = met.agg(F.sum("held"), F.sum("target")).first()
        if sums[0]:
            gap = met.agg(F.max(F.abs(F.col("held") / F.lit(sums[0]) / (F.col("target") / F.lit(sums[1])) - 1))).first()[0]
            worst = max(worst, gap or 0.0)
    return worst


def scaled(cells: DataFrame, wanted: float) -> float:
    """Scale s for which the sum of min(tokens, s x share) is ``wanted``; found on grids, each one pass over the cells."""
    total, least = cells.agg(F.sum("tokens"), F.min(F.col("share") / F.col("tokens"))).first()
    if not total or wanted >= total:
        return math.inf
    low, high = 0.0, 1.0 / least if least else math.inf
    if math.isinf(high):
        return math.inf
    for _ in range(8):
        at = [low + (high - low) * i / GRID for i in range(GRID + 1)]
        sums = cells.agg(*(F.sum(F.least(F.col("tokens").cast("double"), F.col("share") * F.lit(s))).alias(f"s{i}") for i, s in enumerate(at))).first()
        above = next((i for i, v in enumerate(sums) if v >= wanted), GRID)
        low, high = at[max(0, above - 1)], at[above]
    return (low + high) / 2


def draw(key: Column, text: Column) -> Column:
    """Uniform number in [0, 1) from the id and the text."""
    hashed = F.xxhash64(F.coalesce(key.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))
    return F.shiftrightunsigned(hashed, 11).cast("double") / F.lit(float(1 << 53))


def _categories() -> list[Column]:
    """source, lang, topic of rows of ``with_features``; NULL is a category of its own."""
    return [F.coalesce(F.col(f"row.{c}").cast("string"), F.lit("(none)")).alias(c) for c in ("source", "lang")] + [F.col("topic")]


def chances(rows: DataFrame, powers: dict[str, float] | None = None, kept_tokens: float = KEPT_TOKENS) -> DataFrame:
    """(source, lang, topic, rate): the probability of every cell of rows of ``with_features``."""
    powers = powers or POWERS
    cells = stored(rows.where("tokens > 0").groupBy(*_categories()).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents")), "cells")
    targets = {m: own_targets(cells, m, p) for m, p in powers.items()}
    shares = raked(cells, targets)
    gap = margin_gap(shares, targets)
    if gap > REPORTED_GAP:
        warnings.warn(f"the cells cannot meet the target weights: a margin misses its target by {gap:.1%}", stacklevel=2)
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    scale = scaled(shares, kept_tokens * total)
    chance = F.lit(1.0) if math.isinf(scale) else F.least(F.lit(1.0), F.col("share") * F.lit(scale) / F.col("tokens"))
    return shares.select("source", "lang", "topic", chance.alias("rate"))


def sampled_rows(rows: DataFrame, rates: DataFrame, drawn: Column) -> DataFrame:
    """``rows`` of ``with_features`` with probability and kept."""
    named = rows.select("row", "tokens", *_categories(), drawn.alias("drawn"))
    probability = F.when(F.col("tokens") > 0, F.coalesce("rate", F.lit(0.0))).otherwise(0.0)
    joined = named.join(rates, ["source", "lang", "topic"], "left")
    return joined.select("row", "tokens", "topic", probability.alias("probability"), (F.col("drawn") < probability).alias("kept"))


def _marked(docs: DataFrame, key: str, text: str, powers: dict[str, float] | None, kept_tokens: float) -> DataFrame:
    rates = chances(with_features(docs, text, ["source", "lang"]), powers, kept_tokens)
    return sampled_rows(with_features(docs, text), rates, draw(F.col(f"row.{key}"), F.col(f"row.{text}")))


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", powers: dict[str, float] | None = None, kept_tokens: float = KEPT_TOKENS) -> DataFrame:
    """``docs`` with _tokens, _topic, _probability and _kept, which take the place of columns of these names."""
    added = {"_tokens": "tokens", "_topic": "topic", "_probability": "probability", "_kept": "kept"}
    own = [F.col(f"row.`{c}`") for c in docs.columns if c not in added]
    return _marked(docs, key, text, powers, kept_tokens).select(*own, *(F.col(v).alias(k) for k, v in added.items()))


def summary(docs: DataFrame) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, probability, kept) for every document. Texts are read once: all else comes from a written table of their counts."""
    drawn = docs.select("doc_id", "source", "lang", "text", draw(F.col("doc_id"), F.col("text")).alias("drawn"))
    rows = stored(with_features(drawn, "text", ["doc_id", "source", "lang", "drawn"]), "counts")
    found = sampled_rows(rows, chances(rows), F.col("row.drawn"))
    return found.select("row.doc_id", "row.source", "row.lang", "topic", F.col("tokens").alias("n_tokens"), "probability", "kept")


def sampled(docs: DataFrame) -> DataFrame:
    """The sampled rows of ``docs``."""
    return _marked(docs, "doc_id", "text", None, KEPT_TOKENS).where("kept").select("row.*")
