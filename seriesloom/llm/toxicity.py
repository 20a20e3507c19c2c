"""Toxicity of documents by weak supervision.

Terms are words and their first 4 to 8 letters. Those that go with the toxic mark on labelled rows form the lexicon; its strongest terms, the
counts of its hits, and writing patterns are voters that say toxic, clean or nothing. A generative label model estimates
each voter's rates in both classes and the voters' correlations within a class, and weighs down voters that repeat each other. A linear
classifier over the lexicon and the patterns is then trained on the model's posterior labels and scores all documents.

Fitted on at most ``SAMPLE_ROWS`` labelled rows, with at most ``MOST_TERMS`` terms. A NULL or empty text has no terms and gets the
classifier's constant; without labelled rows of both classes every document scores 0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.llm import common

SAMPLE_ROWS = 16_000
MOST_TERMS = 4096
LEXICON_VOTERS = 48
LEAST_ROWS = 3
MARK_ACCURACY = 0.97
LEAST_ODDS = 3  # odds of the mark on rows with a term, against its odds on all rows
CACHE_WORDS = 200_000

_WORD = regex.compile(r"[^\W\d_]+")
_PATTERNS = {
    "shouted": regex.compile(r"\b\p{Lu}{4,}\b(?:\W+\p{Lu}{2,}\b){3}"),
    "exclaimed": regex.compile(r"!{2,}|\?!|!\?"),
    "masked": regex.compile(r"\b\p{L}+[*@#$%]{1,4}\p{L}+\b"),
    "spelled": regex.compile(r"\b\p{L}(?:[ .-]\p{L}\b){3,}"),
    "addressed": regex.compile(r"\b(?:you|your|du|dein|tu|vous|eres|usted)\b", regex.I),
}
PATTERN_NAMES = tuple(_PATTERNS)


def word_terms(word: str) -> list[str]:
    """Terms of a lower-case word: itself, and its beginnings marked with a star."""
    return [word, *(f"{word[:n]}*" for n in range(4, min(8, len(word)) + 1))]


def distinct_words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def patterns_of(text: str | None) -> list[int]:
    return [i for i, name in enumerate(PATTERN_NAMES) if text and _PATTERNS[name].search(text)]


class Lexicon:
    """Terms and their numbers; finds the numbers in a text, remembering blank-free chunks."""

    def __init__(self, terms: list[str]):
        self.number = {t: i for i, t in enumerate(terms)}
        self.chunks: dict[str, tuple[int, ...]] = {}

    def of_chunk(self, chunk: str) -> tuple[int, ...]:
        number = self.number
        return tuple({number[t] for w in _WORD.findall(chunk) for t in word_terms(w) if t in number})

    def hits(self, text: str | None) -> list[int]:
        """Sorted numbers of the distinct terms in ``text``."""
        if not text:
            return []
        found: set[int] = set()
        known = self.chunks
        for chunk in set(text.lower().split()):
            terms = known.get(chunk)
            if terms is None:
                if len(known) >= CACHE_WORDS:
                    known.clear()
                terms = known[chunk] = self.of_chunk(chunk)
            if terms:
                found.update(terms)
        return sorted(found)


def associated_terms(sample: DataFrame, most: int = MOST_TERMS, least: int = LEAST_ROWS) -> list[tuple[str, int, int]]:
    """(term, rows, toxic rows) of the terms most tied to the mark, by the likelihood ratio of their counts.

    Terms are counted within each batch first, then summed by Spark; the ``most`` strongest come back. The ratio must exceed what the strongest
    of so many terms would show by chance.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                seen[y].update({t for w in distinct_words(text) for t in word_terms(w)})
            terms = list(seen[0].keys() | seen[1].keys())
            toxic = [seen[1][t] for t in terms]
            yield pa.record_batch([pa.array(terms, pa.string()), pa.array([seen[0][t] + x for t, x in zip(terms, toxic, strict=True)], pa.int64()), pa.array(toxic, pa.int64())], names=["term", "n", "toxic"])

    common.short_batches(sample.sparkSession)
    total = sample.agg(F.count("*").alias("n"), F.sum("y").alias("toxic")).first()
    if not total["toxic"] or total["toxic"] == total["n"]:
        return []
    rate = total["toxic"] / total["n"]
    summed = sample.select("text", "y").mapInArrow(count, "term string, n long, toxic long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    counts = common.stored(summed.where(F.col("n") >= least), "terms")
    chance = float(np.log(max(2, counts.count())))

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    n, toxic = F.col("n"), F.col("toxic")
    tie = part(toxic, n * rate) + part(n - toxic, n * (1 - rate))
    strongest = counts.where((toxic >= least) & (toxic * (1 - rate) > LEAST_ODDS * rate * (n - toxic))).withColumn("tie", tie).where(F.col("tie") > chance).orderBy(F.desc("tie"), "term").limit(most)
    return [(r["term"], r["n"], r["toxic"]) for r in strongest.collect()]


def voter_terms(terms: list[tuple[str, int, int]], most: int = LEXICON_VOTERS) -> list[int]:
    """Numbers of the strongest terms of which none continues or begins another."""
    chosen: list[int] = []
    for i, (term, _, _) in enumerate(terms):
        stem = term.rstrip("*")
        if not any(stem.startswith(s) or s.startswith(stem) for s in (terms[j][0].rstrip("*") for j in chosen)):
            chosen.append(i)
            if len(chosen) == most:
                break
    return chosen


def votes(hits: list[list[int]], patterns: list[list[int]], marks: np.ndarray, voters: list[int]) -> np.ndarray:
    """Rows by voters: 1 toxic, -1 clean, 0 no vote. The given mark is the last voter."""
    table = np.zeros((len(hits), len(voters) + 3 + len(PATTERN_NAMES) + 1), np.int8)
    column = {t: j for j, t in enumerate(voters)}
    base = len(voters)
    for i, found in enumerate(hits):
        for t in found:
            if t in column:
                table[i, column[t]] = 1
        n = len(found)
        table[i, base] = 1 if n >= 2 else -1 if n == 0 else 0
        table[i, base + 1] = 1 if n >= 4 else 0
        table[i, base + 2] = -1 if not any(t in column for t in found) else 0
        for p in patterns[i]:
            table[i, base + 3 + p] = 1
    table[:, -1] = 2 * marks - 1
    return table


@dataclass
class LabelModel:
    prior: float
    rates: np.ndarray  # class, voter, vote + 1
    share: np.ndarray  # weight of each voter against those it repeats

    def posterior(self, table: np.ndarray) -> np.ndarray:
        logs = np.log(self.rates[1] / self.rates[0])
        logs[:, 1] = 0.0  # no vote is no evidence
        margin = np.log(self.prior / (1 - self.prior)) + (self.share * np.take_along_axis(logs[None], (table[:, :, None] + 1).astype(int), 2)[:, :, 0]).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def label_model(table: np.ndarray, accuracy: float = MARK_ACCURACY, rounds: int = 25) -> LabelModel:
    """Expectation and maximisation over votes whose last column is the given mark.

    The mark is believed to be right at rate ``accuracy``, as if seen on as many rows again, which ties the hidden class to toxicity; all
    other rates and the correlations are estimated.
    """
    n, m = table.shape
    q = np.where(table[:, -1] > 0, accuracy, 1 - accuracy)
    believed = n * np.array([[accuracy, 0, 1 - accuracy], [1 - accuracy, 0, accuracy]])
    onehot = np.stack([table == v for v in (-1, 0, 1)], axis=2).astype(float)
    model = LabelModel(0.5, np.ones((2, m, 3)), np.ones(m))
    for _ in range(rounds):
        weight = np.stack([1 - q, q])
        sums = np.einsum("cn,nmv->cmv", weight, onehot) + 0.5
        sums[:, -1] += believed
        rates = sums / sums.sum(axis=2, keepdims=True)
        prior = float(np.clip(q.mean(), 0.002, 0.998))
        correlation = np.zeros((m, m))
        for w in weight:  # correlations within each class
            mean = (w[:, None] * table).sum(axis=0) / w.sum()
            centred = (table - mean) * np.sqrt(w)[:, None]
            spread = centred.T @ centred
            scale = np.sqrt(np.maximum(np.diag(spread), 1e-9))
            within = np.abs(spread / scale[:, None] / scale[None])
            within[within < max(0.1, 4 / np.sqrt(w.sum() + 1))] = 0  # what so many rows show by chance
            correlation += within * w.sum() / n
        np.fill_diagonal(correlation, 0)
        share = 1 / (1 + correlation.sum(axis=1))
        share[-1] = 1.0
        model = LabelModel(prior, rates, share)
        new = model.posterior(table)
        if np.abs(new - q).max() < 1e-4:
            break
        q = new
    return model


def linear_fit(features: list[list[int]], target: np.ndarray, size: int, penalty: float = 1e-4, steps: int = 1500) -> tuple[np.ndarray, float]:
    """Logistic regression of posterior labels on sets of features, by accelerated gradient steps."""
    rows = np.repeat(np.arange(len(features)), [len(f) for f in features])
    columns = np.fromiter((c for f in features for c in f), np.int64, len(rows))
    n = len(features)
    weight, bias = np.zeros(size), float(np.log(target.mean() / (1 - target.mean())))
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, weight[columns], n) + bias, -40, 40)))
        gap = (p - target) / n
        gradient = np.append(np.bincount(columns, gap[rows], size) + penalty * weight, gap.sum())
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        move = 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-10)
        weight, bias = weight - move[:-1], bias - float(move[-1])
    return weight, bias


@dataclass
class Model:
    terms: list[str]
    weight: np.ndarray  # of the terms, then of the patterns
    bias: float

    def score(self, lexicon: Lexicon, text: str | None) -> float:
        total = self.bias + sum(self.weight[i] for i in lexicon.hits(text)) + sum(self.weight[len(self.terms) + p] for p in patterns_of(text))
        return float(1 / (1 + np.exp(-np.clip(total, -40, 40))))


def fit(sample: DataFrame) -> Model:
    """``sample``: a bounded, written table (_id, text, y)."""
    found = associated_terms(sample)
    terms = [t for t, _, _ in found]
    lexicon_terms = list(terms)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(lexicon_terms)
        for batch in common.pieces(batches):
            texts = batch.column("text").to_pylist()
            kind = pa.list_(pa.int32())
            yield pa.record_batch([batch.column("_id"), batch.column("y"), pa.array([lexicon.hits(t) for t in texts], kind), pa.array([patterns_of(t) for t in texts], kind)], names=["_id", "y", "hits", "patterns"])

    numbers = T.ArrayType(T.IntegerType())
    schema = T.StructType([sample.schema["_id"], T.StructField("y", T.IntegerType()), T.StructField("hits", numbers), T.StructField("patterns", numbers)])
    rows = sample.mapInArrow(read, schema).toArrow().sort_by("_id")
    hits, patterns = rows["hits"].to_pylist(), rows["patterns"].to_pylist()
    marks = rows["y"].to_numpy().astype(int)
    if len(np.unique(marks)) < 2:
        return Model([], np.zeros(len(PATTERN_NAMES)), -40.0)
    table = votes(hits, patterns, marks, voter_terms(found))
    target = np.clip(label_model(table).posterior(table), 1e-4, 1 - 1e-4)
    size = len(terms) + len(PATTERN_NAMES)
    weight, bias = linear_fit([h + [len(terms) + p for p in ps] for h, ps in zip(hits, patterns, strict=True)], target, size)
    return Model(terms, weight, bias)


def scored(docs: DataFrame, model: Model, cut: float = 0.5, text: str = "text") -> DataFrame:
    """``docs`` with score and predicted (1 from ``cut`` on); columns of these names are replaced."""
    common.short_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model.terms)
        for batch in common.pieces(batches):
            scores = np.array([model.score(lexicon, t) for t in batch.column(text).to_pylist()], float)
            yield pa.record_batch([*[batch.column(c) for c in kept], pa.array(scores), pa.array((scores >= cut).astype(np.int32))], names=[*kept, "score", "predicted"])

    return docs.select(*kept).mapInArrow(score, schema)


def not_toxic(docs: DataFrame, model: Model, cut: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``cut``, with all their columns as they are."""
    common.short_batches(docs.sparkSession)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model.terms)
        for batch in common.pieces(batches):
            scores = np.array([model.score(lexicon, t) for t in batch.column(text).to_pylist()], float)
            yield batch.filter(pa.array(scores < cut))

    return docs.mapInArrow(keep, docs.schema)


def trained(docs: DataFrame, labels: DataFrame, parts: int = 5, rest: int = 0, most: int = SAMPLE_ROWS) -> Model:
    return fit(common.stored(common.labelled(docs, labels, "toxic", parts, rest, most), "toxic_sample"))


def classify(docs: DataFrame, labels: DataFrame, parts: int = 5, rest: int = 0, most: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document; labels of the held-out part are not read."""
    model = trained(docs, labels, parts, rest, most)
    rows = docs.select("doc_id", "text", common.held_out(F.col("doc_id"), parts, rest).alias("held_out"))
    return scored(rows, model).select("doc_id", "held_out", "score", "predicted")
