"""Quality of documents by naive Bayes support vectors.

A document is the set of its n-grams: words, and runs of one to three token shapes (letter case, digits, outer punctuation, whether the token
repeats the one before). Each n-gram's indicator is scaled by the log ratio of its smoothed counts in the two classes; a linear hinge-loss
model is fitted on these by dual coordinate descent, and its margins are turned into probabilities on rows kept aside.

The model is fitted on at most ``SAMPLE_ROWS`` labelled rows and has a fixed number of weights. A NULL or empty text has no n-grams and gets the
model's constant; without labelled rows of both classes every score is the share of label 1 (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.llm import common

SAMPLE_ROWS = 12_000
BUCKETS = 1 << 18
CACHE_WORDS = 200_000
PENALTY = 1.0
EPOCHS = 12

_LETTERS = regex.compile(r"[^\W\d_]+")


class Shapes(dict):
    """Token to (word hash << 16 | shape hash), remembered."""

    def __missing__(self, token: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        letters = "".join(_LETTERS.findall(token))
        case = "0" if not letters else "X" if letters.isupper() and len(letters) > 1 else "Xx" if letters[0].isupper() else "x"
        digits = "9" if any(c.isdigit() for c in token) else ""
        lead = token[: len(token) - len(token.lstrip("\"'([{<|*#&$%!.,;:-_="))][:3]
        tail = token[len(token.rstrip("\"')]}>|*#&$%!.,;:-_=?")) :][:3] if letters or digits else token[:3]
        word = int.from_bytes(_digest(token.lower()), "little") & 0xFFFFFFFF
        shape = int.from_bytes(_digest(f"{case}|{digits}|{lead}|{tail}"), "little") & 0xFFFF
        value = self[token] = word << 16 | shape
        return value


def _digest(text: str) -> bytes:
    import xxhash

    return xxhash.xxh64_digest(text.encode("utf-8", "surrogatepass"), seed=5)


_SHAPES = Shapes()


def ngrams(text: str | None) -> np.ndarray:
    """Sorted distinct buckets of a text's n-grams."""
    tokens = text.split() if text else []
    if not tokens:
        return np.zeros(0, np.int32)
    both = np.fromiter(map(_SHAPES.__getitem__, tokens), np.int64, len(tokens)).astype(np.uint64)
    words, shapes = both >> np.uint64(16), both & np.uint64(0xFFFF)
    same = np.concatenate([[False], words[1:] == words[:-1]])
    unit = common.mixed(shapes * np.uint64(2) + same.astype(np.uint64) + np.uint64(1 << 40))
    pair = common.mixed(unit[:-1] * np.uint64(3) + unit[1:])
    triple = common.mixed(pair[:-1] * np.uint64(5) + unit[2:]) if len(tokens) > 2 else pair[:0]
    hashed = np.concatenate([common.mixed(words + np.uint64(1 << 50)), unit, pair, triple])
    return np.unique(hashed & np.uint64(BUCKETS - 1)).astype(np.int32)


@dataclass
class Model:
    ratio: np.ndarray  # log-count ratio of every bucket
    weight: np.ndarray  # of the scaled indicators
    bias: float
    slope: float
    shift: float

    def margin(self, grams: np.ndarray) -> float:
        scale = self.ratio[grams]
        return float(self.weight[grams] @ scale) / max(float(np.linalg.norm(scale)), 1e-9) + self.bias

    def score(self, grams: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(grams) + self.shift, -40, 40))))


def count_ratios(rows: list[np.ndarray], y: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    counts = np.full((2, BUCKETS), smoothing)
    for grams, label in zip(rows, y, strict=True):
        counts[label, grams] += 1
    shares = counts / counts.sum(axis=1, keepdims=True)
    return np.log(shares[1] / shares[0]) * (counts.sum(axis=0) > 2 * smoothing)  # unseen buckets carry nothing


def dual_descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, penalty: float = PENALTY, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and constant of the hinge-loss model; rows are the scaled indicators at unit length with one constant feature."""
    weight, bias, sign = np.zeros(BUCKETS), 0.0, 2 * y - 1
    scaled = [(s := ratio[g]) / max(float(np.linalg.norm(s)), 1e-9) for g in rows]
    square = np.array([float(s @ s) + 1 for s in scaled])
    share = max(1e-3, float(y.mean()))
    most = penalty * np.where(y == 1, 0.5 / share, 0.5 / max(1e-3, 1 - share))
    alpha = np.zeros(len(rows))
    order = np.random.default_rng(3)
    for _ in range(epochs):
        largest = 0.0
        for i in order.permutation(len(rows)).tolist():
            gradient = sign[i] * (float(weight[rows[i]] @ scaled[i]) + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), most[i])
            if (step := new - alpha[i]) != 0.0:
                weight[rows[i]] += step * sign[i] * scaled[i]
                bias += step * sign[i]
                alpha[i] = new
                largest = max(largest, abs(step))
        if largest < 1e-3:
            break
    return weight, bias


def logistic_scale(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make margins into probabilities of label 1, by Newton steps with a weak prior."""
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    found = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ found, -40, 40)))
        hessian = x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (p - target) + 1e-3 * (found - [1.0, 0.0]))
        found = found - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(found[0]), float(found[1])


def fit(rows: list[np.ndarray], y: np.ndarray) -> Model:
    if len(set(y.tolist())) < 2:
        share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        return Model(np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 1.0, float(np.log(share / (1 - share))))
    aside = np.arange(len(rows)) % 5 == 0
    if len(set(y[aside].tolist())) == 2 and len(set(y[~aside].tolist())) == 2:
        learn = [g for g, a in zip(rows, aside, strict=True) if not a]
        ratio = count_ratios(learn, y[~aside])
        model = Model(ratio, *dual_descent(learn, y[~aside], ratio), 1.0, 0.0)
        margins = np.array([model.margin(g) for g, a in zip(rows, aside, strict=True) if a])
        slope, shift = logistic_scale(margins, y[aside])
    else:
        slope, shift = 1.0, 0.0
    ratio = count_ratios(rows, y)
    return Model(ratio, *dual_descent(rows, y, ratio), slope, shift)


def sample_rows(sample: DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    """n-grams and labels of a bounded sample (text, y), cut on the executors."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches):
            grams = [ngrams(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("_id"), batch.column("y"), pa.array(grams, pa.list_(pa.int32()))], names=["_id", "y", "grams"])

    common.short_batches(sample.sparkSession)
    schema = T.StructType([sample.schema["_id"], T.StructField("y", T.IntegerType()), T.StructField("grams", T.ArrayType(T.IntegerType()))])
    found = sample.mapInArrow(cut, schema).toArrow().sort_by("_id")
    return [np.asarray(g, np.int32) for g in found["grams"].to_numpy()], found["y"].to_numpy().astype(int)


def scored(docs: DataFrame, model: Model, cut: float, text: str = "text") -> DataFrame:
    """``docs`` with score and predicted (1 from ``cut`` on)."""
    common.short_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches):
            scores = np.array([model.score(ngrams(t)) for t in batch.column(text).to_pylist()], float)
            yield pa.record_batch([*[batch.column(c) for c in kept], pa.array(scores), pa.array((scores >= cut).astype(np.int32))], names=[*kept, "score", "predicted"])

    return docs.select(*kept).mapInArrow(score, schema)


def classify(docs: DataFrame, labels: DataFrame, parts: int = 5, rest: int = 0, cut: float = 0.3, most: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document; labels of the held-out part are not read."""
    model = fit(*sample_rows(common.labelled(docs, labels, "quality", parts, rest, most)))
    rows = docs.select("doc_id", "text", common.held_out(F.col("doc_id"), parts, rest).alias("held_out"))
    return scored(rows, model, cut).select("doc_id", "held_out", "score", "predicted")
