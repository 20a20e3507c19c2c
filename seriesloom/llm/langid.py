"""Language of documents by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter trigram inside a word (its edges count as a letter) is the product of its letters' vectors,
permuted by their place; a document is the sum of its trigrams' vectors, a language the sum over its learning documents. The
language with the largest cosine wins.

A NULL text or one without letters is ``und`` with score 0, as is everything when nothing could be learned. Repeated rows and
NULL ids are scored like any other; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.llm import common

DIMENSIONS = 1024
CODES = 64  # 0 is the edge of a word, 1 to 26 are a to z, other letters share the rest by code point
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letter_codes() -> np.ndarray:
    codes = np.zeros(0x110000, np.uint8)
    letters = np.array([c for c in range(0x110000) if chr(c).isalpha()])
    codes[letters] = 27 + letters % (CODES - 27)
    codes[ord("a") : ord("z") + 1] = np.arange(1, 27)
    return codes


def trigrams(text: str | None) -> np.ndarray:
    """Codes of all letter trigrams whose middle is a letter; empty without letters."""
    if not text:
        return np.zeros(0, np.int32)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    c = np.concatenate([[0], letter_codes()[points], [0]]).astype(np.int32)
    c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]
    return (c[:-2] * CODES + c[1:-1])[c[1:-1] != 0] * CODES + c[2:][c[1:-1] != 0]


class Trigrams:
    """Vectors of trigrams, made when first met; at most CODES ** 3 of them."""

    def __init__(self, dimensions: int, seed: int = 11):
        letters = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (CODES, dimensions))
        self.placed = [np.roll(letters, shift, axis=1) for shift in (2, 1, 0)]
        self.at = np.full(CODES**3, -1, np.int32)
        self.vectors = np.zeros((4096, dimensions), np.int8)
        self.known = 0

    def rows(self, codes: np.ndarray) -> np.ndarray:
        new = codes[self.at[codes] < 0]
        if len(new):
            first, second, third = self.placed
            while self.known + len(new) > len(self.vectors):
                self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
            self.vectors[self.known : self.known + len(new)] = first[new // CODES**2] * second[new // CODES % CODES] * third[new % CODES]
            self.at[new] = np.arange(self.known, self.known + len(new))
            self.known += len(new)
        return self.vectors[self.at[codes]]

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        total = np.zeros(self.vectors.shape[1], np.float64)
        for at in range(0, len(codes), 4096):
            total += counts[at : at + 4096].astype(np.float32) @ self.rows(codes[at : at + 4096]).astype(np.float32)
        return total


@lru_cache(maxsize=2)
def trigram_vectors(dimensions: int) -> Trigrams:
    return Trigrams(dimensions)


def profiles(docs: DataFrame, text: str, lang: str, learn: Column, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Language names and their unit prototype vectors, from the rows where ``learn`` holds and the language is not NULL.

    Each task sums its documents per language and returns one vector for each; Spark adds these by (language, dimension).
    The result has one vector per language, whatever the number of documents.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in common.pieces(batches):
            for words, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = seen.get(name)
                if counts is None:
                    counts = seen[name] = np.zeros(CODES**3, np.int64)
                codes, n = np.unique(trigrams(words), return_counts=True)
                counts[codes] += n
        vectors = trigram_vectors(dimensions)
        for name, counts in seen.items():
            codes = np.flatnonzero(counts)
            total = np.zeros(dimensions)
            for at in range(0, len(codes), 4096):
                total += counts[codes[at : at + 4096]].astype(np.float64) @ vectors.rows(codes[at : at + 4096]).astype(np.float64)
            yield pa.record_batch([pa.array([name]), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["lang", "bundle"])

    common.short_batches(docs.sparkSession)
    rows = docs.where(learn & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    sums = rows.mapInArrow(partial, "lang string, bundle array<double>").select("lang", F.posexplode("bundle").alias("dim", "value"))
    found = sums.groupBy("lang", "dim").agg(F.sum("value").alias("value")).toPandas()
    names = sorted(found["lang"].unique())
    prototypes = np.zeros((len(names), dimensions))
    prototypes[[names.index(x) for x in found["lang"]], found["dim"].astype(int)] = found["value"]
    return names, prototypes / np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-300)


def identified(docs: DataFrame, names: list[str], prototypes: np.ndarray, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score, the cosine with the winning language (0 where it is negative)."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    dimensions = prototypes.shape[1]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = trigram_vectors(dimensions)
        for batch in common.pieces(batches):
            found, scores = [], []
            for words in batch.column(text).to_pylist():
                codes, counts = np.unique(trigrams(words), return_counts=True)
                if not len(codes) or not names:
                    found.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                bundle = vectors.bundle(codes, counts)
                cosines = prototypes @ bundle / max(float(np.linalg.norm(bundle)), 1e-300)
                best = int(np.argmax(cosines))
                found.append(names[best])
                scores.append(float(np.clip(cosines[best], 0.0, 1.0)))
            yield pa.record_batch([*[batch.column(c) for c in kept], pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=[*kept, "lang_pred", "score"])

    return docs.select(*kept).mapInArrow(predict, schema)


def identify(docs: DataFrame, parts: int = 4, rest: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every document, learned from those outside the held-out part."""
    rows = docs.select("doc_id", "text", "lang")
    names, prototypes = profiles(rows, "text", "lang", common.remainder(F.col("doc_id"), parts) != rest)
    marked = rows.select("doc_id", "text", common.held_out(F.col("doc_id"), parts, rest).alias("held_out"))
    return identified(marked, names, prototypes).select("doc_id", "held_out", "lang_pred", "score")
