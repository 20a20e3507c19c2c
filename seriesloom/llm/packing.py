"""Packing of token sequences into windows of a fixed length by best-fit decreasing.

Documents become token ids ending in one separator id. Overlong documents are first cut into full windows; the rests are placed
by best-fit decreasing within groups of some thousand pieces, chosen at random over the written pieces, so a group's padding is that of a few windows
and no group depends on the documents' keys. Repeated rows and NULL ids are documents of their own; a NULL or empty text is the separator alone.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.llm import common

WINDOW = 2048
SEPARATOR = 1
GROUP_ROWS = 8192
CACHE_WORDS = 500_000

PIECE = "start long, doc_tokens long, ids binary"


class WordEncoder:
    """Ids of whole texts for a vocabulary that drops white space: each blank-free chunk is encoded once and remembered.

    Chunks of letters up to U+00FF are lower-cased and cut into the vocabulary's own word units here, which the tokenizer's model then
    splits; other chunks go through the whole tokenizer.
    """

    UNIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    ODD = regex.compile(r"[^\u0000-ÿ]|[\u0000-\u001f\u007f\u0085]|<\|")
    ODD_SPACE = regex.compile(r"[\u001c-\u001f]")
    BLANK = regex.compile(r"[^\S\u001c-\u001f]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.chunks: dict[str, bytes] = {}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow U+0100
        others = [b for b in range(256) if b not in set(plain)]
        self.signs = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}

    def _unit(self, unit: str) -> bytes:
        signs = unit if unit.isascii() else unit.encode().decode("latin-1").translate(self.signs)
        return array("I", [t.id for t in self.model.tokenize(signs)]).tobytes()

    def _learn(self, chunk: str) -> bytes:
        if len(self.chunks) >= CACHE_WORDS:
            self.chunks.clear()
        if chunk.isascii() and chunk.isalpha():
            found = self._unit(chunk.lower())
        elif self.ODD.search(chunk):
            found = array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        else:
            found = b"".join([self._unit(u) for u in self.UNIT.findall(chunk.lower())])
        self.chunks[chunk] = found
        return found

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        if text.isascii() or not self.ODD.search(text):
            text = text.lower()  # one sign for one sign here
        words = self.BLANK.split(text) if self.ODD_SPACE.search(text) else text.split()
        known = self.chunks.get
        return np.frombuffer(b"".join([known(w) or self._learn(w) for w in words if w]), "<u4")


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def token_pieces(docs: DataFrame, vocabulary: str, window: int = WINDOW, separator: int = SEPARATOR) -> DataFrame:
    """(doc_id, start, doc_tokens, ids): every document's ids, little-endian unsigned 32-bit, cut into full windows and one rest."""
    common.short_batches(docs.sparkSession)
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *T._parse_datatype_string(PIECE).fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(vocabulary)
        for batch in common.pieces(batches):
            rows, starts, totals, ids = [], [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                found = np.append(words.encode(text), np.uint32(separator)).astype("<u4")
                for at in range(0, len(found), window):
                    rows.append(row)
                    starts.append(at)
                    totals.append(len(found))
                    ids.append(found[at : at + window].tobytes())
            keys = batch.column("doc_id").take(pa.array(rows, pa.int64()))
            yield pa.record_batch([keys, pa.array(starts, pa.int64()), pa.array(totals, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "doc_tokens", "ids"])
        words.chunks.clear()  # workers live on for other stages

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


class OpenWindows:
    """Segment tree over remaining capacities: a node counts the open windows whose rest lies in its range."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.stacks: dict[int, list[int]] = {}

    def add(self, rest: int, window: int) -> None:
        self.stacks.setdefault(rest, []).append(window)
        at = rest + self.size
        while at:
            self.count[at] += 1
            at >>= 1

    def take_tightest(self, need: int) -> tuple[int, int] | None:
        """Remove and return (rest, window) of the open window with the smallest rest of at least ``need``."""
        at = need + self.size
        while not self.count[at]:
            while at & 1:  # right children have nothing to their right under the same parent
                at >>= 1
                if at <= 1:
                    return None
            at += 1
        while at < self.size:
            at = 2 * at if self.count[2 * at] else 2 * at + 1
        rest = at - self.size
        window = self.stacks[rest].pop()
        while at:
            self.count[at] -= 1
            at >>= 1
        return rest, window


def fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of every length, longest first, each into the tightest open window that holds it."""
    windows, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, opened = OpenWindows(capacity), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        found = tree.take_tightest(length)
        rest, window = found if found else (capacity, opened)
        opened += not found
        windows[i], offsets[i] = window, capacity - rest
        if rest > length:
            tree.add(rest - length, window)
    return windows, offsets


def best_fit_decreasing(parts: DataFrame, length: str = "length", capacity: int = WINDOW, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``parts`` with sequence_id and offset: rows of 1 to ``capacity`` tokens placed into sequences, gapless from offset 0.

    Columns of these names in ``parts`` are replaced. ``parts`` is written first, which fixes the random groups.
    """
    kept = [c for c in parts.columns if c not in ("sequence_id", "offset", "_row", "_group")]
    held = common.stored(parts.select(*kept).withColumn("_row", F.monotonically_increasing_id()), "parts")
    groups = max(1, -(-held.count() // group_rows))
    schema = T.StructType([*[held.schema[c] for c in kept], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_row")
        windows, offsets = fit_decreasing(rows.column(length).to_numpy(), capacity)
        numbers = (rows.column("_group")[0].as_py() << 32) + windows
        return rows.select(kept).append_column("sequence_id", pa.array(numbers)).append_column("offset", pa.array(offsets))

    grouped = held.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)))
    return grouped.groupBy("_group").applyInArrow(place, schema)


def packed(docs: DataFrame, vocabulary: str, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    digest = token_pieces(docs, vocabulary, window).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens"
    )
    return best_fit_decreasing(digest, "length", window)


def padding(placed: pd.DataFrame, capacity: int = WINDOW) -> int:
    """Padding tokens of placed pieces: sequences are padded to ``capacity``, except at a power of two."""
    used = placed.groupby("sequence_id")["length"].sum()
    return int((capacity - used[(used & (used - 1)) != 0]).sum())
