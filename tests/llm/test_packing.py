import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seriesloom.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_encoder_equals_tokenizer(tokenizer, odd_rows):
    rnd = random.Random(1)
    odd = [
        "It's a TEST, don't!! ﬁne İstanbul ΣΑΣ naïve 12,345.67 <|endoftext|> x",
        "a\x1cb\x1d  c d e",
        "Eté café ÀÉ ẞ ß ǅ",
        "日本語 text 🙂🙂 ok",
        "a\x00b\x85c ﻿bom 's 's'S they'RE I'LL",
    ]
    odd += ["".join(rnd.choice("abcdeÀé ßσΣİ́​\x1c\x85\t\n'\"12.,!<|>🙂日Ⅷ½ªº") for _ in range(50)) for _ in range(300)]
    words = packing.WordEncoder(PATH)
    for text in [*odd, *(r[1] or "" for r in odd_rows)]:
        assert words.encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_every_sign_up_to_latin_extended(tokenizer):
    rnd = random.Random(6)
    signs = [chr(c) for c in range(0x180)]
    words = packing.WordEncoder(PATH)
    texts = [f"{a}{x}{b}" for x in signs for a, b in (("", ""), ("a", "b"), ("", "Ês"), ("é", ","), ("1 ", " 2"))]
    texts += ["".join(rnd.choice(signs) for _ in range(40)) for _ in range(1500)]
    for text in texts:
        assert words.encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, ascii(text)


def test_encoder_forgets(monkeypatch, tokenizer):
    monkeypatch.setattr(packing, "CACHE_WORDS", 5)
    words = packing.WordEncoder(PATH)
    text = " ".join(f"word{i} again" for i in range(40))
    assert words.encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert len(words.chunks) <= 5


@pytest.mark.parametrize("window", [64, 2048])
def test_round_trip(odd_docs, odd_rows, tokenizer, window):
    docs = odd_docs.withColumn("start", F.lit(9)).withColumn("sequence_id", F.lit(1)).withColumn("length", F.lit(2))
    rows = packing.packed(docs, PATH, window).toPandas()
    want = []
    for r in odd_rows:
        ids = np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(r[0], at, len(ids[at : at + window]), zlib.crc32(ids[at : at + window].tobytes()), len(ids)) for at in range(0, len(ids), window)]
    got = [(None if np.isnan(k) else int(k), *v) for k, *v in rows[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].itertuples(index=False, name=None)]
    exact = {k for k in got if k[0] is None or abs(k[0]) < 2**53}
    assert sorted(map(str, exact)) == sorted(str(w) for w in set(want) if w[0] is None or abs(w[0]) < 2**53)
    assert len(got) == len(want)
    for _, sequence in rows.sort_values("offset").groupby("sequence_id"):
        assert sequence["offset"].tolist() == [0, *np.cumsum(sequence["length"])[:-1]]
        assert sequence["length"].sum() <= window


def test_tightest_window_wins():
    windows, offsets = packing.fit_decreasing(np.array([60, 50, 45, 40, 30, 10, 5]), 100)
    assert windows.tolist() == [0, 1, 1, 0, 2, 2, 1] and offsets.tolist() == [0, 0, 50, 60, 0, 30, 95]


def test_segment_tree_equals_plain_best_fit():
    rnd = random.Random(4)
    lengths = np.array([rnd.randrange(1, 257) for _ in range(700)])
    windows, _ = packing.fit_decreasing(lengths, 256)
    rests: list[int] = []
    for i in np.argsort(-lengths, kind="stable"):
        fitting = [(r, w) for w, r in enumerate(rests) if r >= lengths[i]]
        if fitting:
            assert rests[windows[i]] == min(fitting)[0]
        else:
            assert windows[i] == len(rests)
            rests.append(256)
        rests[windows[i]] -= lengths[i]


def test_little_padding(spark):
    rnd = random.Random(2)
    parts = spark.createDataFrame([(i, min(2048, int(rnd.expovariate(1 / 700)) + 1)) for i in range(5000)], "part long, length long")
    placed = packing.best_fit_decreasing(parts, group_rows=1500).toPandas()
    assert len(placed) == 5000 and placed["part"].nunique() == 5000
    assert packing.padding(placed) < 0.02 * placed["length"].sum()


def test_empty_table(no_docs):
    assert packing.packed(no_docs, PATH).collect() == []
