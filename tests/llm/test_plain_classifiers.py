"""The classifying operators against plain versions of their rules, over whole texts."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from seriesloom.llm import common, langid, quality, toxicity

WORDS = {"en": "the river ran under old stone bridges while night was falling", "fr": "la rivière coulait sous les vieux ponts pendant que la nuit tombait", "de": "der fluß floss unter alten brücken während die nacht fiel", "el": "το ποτάμι έτρεχε κάτω από τις γέφυρες"}
RUDE = ["scum", "idiots", "trash"]


def remainder(key, parts):
    return None if key is None else zlib.crc32(str(key).encode()) % parts


@pytest.fixture(scope="module")
def corpus(spark, odd_rows):
    rnd = random.Random(12)
    rows, labels = list(odd_rows), []
    for i in range(260):
        lang = rnd.choice(sorted(WORDS))
        words = [rnd.choice(WORDS[lang].split()) for _ in range(rnd.randrange(3, 40))]
        toxic, good = int(i % 4 == 0), int(i % 3 != 0)
        if toxic:
            words += rnd.sample(RUDE, 2)
        if not good:
            words = [w.upper() + "!!" if k % 2 else w for k, w in enumerate(words)]
        rows.append((1000 + i, " ".join(words), lang, "s", None))
        labels.append((1000 + i, good, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows, labels


def plain_bundle(text, letters):
    total = np.zeros(letters.shape[1])
    for word in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split():
        codes = [0, *(ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % 37 for c in word), 0]
        for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
            total += np.roll(letters[a], 2).astype(float) * np.roll(letters[b], 1) * letters[c]
    return total


def test_language_equals_plain_profiles(corpus):
    docs, _, rows, _ = corpus
    letters = np.random.default_rng(11).choice(np.array([-1, 1], np.int8), (64, 1024))
    short = [r for r in rows if len(r[1] or "") < 4000]
    profiles = {}
    for key, text, lang, _, _ in rows:
        if key is not None and lang is not None and remainder(key, 4) != 2:
            profiles[lang] = profiles.get(lang, 0) + plain_bundle(text, letters)
    names = sorted(profiles)
    got = {}
    for r in langid.identify(docs).collect():
        got.setdefault(r.doc_id, []).append((r.lang_pred, r.score, r.held_out))
    for key, text, *_ in short:
        bundle = plain_bundle(text, letters)
        if not any(c.isalpha() for c in text or ""):
            want = ("und", 0.0)
        else:
            cosines = [float(profiles[n] @ bundle / np.linalg.norm(profiles[n]) / np.linalg.norm(bundle)) for n in names]
            want = (names[int(np.argmax(cosines))], min(max(max(cosines), 0.0), 1.0))
        for name, score, held in got[key]:
            assert (name, score) == (want[0], pytest.approx(want[1], abs=1e-6)) or key is None
            assert held == (remainder(key, 4) == 2)


def mix(value):
    return int(common.mixed(np.array([value % (1 << 64)], np.uint64))[0])


def plain_ngrams(text):
    """Buckets of the set of words and of runs of one to three shapes."""
    tokens = (text or "").split()
    both = [quality.Shapes()[t] for t in tokens]
    found, units = set(), []
    for i, b in enumerate(both):
        found.add(mix((b >> 16) + (1 << 50)))
        units.append(mix((b & 0xFFFF) * 2 + (i > 0 and b >> 16 == both[i - 1] >> 16) + (1 << 40)))
    pairs = [mix(a * 3 + b) for a, b in zip(units, units[1:], strict=False)]
    found |= {*units, *pairs, *(mix(p * 5 + u) for p, u in zip(pairs, units[2:], strict=False))}
    return sorted({h % quality.BUCKETS for h in found})


def plain_quality(rows):
    """(log ratios, weights, constant) over rows (buckets, label): smoothed count ratios, then dual coordinate descent on dictionaries."""
    counts = [Counter(), Counter()]
    for grams, y in rows:
        counts[y].update(grams)
    seen = counts[0].keys() | counts[1].keys()
    total = [sum(c.values()) + quality.BUCKETS for c in counts]
    ratio = {g: math.log((counts[1][g] + 1) / total[1] / ((counts[0][g] + 1) / total[0])) for g in seen}
    scaled = []
    for grams, _ in rows:
        norm = max(math.sqrt(sum(ratio[g] ** 2 for g in grams)), 1e-9)
        scaled.append({g: ratio[g] / norm for g in grams})
    share = sum(y for _, y in rows) / len(rows)
    weight, bias, alpha, order = Counter(), 0.0, [0.0] * len(rows), np.random.default_rng(3)
    for _ in range(quality.EPOCHS):
        largest = 0.0
        for i in order.permutation(len(rows)).tolist():
            sign, most = (1, quality.PENALTY * 0.5 / share) if rows[i][1] else (-1, quality.PENALTY * 0.5 / (1 - share))
            square = sum(v * v for v in scaled[i].values()) + 1
            gradient = sign * (sum(weight[g] * v for g, v in scaled[i].items()) + bias) - 1
            step = min(max(alpha[i] - gradient / square, 0.0), most) - alpha[i]
            if step:
                for g, v in scaled[i].items():
                    weight[g] += step * sign * v
                bias += step * sign
                alpha[i] += step
                largest = max(largest, abs(step))
        if largest < 1e-3:
            break
    return ratio, weight, bias


def plain_margin(model, grams):
    ratio, weight, bias = model
    norm = max(math.sqrt(sum(ratio.get(g, 0.0) ** 2 for g in grams)), 1e-9)
    return sum(weight[g] * ratio.get(g, 0.0) for g in grams) / norm + bias


def test_quality_equals_plain_fit_and_scores(corpus):
    docs, labels, rows, marks = corpus
    texts = {r[0]: r[1] for r in rows}
    learned = sorted((k, plain_ngrams(texts[k]), y) for k, y, _ in marks if remainder(k, 5) != 0)
    aside = [i % 5 == 0 for i in range(len(learned))]
    half = plain_quality([(g, y) for (_, g, y), a in zip(learned, aside, strict=True) if not a])
    y = np.array([v for (_, _, v), a in zip(learned, aside, strict=True) if a])
    margins = np.array([plain_margin(half, g) for (_, g, _), a in zip(learned, aside, strict=True) if a])
    slope, shift = quality.logistic_scale(margins, y)
    whole = plain_quality([(g, v) for _, g, v in learned])
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None or len(texts[r.doc_id] or "") > 4000 or sum(x[0] == r.doc_id for x in rows) > 1:
            continue
        want = 1 / (1 + math.exp(-(slope * plain_margin(whole, plain_ngrams(texts[r.doc_id])) + shift)))
        assert r.score == pytest.approx(want, abs=1e-6)
        assert r.predicted == int(r.score >= 0.3) and r.held_out == (remainder(r.doc_id, 5) == 0)


def plain_terms(text):
    found = set()
    for word in toxicity._WORD.findall((text or "").lower()):
        found |= {word, *(word[:n] + "*" for n in range(4, 9) if n <= len(word))}
    return found


def test_toxicity_equals_plain_lexicon_and_scores(corpus):
    docs, labels, rows, marks = corpus
    texts = {r[0]: r[1] for r in rows}
    learned = [(plain_terms(texts[k]), y) for k, _, y in marks if remainder(k, 5) != 0]
    n, toxic = Counter(), Counter()
    for terms, y in learned:
        n.update(terms)
        toxic.update(terms if y else ())
    rate = sum(y for _, y in learned) / len(learned)

    def part(seen, expected):
        return seen * math.log(seen / expected) if seen else 0.0

    counted = [t for t in n if n[t] >= toxicity.LEAST_ROWS]
    ties = {t: part(toxic[t], n[t] * rate) + part(n[t] - toxic[t], n[t] * (1 - rate)) for t in counted if toxic[t] >= toxicity.LEAST_ROWS and toxic[t] * (1 - rate) > toxicity.LEAST_ODDS * rate * (n[t] - toxic[t])}
    chosen = sorted((t for t in ties if ties[t] > math.log(len(counted))), key=lambda t: (-round(ties[t], 9), t))
    model = toxicity.trained(docs, labels)
    assert sorted(model.terms) == sorted(chosen) and set(RUDE) <= set(chosen)

    got = toxicity.classify(docs, labels).collect()
    assert len(got) == len(rows)
    weight = dict(zip([*model.terms, *toxicity.PATTERN_NAMES], model.weight, strict=True))
    for r in got:
        if r.doc_id is None or sum(x[0] == r.doc_id for x in rows) > 1:
            continue
        text = texts[r.doc_id]
        total = model.bias + sum(weight[t] for t in plain_terms(text) if t in weight) + sum(weight[p] for p, found in toxicity._PATTERNS.items() if text and found.search(text))
        assert r.score == pytest.approx(1 / (1 + math.exp(-min(max(total, -40), 40))), abs=1e-9)
        assert r.predicted == int(r.score >= 0.5)
    assert all(r.predicted for r in got if r.doc_id in range(1000, 1260, 4))
