"""Each stage of the pipeline against a plain version of its decision, on one small table."""

import random
from collections import Counter

import public_tokenizers
import pytest
from brute import near_documents, repeated_bytes, shingle_set
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline as cp
from seriesloom.llm import common, mixing, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
INSULTS = ["stupid", "idiot", "scum", "trash"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(9)
    passage = " ".join(f"shared{rnd.randrange(90)}" for _ in range(70))
    rows, labels = [], []
    for i in range(240):
        words = [f"w{rnd.randrange(4000)}" for _ in range(rnd.randrange(5, 160))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(INSULTS))
        if i % 11 == 1:
            words = words[:30] + passage.split() + words[30:]
        rows.append((i, " ".join(words), ["en", "fr"][i % 2], f"src{min(i % 9, 3)}", None))
        labels.append((i, 1, int(toxic)))
    rows += [(300 + k, rows[k][1] + " added", "en", "src0", None) for k in range(1, 40, 3)]
    rows += [rows[2], (None, "no id here " + rows[3][1], "en", None, None), (400, None, None, "src1", None), (401, "", "en", "src1", None)]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), rows


def values(df):
    return Counter(str(tuple(r)[:4]) for r in df.collect())


def test_stages(spark, corpus):
    path, rows = corpus
    docs = common.table(spark, path, "documents")
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_copies", "repeats", "mixing", "packing"]

    clean = common.stored(cp.STAGES[0][1](spark, docs, path), "clean")
    assert clean.columns == docs.columns
    model = toxicity.trained(docs, common.table(spark, path, "labels"))
    lexicon = toxicity.Lexicon(model.terms)
    want = Counter(str(r[:4]) for r in rows if model.score(lexicon, r[1]) < 0.5)
    assert values(clean) == want
    assert sum(any(w in (r[1] or "").split() for w in INSULTS) for r in rows) - len(rows) + clean.count() == 0

    alone = common.stored(cp.STAGES[1][1](spark, clean, path), "alone")
    before = [tuple(r) for r in clean.collect()]
    classes = near_documents([(r[0], r[1]) for r in before])
    assert alone.columns == docs.columns
    kept = [tuple(r) for r in alone.collect()]
    assert sum(bool(shingle_set(r[1])) for r in kept) == len({c for _, n, c in classes if n})
    assert sum(not shingle_set(r[1]) for r in kept) == sum(not shingle_set(r[1]) for r in before)
    assert set(map(str, kept)) <= set(map(str, before))
    after = near_documents([(r[0], r[1]) for r in kept])
    assert all(n == 0 or c == k for k, n, c in after)

    cut = common.stored(cp.STAGES[2][1](spark, alone, path), "cut")
    texts = {r[0]: r[1] for r in kept}
    removed = dict(zip(texts, repeated_bytes(list(texts.values())), strict=True))
    assert cut.columns == docs.columns and cut.count() == len(kept)
    for r in cut.collect():
        size, gone, _, _ = removed[r.doc_id]
        assert len((r.text or "").encode()) == size - gone
        assert r.n_chars == (None if r.text is None else len(r.text))

    mixed = common.stored(cp.STAGES[3][1](spark, cut, path), "mixed")
    chance = {r.doc_id: (r._probability, r._kept) for r in mixing.mixed(cut).collect()}
    assert mixed.columns == docs.columns
    assert {r.doc_id for r in mixed.collect()} == {k for k, (_, keep) in chance.items() if keep}

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    packed = cp.STAGES[4][1](spark, mixed, path).toPandas()
    total = sum(len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in mixed.collect())
    assert packed["length"].sum() == total and packed.groupby("sequence_id")["length"].sum().max() <= 2048


@pytest.mark.parametrize("stage", [n for n, _ in cp.STAGES])
def test_stages_keep_user_columns(spark, corpus, stage):
    path, _ = corpus
    names = ["score", "predicted", "_key", "_text", "_rate", "_kept", "_text_key", "_text_hash", "_copy", "_all", "_id", "set", "token", "row", "tokens", "start", "length", "sequence_id", "_row", "root"]
    docs = common.table(spark, path, "documents")
    wide = docs.drop("n_chars").withColumns({c: F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in names})
    out = dict(cp.STAGES)[stage](spark, wide, path)
    rows = out.collect()
    assert rows
    if stage != "packing":
        assert out.columns == wide.columns
        assert all(r[c] == f"{c} of {'none' if r.doc_id is None else r.doc_id}" for r in rows for c in names)
        plain = dict(cp.STAGES)[stage](spark, docs, path)
        assert Counter(str((r.doc_id, r.text)) for r in plain.collect()) == Counter(str((r.doc_id, r.text)) for r in rows)


def test_run_is_the_stages(spark, corpus):
    path, _ = corpus
    one = entry.queries()["pipeline"](spark, path).toPandas()
    assert one["length"].sum() > 0 and one["offset"].min() == 0
    docs = common.table(spark, path, "documents")
    for name, stage in cp.STAGES:
        docs = common.stored(stage(spark, docs, path), name)
    two = docs.toPandas()
    key = ["doc_id", "start", "length", "ids_crc32"]
    assert sorted(map(str, one[key].itertuples(index=False))) == sorted(map(str, two[key].itertuples(index=False)))


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []


def test_contract():
    runs, sql = entry.queries(), entry.oracle_sql()
    assert "pipeline" in runs and [sum(n.startswith(f"op{k}_") for n in runs) for k in range(1, 14)] == [1] * 13
    assert set(sql) <= set(runs)
