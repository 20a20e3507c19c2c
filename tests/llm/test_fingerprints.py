import re
from hashlib import md5, sha256
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from seriesloom.llm import fingerprints as fp

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return set(WORD.findall("".join(c.lower() if c.isascii() else c for c in text)))


def brute(rows):
    """Rows of (id, text) to the result columns, plainly."""
    rows = [(k, t or "") for k, t in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0), reverse=True)
    df = {}
    for _, t in rows:
        for w in words(t):
            df[w] = df.get(w, 0) + 1
    lexicon = {w for w, n in df.items() if n * fp.COMMON <= len(rows) <= n * fp.RARE}

    def parts(text):
        found = words(text)
        short = len(found) <= fp.SHORT
        hashes = {w: int(md5(w.encode()).hexdigest()[:15], 16) for w in (found if short else found & lexicon)}
        cuts = [{w: h % (32 if short else 64) for w, h in hashes.items()}, {w: (h >> 6) % 512 for w, h in hashes.items()}]
        if all(c >= 32 for cut in cuts for c in cut.values()):
            return [md5(text.encode()).hexdigest()[: fp.DIGITS]] * fp.PARTS
        out = []
        for cut in cuts:
            for k in range(fp.USED):
                here = sorted((w for w in cut if cut[w] == k), key=lambda w: w.encode())
                out.append(md5(" ".join(here).encode()).hexdigest()[: fp.DIGITS] if here else fp.BLANK)
        return out

    def near(a, b):
        given = [(x, y) for x, y in zip(a, b, strict=True) if (x, y) != (fp.BLANK, fp.BLANK)]
        return sum(x == y for x, y in given) / len(given)

    result = []
    for at, i in enumerate(order):
        key, text = rows[i]
        follower = rows[order[(at + 1) % len(order)]][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + follower[:cut]
        a, b, c = parts(text), parts(edited), parts(follower)
        result.append((key, len(text), sha256(edited.encode()).hexdigest(), "".join(a), "".join(b), near(a, b), near(a, c)))
    return result


def test_odd_rows(odd_docs, odd_rows):
    rows = [(r[0], r[1]) for r in odd_rows if r[0] != 7]  # the order of equal ids is by a hash
    docs = odd_docs.where("doc_id IS NULL OR doc_id <> 7").withColumn("bucket", F.lit(1)).withColumn("row", F.lit(1)).withColumn("term", F.lit("x"))
    got = sorted(map(tuple, fp.fingerprints(docs).collect()), key=str)
    want = sorted(brute(rows), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5:] for g in got] == [pytest.approx(w[5:]) for w in want]


def test_many_buckets(spark):
    rows = [(i * 5 % 1001, f"text {i} of many words here and there a{i % 9} b{i % 40} c{i % 97} d e f g") for i in range(1001)]
    got = sorted(map(tuple, fp.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()))
    want = sorted(brute(rows))
    assert [g[:5] for g in got] == [w[:5] for w in want]


def test_repeated_rows(odd_docs, odd_rows):
    rows = fp.fingerprints(odd_docs).collect()
    assert len(rows) == len(odd_rows)
    by_text = {}
    for r in rows:
        if r.doc_id in (7, 8):
            by_text.setdefault("base", set()).add(r.fingerprint)
    assert len(by_text["base"]) == 1
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    first = [r for r in rows if r.doc_id == 7]
    assert len(first) == 2 and max(r.near_next for r in first) == 1.0


def test_one_and_no_row(spark, no_docs):
    (only,) = fp.fingerprints(spark.createDataFrame([(4, "abc def ghi")], "doc_id long, text string")).collect()
    assert only.near_next == 1.0 and only.n_chars == 11
    assert fp.fingerprints(no_docs).collect() == []


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="test tables absent")
def test_equals_sql(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}')")
    want = con.execute(fp.SQL).fetchall()
    got = fp.fingerprints(spark.read.parquet(path)).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect()
    assert sorted(map(tuple, got)) == sorted(want)
