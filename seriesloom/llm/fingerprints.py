"""Document fingerprints after the I-Match method, in DataFrame functions only.

Terms are words in lower case. The lexicon keeps those whose inverse document frequency lies in a band; it is cut into
randomised subsets of two sizes by a hash of the term. A document's fingerprint has one part per subset: the hash of its sorted distinct terms
there, or a blank. Two fingerprints are alike by the share of equal parts among those that are not blank in both.

Documents of at most ``SHORT`` different terms use all their terms; where no term is in a subset, all parts come from the hash of the text. The lexicon has at
most (mean terms of a document) x ``RARE`` terms, however many documents there are, so it is broadcast. NULL texts are empty ones. Order for the next
document: doc_id descending, NULL ids last, equal ids by a hash of the text; repeated rows follow each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from seriesloom.llm import common

COMMON = 8  # terms in more than 1 of 8 documents are too common: inverse document frequency below ln 8
RARE = 1100  # and those in fewer than 1 of 1100 too rare: above ln 1100
SHORT = 8
#: Cuts of the lexicon: classes that a term's hash falls in; the first 32 of each cut are its subsets. In short texts all terms fall in subsets of the first cut.
CUTS = (64, 512)
USED = 32
PARTS = USED * len(CUTS)
DIGITS = 4
BLANK = "-" * DIGITS
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS_PER_PARTITION = 4
SAMPLE_PER_BUCKET = 32
STRIDE = 64


def terms(text: Column) -> Column:
    """Distinct words of a text."""
    return F.array_remove(F.array_distinct(F.split(common.ascii_lower_col(text), NOT_WORD)), "")


def subset_code(term: Column, short: bool = False) -> Column:
    """Classes of a term in the cuts of the lexicon, from its hash, and which eight a class belongs to."""
    hashed = F.conv(F.substring(F.md5(term.cast("binary")), 1, 15), 16, 10).cast("long")
    first = F.pmod(hashed, F.lit(USED if short else CUTS[0])).cast("int")
    second = F.pmod(F.shiftright(hashed, CUTS[0].bit_length() - 1), F.lit(CUTS[1])).cast("int")
    return F.struct(first.alias("c0"), F.shiftright(first, 3).alias("e0"), second.alias("c1"), F.shiftright(second, 3).alias("e1"))


def lexicon(docs: DataFrame, text: str, common_share: int = COMMON, rare_share: int = RARE) -> DataFrame:
    """(term, code) of the terms inside the band that are in a subset."""
    counts = docs.select(F.explode(terms(F.coalesce(F.col(text), F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    total = docs.count()
    inside = counts.where((F.col("df") * common_share <= total) & (F.col("df") * rare_share >= total))
    return inside.select("term", subset_code(F.col("term")).alias("code")).where((F.col("code.c0") < USED) | (F.col("code.c1") < USED))


def _part(used: Column) -> Column:
    """Hash of sorted terms, or a blank."""
    joined = F.array_join(F.array_sort(F.transform(used, lambda x: x["term"])), " ")
    return F.when(F.size(used) == 0, F.lit(BLANK)).otherwise(F.substring(F.md5(joined.cast("binary")), 1, DIGITS))


def _cut_parts(found: Column, cut: int) -> Column:
    """Parts of one cut's subsets. Classes are taken out eight at a time first, so that a term is looked at some ten times."""
    eights = F.transform(F.sequence(F.lit(0), F.lit(USED // 8 - 1)), lambda g: F.filter(found, lambda x: x["code"][f"e{cut}"] == g))

    def of_eight(group: Column, g: Column) -> Column:
        return F.transform(F.sequence(g * 8, g * 8 + 7), lambda k: _part(F.filter(group, lambda x: x["code"][f"c{cut}"] == k)))

    return F.flatten(F.transform(eights, of_eight))


def parts(found: Column, own: Column) -> Column:
    """Fingerprint parts of an array of (term, code); ``own`` is the hash of the text."""
    second = F.filter(found, lambda x: x["code"]["c1"] < USED)
    cuts = F.concat(_cut_parts(found, 0), _cut_parts(second, 1))
    return F.when(F.size(found) == 0, F.array_repeat(F.substring(own, 1, DIGITS), PARTS)).otherwise(cuts)


def likeness(one: Column, two: Column) -> Column:
    pairs = F.zip_with(one, two, lambda x, y: F.when((x == BLANK) & (y == BLANK), F.lit(None)).otherwise((x == y).cast("int")))
    given = F.filter(pairs, lambda x: x.isNotNull())
    return F.when(F.size(given) == 0, F.lit(1.0)).otherwise(F.size(F.filter(given, lambda x: x == 1)) / F.size(given))


def _order_key(key: str, text: str) -> Column:
    return F.struct(F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("k"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"))


def _literal(keys: list[Row]) -> Column:
    return F.array(*(F.struct(F.lit(x["k"]).cast("long").alias("k"), F.lit(x["h"]).cast("long").alias("h")) for x in keys))


def _bucket(key: Column, splitters: list[Row]) -> Column:
    """How many splitters (in descending order) lie above the key: first in strides, then inside one."""
    if not splitters:
        return F.lit(0)
    whole = F.size(F.filter(_literal(splitters[STRIDE - 1 :: STRIDE]), lambda s: s > key)) if len(splitters) >= STRIDE else F.lit(0)
    rest = F.slice(_literal(splitters), whole * STRIDE + 1, STRIDE)
    return (whole * STRIDE + F.size(F.filter(rest, lambda s: s > key))).cast("int")


def in_order(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text, order, bucket, guard): rows dealt by ranges of the order, sampled splitters between them.

    Every bucket also holds a guard: a copy of the row that follows its last one, in the end the first row of all.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), _order_key(key, text).alias("order"))
    buckets = BUCKETS_PER_PARTITION * common.shuffle_count(spark)
    total = docs.count()
    every = max(1, total // (buckets * SAMPLE_PER_BUCKET))
    sample = sorted({r["order"] for r in rows.select("order").where(F.pmod(F.xxhash64("order"), F.lit(every)) == 0).distinct().collect()}, reverse=True)
    buckets = min(buckets, max(1, len(sample) // 4))
    splitters = sample[len(sample) // buckets :: max(1, len(sample) // buckets)][: buckets - 1]
    dealt = rows.withColumn("bucket", _bucket(F.col("order"), splitters))
    firsts = sorted((r["bucket"], r["first"]) for r in dealt.groupBy("bucket").agg(F.max("order").alias("first")).collect())
    following = [(b, firsts[(i + 1) % len(firsts)][1]) for i, (b, _) in enumerate(firsts)]
    after = spark.createDataFrame([(b, x["k"], x["h"]) for b, x in following] or [(0, 0, 0)], "bucket int, k long, h long")
    guards = rows.join(F.broadcast(after), (F.col("order.k") == F.col("k")) & (F.col("order.h") == F.col("h"))).dropDuplicates(["bucket"])
    columns = ["id", "text", "order", "bucket"]
    both = dealt.select(*columns, F.lit(False).alias("guard")).union(guards.select(*columns, F.lit(True).alias("guard")))
    return both.repartition(common.shuffle_count(spark), "bucket")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every document.

    The edited text has its last third replaced by the beginning of the next document.
    """
    order = Window.partitionBy("bucket").orderBy("guard", F.desc("order"))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    follower = F.coalesce(F.lead("text").over(order), F.lit(""))
    rows = in_order(docs, key, text).select("bucket", F.row_number().over(order).alias("row"), "id", "guard", "text", follower.alias("follower"))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("follower"), F.lit(1), third))
    rows = rows.select("bucket", "row", "id", "guard", n.cast("long").alias("n_chars"), F.explode(F.array(F.struct(F.lit(False).alias("edit"), F.col("text").alias("t")), F.struct(F.lit(True).alias("edit"), edited.alias("t")))).alias("v"))
    words = F.array_append(terms(F.col("v.t")), "")  # the empty term keeps every text in
    opened = rows.select(
        "bucket", "row", "id", "guard", "n_chars", F.col("v.edit").alias("edit"), F.md5(F.col("v.t").cast("binary")).alias("own"),
        F.when(F.col("v.edit"), F.sha2(F.col("v.t").cast("binary"), 256)).alias("sha"), words.alias("words"),
    ).select("*", (F.size("words") <= SHORT + 1).alias("short"), F.explode("words").alias("term")).drop("words")
    known = lexicon(docs, text)
    met = opened.join(F.broadcast(known), "term", "left").where("term = '' OR short OR code IS NOT NULL")
    used = F.when(F.col("term") != "", F.struct("term", F.when(F.col("short"), subset_code(F.col("term"), True)).otherwise(F.col("code")).alias("code")))
    once = F.col("term") == ""  # the texts' hashes travel with one row of each text only
    slim = met.select("bucket", "row", "id", "guard", "n_chars", "edit", used.alias("used"), F.when(once, F.col("own")).alias("own"), F.when(once, F.col("sha")).alias("sha"))
    plain, changed = ~F.col("edit"), F.col("edit")
    grouped = slim.groupBy("bucket", "row").agg(
        F.first("id").alias("id"), F.first("guard").alias("guard"), F.first("n_chars").alias("n_chars"), F.max("sha").alias("edited_sha256"),
        F.collect_list(F.when(plain, F.col("used"))).alias("found"), F.max(F.when(plain, F.col("own"))).alias("own"),
        F.collect_list(F.when(changed, F.col("used"))).alias("found_edited"), F.max(F.when(changed, F.col("own"))).alias("own_edited"),
    )
    marked = grouped.select("bucket", "row", "id", "guard", "n_chars", "edited_sha256", parts(F.col("found"), F.col("own")).alias("a"), parts(F.col("found_edited"), F.col("own_edited")).alias("b"))
    paired = marked.withColumn("c", F.lead("a").over(Window.partitionBy("bucket").orderBy("row"))).where(~F.col("guard"))
    return paired.select(
        F.col("id").alias(key), "n_chars", "edited_sha256", F.array_join("a", "").alias("fingerprint"), F.array_join("b", "").alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"),
    )


#: The same in SQL. Equal ids follow each other by a hash there is no SQL for; ids are unique in the tables.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents),
pairs AS (SELECT *, coalesce(lead(doc_id) OVER (ORDER BY doc_id DESC), max(doc_id) OVER ()) AS next_id FROM d),
edits AS (SELECT p.doc_id, p.next_id, p.n, p.t, substring(p.t, 1, p.n - p.n // 3) || substring(q.t, 1, p.n // 3) AS e FROM pairs p JOIN d q ON q.doc_id = p.next_id),
texts AS (SELECT doc_id, 0 AS v, t FROM edits UNION ALL SELECT doc_id, 1, e FROM edits),
words AS (SELECT doc_id, v, t, list_distinct(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM texts),
opened AS (SELECT doc_id, v, len(w) <= 8 AS short, unnest(w) AS term FROM words),
lex AS (SELECT term FROM opened WHERE v = 0 GROUP BY term HAVING count(*) * 8 <= (SELECT count(*) FROM documents) AND count(*) * 1100 >= (SELECT count(*) FROM documents)),
hashed AS (SELECT doc_id, v, term, short, ('0x' || substring(md5(term), 1, 15))::BIGINT AS h FROM opened WHERE short OR term IN (SELECT term FROM lex)),
used AS (SELECT doc_id, v, term, CASE WHEN short THEN h % 32 ELSE h % 64 END AS c0, (h >> 6) % 512 AS c1 FROM hashed WHERE short OR h % 64 < 32 OR (h >> 6) % 512 < 32),
classes AS (SELECT doc_id, v, term, c0 AS part FROM used WHERE c0 < 32 UNION ALL SELECT doc_id, v, term, 32 + c1 FROM used WHERE c1 < 32),
hashes AS (SELECT doc_id, v, part, substring(md5(string_agg(term, ' ' ORDER BY encode(term))), 1, 4) AS s FROM classes GROUP BY ALL),
grid AS (SELECT w.doc_id, w.v, g.part, CASE WHEN NOT EXISTS (SELECT 1 FROM used u WHERE u.doc_id = w.doc_id AND u.v = w.v) THEN substring(md5(w.t), 1, 4) ELSE coalesce(s, '----') END AS s
  FROM words w CROSS JOIN (SELECT unnest(range(64)) AS part) g LEFT JOIN hashes x ON x.doc_id = w.doc_id AND x.v = w.v AND x.part = g.part),
prints AS (SELECT doc_id, v, list(s ORDER BY part) AS p FROM grid GROUP BY ALL),
near AS (SELECT a.doc_id AS one, a.v AS v1, b.doc_id AS two, b.v AS v2,
    sum((a.s = b.s AND a.s <> '----')::INT) / sum((a.s <> '----' OR b.s <> '----')::INT)::DOUBLE AS near
  FROM (SELECT doc_id, doc_id AS other, 1 AS ov FROM edits UNION ALL SELECT doc_id, next_id, 0 FROM edits) l
  JOIN grid a ON a.doc_id = l.doc_id AND a.v = 0 JOIN grid b ON b.doc_id = l.other AND b.v = l.ov AND b.part = a.part GROUP BY ALL)
SELECT e.doc_id, e.n AS n_chars, sha256(e.e) AS edited_sha256, array_to_string(p.p, '') AS fingerprint, array_to_string(q.p, '') AS edited_fingerprint,
  m.near AS near_edited, x.near AS near_next
FROM edits e JOIN prints p ON p.doc_id = e.doc_id AND p.v = 0 JOIN prints q ON q.doc_id = e.doc_id AND q.v = 1
JOIN near m ON m.one = e.doc_id AND m.two = e.doc_id AND m.v2 = 1 JOIN near x ON x.one = e.doc_id AND x.two = e.next_id AND x.v2 = 0
"""
