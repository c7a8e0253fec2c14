"""Importance resampling towards a target distribution of hashed word features.

Every document's features (runs of one to `most_words` words) fall into `BUCKETS` buckets. Counts of all buckets over the
whole corpus and over the target texts give each bucket a gain, the logarithm of how much likelier it is in the target. The
gains are one literal array of `BUCKETS` numbers, whatever the corpus: scoring makes each document's bucket array with
higher-order functions and sums up the elements of the literal, so no document is exploded and no text is shuffled. What
shuffles is the buckets' totals, and then the few numbers of the documents that are drawn.

Gumbel noise that depends on the id alone is added to the scores, so the highest scores are a draw without replacement. Scores
are whole numbers in a range that doesn't follow the corpus (gains are logarithms of ratios of counts), so a table with a
row for each score says where the cut lies and how many documents are above each score; only documents of one score are
ordered among each other.

Words are runs of ASCII letters and digits and of any other characters beyond ASCII; only A to Z are lower-cased. Null and
empty texts have no features: weight 0, never drawn. Rows without an id have no score, aren't drawn and don't count among
the documents that are drawn from. Rows that repeat an id are documents of their own with the same noise; equal scores go
to the smaller id, of equal ids to the row with more features, and rows alike in all of these are interchangeable. With an
empty target, or an empty corpus, counts of 0 hold. Other columns, whatever their names, don't matter.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.checksums import CRC_TABLE_SQL, LOWER, UPPER, crc_sql
from plumbline.session import settle

BUCKETS = 10_000
#: Words of a feature at most, percent of the documents that are drawn, words that a document must have to be drawn.
MOST_WORDS, PERCENT, LEAST_WORDS = 1, 10, 20
SEED = 2024
#: What parts words, after lower-casing.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RESULT = ["doc_id", "n_features", "weight", "score", "rank"]


def words_of(text: Column) -> Column:
    """The words of a text; null has none."""
    plain = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    return F.filter(F.split(plain, BETWEEN), lambda w: w != "")


def buckets_of(words: Column, most_words: int = MOST_WORDS) -> Column:
    """The bucket of every feature: all runs of one to `most_words` words."""

    def runs(width: int) -> Column:
        if width == 1:
            features = words
        else:
            places = F.when(F.size(words) >= width, F.sequence(F.lit(1), F.size(words) - (width - 1))).otherwise(F.array().cast("array<int>"))
            features = F.transform(places, lambda i: F.array_join(F.slice(words, i, width), " "))
        return F.transform(features, lambda x: F.pmod(F.crc32(x.cast("binary")), F.lit(BUCKETS)).cast("int"))

    return F.concat(*(runs(n) for n in range(1, most_words + 1)))


def totals(docs: DataFrame, text_col: str, most_words: int = MOST_WORDS) -> np.ndarray:
    """How many features of all texts fall in each bucket."""
    counted = docs.select(F.explode(buckets_of(words_of(F.col(text_col)), most_words)).alias("bucket")).groupBy("bucket").count()
    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in counted.collect():  # BUCKETS rows at most
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of every bucket, from its counts in both, each with one more."""
    s_all, t_all = float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + BUCKETS) / ((s + 1) * (t_all + BUCKETS)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the id alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000e0) * F.log(-F.log((h + F.lit(0.5e0)) / F.lit(4294967296e0))))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, most_words: int = MOST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score of every document, and the rank of those that are drawn."""
    gain = F.lit(gains(totals(docs, text_col, most_words), totals(target, target_text, most_words)))
    words = docs.select(F.col(id_col).cast("long").alias("doc_id"), words_of(F.col(text_col)).alias("words"))
    hashed = words.select("doc_id", F.size("words").alias("n_words"), buckets_of(F.col("words"), most_words).alias("buckets"))
    summed = F.aggregate("buckets", F.lit(0).cast("long"), lambda a, b: a + F.element_at(gain, b + 1))
    weighed = hashed.select("doc_id", "n_words", F.size("buckets").cast("long").alias("n_features"), F.when(F.size("buckets") > 0, F.floor(summed / F.size("buckets"))).otherwise(F.lit(0)).cast("long").alias("weight"))
    scored = weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = settle(scored.withColumn("may", (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()))

    # a row for each score, with the number of documents above it; up to the one where the draw ends
    levels = scored.where("may").groupBy("score").agg(F.count("*").alias("n"))
    running = Window.orderBy(F.desc("score"))  # some ten thousand scores, whatever the corpus
    drawn = percent * (levels.agg(F.sum("n")).first()[0] or 0) // 100
    levels = levels.select("score", (F.sum("n").over(running.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("above")).where(F.col("above") < drawn)
    levels = settle(levels)
    cut = levels.agg(F.min("score")).first()[0]
    if cut is None:
        return scored.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    inside = F.col("may") & (F.col("score") >= cut)
    among = F.row_number().over(Window.partitionBy("score").orderBy("doc_id", F.desc("n_features"), "weight"))
    ranked = scored.where(inside).withColumn("among", among).join(F.broadcast(levels), "score").withColumn("rank", (F.col("above") + F.col("among")).cast("long"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.select(*RESULT).unionByName(scored.where(~inside).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))


RESAMPLE_SQL = rf"""
WITH {CRC_TABLE_SQL},
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
e AS (SELECT doc_id, unnest(ws) AS x FROM w),
y AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS x FROM benchmark),
v AS (SELECT x, {crc_sql("x")} % 10000 AS b FROM (SELECT x FROM e UNION SELECT x FROM y), ct),
s AS (SELECT b, count(*) AS s FROM e JOIN v USING (x) GROUP BY b),
t AS (SELECT b, count(*) AS t FROM y JOIN v USING (x) GROUP BY b),
a AS (SELECT CAST((SELECT count(*) FROM e) AS DOUBLE) AS sa, CAST((SELECT count(*) FROM y) AS DOUBLE) AS ta),
g AS (SELECT v.x, CAST(floor(1000 * ln((coalesce(t, 0) + 1) * (sa + 10000) / ((coalesce(s, 0) + 1) * (ta + 10000)))) AS BIGINT) AS gain FROM v LEFT JOIN s USING (b) LEFT JOIN t USING (b), a),
z AS (SELECT e.doc_id, sum(gain) AS total FROM e JOIN g USING (x) GROUP BY e.doc_id),
q AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_features, CASE WHEN len(ws) = 0 THEN 0 ELSE CAST(floor(CAST(total AS DOUBLE) / len(ws)) AS BIGINT) END AS weight,
  CAST('0x' || substr(sha256('2024:' || w.doc_id), 1, 8) AS BIGINT) AS h FROM w LEFT JOIN z ON z.doc_id = w.doc_id),
c AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM q),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS k, count(*) OVER () AS n FROM c WHERE n_features >= 20)
SELECT c.doc_id, c.n_features, c.weight, c.score, CASE WHEN r.k <= 10 * r.n // 100 THEN r.k END AS rank FROM c LEFT JOIN r ON r.doc_id = c.doc_id
"""
