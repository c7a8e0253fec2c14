"""Spelling variants of words, grouped by a symmetric-delete join.

1. Runs of letters of all whole texts are counted; of rare words and short ones nothing is kept.
2. Every word emits itself and its distinct single deletions. Two words that differ by one inserted, deleted or replaced
   character share exactly one of these keys, so a plain equi-join meets every such pair once; words that only share a key
   (two edits apart) are ruled out by their distance. A key is shared by the words that one inserted character makes of
   it and no others: at most `LETTERS` times its length plus one, whatever the corpus.
3. A word's form is the near word that is most frequent, if that is at least `RATIO` times as frequent. Forms rise in
   frequency by this factor, so following them ends; roots are found by joining forms with themselves, which doubles the
   steps taken each time.

Only A to Z are lower-cased. To exercise the grouping on clean text, one in `ONE_IN` runs loses a character, as the checksum of
its document's id and the run says; `one_in=0` leaves all as they are. Runs of documents without an id stay whole. Null
and empty texts have no words; repeated rows count each; an empty table gives none. Of equally frequent near words the
smallest in code-point order is the form. Other columns, whatever their names, don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.checksums import CRC_TABLE_SQL, LOWER, UPPER, crc_sql
from plumbline.session import settle

#: Runs of these after lower-casing; so many letters there are.
RUN, LETTERS = r"[a-zÀ-ÿ]+", 90
LEAST_LENGTH, LEAST_COUNT, RATIO, ONE_IN = 5, 3, 2, 97


def without(word: Column, place: Column) -> Column:
    """The word less the character at a place (from 1)."""
    return F.concat(F.substring(word, F.lit(1), place - 1), F.substring(word, place + 1, F.length(word)))


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", one_in: int = ONE_IN) -> DataFrame:
    """word, n: words of at least `LEAST_LENGTH` characters and `LEAST_COUNT` occurrences."""
    plain = F.translate(F.col(text_col).cast("string"), UPPER, LOWER)
    runs = docs.select(F.col(id_col).cast("long").cast("string").alias("id"), F.explode(F.regexp_extract_all(plain, F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= LEAST_LENGTH)
    word = F.col("run")
    if one_in:
        h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
        word = F.when(F.pmod(h, F.lit(one_in)) == 0, without(word, F.pmod(h, F.length(word)).cast("int") + 1)).otherwise(word)
    counted = runs.select(word.alias("word")).where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= LEAST_COUNT)


def near_words(words: DataFrame) -> DataFrame:
    """word, n, near, near_n of every ordered pair of words (word, n) that differ by exactly one character."""
    deletions = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: without(F.col("word"), i))
    keyed = words.select("word", "n", F.explode(F.array_distinct(F.concat(F.array("word"), deletions))).alias("key"))
    a, b = keyed.alias("a"), keyed.alias("b")
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.word") != F.col("b.word")) & (F.levenshtein("a.word", "b.word", 1) == 1))
    return met.select(F.col("a.word").alias("word"), F.col("a.n").alias("n"), F.col("b.word").alias("near"), F.col("b.n").alias("near_n"))


def roots_of(forms: DataFrame) -> DataFrame:
    """word, root of all words that have a form (word, form)."""
    ahead_of = forms.select("word", F.col("form").alias("root"))
    done: DataFrame | None = None
    while True:
        known = ahead_of if done is None else ahead_of.unionByName(done)
        beyond = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = settle(ahead_of.join(beyond, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("open")))
        found = moved.where("NOT open").select("word", "root")
        done = found if done is None else done.unionByName(found)
        ahead_of = moved.where("open").select("word", "root")
        if not ahead_of.limit(1).count():
            return done


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", one_in: int = ONE_IN) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word."""
    words = settle(word_counts(docs, id_col, text_col, one_in))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best")
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best)
    named = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("best.less") >= RATIO * F.col("n"), F.col("best")).alias("best"))
    named = settle(named.select("word", "n", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n")))
    roots = roots_of(named.where("form IS NOT NULL").select("word", "form"))
    return named.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


VARIANTS_SQL = rf"""
WITH RECURSIVE {CRC_TABLE_SQL},
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-zÀ-ÿ]+')) AS run FROM documents),
tally AS (SELECT doc_id, run, count(*) AS k FROM runs WHERE length(run) >= 5 GROUP BY doc_id, run),
hashed AS (SELECT run, k, {crc_sql("doc_id || ':' || run")} AS h FROM tally, ct),
kept AS (SELECT k, CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM hashed),
words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM kept WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words),
cut AS (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS k FROM places),
near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.k = b.k AND a.p = b.p AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON w.word = c.k
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON w.word = c.k),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word),
named AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * w.n THEN other END AS form, CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
steps(word, root) AS (SELECT word, word FROM named UNION ALL SELECT s.word, m.form FROM steps s JOIN named m ON m.word = s.root WHERE m.form IS NOT NULL),
ends AS (SELECT s.word, s.root FROM steps s JOIN named m ON m.word = s.root WHERE m.form IS NULL)
SELECT word, n, n_near, form, form_n, root FROM named JOIN ends USING (word)
"""
