"""Quality rules of documents and of the hosts they come from, in DataFrame functions alone.

Each whole text is measured in place with array functions, so its windows and lines never leave the row. Words are runs of
characters other than the ASCII blanks. Hosts (here: sources) are then judged by the share of their documents that fail
any rule: the shares of all hosts give an empirical beta prior by moments, each host's share is shrunk towards it, and a
host whose shrunk share exceeds `HOST_LIMIT` loses all its documents.

Null and empty texts have no words and fail. Documents without a host share one host. Repeated rows count each. An empty
table gives none. Other columns don't matter: only id, text and host are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.skew import join_counted
from plumbline.session import settle

BLANKS = "\t\n\x0b\x0c\r "
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Percent of words that may stand in repeated three-word windows.
REPEAT_PERCENT = 50
#: Percent of a document's words that symbols may number, and of lines that may be copies, before it counts against its host.
HOST_SYMBOL_PERCENT = 50
HOST_LINE_PERCENT = 60
#: A host is dropped when its shrunk share of failing documents exceeds this: clearly more than half must fail, so that a
#: host loses its good documents only where they are the smaller part.
HOST_LIMIT = 0.6
#: Bounds of the prior's strength in documents.
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 10_000.0
#: Low bits that hold a window's place where hashes and places are sorted as one number.
PLACE_BITS = 20


def chars_in(text: Column, characters: str) -> Column:
    """How many characters of the text are among those given."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def covered_words(starts: Column) -> Column:
    """Words in three-word windows that begin at these ascending places."""
    gaps = F.transform(starts, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(starts, i + 1) - p, F.lit(3))).cast("long"))
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines of each document."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    trimmed = F.btrim(text, F.lit(BLANKS))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(host_col).cast("string").alias("host"),
        F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+", -1)).alias("words"),
        lines.alias("lines"),
        (F.length(text) - chars_in(text, BLANKS)).cast("long").alias("word_chars"),
        chars_in(text, SYMBOLS).cast("long").alias("n_symbols"),
    )
    words = F.col("words")
    counted = base.select(
        "doc_id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.when(F.size("words") >= 4, F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))).otherwise(F.array().cast("array<bigint>")).alias("windows"),
    )
    # One primitive sort brings equal windows together: the hash's low bits above, the place below; neighbours are then
    # compared by the whole hash. Texts with more windows than places fit take a sort of (hash, place) pairs.
    windows = F.col("windows")
    small = F.size("windows") < (1 << PLACE_BITS)
    keyed = counted.withColumn("keyed", F.when(small, F.sort_array(F.transform(windows, lambda h, i: F.shiftleft(h, PLACE_BITS).bitwiseOR(i.cast("long"))))).otherwise(F.array().cast("array<bigint>")))
    keys = F.col("keyed")
    mask = (1 << PLACE_BITS) - 1

    def same(a: Column, b: Column) -> Column:
        return F.coalesce((F.shiftright(a.bitwiseXOR(b), PLACE_BITS) == 0) & (F.get(windows, a.bitwiseAND(F.lit(mask)).cast("int")) == F.get(windows, b.bitwiseAND(F.lit(mask)).cast("int"))), F.lit(False))

    repeated = F.filter(keys, lambda a, i: same(a, F.get(keys, i - 1)) | same(a, F.get(keys, i + 1)))
    few = keyed.withColumn("starts", F.sort_array(F.transform(repeated, lambda a: a.bitwiseAND(F.lit(mask)).cast("int"))))
    pairs = F.when(small, F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    many = few.withColumn("pairs", pairs)
    sorted_pairs = F.col("pairs")
    alike = F.filter(sorted_pairs, lambda a, i: F.coalesce(a["h"] == F.get(sorted_pairs, i - 1)["h"], F.lit(False)) | F.coalesce(a["h"] == F.get(sorted_pairs, i + 1)["h"], F.lit(False)))
    placed = many.withColumn("starts", F.when(small, F.col("starts")).otherwise(F.sort_array(F.transform(alike, lambda a: a["i"]))))
    return placed.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", covered_words(F.col("starts")).alias("n_repeat_words"))


def host_verdicts(measured: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """host, n_docs, n_failed, shrunk_rate, host_dropped; `measured` also has `failed`."""
    hosts = measured.groupBy("host").agg(F.count("*").alias("n_docs"), F.count_if("failed").alias("n_failed")).withColumn("rate", F.col("n_failed") / F.col("n_docs"))
    moments = hosts.agg(
        (F.sum("n_failed") / F.sum("n_docs")).alias("mean"),
        (F.sum(F.col("n_docs") * F.col("rate") * F.col("rate")) / F.sum("n_docs")).alias("square"),
        (F.count("*") / F.sum("n_docs")).alias("noise"),
    ).first()  # one row, whatever the number of hosts
    mean = moments["mean"] or 0.0
    between = (moments["square"] or 0.0) - mean * mean - mean * (1 - mean) * (moments["noise"] or 0.0)  # beyond what counting explains
    strength = MOST_STRENGTH if between <= 0 else min(max(mean * (1 - mean) / between - 1, LEAST_STRENGTH), MOST_STRENGTH)
    shrunk = (F.col("n_failed") + F.lit(strength * mean)) / (F.col("n_docs") + F.lit(strength))
    return hosts.select("host", "n_docs", "n_failed", shrunk.alias("shrunk_rate"), (shrunk > limit).alias("host_dropped"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of each document."""
    measured = measure(docs, id_col, text_col, host_col)
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    other = (100 * F.col("n_symbols") > HOST_SYMBOL_PERCENT * F.col("n_words")) | (100 * F.col("n_dup_lines") > HOST_LINE_PERCENT * F.col("n_lines"))
    settled = settle(measured.withColumn("base_failed", base_failed).withColumn("failed", base_failed | other))
    named = F.coalesce(F.concat(F.lit("="), F.col("host")), F.lit("")).alias("named")  # no host is a host too
    verdicts = host_verdicts(settled).select(named, "host_dropped", F.col("n_docs").alias("n"))
    joined = join_counted(settled.select("*", named), settle(verdicts), ["named"])
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~F.col("host_dropped")).alias("kept"))


def judge_sections(docs: DataFrame) -> DataFrame:
    """The same with sections of documents of like size (quarters of a doubling of `n_chars`) in place of hosts: where most of a
    section's documents fail, the others go too."""
    return judge(docs.withColumn("section", F.floor(4e0 * F.log2(F.greatest(F.col("n_chars"), F.lit(1)))).cast("string")), host_col="section")


JUDGE_SQL = r"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, a, b, c) AS k FROM g) WHERE k > 1),
p AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM r) GROUP BY doc_id),
m AS (SELECT w.doc_id, host, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(len(ls) AS BIGINT) AS n_lines,
  CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN p ON p.doc_id = w.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
x AS (SELECT *, base_failed OR 100 * n_symbols > 50 * n_words OR 100 * n_dup_lines > 60 * n_lines AS failed FROM f),
h AS (SELECT host, count(*) AS n, count(*) FILTER (WHERE failed) AS k FROM x GROUP BY host),
s AS (SELECT sum(k) / sum(n) AS mean, sum(n * (k / n) * (k / n)) / sum(n) AS square, count(*) / sum(n) AS noise FROM h),
b AS (SELECT mean, square - mean * mean - mean * (1 - mean) * noise AS v FROM s),
q AS (SELECT mean, CASE WHEN v <= 0 THEN 1e4 ELSE least(greatest(mean * (1 - mean) / v - 1, 2e0), 1e4) END AS strength FROM b),
z AS (SELECT host FROM h, q WHERE (k + strength * mean) / (n + strength) > 6e-1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT EXISTS (SELECT 1 FROM z WHERE z.host IS NOT DISTINCT FROM x.host) AS kept FROM x
"""
SECTIONS_SQL = JUDGE_SQL.replace("source AS host", "CAST(CAST(floor(4e0 * log2(greatest(n_chars, 1))) AS BIGINT) AS VARCHAR) AS host")
