"""Chat formatting with collapse of cumulative snapshots, in DataFrame functions alone.

Logs often hold a conversation many times, each time one turn longer. Every turn has a hash of its place and content; the
running exclusive-or of these is a hash of the turns so far. A conversation whose whole hash is a proper prefix's hash of
another one is a snapshot of it and goes by an anti-join; equal conversations leave the least id. What remains is rendered.

Turns are ordered by number (none: last), then role, then the text's MD5. Rows that repeat a turn count once. Null roles
and texts are empty; rows without a conversation id are left out; an empty table gives none; other columns don't matter.
Places and running hashes are computed in blocks of turns and then across a conversation's blocks. Blocks are stretches of
turn numbers; where many turns share one number (or have none) a block is parted by number, role and the beginning of the
text's MD5, which keeps the order. Rendered text comes in parts of `PART_TURNS` turns, so a conversation of any length is
never gathered in one row or task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import settle

#: Turn numbers in a block of the running hash, and the rows beyond which a block is parted further.
BLOCK_TURNS = 1024
MOST_ROWS = 4096
#: Turns rendered into one row.
PART_TURNS = 256
LAST = 2**63 - 1


def numbered(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text with nulls settled as the module says."""
    return turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.coalesce(F.col(turn_col).cast("long"), F.lit(LAST)).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def placed_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, pos, total, first, second: places, turns of the conversation, running hashes."""
    keys = settle(turns.select("conv_id", "turn", "role", F.md5("text").alias("digest")).distinct().withColumn("span", F.floor(F.col("turn") / BLOCK_TURNS)))
    crowded = keys.groupBy("conv_id", "span").count().where(F.col("count") > MOST_ROWS).select("conv_id", "span", F.lit(True).alias("crowded"))
    finer = F.when(F.col("crowded"), F.struct("turn", "role", F.substring("digest", 1, 3).alias("digest")))
    keys = keys.join(crowded, ["conv_id", "span"], "left").withColumn("block", F.struct("span", finer.alias("finer"))).drop("span", "crowded")
    block = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "digest")
    across = Window.partitionBy("conv_id").orderBy("block")
    local = keys.withColumn("local", F.row_number().over(block) - 1)
    counts = local.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    starts = counts.select("conv_id", "block", (F.sum("n").over(across) - F.col("n")).alias("start"), F.sum("n").over(Window.partitionBy("conv_id")).alias("total"))
    placed = local.join(starts, ["conv_id", "block"]).withColumn("pos", F.col("start") + F.col("local")).drop("start", "local")
    hashed = placed.withColumn("a", F.xxhash64(F.lit(1), "pos", "role", "digest")).withColumn("b", F.xxhash64("digest", "role", "pos", F.lit(2)))
    inner = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    running = hashed.withColumn("first", F.bit_xor("a").over(inner)).withColumn("second", F.bit_xor("b").over(inner))
    sums = hashed.groupBy("conv_id", "block").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("conv_id", "block", F.coalesce(F.bit_xor("a").over(earlier), F.lit(0)).alias("carry_a"), F.coalesce(F.bit_xor("b").over(earlier), F.lit(0)).alias("carry_b"))
    return running.drop("a", "b").join(carried, ["conv_id", "block"]).select(
        "conv_id", "turn", "role", "digest", "pos", "total", F.col("first").bitwiseXOR(F.col("carry_a")).alias("first"), F.col("second").bitwiseXOR(F.col("carry_b")).alias("second")
    )


def maximal(placed: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies of the conversations that no other one continues, one of equal ones."""
    key = ["length", "first", "second"]
    ends = placed.withColumn("length", F.col("pos") + 1)
    whole = ends.where("length = total").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    prefixes = ends.where("length < total").select(*key).distinct()
    return whole.join(prefixes, key, "left_anti").select("conv_id", F.col("length").alias("n_turns"), "n_copies")


def render(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, part, n_turns, n_copies, rendered: the maximal conversations in `PART_TURNS` turns a row."""
    rows = numbered(turns, conv_col, turn_col, role_col, text_col)
    placed = settle(placed_turns(rows))
    kept = maximal(placed)
    places = placed.join(kept, "conv_id").select("conv_id", "turn", "role", "digest", "pos", "n_turns", "n_copies")
    line = F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>\n"))
    segments = rows.withColumn("digest", F.md5("text")).join(places, ["conv_id", "turn", "role", "digest"]).select("conv_id", "pos", "n_turns", "n_copies", F.floor(F.col("pos") / PART_TURNS).alias("part"), line.alias("line"))
    parts = segments.groupBy("conv_id", "part").agg(F.min("n_turns").alias("n_turns"), F.min("n_copies").alias("n_copies"), F.array_sort(F.collect_set(F.struct("pos", "line"))).alias("lines"))
    return parts.select("conv_id", "part", "n_turns", "n_copies", F.array_join(F.col("lines.line"), "").alias("rendered"))


RENDER_SQL = """
WITH t AS (SELECT DISTINCT conv_id, coalesce(turn, 9223372036854775807) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, md5(text)) - 1 AS pos FROM t),
s AS (SELECT conv_id, list(role || chr(31) || text ORDER BY pos) AS l FROM p GROUP BY conv_id),
x AS (SELECT DISTINCT l[1:k] AS l FROM (SELECT l, unnest(range(1, len(l))) AS k FROM s)),
f AS (SELECT l, min(conv_id) AS conv_id, count(*) AS n_copies FROM s GROUP BY l),
k AS (SELECT conv_id, n_copies, CAST(len(l) AS BIGINT) AS n_turns FROM f WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.l = f.l))
SELECT p.conv_id, CAST(pos // 256 AS BIGINT) AS part, n_turns, n_copies, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY pos) AS rendered
FROM p JOIN k ON p.conv_id = k.conv_id GROUP BY p.conv_id, pos // 256, n_turns, n_copies
"""
