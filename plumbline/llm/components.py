"""Connected components of links by alternating star steps, all in DataFrame operations.

Every step points a vertex's neighbours to the least vertex around it; the number of rounds follows the logarithm of the
number of vertices. No list of neighbours is ever gathered: a vertex with very many links only has a minimum taken over
them, which is sent to where they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.skew import join_counted
from plumbline.session import settle

#: Fewer links are no matter in one task.
MANY_LINKS = 50_000


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 20)))).first())


def _met(edges: DataFrame, least: DataFrame, many: bool) -> DataFrame:
    return join_counted(edges, least, ["u"]) if many else edges.join(least, "u")


def _large(edges: DataFrame, many: bool) -> DataFrame:
    """Neighbours above a vertex point to the least one around it."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
    return _met(both.where("v > u"), least, many).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame, many: bool) -> DataFrame:
    """A vertex and its neighbours below point to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = _met(down, least, many).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, component): every linked vertex other than the least of its component, with that least one."""
    edges = settle(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    before = _fingerprint(edges)
    while before[0]:
        edges = settle(_small(_large(edges, before[0] > MANY_LINKS), before[0] > MANY_LINKS))
        now = _fingerprint(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
