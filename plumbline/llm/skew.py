"""Joins on keys of which a few may hold a large share of all rows.

The hottest keys, at most `MOST_HOT` of them, go to all tasks; their rows stay where they are. A key that isn't among the
`MOST_HOT` hottest has at most that fraction of all rows, so the shuffle join of the rest has no hot key left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import settle

MOST_HOT = 10_000
#: Keys of fewer rows are never hot.
HOT_ROWS = 200


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """Inner join of rows with `counted`: one row for each key, with the number `n` of rows that have it."""
    hot = settle(counted.where(F.col(n) > HOT_ROWS).orderBy(F.desc(n), *keys).limit(MOST_HOT))
    if not hot.limit(1).count():
        return rows.join(counted, keys)
    known = F.broadcast(hot.select(*keys))  # MOST_HOT rows at most
    cold = rows.join(known, keys, "left_anti").join(counted.join(known, keys, "left_anti"), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(cold)


#: Rows of a key that one copy of its partner serves.
SERVED_ROWS = 5_000


def served(rows: DataFrame, one: DataFrame, key: str, spread: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of an inner join on [key, __copy] of rows with `one`, whose rows may be large and aren't to be sent to all tasks:
    of a key's partner there are as many copies as its rows need, and the rows are dealt among them by the column `spread`."""
    counted = settle(rows.groupBy(key).agg(F.count("*").alias("__n")))
    copies = F.ceil(F.col("__n") / SERVED_ROWS).cast("long")
    dealt = join_counted(rows, counted, [key], "__n").withColumn("__copy", F.pmod(F.xxhash64(spread), copies)).drop("__n")
    partners = one.join(counted, key).withColumn("__copy", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1))).drop("__n")
    return dealt, partners
