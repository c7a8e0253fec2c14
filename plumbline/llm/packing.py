"""Best-fit packing of tokenised documents into fixed-length training sequences.

Method: the linear grouping scheme for bin packing. How many pieces there are of each length (at most `capacity` counts)
describes the whole packing problem, so only that histogram reaches the driver, whatever the size of the corpus:

1. lengths above a share of the capacity (`SCHEMES`) are sorted and dealt into groups of equal cardinality; each is rounded up to
   the largest of its group, which leaves few distinct sizes;
2. the configurations of these sizes are optimised by column generation (revised simplex over the configurations,
   knapsack by dynamic programming for new ones) and rounded down, what is left is put by best fit;
3. actual lengths take the rounded places, which frees the difference;
4. the remaining small lengths go by best fit, largest first, into the fullest sequence that still takes them.

The plan is a list of runs ("so many alike sequences with these lengths at these offsets"). Its size follows the number
of distinct lengths, not the number of documents. Pieces find their place by their rank among the pieces of their length;
the ranks are computed in buckets, so no length, however common, is gathered in one task.

Null and empty texts are documents of the end id alone. Repeated rows are documents of their own. An empty table gives no
rows. Only the id and text columns are read; other columns, whatever their names, don't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import wordtok
from plumbline.session import settle, ship_package

#: (Groups of the linear grouping, share of the capacity up to which lengths are small): the scheme runs with each pair
#: on the histogram, and the plan with the fewest sequences is taken.
SCHEMES = ((250, 4), (250, 3))
#: Pieces whose ranks are computed together, and buckets whose sums are.
RANK_BUCKET, BUCKET_RUN = 64, 1_000
#: Buckets up to this number have their sizes broadcast; more are joined by a shuffle.
MOST_BROADCAST = 200_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, tie long"


def cut_documents(docs: DataFrame, id_col: str, text_col: str, path: str, end_id: int, capacity: int) -> DataFrame:
    """One row per piece: documents' ids with `end_id` after them, cut every `capacity` ids where longer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = wordtok.load(path)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, offsets = tokens.encode(batch.column(1))
            doc, piece, start, length, crc = [], [], [], [], []
            keys = batch.column(0).to_pylist()
            tail = np.array([end_id], "<u4")
            for k, key in enumerate(keys):
                own = np.concatenate([ids[offsets[k] : offsets[k + 1]].astype("<u4"), tail])
                for n, at in enumerate(range(0, len(own), capacity)):
                    part = own[at : at + capacity]
                    doc.append(key)
                    piece.append(n)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            tie = (np.array(crc, np.int64) * 1_000_003 + np.array(start, np.int64)).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(tie, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32", "tie"])

    ship_package(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECES)


# ---------------------------------------------------------------------------------------------------- planning


@dataclass
class Run:
    """`count` alike sequences; `items`: their lengths in order; `room`: what is free in each."""

    count: int
    items: tuple[int, ...]
    room: int


def group_lengths(histogram: dict[int, int], groups: int) -> list[list[list[int]]]:
    """Large lengths, largest first, dealt into `groups` groups of equal cardinality: lists of [length, number]."""
    total = sum(histogram.values())
    size = max(1, -(-total // groups))
    dealt: list[list[list[int]]] = []
    room = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not room:
                dealt.append([])
                room = size
            take = min(left, room)
            dealt[-1].append([length, take])
            left -= take
            room -= take
    merged: list[list[list[int]]] = []
    for g in dealt:  # groups with one rounded size are one size
        if merged and merged[-1][0][0] == g[0][0]:
            for length, n in g:
                if merged[-1][-1][0] == length:
                    merged[-1][-1][1] += n
                else:
                    merged[-1].append([length, n])
        else:
            merged.append(g)
    return merged


def best_configuration(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes that fits and is worth most: unbounded knapsack, one more item in each step."""
    value = np.zeros(capacity + 1)
    taken: list[np.ndarray] = []
    for _ in range(capacity // int(sizes.min())):
        options = np.full((len(sizes) + 1, capacity + 1), -np.inf)
        options[-1] = value
        for g, s in enumerate(sizes):
            options[g, s:] = value[: capacity + 1 - s] + worth[g]
        choice = options.argmax(0)
        better = options.max(0)
        if np.all(better <= value + 1e-12):
            break
        choice[better <= value + 1e-12] = len(sizes)
        taken.append(choice)
        value = better
    counts, room = np.zeros(len(sizes), np.int64), capacity
    for choice in reversed(taken):
        g = choice[room]
        if g < len(sizes):
            counts[g] += 1
            room -= int(sizes[g])
    return float(worth @ counts), counts


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[list[tuple[np.ndarray, float]], float]:
    """Fractional optimum of "cover the demand by configurations": (configuration, how many) with few of them, and a
    lower bound of how many any cover takes (Farley's, from the duals), which they meet.

    Pivots go on until no configuration improves. Demands are moved apart by a billionth, so that no pivot is degenerate:
    each one gains and the search ends.
    """
    m = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    amount = demand * (1 + 1e-9 * (np.arange(1, m + 1) * 0.6180339887498949 % 1)) / np.diag(basis)
    while True:
        worth = np.maximum(np.linalg.solve(basis.T, np.ones(m)), 0)
        gain, column = best_configuration(sizes, worth, capacity)
        if gain <= 1 + 1e-7:
            break
        direction = np.linalg.solve(basis, column.astype(float))
        usable = direction > 1e-9
        if not usable.any():
            break
        ratios = np.where(usable, amount / np.where(usable, direction, 1), np.inf)
        leave = int(ratios.argmin())
        step = ratios[leave]
        if step <= 0:
            break
        amount = np.maximum(amount - step * direction, 0)
        amount[leave] = step
        basis[:, leave] = column
    chosen = [(basis[:, k].round().astype(np.int64), float(amount[k])) for k in range(m) if amount[k] > 1e-9]
    return chosen, float(worth @ demand) / max(gain, 1.0)


def place_large(histogram: dict[int, int], capacity: int, groups: int) -> list[Run]:
    """Steps 1 to 3 for the large lengths."""
    if not histogram:
        return []
    dealt = group_lengths(histogram, groups)
    sizes = np.array([g[0][0] for g in dealt], np.int64)
    demand = np.array([sum(n for _, n in g) for g in dealt], np.int64)
    stock = [[list(x) for x in g] for g in dealt]
    left = demand.copy()
    runs: list[Run] = []
    chosen, _ = configurations(sizes, demand.astype(float), capacity)
    for column, amount in sorted(chosen, key=lambda x: -x[1]):
        count = int(amount + 1e-6)
        if not column.sum():
            continue
        count = min([count, *(int(left[g]) // int(column[g]) for g in np.flatnonzero(column))])
        if count <= 0:
            continue
        slots = [g for g in np.flatnonzero(column) for _ in range(column[g])]
        left -= column * count
        while count:  # actual lengths take the places: runs end where a stretch of equal lengths ends
            heads = [0] * len(stock)
            want: dict[tuple[int, int], int] = {}
            picks = []
            for g in slots:  # slots of one group draw on one length as far as it reaches, else on the next
                if want.get((g, heads[g]), 0) + 1 > stock[g][heads[g]][1]:
                    heads[g] += 1
                want[g, heads[g]] = want.get((g, heads[g]), 0) + 1
                picks.append((g, heads[g]))
            n = min([count, *(stock[g][h][1] // k for (g, h), k in want.items())])
            items = tuple(sorted((stock[g][h][0] for g, h in picks), reverse=True))
            runs.append(Run(n, items, capacity - sum(items)))
            for (g, h), k in want.items():
                stock[g][h][1] -= k * n
            for g in range(len(stock)):
                stock[g] = [x for x in stock[g] if x[1]]
            count -= n
    rest: dict[int, int] = {}
    for g in stock:
        for length, n in g:
            rest[length] = rest.get(length, 0) + n
    return best_fit(runs, rest, capacity)


def best_fit(runs: list[Run], histogram: dict[int, int], capacity: int) -> list[Run]:
    """Largest first, each into the sequence with the least room that takes it; all alike pieces at once."""
    by_room: dict[int, list[Run]] = {}
    for r in runs:
        by_room.setdefault(r.room, []).append(r)
    rooms = np.zeros(capacity + 1, bool)
    rooms[[r for r in by_room]] = True
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            fitting = np.flatnonzero(rooms[length:])
            if len(fitting):
                room = int(fitting[0]) + length
                run = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room]
                    rooms[room] = False
            else:
                room = capacity
                run = Run(-(-left // (capacity // length)), (), capacity)
            each = room // length
            full = min(run.count, left // each)
            made = []
            if full:
                made.append(Run(full, run.items + (length,) * each, room - each * length))
                left -= full * each
            if full < run.count:
                spare = run.count - full
                if left:  # fewer than `each` are left if any sequence is
                    put = min(left, each)
                    made.append(Run(1, run.items + (length,) * put, room - put * length))
                    left -= put
                    spare -= 1
                if spare:
                    made.append(Run(spare, run.items, room))
            for r in made:
                by_room.setdefault(r.room, []).append(r)
                rooms[r.room] = True
    return [r for group in by_room.values() for r in group if r.items]


def plan_sequences(histogram: dict[int, int], capacity: int, schemes: tuple[tuple[int, int], ...] = SCHEMES) -> list[Run]:
    """All runs for a histogram of lengths (1 to capacity)."""
    plans = []
    for groups, share in schemes:
        border = capacity // share
        runs = place_large({k: n for k, n in histogram.items() if k > border and n}, capacity, groups)
        plans.append(best_fit(runs, {k: n for k, n in histogram.items() if k <= border and n}, capacity))
    return min(plans, key=lambda runs: sum(r.count for r in runs))


def places(runs: list[Run]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset): the rank-th piece of a length goes to first sequence + rank - first rank."""
    used: dict[int, int] = {}
    rows = []
    first = 0
    for r in runs:
        offset = 0
        for length in r.items:
            begin = used.get(length, 0)
            used[length] = begin + r.count
            rows.append((length, begin, begin + r.count, first, offset))
            offset += length
        first += r.count
    return rows


# ---------------------------------------------------------------------------------------------------- operator


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, path: str | None = None) -> DataFrame:
    """Rows of doc_id, piece, start, length, ids_crc32, sequence_id, offset for all documents (see the module's text)."""
    spark = docs.sparkSession
    pieces = settle(cut_documents(docs, id_col, text_col, path or wordtok.vocabulary_path(), end_id, capacity))
    found = pieces.groupBy("length").count().collect()  # at most `capacity` rows
    histogram = {r["length"]: r["count"] for r in found}
    rows = places(plan_sequences(histogram, capacity))
    dealt = [(length, -(-n // RANK_BUCKET)) for length, n in histogram.items()]
    buckets = F.broadcast(spark.createDataFrame(dealt, "length long, buckets long"))  # at most `capacity` rows
    bucketed = pieces.join(buckets, "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "tie"), F.col("buckets"))).drop("buckets")
    sizes = bucketed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    sizes = settle(sizes.withColumn("run", F.floor(F.col("bucket") / BUCKET_RUN)))  # a prefix sum in two levels: runs of buckets, and runs
    runs = sizes.groupBy("length", "run").agg(F.sum("n").alias("m"))
    runs = runs.select("length", "run", (F.sum("m").over(Window.partitionBy("length").orderBy("run")) - F.col("m")).alias("earlier"))
    inside = F.sum("n").over(Window.partitionBy("length", "run").orderBy("bucket")) - F.col("n")
    before = sizes.select("length", "run", "bucket", inside.alias("inside")).join(runs, ["length", "run"]).select("length", "bucket", (F.col("inside") + F.col("earlier")).alias("before"))
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "tie")
    ranked = (
        bucketed.withColumn("local", F.row_number().over(order) - 1)
        .join(F.broadcast(before) if sum(n for _, n in dealt) <= MOST_BROADCAST else before, ["length", "bucket"])
        .withColumn("rank", F.col("local") + F.col("before"))
        .drop("local", "before", "bucket", "tie")
    )
    return take_places(ranked, rows)


def take_places(ranked: DataFrame, rows: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """Look each piece's rank up in the plan, which has a size bound and travels with the task."""
    by_length: dict[int, tuple[np.ndarray, ...]] = {}
    if rows:
        ordered = np.array(sorted(rows), np.int64)
        for part in np.split(ordered, np.flatnonzero(np.diff(ordered[:, 0])) + 1):
            by_length[int(part[0, 0])] = tuple(part[:, k] for k in range(1, 5))
    plan = ranked.sparkSession.sparkContext.broadcast(by_length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for one in np.unique(length):
                mine = np.flatnonzero(length == one)
                begins, _, firsts, offsets = plan.value[int(one)]
                k = np.searchsorted(begins, rank[mine], "right") - 1
                sequence[mine] = firsts[k] + rank[mine] - begins[k]
                offset[mine] = offsets[k]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
