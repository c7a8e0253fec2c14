"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF weighted word shingles.

1. Equal word sequences are one class from the start; each is known by the document of the least id.
2. Document frequencies of shingles are counted over the distinct contents: over all documents first, and what copies of one
   content added is taken off again. Counts are kept in a table of `COUNTERS` counters (shingles share one where their
   hashes do; the mean of what others add is taken off), so memory doesn't follow the corpus. A shingle's weight is how
   often it stands in the text times its IDF, smoothed and damped: `IDF_FLOOR` of the weight doesn't depend on the IDF.
   Copies that differ in edits share shingles that are frequent for this very reason; else their edits would outweigh them.
3. Each class gets `SAMPLES` consistent weighted samples (Ioffe 2010), which agree between two documents with the
   probability of their weighted Jaccard similarity. Bands of `ROWS` samples are hashed; equal bands make candidates.
4. Every class is first compared with one head of its bands: the class that meets most others, and of such the least. In
   bands that then still hold several components, every pair of members of different components is compared: members are
   packed in blocks by size and component, pairs of blocks are the unit of work, and a block pair's similarities are
   matrix products that leave only the links. Nothing is capped.
5. Every link rests on the exact weighted Jaccard similarity of the whole texts, and links form components.

Words: runs of characters other than ASCII blanks, lower case, without punctuation at their ends. Fewer than five words
are one shingle. Texts without words (null, empty) are alike to nothing, not even each other. Rows without an id are left
out; repeated rows give repeated results. An empty table gives none. Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.bitmaps import bitmap_of, hits, packed_texts, unpack_texts
from plumbline.llm.components import components
from plumbline.llm.skew import join_counted, served
from plumbline.llm.trees import packed, sum_vectors, vector_batch
from plumbline.llm.wordsplit import content_codes, hashed_runs, mix
from plumbline.session import settle, ship_package

SHINGLE = 5
SIMILARITY = 0.8
SAMPLES, ROWS = 64, 4
#: Counters of document frequency.
COUNTERS = 1 << 21
#: Share of a shingle's weight that does not depend on its IDF.
IDF_FLOOR = 0.5
#: Added to document frequencies: below it they say little of how common words are, and much of how many copies a text has.
SMOOTHING = 100
#: Ids of 8 bytes that are sent to all tasks at most.
MOST_SENT = 1_000_000
#: Random draws (r, log c, beta) that hashes choose from.
DRAWS = 1 << 16

_rng = np.random.default_rng(20_240_229)
_R = -np.log(_rng.random(DRAWS) * _rng.random(DRAWS))
R = np.maximum(_R, 1e-3).astype(np.float32)
LOG_C = np.log(np.maximum(-np.log(_rng.random(DRAWS) * _rng.random(DRAWS)), 1e-9)).astype(np.float32)
BETA = _rng.random(DRAWS).astype(np.float32)
MULTIPLIERS = _rng.integers(1 << 62, 1 << 63, SAMPLES, dtype=np.uint64) | np.uint64(1)
POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(SHINGLE)], np.uint64)


# ------------------------------------------------------------------------------------------------- shingles


def shingle_codes(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of documents in the order of their words, and the documents' bounds among them."""
    sizes = np.diff(bounds)
    counts = np.where(sizes >= SHINGLE, sizes - SHINGLE + 1, np.minimum(sizes, 1))
    ends = np.concatenate([[0], np.cumsum(counts)])
    place = np.arange(ends[-1]) + np.repeat(bounds[:-1] - ends[:-1], counts)
    with np.errstate(over="ignore"):
        n = max(0, len(words) - SHINGLE + 1)
        code = np.zeros(max(n, len(words)), np.uint64)
        for k in range(SHINGLE):
            code[:n] += words[k : k + n] * POWERS[k]
        code[:n] = mix(code[:n] + np.uint64(SHINGLE))
        out = code[place] if len(place) else np.zeros(0, np.uint64)
        for d in np.flatnonzero((sizes > 0) & (sizes < SHINGLE)):
            width = int(sizes[d])
            own = (words[bounds[d] : bounds[d + 1]] * POWERS[:width]).sum(dtype=np.uint64)
            out[ends[d]] = mix(np.array([own + np.uint64(width)], np.uint64))[0]
    return out, ends


def add_frequencies(totals: np.ndarray, codes: np.ndarray, bounds: np.ndarray, times: np.ndarray | None = None) -> None:
    """Count every document (`times` over) at the counters of its distinct shingles."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    pairs = np.unique(owner * COUNTERS + (codes & np.uint64(COUNTERS - 1)).astype(np.int64))
    np.add.at(totals, pairs % COUNTERS, 1 if times is None else times[pairs // COUNTERS])


def shingle_weights(totals: np.ndarray, n: int) -> np.ndarray:
    """Damped IDF of every counter among n contents: IDF_FLOOR to 1, float32."""
    if n < 2:
        return np.ones(COUNTERS, np.float32)
    others = (totals.sum() - totals) / (COUNTERS - 1)  # what shingles of other hashes add to a counter in the mean
    idf = np.log((n + SMOOTHING) / (np.clip(totals - others, 1, n) + SMOOTHING)) / np.log((n + SMOOTHING) / (1 + SMOOTHING))
    return (IDF_FLOOR + (1 - IDF_FLOOR) * np.clip(idf, 0, 1)).astype(np.float32)


def weighed(codes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of one document and their weights."""
    distinct, count = np.unique(codes, return_counts=True)
    return distinct, count * weights[(distinct & np.uint64(COUNTERS - 1)).astype(np.int64)].astype(np.float64)


def shingles_of(words: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same from the hashes of its words."""
    return weighed(shingle_codes(words, np.array([0, len(words)]))[0], weights)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two documents' shingles."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = np.minimum(a[1][i], b[1][j]).sum()
    return float(shared / (a[1].sum() + b[1].sum() - shared))


def samples_of(codes: np.ndarray, logs: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Consistent weighted samples (documents x SAMPLES) of documents with one shingle at least each."""
    out = np.empty((len(bounds) - 1, SAMPLES), np.uint64)
    starts = bounds[:-1]
    place = np.arange(len(codes), dtype=np.int64)
    logs = logs.astype(np.float32)
    with np.errstate(over="ignore"):
        for k in range(SAMPLES):
            draw = ((codes * MULTIPLIERS[k]) >> np.uint64(48)).astype(np.int32)
            r, beta = R[draw], BETA[draw]
            t = np.floor(logs / r + beta)
            score = LOG_C[draw] - r * (t - beta + np.float32(1))
            key = ((score + np.float32(4096)) * np.float32(1 << 17)).astype(np.int64)
            least = np.minimum.reduceat((key << np.int64(32)) | (place & 0xFFFFFFFF), starts) & 0xFFFFFFFF
            out[:, k] = mix(codes[least] + t[least].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out


def bands_of(samples: np.ndarray) -> np.ndarray:
    """One hash of each band: documents x (SAMPLES / ROWS), int64."""
    with np.errstate(over="ignore"):
        code = np.zeros((len(samples), SAMPLES // ROWS), np.uint64)
        for k in range(ROWS):
            code = mix(code + samples[:, k::ROWS] * np.uint64(2 * k + 0x9E3779B97F4A7C15))
        return mix(code + np.arange(1, SAMPLES // ROWS + 1, dtype=np.uint64)).view(np.int64)


# ------------------------------------------------------------------------------------------------- operator

def survey(texts: DataFrame) -> DataFrame:
    """doc_id, c1 and c2 (content hashes; null without words) of every document, and from each task a row with `v`: the
    document frequencies of its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for begin, words, bounds in hashed_runs(batch.column(1)):
                add_frequencies(totals, *shingle_codes(words, bounds))
                codes = [content_codes(words[a:b]) if b > a else (None, None) for a, b in zip(bounds, bounds[1:])]
                ids = batch.column(0).slice(begin, len(codes))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([c[k] for c in codes], pa.int64()) for k in range(2)), pa.nulls(len(codes), pa.binary())], names=["doc_id", "c1", "c2", "v"])
        if totals.any():
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, pa.int64()) for _ in range(3)), pa.array([packed(totals)], pa.binary())], names=["doc_id", "c1", "c2", "v"])

    return texts.mapInArrow(run, "doc_id long, c1 long, c2 long, v binary")


def copies_frequencies(texts: DataFrame, copied: DataFrame) -> np.ndarray | None:
    """What the copies beyond the first of contents (doc_id, c1, n) added to the counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            c1, n = batch.column("c1").to_pylist(), batch.column("n").to_numpy()
            for begin, words, bounds in hashed_runs(unpack_texts(batch.column("z"))):
                own = np.array([b > a and content_codes(words[a:b])[0] == c1[begin + k] for k, (a, b) in enumerate(zip(bounds, bounds[1:]))])
                add_frequencies(totals, *shingle_codes(words, bounds), np.where(own, n[begin : begin + len(own)] - 1, 0))
        if totals.any():
            yield vector_batch(totals)

    one = packed_texts(texts, bitmap_of(copied.select("doc_id"))).join(copied, "doc_id").dropDuplicates(["doc_id", "c1", "z"])
    return sum_vectors(one.select("c1", "n", "z").mapInArrow(run, "v binary"))


SKETCH = "doc_id long, c1 long, c2 long, weight double, bands array<long>"


def sketch(texts: DataFrame, weights: object, wanted: np.ndarray) -> DataFrame:
    """Content hashes, total weight and band hashes of the documents with words whose id may be in the bitmap."""
    chosen = texts.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(hits(batch.column(0), chosen.value)))
            for begin, words, bounds in hashed_runs(batch.column(1)):
                codes, ends = shingle_codes(words, bounds)
                mine = np.flatnonzero(np.diff(ends)).tolist()
                if not mine:
                    continue
                own = [weighed(codes[ends[k] : ends[k + 1]], weights.value) for k in mine]
                content = [content_codes(words[bounds[k] : bounds[k + 1]]) for k in mine]
                sizes = np.concatenate([[0], np.cumsum([len(c) for c, _ in own])])
                bands = bands_of(samples_of(np.concatenate([c for c, _ in own]), np.log(np.concatenate([w for _, w in own])), sizes))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([begin + k for k in mine])), *(pa.array([c[k] for c in content], pa.int64()) for k in range(2)), pa.array([float(w.sum()) for _, w in own]), pa.array(list(bands), pa.list_(pa.int64()))],
                    names=["doc_id", "c1", "c2", "weight", "bands"],
                )

    return texts.mapInArrow(run, SKETCH)


def verify(pairs: DataFrame, texts: DataFrame, weights: object, least: float) -> DataFrame:
    """(a, b) of the pairs (a, b, ca, cb) whose texts, of these content hashes, are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, tuple] | None = None
        for batch in batches:
            linked = np.zeros(batch.num_rows, bool)
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                own: list[np.ndarray] = []
                for _, words, bounds in hashed_runs(unpack_texts(part.column("z_a"))):
                    own += [words[bounds[k] : bounds[k + 1]] for k in range(len(bounds) - 1)]
                ca, cb = part.column("ca").to_pylist(), part.column("cb").to_pylist()
                for k in range(part.num_rows):
                    if content_codes(own[k])[0] != ca[k]:
                        continue
                    if held is None or held[0] != cb[k]:
                        (_, words, _), = hashed_runs(unpack_texts(part.column("z_b").slice(k, 1)))
                        if content_codes(words)[0] != cb[k]:
                            continue
                        held = (cb[k], shingles_of(words, weights.value))
                    linked[at + k] = similarity(shingles_of(own[k], weights.value), held[1]) >= least
            keep = np.flatnonzero(linked)
            yield pa.RecordBatch.from_arrays([batch.column(n).take(pa.array(keep)) for n in ("a", "b")], names=["a", "b"])

    own = packed_texts(texts, bitmap_of(pairs.select("a"))).select(F.col("doc_id").alias("a"), F.col("z").alias("z_a"))
    heads = packed_texts(texts, bitmap_of(pairs.select("b"))).select(F.col("doc_id").alias("b"), F.col("z").alias("z_b"))
    dealt, partners = served(pairs, heads, "b", "a")
    both = dealt.join(own, "a").join(partners, ["b", "__copy"])
    return both.select("a", "b", "ca", "cb", "z_a", "z_b").mapInArrow(run, "a long, b long").distinct()


# ------------------------------------------------------------------------------------------------- blocks


def block_similarity(a: list[tuple[np.ndarray, np.ndarray]], b: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Weighted Jaccard similarity of every document of one block with every one of another."""
    total_a, total_b = (np.array([w.sum() for _, w in x]) for x in (a, b))
    codes_a, codes_b = (np.concatenate([c for c, _ in x]) for x in (a, b))
    weights_a, weights_b = (np.concatenate([w for _, w in x]) for x in (a, b))
    rows_a, rows_b = (np.repeat(np.arange(len(x)), [len(c) for c, _ in x]) for x in (a, b))
    common = np.intersect1d(codes_a, codes_b)
    shared = np.zeros((len(a), len(b)))
    if len(common):
        sides = []
        for codes, weight, rows in ((codes_a, weights_a, rows_a), (codes_b, weights_b, rows_b)):
            at = np.minimum(np.searchsorted(common, codes), len(common) - 1)
            hit = common[at] == codes
            order = np.argsort(at[hit], kind="stable")
            sides.append((at[hit][order], weight[hit][order], rows[hit][order]))
        high, low = np.full(len(common), -np.inf), np.full(len(common), np.inf)
        for at, weight, _ in sides:
            np.maximum.at(high, at, weight)
            np.minimum.at(low, at, weight)
        even = high - low < 1e-9  # the shingle weighs alike wherever it is: presence is enough
        for begin in range(0, len(common), 2048):
            end = min(len(common), begin + 2048)
            dense = []
            for (at, _, rows), n in zip(sides, (len(a), len(b)), strict=True):
                x = np.zeros((n, end - begin))
                lo, hi = np.searchsorted(at, [begin, end])
                x[rows[lo:hi], at[lo:hi] - begin] = 1
                dense.append(x)
            shared += (dense[0] * np.where(even[begin:end], high[begin:end], 0)) @ dense[1].T
        for k in np.flatnonzero(~even):
            parts = []
            for at, weight, rows in sides:
                lo, hi = np.searchsorted(at, [k, k + 1])
                parts.append((rows[lo:hi], weight[lo:hi]))
            shared[np.ix_(parts[0][0], parts[1][0])] += np.minimum.outer(parts[0][1], parts[1][1])
    return shared / (total_a[:, None] + total_b[None, :] - shared)


def spanning(rows: np.ndarray, cols: np.ndarray, ids_a: list[int], ids_b: list[int], labels_a: list[int], labels_b: list[int]) -> list[tuple[int, int]]:
    """Of links between labelled documents, as many as join the labels that they join."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    kept = []
    for i, j in zip(rows.tolist(), cols.tolist(), strict=True):
        x, y = root(labels_a[i]), root(labels_b[j])
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append((ids_a[i], ids_b[j]))
    return kept


#: Documents in a block, and how many of one component make blocks of their own.
BLOCK_DOCS = 128
#: Shingles' weight in a block, about.
BLOCK_WEIGHT = 200_000


def block_links(members: DataFrame, texts: DataFrame, weights: object, least: float) -> DataFrame:
    """Links between members (band, doc_id, c1, weight, label) of one band and different labels."""

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, words, bounds in hashed_runs(unpack_texts(batch.column(1))):
                codes, ends = shingle_codes(words, bounds)
                n = len(bounds) - 1
                first = [content_codes(words[bounds[k] : bounds[k + 1]])[0] for k in range(n)]
                own = [codes[ends[k] : ends[k + 1]].tobytes() for k in range(n)]  # their weights are in the table that all tasks have
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, n), pa.array(first, pa.int64()), pa.array(own, pa.binary())], names=["doc_id", "c1", "codes"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def side(cell: pa.Scalar) -> tuple[list[int], list[int], list[tuple[np.ndarray, np.ndarray]]]:
            rows = cell.as_py()
            return [r["doc_id"] for r in rows], [r["label"] for r in rows], [weighed(np.frombuffer(r["codes"], np.uint64), weights.value) for r in rows]

        for batch in batches:
            found: list[tuple[int, int]] = []
            for k in range(batch.num_rows):
                ids_a, labels_a, a = side(batch.column(0)[k])
                ids_b, labels_b, b = side(batch.column(1)[k])
                alike = (block_similarity(a, b) >= least - 1e-6) & (np.array(labels_a)[:, None] != np.array(labels_b)[None, :])
                found += spanning(*np.nonzero(alike), ids_a, ids_b, labels_a, labels_b)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    wanted = members.select("doc_id", "c1").distinct()
    needed = packed_texts(texts, bitmap_of(wanted.select("doc_id")))
    profiles = settle(needed.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(profile, "doc_id long, c1 long, codes binary").dropDuplicates(["doc_id", "c1"]))
    ratio = float(np.log(1 / least))
    sized = members.withColumn("size", F.floor(F.log("weight") / ratio).cast("int"))
    labels = sized.groupBy("band", "size", "label").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    # a component of many members makes blocks of its own, which are never compared with one another; -1: the others'
    labels = settle(labels.withColumn("pure", F.when(F.col("n") >= BLOCK_DOCS, F.col("label")).otherwise(F.lit(-1).cast("long"))))
    parts = labels.groupBy("band", "size", "pure").agg(F.sum("n").alias("m"), F.sum("w").alias("w"))
    parts = settle(parts.select("band", "size", "pure", F.greatest(F.ceil(F.col("m") / BLOCK_DOCS), F.ceil(F.col("w") / BLOCK_WEIGHT)).alias("blocks")))
    named = labels.join(parts, ["band", "size", "pure"]).select("band", "size", "label", "pure", "blocks", "n")
    block = F.struct("band", "size", "pure", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).alias("block"))
    dealt = join_counted(sized, named, ["band", "size", "label"]).select("doc_id", "c1", "label", block.alias("key"))
    blocks = settle(dealt.join(profiles, ["doc_id", "c1"]).groupBy("key").agg(F.collect_list(F.struct("doc_id", "label", "codes")).alias("rows")))
    # which blocks meet is settled from the small table of parts; the documents follow by the blocks' keys
    left = parts.select("band", *(F.col(c).alias(f"{c}_a") for c in ("size", "pure", "blocks")))
    right = parts.select("band", *(F.col(c).alias(f"{c}_b") for c in ("size", "pure", "blocks")))
    meet = left.join(right, "band").where("(size_b = size_a AND pure_b >= pure_a OR size_b = size_a + 1) AND (pure_a = -1 OR pure_a <> pure_b)")
    same = (F.col("size_a") == F.col("size_b")) & (F.col("pure_a") == F.col("pure_b"))
    meet = meet.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks_a") - 1)))
    meet = meet.withColumn("j", F.explode(F.sequence(F.when(same, F.col("i")).otherwise(F.lit(0).cast("long")), F.col("blocks_b") - 1)))
    pairs = meet.select(*(F.struct("band", F.col(f"size_{s}").alias("size"), F.col(f"pure_{s}").alias("pure"), F.col(k).alias("block")).alias(f"key_{s}") for s, k in (("a", "i"), ("b", "j"))))
    first, second = (blocks.select(F.col("key").alias(f"key_{s}"), F.col("rows").alias(f"rows_{s}")) for s in "ab")
    return pairs.join(first, "key_a").join(second, "key_b").select("rows_a", "rows_b").mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """doc_id and class_id (the least id of its near-duplicate class) of every document."""
    spark = docs.sparkSession
    ship_package(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id IS NOT NULL")
    seen = settle(survey(texts))
    rows = seen.where("v IS NULL").select("doc_id", "c1", "c2")
    classes = settle(rows.where("c1 IS NOT NULL").groupBy("c1", "c2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")))
    totals = sum_vectors(seen.where("v IS NOT NULL").select("v"))
    more = copies_frequencies(texts, classes.where("n > 1").select("doc_id", "c1", "n"))
    totals = np.zeros(COUNTERS, np.int64) if totals is None else totals - (0 if more is None else more)
    weights = spark.sparkContext.broadcast(shingle_weights(totals, classes.count()))  # COUNTERS numbers, whatever the corpus
    own = classes.select("doc_id", "c1", "c2")
    sketches = settle(sketch(texts, weights, bitmap_of(own.select("doc_id"))).join(own, ["doc_id", "c1", "c2"], "left_semi").dropDuplicates(["doc_id", "c1", "c2"]))
    in_bands = sketches.select("doc_id", F.explode("bands").alias("band"))
    shared = settle(in_bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"))
    met = settle(join_counted(in_bands, shared, ["band"]).join(sketches.select("doc_id", "c1", "weight"), "doc_id"))

    # every class and one head: the class that meets most others in all its bands together
    hubs = met.groupBy("doc_id").agg(F.sum("n").alias("hub"))
    scored = met.drop("n").join(hubs, "doc_id")
    heads = scored.groupBy("band").agg(F.min(F.struct((-F.col("hub")).alias("rank"), "doc_id", "c1", "weight")).alias("head"), F.count("*").alias("n"))
    size_allows = f"least(weight, head.weight) >= greatest(weight, head.weight) * {least} - 1e-6"
    stars = join_counted(scored, heads, ["band"]).where("doc_id <> head.doc_id").where(size_allows)
    pairs = settle(stars.groupBy("doc_id", "c1").agg(F.min("head").alias("head")).select(F.col("doc_id").alias("a"), F.col("head.doc_id").alias("b"), F.col("c1").alias("ca"), F.col("head.c1").alias("cb")))
    found = components(verify(pairs, texts, weights, least))

    def labelled(frame: DataFrame, name: str) -> DataFrame:
        return frame.join(found.select(F.col("vertex").alias("doc_id"), F.col("component").alias(name)), "doc_id", "left").withColumn(name, F.coalesce(name, "doc_id"))

    # every pair of different components in a band
    members = settle(labelled(met.drop("n"), "label"))
    open_bands = members.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")).where("low <> high").select("band", "n")
    inside = settle(join_counted(members, open_bands, ["band"]).drop("n"))
    if inside.limit(1).count():
        more = block_links(inside, texts, weights, least)
        found = components(found.select(F.col("vertex").alias("a"), F.col("component").alias("b")).union(more))

    named = labelled(classes.select("c1", "c2", "doc_id", "n"), "class_id").select("c1", "c2", "class_id", "n")
    known = join_counted(rows.where("c1 IS NOT NULL"), named, ["c1", "c2"]).select("doc_id", "class_id")
    return known.unionByName(rows.where("c1 IS NULL").select("doc_id", F.col("doc_id").alias("class_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """All rows and columns of one document (the least id) of each class; of rows that repeat an id the one with the least
    MD5 of its text stays (of equal texts any), rows without an id all stay."""
    classes = settle(near_duplicates(docs, id_col, text_col, least))
    dropped = classes.where("doc_id <> class_id").select(F.col("doc_id").alias("__dropped")).distinct()
    kept = docs.join(dropped, docs[id_col] == dropped["__dropped"], "left_anti")
    repeated = settle(classes.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__repeated")))
    many = repeated.count()
    if many:
        named = F.broadcast(repeated) if many <= MOST_SENT else repeated
        same = F.col(id_col).cast("long") == F.col("__repeated")
        again = kept.join(named, same, "left_semi")
        one = again.groupBy(F.col(id_col).alias("__id")).agg(F.min_by(F.struct(*kept.columns), F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("__row"))
        kept = kept.join(named, same, "left_anti").unionByName(one.select("__row.*"))
    return kept
