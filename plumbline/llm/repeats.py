"""Repeated passages over all texts by a depth-limited radix sort of suffixes.

Only the first `WINDOW` bytes of a suffix matter: suffixes that agree in them are equal windows. Windows are told apart by their
most significant digits first, and whatever stands alone after a pass leaves the sort.

1. The first digit is a window's anchor: of its substrings of `GRAM` bytes the one with the least hash, the leftmost of equal
   ones. Equal windows have the same anchor at the same place, neighbouring windows mostly share theirs, so a pass over the
   anchors (one for some fourteen bytes) stands for a pass over all windows. Anchors found in one document only are done.
2. For the others each anchor's context is taken: the bytes of the windows that it stands for. Of equal contexts only the one
   with the least document goes on, inside a task at once.
3. In a task, contexts of one anchor are brought together; where they differ, their windows are sorted digit by digit
   (`DIGIT` bytes), again leaving out what stands alone. Equal groups at full depth are exactly the repeated windows, and a
   window that has a smaller document in its group is one to remove.
4. Anchors with more than `MOST_CONTEXTS` different contexts take their last pass as a shuffle on the whole window instead,
   with minima combined before it; hot windows are joined apart.

Whole texts that equal one of a smaller id are wholly repeated and take no part in the sort. Texts shuffle compressed, and
only where something in them may be repeated.

Texts are UTF-8 bytes, null texts empty ones; matches don't cross documents. Rows that repeat an id are judged each, and not
against each other. Rows without an id lose nothing and others lose nothing to them. Texts of less than `WINDOW` bytes
have no windows. An empty table gives none. Other columns, whatever their names, don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.bitmaps import bitmap_of, hits
from plumbline.llm.skew import join_counted
from plumbline.llm.wordsplit import give_back, runs
from plumbline.session import settle, ship_package

WINDOW = 50
#: Bytes of an anchor; a window holds WINDOW - GRAM + 1 candidates.
GRAM = 24
#: Bytes of a digit of the sort inside a task.
DIGIT = 8
#: Windows looked at together, and contexts sorted together.
SEGMENT, SORTED = 1_000_000, 20_000
#: Different contexts of one anchor that a task sorts; more are told apart by a shuffle.
MOST_CONTEXTS = 50_000
#: A context's bytes at most, in whole digits.
_WIDE = -(-(2 * WINDOW - GRAM) // DIGIT) * DIGIT
_LOW = np.uint64(0xFFFFFFFF)
#: Bits of an anchor's hash that are sent about. Anchors that share them are sorted together and told apart by their bytes.
_SENT = ~np.uint64(0xFFFF)
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


# ------------------------------------------------------------------------------------------------- anchors


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts one after the other, and the texts' bounds among them."""
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2] if len(texts) else None
    return (np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]), ends - ends[0]


def gram_codes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes that begin at each place."""
    n = len(data) - GRAM + 1
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)).view("<u8")[:, 0]
    code = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k, factor in enumerate(_FACTORS):
            code ^= words[8 * k : 8 * k + n]
            code *= factor
            code ^= code >> np.uint64(31)
    return code


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbouring values."""
    least, done = values, 1
    while done < width:
        step = min(done, width - done)
        least = np.minimum(least[:-step], least[step:])
        done += step
    return least


def anchors(data: np.ndarray, bounds: np.ndarray, begin: int) -> tuple[np.ndarray, ...]:
    """Of the windows of documents that start in a segment of the bytes: (owner, hash, place of the anchor, first and last
    start of a window that it stands for), places among all bytes."""
    part = data[begin : begin + SEGMENT + WINDOW - 1]
    if len(part) < WINDOW:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.int64))
    codes = gram_codes(part)
    place = (sliding_least((codes & ~_LOW) | np.arange(len(codes), dtype=np.uint64), WINDOW - GRAM + 1) & _LOW).astype(np.int64)
    start = np.arange(begin, begin + len(place))
    owner = np.repeat(np.arange(len(bounds) - 1), np.clip(bounds[1:], begin, start[-1] + 1) - np.clip(bounds[:-1], begin, start[-1] + 1))
    inside = start + WINDOW <= bounds[owner + 1]
    place, start, owner = place[inside], start[inside], owner[inside]
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, np.int64)
    last = np.concatenate([first[1:], [len(place)]])[: len(first)] - 1
    return owner[first], codes[place[first]] & _SENT, begin + place[first], start[first], start[last]


def _heads(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Where in the order a row differs from the one before in any key."""
    new = np.ones(len(order), bool)
    if len(order) > 1:
        new[1:] = np.logical_or.reduce([(k[order[1:]] != k[order[:-1]]).reshape(len(order) - 1, -1).any(axis=1) for k in keys])
    return new


def shared_anchors(texts: DataFrame) -> DataFrame:
    """doc_id and grams: hashes of the anchors that other documents have too."""
    ship_package(texts.sparkSession)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, part in runs(batch.column("text"), SEGMENT):
                ids = batch.column("doc_id").slice(row, len(part)).to_numpy(zero_copy_only=False)
                data, bounds = bytes_of(part)
                for begin in range(0, len(data), SEGMENT):
                    owner, code, *_ = anchors(data, bounds, begin)
                    doc = ids[owner]
                    order = np.lexsort((doc, code))
                    order = order[_heads(order, code, doc)]
                    code, doc = code[order], doc[order]
                    if not len(code):
                        continue
                    # two documents are enough to say elsewhere that an anchor is shared; what more has it here, is dealt freely
                    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
                    size = np.diff(np.concatenate([first, [len(code)]]))
                    rank = np.arange(len(code)) - np.repeat(first, size)
                    known = (rank > 0) & (rank < np.repeat(size, size) - 1)
                    yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(doc), pa.array(np.where(known, 1 + (doc & 0xFFFF), 0).astype(np.int32))], names=["h", "doc_id", "salt"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, int, int, bool] | None = None  # hash, least and largest document so far, whether they were given out
        for batch in batches:
            h, doc, salt = (batch.column(k).to_numpy() for k in range(3))
            sure = salt > 0
            if sure.any():
                yield pa.RecordBatch.from_arrays([pa.array(doc[sure]), pa.array(h[sure])], names=["doc_id", "h"])
            h, doc, fresh = h[~sure], doc[~sure], np.ones(int((~sure).sum()), bool)
            if held is not None:
                h, doc, fresh = np.concatenate([[held[0]] * 2, h]), np.concatenate([held[1:3], doc]), np.concatenate([[not held[3], not held[3] and held[1] != held[2]], fresh])
            if not len(h):
                continue
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            low, high = np.minimum.reduceat(doc, first), np.maximum.reduceat(doc, first)
            many = np.repeat(low != high, np.diff(np.concatenate([first, [len(h)]])))
            held = (int(h[-1]), int(low[-1]), int(high[-1]), bool(low[-1] != high[-1]))
            out = many & fresh
            yield pa.RecordBatch.from_arrays([pa.array(doc[out]), pa.array(h[out])], names=["doc_id", "h"])

    dealt = texts.select("doc_id", "text").mapInArrow(find, "h long, doc_id long, salt int").repartition("h", "salt").sortWithinPartitions("h")
    return dealt.mapInArrow(meet, "doc_id long, h long").groupBy("doc_id").agg(F.collect_set("h").alias("grams"))


# ------------------------------------------------------------------------------------------------- contexts


FOUND = "h long, salt int, doc_id long, c long, begin long, n int, left int, context binary"


def _found(h: np.ndarray | None, salt: np.ndarray, doc: np.ndarray, c: np.ndarray, begin: np.ndarray, n: np.ndarray, left: np.ndarray | None = None, context: pa.Array | None = None) -> pa.RecordBatch:
    """Rows with a context are windows to be judged, n + 1 of them from `begin` on; rows without are n bytes to be removed."""
    size = len(doc)
    return pa.RecordBatch.from_arrays(
        [
            pa.nulls(size, pa.int64()) if h is None else pa.array(h.view(np.int64)), pa.array(salt.astype(np.int32)), pa.array(doc), pa.array(c), pa.array(begin.astype(np.int64)), pa.array(n.astype(np.int32)),
            pa.nulls(size, pa.int32()) if left is None else pa.array(left.astype(np.int32)), pa.nulls(size, pa.binary()) if context is None else context,
        ],
        names=["h", "salt", "doc_id", "c", "begin", "n", "left", "context"],
    )


def matrix_of(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rows of bytes of given sizes, filled up with zeros to _WIDE."""
    padded = np.concatenate([data, np.zeros(_WIDE, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, _WIDE)[first]
    rows[np.arange(_WIDE) >= size[:, None]] = 0
    return rows


def row_codes(rows: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """A hash of each row of bytes and of further numbers."""
    words = np.ascontiguousarray(rows).view("<u8")
    code = np.zeros(len(rows), np.uint64)
    with np.errstate(over="ignore"):
        for k, column in enumerate([*words.T, *(x.astype(np.uint64) for x in more)]):
            code = (code ^ column) * _FACTORS[k % 3]
            code ^= code >> np.uint64(29)
    return code


def contexts(texts: DataFrame) -> DataFrame:
    """Contexts (FOUND) of the anchors among `grams` of compressed texts (doc_id, c, z, grams). Of those that are equal in a
    segment only the least document's stay; what the others have of them is to be removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_up = zstandard.ZstdDecompressor()
        for batch in batches:
            texts = pa.array([open_up.decompress(x.as_py()) for x in batch.column("z")], pa.large_binary())
            for row, part in runs(texts, SEGMENT):
                ids, contents = (batch.column(n).slice(row, len(part)).to_numpy(zero_copy_only=False) for n in ("doc_id", "c"))
                wanted = np.unique(batch.column("grams").slice(row, len(part)).flatten().to_numpy().view(np.uint64))
                data, bounds = bytes_of(part)
                for begin in range(0, len(data), SEGMENT):
                    owner, code, place, first, last = anchors(data, bounds, begin)
                    at = np.minimum(np.searchsorted(wanted, code), len(wanted) - 1)
                    mine = np.flatnonzero(wanted[at] == code) if len(wanted) else np.zeros(0, np.int64)
                    if not len(mine):
                        continue
                    owner, code, place, first, last = (x[mine] for x in (owner, code, place, first, last))
                    left, n, doc, start = place - first, last - first, ids[owner], first - bounds[owner]
                    rows = matrix_of(data[begin : begin + SEGMENT + 2 * WINDOW], first - begin, n + WINDOW)
                    own = row_codes(rows, left)
                    order = np.lexsort((doc, own))
                    head = _heads(order, own, rows.view("<u8"), left, n)
                    least = np.repeat(doc[order][head], np.diff(np.concatenate([np.flatnonzero(head), [len(order)]])))
                    gone = doc[order] > least
                    a, b = order[gone], order[~gone]
                    if len(a):
                        yield _found(None, 1 + (doc[a] & 0xFFFF), doc[a], contents[owner[a]], start[a], n[a] + WINDOW)
                    yield _found(code[b], np.zeros(len(b)), doc[b], contents[owner[b]], start[b], n[b], left[b], pa.array([r[:s].tobytes() for r, s in zip(rows[b], (n[b] + WINDOW).tolist(), strict=True)], pa.binary()))

    return texts.select("doc_id", "c", "z", "grams").mapInArrow(run, FOUND)


# ------------------------------------------------------------------------------------------------- the sort


def least_of_windows(rows: np.ndarray, h: np.ndarray, left: np.ndarray, n: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The least document that has a window, for each window of contexts (context after context, in their order): windows of
    one anchor at one place are sorted by digit after digit, and those that stand alone leave the sort."""
    size = n + 1
    owner = np.repeat(np.arange(len(rows)), size)
    skip = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    least = doc[owner]
    at = np.arange(len(owner))
    group = np.unique(np.column_stack([h.view(np.int64)[owner], left[owner] - skip]), axis=0, return_inverse=True)[1].reshape(-1) if len(owner) else at
    shifted = np.lib.stride_tricks.sliding_window_view(np.concatenate([rows, np.zeros((len(rows), DIGIT), np.uint8)], axis=1), DIGIT, axis=1)
    for depth in range(0, WINDOW, DIGIT):
        digit = np.ascontiguousarray(shifted[owner[at], skip[at] + depth]).view(">u8")[:, 0].astype(np.uint64)
        if depth + DIGIT > WINDOW:
            digit >>= np.uint64(8 * (depth + DIGIT - WINDOW))
        order = np.lexsort((digit, group))
        head = _heads(order, group, digit)
        group = np.cumsum(head) - 1
        alone = np.bincount(group, minlength=1) == 1
        stay = ~alone[group]
        at, group = at[order][stay], group[stay]
        if not len(at):
            return least
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    least[at] = np.repeat(np.minimum.reduceat(doc[owner[at]], first), np.diff(np.concatenate([first, [len(at)]])))
    return least


def judged(h: np.ndarray, doc: np.ndarray, c: np.ndarray, begin: np.ndarray, n: np.ndarray, left: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    """What is to be removed of all contexts of some anchors."""
    code = row_codes(rows, h, left)
    order = np.lexsort((doc, code))
    head = _heads(order, code, h, rows.view("<u8"), left, n)
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(head) - 1
    heads = order[head]  # one of each kind of context, of its least document
    anchor, kind, kinds = np.unique(h[heads], return_inverse=True, return_counts=True)
    differ = kinds[kind.reshape(-1)] > 1
    same = ~differ[which]
    gone = np.flatnonzero(same & (doc > doc[heads][which]))
    out = [gone, np.zeros(len(gone), np.int64), n[gone]]  # row, first window and last window that a smaller document has
    mixed = np.flatnonzero(differ)
    if len(mixed):
        chosen = heads[mixed]
        windows = least_of_windows(rows[chosen], h[chosen], left[chosen], n[chosen], doc[chosen])
        size = n[chosen] + 1
        start = np.zeros(len(heads), np.int64)
        start[mixed] = np.cumsum(size) - size
        rest = np.flatnonzero(~same)
        each = n[rest] + 1
        owner = np.repeat(np.arange(len(rest)), each)
        skip = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
        covered = windows[np.repeat(start[which[rest]], each) + skip] < doc[rest][owner]
        owner, skip = owner[covered], skip[covered]
        if len(owner):
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            last = np.concatenate([first[1:], [len(owner)]]) - 1
            out = [np.concatenate(x) for x in zip(out, [rest[owner[first]], skip[first], skip[last]], strict=True)]
    row, a, b = out  # windows between two that go overlap with both, so all bytes from the first to the last one go
    return _found(None, np.ones(len(row)), doc[row], c[row], begin[row] + a, b - a + WINDOW)


def sort_contexts(found: DataFrame, most: int = MOST_CONTEXTS, together: int = SORTED) -> DataFrame:
    """What is to be removed (FOUND without contexts); contexts of anchors that have more than `most` come back as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        passed: int | None = None  # the anchor whose contexts are handed on

        def unpacked(rows: pa.RecordBatch) -> tuple:
            cells = rows.column("context")
            ends = np.frombuffer(cells.buffers()[1], np.int32)[cells.offset : cells.offset + len(cells) + 1].astype(np.int64)
            data = np.frombuffer(cells.buffers()[2], np.uint8)[ends[0] : ends[-1]]
            own = {k: rows.column(k).to_numpy() for k in ("h", "doc_id", "c", "begin", "n", "left")}
            n, left = own["n"].astype(np.int64), own["left"].astype(np.int64)
            return own["h"].view(np.uint64), own["doc_id"], own["c"], own["begin"], n, left, matrix_of(data, ends[:-1] - ends[0], np.diff(ends))

        for batch in batches:
            done = pc.is_null(batch.column("context"))
            if pc.any(done).as_py():
                yield batch.filter(done)
                batch = batch.filter(pc.invert(done))
            while batch.num_rows:
                h = batch.column("h").to_numpy()
                if passed is not None:
                    own = int(np.searchsorted(h, passed, "right"))
                    yield batch.slice(0, own)
                    batch = batch.slice(own)
                    passed = passed if not batch.num_rows else None
                    continue
                take = batch.slice(0, together)
                batch = batch.slice(together)
                held.append(take)
                count += take.num_rows
                if count >= together:
                    rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    whole = int(np.searchsorted(rows.column("h").to_numpy(), rows.column("h")[-1].as_py(), "left"))  # the last anchor may go on
                    if whole:
                        yield judged(*unpacked(rows.slice(0, whole)))
                    rest = rows.slice(whole)
                    if rest.num_rows > most:
                        passed = rest.column("h")[0].as_py()
                        yield rest
                        held, count = [], 0
                    else:
                        held, count = [rest], rest.num_rows
                        give_back()
        if held:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()
            if rows:
                yield judged(*unpacked(rows[0]))

    return found.repartition("h", "salt").sortWithinPartitions("h").mapInArrow(run, FOUND)


def last_pass(hot: DataFrame) -> DataFrame:
    """doc_id, c, begin, n of the windows of contexts (FOUND) that a smaller document has too, by a shuffle on whole windows."""
    window = F.substring("context", F.col("i") + 1, F.lit(WINDOW))
    windows = hot.select("doc_id", "c", "begin", "context", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("i")).select("doc_id", "c", (F.col("begin") + F.col("i")).alias("begin"), window.alias("window"))
    least = settle(windows.groupBy("window").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    return join_counted(windows, least, ["window"]).where("least < doc_id").select("doc_id", "c", "begin", F.lit(WINDOW).alias("n"))


# ------------------------------------------------------------------------------------------------- operator


def squeezed(texts: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """doc_id, c, n_bytes of all rows; z, the compressed text, of those whose id may be in the bitmap; else its sha256."""
    shared = texts.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            hit = hits(batch.column(0), shared.value)
            cells = [x.as_buffer() if x.is_valid else b"" for x in batch.column(2).cast(pa.large_binary())]
            z = [squeeze.compress(x) if k else None for x, k in zip(cells, hit.tolist(), strict=True)]
            sha = [None if k else hashlib.sha256(x).hexdigest() for x, k in zip(cells, hit.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x in cells], pa.int64()), pa.array(z, pa.binary()), pa.array(sha, pa.string())], names=["doc_id", "c", "n_bytes", "z", "sha"])
            give_back()

    return texts.select("doc_id", "c", "text").mapInArrow(run, "doc_id long, c long, n_bytes long, z binary, sha string")


def open_again(rows: DataFrame) -> DataFrame:
    """doc_id, text of compressed rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_up = zstandard.ZstdDecompressor()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([open_up.decompress(x.as_py()).decode() for x in batch.column(1)], pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "z").mapInArrow(run, "doc_id long, text string")


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def cut(rows: DataFrame) -> DataFrame:
    """The result's rows of (doc_id, n_bytes, z, sha, spans): begin and length of what is to be removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_up = zstandard.ZstdDecompressor()
        for batch in batches:
            removed, count, sha = [], [], []
            for size, z, own, spans in zip(batch.column("n_bytes").to_pylist(), batch.column("z"), batch.column("sha").to_pylist(), batch.column("spans"), strict=True):
                if not z.is_valid:
                    removed.append(0), count.append(0), sha.append(own)
                    continue
                data = np.frombuffer(open_up.decompress(z.as_py()), np.uint8)
                edge = np.zeros(size + 1, np.int64)
                if spans.is_valid:
                    begin, n = (np.asarray(spans.values.field(k)).astype(np.int64) for k in ("begin", "n"))
                    np.add.at(edge, begin, 1)
                    np.add.at(edge, begin + n, -1)
                gone = np.cumsum(edge)[:size] > 0
                removed.append(int(gone.sum()))
                count.append(int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if size else 0)
                sha.append(hashlib.sha256(data[~gone].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
            give_back()

    return rows.select("doc_id", "n_bytes", "z", "sha", "spans").mapInArrow(run, RESULT)


def copies_of(texts: DataFrame) -> DataFrame:
    """doc_id, c, n_bytes of the rows whose whole text a smaller document has too."""
    known = texts.where(f"doc_id IS NOT NULL AND octet_length(text) >= {WINDOW}").select("doc_id", "c", F.md5("text").alias("md5"), F.octet_length("text").cast("long").alias("n_bytes"))
    known = settle(known)
    counted = known.groupBy("c", "md5").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1")
    return join_counted(known, settle(counted), ["c", "md5"]).where("least < doc_id").select("doc_id", "c", "n_bytes")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_CONTEXTS, together: int = SORTED) -> tuple[DataFrame, DataFrame]:
    """(texts as doc_id, c, text; for each doc_id and c the spans to be removed, which may overlap). c: a hash of the text."""
    ship_package(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("c"), text.alias("text"))
    copies = settle(copies_of(texts))
    bitmap = bitmap_of(copies.select("doc_id"))
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~hits(batch.column(0), shared.value)))

    # rows that the bitmap rules out are no copies; only the others are joined to see
    long = texts.where(f"doc_id IS NOT NULL AND octet_length(text) >= {WINDOW}")
    maybe = squeezed(long, bitmap).where("z IS NOT NULL").join(copies.select("doc_id", "c"), ["doc_id", "c"], "left_anti")
    own = long.select("doc_id", "text").mapInArrow(others, "doc_id long, text string").unionByName(open_again(maybe))
    grams = settle(shared_anchors(own))
    met = squeezed(long, bitmap_of(grams.select("doc_id"))).where("z IS NOT NULL").join(grams, "doc_id")
    found = sort_contexts(contexts(met), most, together)
    judged, open_ = F.col("context").isNull(), F.struct("begin", "n", "context")
    rows = settle(found.groupBy("doc_id", "c").agg(F.collect_set(F.when(judged, F.struct("begin", "n"))).alias("spans"), F.collect_list(F.when(~judged, open_)).alias("hot")))
    # copies are no documents of the sort, so each document is in one of both
    spans = rows.select("doc_id", "c", "spans").unionByName(copies.select("doc_id", "c", F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.col("n_bytes").cast("int").alias("n"))).alias("spans")))
    hot = rows.select("doc_id", "c", F.explode("hot").alias("x")).select("doc_id", "c", "x.*")
    if hot.limit(1).count():
        more = last_pass(hot).groupBy("doc_id", "c").agg(F.collect_set(F.struct("begin", "n")).alias("spans"))
        spans = settle(spans.unionByName(more).groupBy("doc_id", "c").agg(F.flatten(F.collect_list("spans")).alias("spans")))
    return texts, spans.where(F.size("spans") > 0)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_CONTEXTS, together: int = SORTED) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    texts, spans = repeated_spans(docs, id_col, text_col, most, together)
    return cut(squeezed(texts, bitmap_of(spans.select("doc_id"))).join(spans, ["doc_id", "c"], "left"))
