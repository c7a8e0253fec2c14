"""Token ids in files of fixed-width bit packing, with block offsets for vectorised unpacking and random access.

A file is a row of segments with a marker after each. A segment: header; blocks of `BLOCK_IDS` ids, each id in the least
number of bits that holds the vocabulary, each block beginning on a byte; then the offsets of the blocks, the documents' ids
(8 bytes and a null flag) and where each begins. All numbers are little-endian, ids fill bits from the lowest.

The marker is 128 random bits, drawn for each folder and kept beside the files. It lets readers enter a file anywhere, so a
file holds all that a task writes (hundreds of megabytes) and is read back in byte ranges, some segments at a time.

Documents are written in ascending id (nulls first; rows that repeat an id follow each other in the order of their texts). Null and empty texts hold
the end id alone. An empty table makes no document. Other columns don't matter.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm import wordtok
from plumbline.llm.flatfiles import empty_folder, new_folder, read_segments, write_payloads
from plumbline.session import settle, ship_package

MAGIC = b"PLMBIDS1"
HEADER = struct.Struct("<8sIIQQQQQ")  # magic, bits, ids in a block, documents, ids, place of the index, part, seq
BLOCK_IDS = 4096
#: A segment is closed when it holds so many ids; a document is never cut.
SEGMENT_IDS = 1_000_000


def bits_for(vocabulary: int) -> int:
    """The least width that holds ids below `vocabulary`."""
    return max(1, (vocabulary - 1).bit_length())


def pack_ids(ids: np.ndarray, bits: int) -> bytes:
    """Ids one after the other in `bits` bits each."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_ids(data: bytes, bits: int, count: int) -> np.ndarray:
    """The first `count` ids: every id is cut out of the eight bytes that begin where it begins."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype(np.uint32)
    padded = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(8, np.uint8)])
    at = np.arange(count, dtype=np.int64) * bits
    window = np.zeros(count, np.uint64)
    for k in range((bits + 7 + 7) // 8):
        window |= padded[(at >> 3) + k].astype(np.uint64) << np.uint64(8 * k)
    return ((window >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def build_segment(doc_ids: list[int | None], ids: np.ndarray, starts: np.ndarray, bits: int, part: int = 0, seq: int = 0) -> bytes:
    """One segment; starts: where each document begins in ids, and their end."""
    blocks = [pack_ids(ids[k : k + BLOCK_IDS], bits) for k in range(0, len(ids), BLOCK_IDS)]
    offsets = np.cumsum([HEADER.size, *map(len, blocks)]).astype("<u8")
    keys = np.array([0 if x is None else x for x in doc_ids], "<i8")
    nulls = np.array([x is None for x in doc_ids], np.uint8)
    head = HEADER.pack(MAGIC, bits, BLOCK_IDS, len(doc_ids), len(ids), int(offsets[-1]), part, seq)
    return b"".join([head, *blocks, offsets.tobytes(), keys.tobytes(), nulls.tobytes(), starts.astype("<u8").tobytes()])


class Segment:
    """Random access to a segment's content: only the blocks that hold the asked ids are unpacked."""

    def __init__(self, content: bytes) -> None:
        self.content = content
        magic, self.bits, self.block, self.documents, self.ids, index, self.part, self.seq = HEADER.unpack_from(content)
        if magic != MAGIC:
            raise ValueError("not a segment of token ids")
        blocks = -(-self.ids // self.block)
        self.offsets = np.frombuffer(content, "<u8", blocks + 1, index)
        index += 8 * (blocks + 1)
        self.doc_ids = np.frombuffer(content, "<i8", self.documents, index)
        index += 8 * self.documents
        self.nulls = np.frombuffer(content, np.uint8, self.documents, index).astype(bool)
        index += self.documents
        self.starts = np.frombuffer(content, "<u8", self.documents + 1, index).astype(np.int64)

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids from `start` to before `stop`."""
        if not 0 <= start <= stop <= self.ids:
            raise IndexError((start, stop))
        if start == stop:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        parts = [unpack_ids(self.content[self.offsets[b] : self.offsets[b + 1]], self.bits, min(self.block, self.ids - b * self.block)) for b in range(first, last + 1)]
        return np.concatenate(parts)[start - first * self.block : stop - first * self.block]

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document."""
        return self.read(int(self.starts[k]), int(self.starts[k + 1]))


def write_token_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, path: str | None = None) -> None:
    """Token files of all documents in ascending order of their ids."""
    path = path or wordtok.vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = wordtok.load(path)
        bits = bits_for(max(tokens.vocabulary, end_id + 1))
        part, seq = TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        pieces: list[np.ndarray] = []
        sizes: list[int] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal seq, held
            starts = np.concatenate([[0], np.cumsum(sizes)])
            payload = build_segment(names, np.concatenate(pieces), starts, bits, part, seq)
            seq, held = seq + 1, 0
            names.clear(), pieces.clear(), sizes.clear()
            return pa.RecordBatch.from_arrays([pa.array([payload], pa.binary())], names=["payload"])

        tail = np.array([end_id], np.uint32)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                piece = batch.slice(at, 4096)
                ids, offsets = tokens.encode(piece.column(1))
                for k, key in enumerate(piece.column(0).to_pylist()):
                    names.append(key)
                    pieces += [ids[offsets[k] : offsets[k + 1]], tail]
                    sizes.append(int(offsets[k + 1] - offsets[k]) + 1)
                    held += sizes[-1]
                    if held >= SEGMENT_IDS:
                        yield close()
        if names:
            yield close()

    ship_package(docs.sparkSession)
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = chosen.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")  # rows of one id are in one partition
    marker = uuid.uuid4().hex
    docs.sparkSession.createDataFrame([(marker,)], "value string").write.text(f"{folder}/marker")
    write_payloads(ordered.mapInArrow(run, "payload binary"), f"{folder}/ids", marker)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files of a folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                f = Segment(content.as_py())
                crc = []
                for low in range(0, f.documents, 256):
                    high = min(f.documents, low + 256)
                    base = int(f.starts[low])
                    ids = f.read(base, int(f.starts[high])).astype("<u4")
                    crc += [zlib.crc32(ids[f.starts[k] - base : f.starts[k + 1] - base].tobytes()) for k in range(low, high)]
                n = f.documents
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, f.part, np.int64)), pa.array(np.full(n, f.seq, np.int64)), pa.array(f.doc_ids, mask=f.nulls), pa.array(f.starts[:-1]), pa.array(np.diff(f.starts)), pa.array(crc, pa.int64())],
                    names=["part", "seq", "doc_id", "local", "n_tokens", "ids_crc32"],
                )

    marker = spark.read.text(f"{folder}/marker").first()[0]
    rows = settle(read_segments(spark, f"{folder}/ids", marker).mapInArrow(run, "part long, seq long, doc_id long, local long, n_tokens long, ids_crc32 long"))
    by_segment = rows.groupBy("part", "seq").agg(F.sum("n_tokens").alias("ids"))
    by_part = by_segment.groupBy("part").agg(F.sum("ids").alias("part_ids"))
    parts = by_part.select("part", (F.sum("part_ids").over(Window.orderBy("part")) - F.col("part_ids")).alias("part_start"))  # a row for each task that wrote
    in_part = Window.partitionBy("part").orderBy("seq")
    starts = by_segment.join(parts, "part").select("part", "seq", (F.col("part_start") + F.sum("ids").over(in_part) - F.col("ids")).alias("segment_start"))
    return rows.join(starts, ["part", "seq"]).select("doc_id", (F.col("segment_start") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, **options: object) -> DataFrame:
    """Write all documents' token files and give what reading them back gives."""
    if not docs.limit(1).count():
        return docs.sparkSession.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    folder = new_folder(docs.sparkSession, "token-files")
    write_token_files(docs, folder, **options)
    found = read_documents(docs.sparkSession, folder)  # read back and settled
    empty_folder(docs.sparkSession, folder)
    return found
