"""Token counts of documents in flat, unindexed token files by a separator scan.

A flat file is nothing but 16-bit little-endian numbers: 0 ends a document, any other is a token's id and one. Files are cut into blocks;
each block is searched for the end id at once (NumPy), which leaves its separators' places. A prefix scan over the blocks
(sums of ids and separators, the last separator so far) then stitches documents that cross blocks or files. The scan has
two levels, blocks within a part and parts, so no task sees the rows of all blocks.

Special tokens' strings in a text are ordinary characters.
Null and empty texts are documents of no tokens; what follows the last separator of a part counts as a document where it
isn't empty. Repeated rows and null ids are documents of their own. Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm import wordtok
from plumbline.llm.flatfiles import empty_folder, new_folder, read_files, write_payloads
from plumbline.session import settle, ship_package

ID_BYTES = 2
#: The number that ends a document.
END = 0
#: Documents are written in stretches of so many ids or more, and files of so many stretches: 32 MB, as a task reads files whole.
STRETCH_IDS, FILE_STRETCHES = 1_000_000, 16
#: Bytes searched at once.
BLOCK_BYTES = 1 << 18
#: A document's name in the list beside the token files: whether there is one, and the integer id.
NAME = np.dtype([("known", "u1"), ("doc_id", "<i8")])


def write_flat(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> None:
    """Write kind=tokens (flat files) and kind=names (the documents' ids in the same order)."""
    path = path or wordtok.vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = wordtok.load(path, plain=True)
        if tokens.vocabulary + 1 > 1 << 8 * ID_BYTES:
            raise ValueError("the vocabulary does not fit the width of an id")
        held, size, seq = [], 0, 0
        names: list[np.ndarray] = []
        tail = np.array([END], "<u2")

        def row(kind: str, number: int, payload: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([number], pa.int64()), pa.array([payload], pa.binary())], names=["kind", "seq", "payload"])

        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                piece = batch.slice(at, 4096)
                ids, offsets = tokens.encode(piece.column(1))
                ids = (ids + 1).astype("<u2")
                keys = piece.column(0)
                own = np.zeros(len(keys), NAME)
                own["known"] = np.asarray(keys.is_valid().to_numpy(zero_copy_only=False))
                own["doc_id"] = keys.fill_null(0).to_numpy()
                names.append(own)
                for k in range(len(keys)):
                    held += [ids[offsets[k] : offsets[k + 1]], tail]
                    size += int(offsets[k + 1] - offsets[k]) + 1
                    if size >= STRETCH_IDS:
                        yield row("tokens", seq, np.concatenate(held[:-1]).tobytes())  # the sink ends it with END
                        held, size, seq = [], 0, seq + 1
        if size:
            yield row("tokens", seq, np.concatenate(held[:-1]).tobytes())
        if names:
            yield row("names", 0, np.concatenate(names).tobytes())

    ship_package(docs.sparkSession)
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = chosen.mapInArrow(run, "kind string, seq long, payload binary").sortWithinPartitions("kind", "seq")
    write_payloads(rows, folder, chr(END) * ID_BYTES, "kind", FILE_STRETCHES)


def separators_in(data: bytes | memoryview, end_id: int) -> np.ndarray:
    """Places of the end id in a block; an incomplete id at the end isn't one."""
    return np.flatnonzero(np.frombuffer(data, "<u2", len(data) // ID_BYTES) == end_id)


def scan_blocks(files: DataFrame, end_id: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """part, seq, block, n_ids and the separators' places of every block of every file (part, seq, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, content in zip(batch.column("part").to_pylist(), batch.column("seq").to_pylist(), batch.column("content"), strict=True):
                data = memoryview(content.as_buffer())  # blocks are views of the file's bytes
                blocks = [data[at : at + block_bytes] for at in range(0, max(1, len(data)), block_bytes)]
                n = len(blocks)
                places = [separators_in(x, end_id) for x in blocks]
                counts = [len(x) // ID_BYTES for x in blocks]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int64()), pa.array([seq] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(counts, pa.int64()), pa.array(places, pa.list_(pa.int64()))],
                    names=["part", "seq", "block", "n_ids", "places"],
                )

    return files.select("part", "seq", "content").mapInArrow(run, "part long, seq long, block long, n_ids long, places array<long>")


def documents_of(blocks: DataFrame) -> DataFrame:
    """part, document (its number in the part), start (ids before it in all parts, separators among them), n_tokens."""
    blocks = blocks.withColumn("n_places", F.size("places").cast("long"))
    order = Window.partitionBy("part").orderBy("seq", "block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    scanned = (
        blocks.withColumn("ids_before", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))
        .withColumn("documents_before", F.coalesce(F.sum("n_places").over(before), F.lit(0).cast("long")))
        .withColumn("last", F.when(F.col("n_places") > 0, F.col("ids_before") + F.element_at("places", -1)))
        .withColumn("open", F.coalesce(F.max("last").over(before) + 1, F.lit(0).cast("long")))
        .withColumn("is_end", F.lead("block").over(order).isNull())
    )
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    parts = totals.select("part", (F.sum("part_ids").over(Window.orderBy("part")) - F.col("part_ids")).alias("part_start"))  # a row for each part
    ends = scanned.select("*", F.posexplode("places").alias("k", "place")).select(
        "part",
        (F.col("documents_before") + F.col("k")).alias("document"),
        F.when(F.col("k") == 0, F.col("open")).otherwise(F.col("ids_before") + F.get("places", F.col("k") - 1) + 1).alias("begin"),
        (F.col("ids_before") + F.col("place")).alias("end"),
    )
    tail_begin = F.coalesce(F.col("last") + 1, F.col("open"))
    tails = scanned.where("is_end").select("part", (F.col("documents_before") + F.col("n_places")).alias("document"), tail_begin.alias("begin"), (F.col("ids_before") + F.col("n_ids")).alias("end")).where("begin < end")
    return ends.unionByName(tails).join(parts, "part").select("part", "document", (F.col("part_start") + F.col("begin")).alias("start"), (F.col("end") - F.col("begin")).alias("n_tokens"))


def names_of(spark: SparkSession, folder: str) -> DataFrame:
    """part, document, doc_id as `write_flat` listed them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, content in zip(batch.column("part").to_pylist(), batch.column("content"), strict=True):
                data = content.as_py()
                own = np.frombuffer(data, NAME, len(data) // NAME.itemsize)  # the sink's separator is no whole name
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), part, np.int64)), pa.array(np.arange(len(own))), pa.array(own["doc_id"].copy(), mask=own["known"] == 0)], names=["part", "document", "doc_id"])

    return read_files(spark, f"{folder}/kind=names").select("part", "content").mapInArrow(run, "part long, document long, doc_id long")


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens of all documents, found by scanning flat token files made of them."""
    spark = docs.sparkSession
    if not docs.limit(1).count():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long")
    folder = new_folder(spark, "flat-tokens")
    write_flat(docs, folder, id_col, text_col, path)
    blocks = settle(scan_blocks(read_files(spark, f"{folder}/kind=tokens"), END))
    names = settle(names_of(spark, folder))
    empty_folder(spark, folder)
    return documents_of(blocks).join(names, ["part", "document"]).select("doc_id", "start", "n_tokens")
