"""Token ids in files of fixed-width bit fields, with blocks that can be read one by one.

A file holds blocks of ``BLOCK`` ids (the last may be shorter). Every id takes the fewest bits that the
vocabulary needs, least bit first; a block is padded to whole bytes. Behind the blocks stand the blocks'
offsets, the documents' ids (a null one is marked) and the place after each document's last id, then a
header as JSON and its length. Documents are in ascending order of ``doc_id``, in a file and over the
files; ``manifest`` rows give the files' order and the ids before each.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm.units import Memory, Ragged, single_threaded, slices
from lodestar.sources.tables import remember, shared_dir, stored, table

BLOCK, MAGIC = 1 << 16, b"BITSIDS1"
#: The id behind every document.
END = 2
#: Widths at which the fields are whole little-endian numbers.
WHOLE = {8: "<u1", 16: "<u2", 32: "<u4"}


def pack(ids: np.ndarray, width: int) -> bytes:
    """``ids`` in ``width`` bits each, least bit first, padded to whole bytes."""
    if width in WHOLE:
        return ids.astype(WHOLE[width]).tobytes()
    bits = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return np.packbits(bits, bitorder="little").tobytes()


def unpack(data: bytes, width: int, start: int, stop: int) -> np.ndarray:
    """The ids ``start`` to ``stop`` of packed ``data``."""
    if width in WHOLE:
        return np.frombuffer(data, WHOLE[width])[start:stop].astype(np.uint32)
    low = start * width
    bits = np.unpackbits(np.frombuffer(data, np.uint8)[low // 8 : -(-stop * width // 8)], bitorder="little")
    bits = bits[low % 8 : low % 8 + (stop - start) * width].reshape(-1, width)
    wide = np.zeros((stop - start, 32), np.uint8)
    wide[:, :width] = bits
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").reshape(-1)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


class Writer:
    """Writes one file, block by block."""

    def __init__(self, path: str, width: int):
        where, name = opened(path)
        self.out, self.width = where.open_output_stream(name), width
        self.offsets, self.docs, self.ends, self.kept, self.n = [0], [], [], [], 0

    def add(self, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> self.width:
            raise ValueError(f"an id needs more than {self.width} bits")
        self.kept.append(ids)
        self.n += len(ids)
        if sum(map(len, self.kept)) >= BLOCK:
            self.flush(BLOCK)

    def end(self, docs: list[int | None], ends: np.ndarray) -> None:
        """``docs`` end at ``ends``, counted in this file."""
        self.docs += docs
        self.ends.append(ends)

    def flush(self, least: int) -> None:
        ids, at = np.concatenate(self.kept) if self.kept else np.zeros(0, np.uint32), 0
        while len(ids) - at >= least and at < len(ids):
            block = pack(ids[at : at + BLOCK], self.width)
            self.out.write(block)
            self.offsets.append(self.offsets[-1] + len(block))
            at += BLOCK
        self.kept = [ids[at:]] if at < len(ids) else []

    def close(self) -> None:
        self.flush(1)
        null = [i for i, d in enumerate(self.docs) if d is None]
        parts = [np.array(self.offsets, "<u8"), np.array([d or 0 for d in self.docs], "<i8"), np.concatenate([np.zeros(0, np.int64), *self.ends]).astype("<u8")]
        head = json.dumps({"width": self.width, "block": BLOCK, "ids": self.n, "docs": len(self.docs), "null": null, "index": self.offsets[-1]}).encode()
        for p in parts:
            self.out.write(p.tobytes())
        self.out.write(head + len(head).to_bytes(8, "little") + MAGIC)
        self.out.close()


class Reader:
    """Random access to one file: any range of its ids, any of its documents."""

    def __init__(self, path: str):
        where, name = opened(path)
        self.file = where.open_input_file(name)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{path} is no file of packed ids")
        n = int.from_bytes(tail[:8], "little")
        head = json.loads(self.file.read_at(n, size - 16 - n))
        self.width, self.block, self.n = head["width"], head["block"], head["ids"]
        blocks, docs = -(-self.n // self.block) + 1, head["docs"]
        index = self.file.read_at(8 * (blocks + 2 * docs), head["index"])
        self.offsets = np.frombuffer(index, "<u8", blocks).astype(np.int64)
        self.docs = np.frombuffer(index, "<i8", docs, 8 * blocks).tolist()
        for i in head["null"]:
            self.docs[i] = None
        self.ends = np.frombuffer(index, "<u8", docs, 8 * (blocks + docs)).astype(np.int64)

    def blocks(self, start: int, stop: int) -> Iterator[np.ndarray]:
        """The ids ``start`` to ``stop``, a block at a time; only the blocks that hold them are read."""
        while start < stop:
            k = start // self.block
            until = min(stop, (k + 1) * self.block)
            # eight ids fill whole bytes
            first, last = (start - k * self.block) // 8, -(-(until - k * self.block) * self.width // 8)
            data = self.file.read_at(last - first * self.width, int(self.offsets[k]) + first * self.width)
            skip = start - k * self.block - 8 * first
            yield unpack(data, self.width, skip, skip + until - start)
            start = until

    def ids(self, start: int, stop: int) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint32), *self.blocks(start, stop)])

    def document(self, i: int) -> np.ndarray:
        """The ids of the file's ``i``-th document, its end id included."""
        return self.ids(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))

    def close(self) -> None:
        self.file.close()


class Encoder:
    """A byte-level vocabulary of the tokenizers library; each distinct unit is encoded once."""

    def __init__(self, path: str):
        single_threaded()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = max(1, (self.tokenizer.get_vocab_size() - 1).bit_length())
        self.forget()

    def forget(self) -> None:
        self.memory, self.ids = Memory(self.learn), Ragged.empty(np.uint32)

    def learn(self, units: list[str]) -> None:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        self.ids = self.ids.grown(n, np.fromiter(chain.from_iterable(ids), np.uint32, int(n.sum())))

    def encode(self, texts: pa.Array, end: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows that end, the number of ids so far up to each end (the end id counts), and the ids; a part of the texts at a time."""
        for part in slices(texts):
            if self.memory.full():
                self.forget()
            numbers = self.memory.numbers(part.units)
            n = np.cumsum(np.concatenate([[0], self.ids.lengths(numbers)]))[np.cumsum(part.counts)][part.ends]
            ids = np.insert(self.ids.take(numbers), n, np.uint32(end))
            yield part.rows[part.ends], n + np.arange(1, len(n) + 1), ids


@cache
def encoder(path: str) -> Encoder:
    """A worker's encoder, kept between its tasks."""
    return Encoder(path)


def write_packed(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """Encode ``docs(doc_id, text)`` and write the ids to files in the shared folder.

    Returns the stored ``manifest(file, path, n_docs, n_ids, before)``: files in order of ``doc_id`` (null ids
    first, equal ids by text), and the ids in all files before. Texts are dealt to tasks by ranges of
    ``doc_id`` before they are encoded. A task writes its file under a new name and only a task that ended
    is in the manifest, so what a lost executor began is never read. Rows of one ``doc_id`` share a file.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/packed-{uuid.uuid4().hex}"
    spark.range(1, numPartitions=1).write.json(f"{folder}/about")  # makes the folder, on whatever system it is
    remember(spark, folder)

    def write(batches):
        from pyspark import TaskContext

        tokens, writer, where = encoder(path), None, ""
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                where = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.ids"
                writer = Writer(where, tokens.width)
            docs = batch.column(0).to_pylist()
            for rows, n, ids in tokens.encode(batch.column(1), end):
                writer.end([docs[r] for r in rows], writer.n + n)
                writer.add(ids)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"file": pa.array([TaskContext.get().partitionId()], pa.int32()), "path": [where], "n_docs": pa.array([len(writer.docs)], pa.int64()), "n_ids": pa.array([writer.n], pa.int64())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ranged = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    files = stored(ranged.mapInArrow(write, "file int, path string, n_docs long, n_ids long"), "manifest")
    # a row a file: a window over all of them is small
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return stored(files.withColumn("before", before), "manifest")


def read_packed(manifest: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, from the files; a block is in memory at a time."""

    def read(batches):
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = Reader(path)
                crcs, doc, at = np.zeros(len(file.docs), np.int64), 0, 0
                for ids in file.blocks(0, file.n):
                    raw, low = memoryview(ids.astype("<u4")).cast("B"), at
                    while doc < len(file.docs) and at < low + len(ids):
                        stop = min(int(file.ends[doc]), low + len(ids))
                        crcs[doc] = zlib.crc32(raw[4 * (at - low) : 4 * (stop - low)], int(crcs[doc]))
                        doc, at = doc + (stop == file.ends[doc]), stop
                starts = np.concatenate([[0], file.ends[:-1]]) if len(file.docs) else file.ends
                file.close()
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(file.docs, pa.int64()), "start": starts + before, "n_tokens": file.ends - starts, "ids_crc32": crcs})

    spread = manifest.select("path", "before").repartition(max(1, manifest.count()))
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_range(manifest: DataFrame, start: int, stop: int) -> DataFrame:
    """``(at, ids)``: the ids from place ``start`` to before ``stop`` of all files, a row for each file and block that holds some."""

    def read(batches):
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = Reader(path)
                at = max(start - before, 0)
                for ids in file.blocks(at, min(stop - before, file.n)):
                    yield pa.RecordBatch.from_pydict({"at": pa.array([before + at], pa.int64()), "ids": pa.array([ids.astype(np.int32)], pa.list_(pa.int32()))})
                    at += len(ids)
                file.close()

    held = manifest.where((F.col("before") < stop) & (F.col("before") + F.col("n_ids") > start))
    return held.select("path", "before").mapInArrow(read, "at long, ids array<int>")


def op11_packed_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` as ids of the byte-level vocabulary, packed in files and read back.

    A null or empty text has the end id alone. Rows without an id come first, under a null ``doc_id``; rows of one id
    follow each other, ordered by text, each with its own result. An empty table gives no file and no row. Other columns are not read.
    """
    return read_packed(write_packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
