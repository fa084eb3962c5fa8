"""Token ids in binary files: blocks of ids as bit or byte planes, each compressed, under a chunk index.

A file holds the ids of consecutive documents. Layout, all integers little-endian:

    magic "LTP1" | blocks | index (zstandard of JSON) | index length, 8 bytes | magic

A block is ``block_ids`` ids (the last has fewer). Its ids are transposed so that plane p holds bit p (or
byte p) of every id, and each plane is a zstandard frame of its own; planes above the largest id are
absent. The index tells of each block its place, number of ids and plane sizes, so any one can be read
alone, and of all documents their ids, as differences, and lengths. Documents without an id come last; the index has their number.

Files are written by tasks under a name of their own for each attempt. The table of written files, in the
shared folder, names those of the attempts that counted; a lost executor leaves at most a file that
nothing refers to.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattice.llm.shared import Task, fresh_path, small_batches, table
from lattice.llm.text import blocks
from lattice.llm.tokens import Vocabulary, encoder

MAGIC = b"LTP1"
FILES = "part int, path string, documents long, ids long"
PART_BYTES = 32 << 20  # bytes of input, as stored, for each file


def split_planes(ids: np.ndarray, width: str) -> list[bytes]:
    """Planes of unsigned 32-bit ids, lowest first, as far up as any id reaches. Bits are packed, first id first."""
    data = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    top = int(ids.max()) if len(ids) else 0
    if width == "byte":
        return [np.ascontiguousarray(data[:, p]).tobytes() for p in range((top.bit_length() + 7) // 8)]
    return [np.packbits(data[:, p // 8] >> (p % 8) & 1).tobytes() for p in range(top.bit_length())]


def join_planes(planes: list[bytes], n: int, width: str) -> np.ndarray:
    """The ids that split_planes took apart."""
    data = np.zeros((n, 4), np.uint8)
    for p, plane in enumerate(planes):
        raw = np.frombuffer(plane, np.uint8)
        if width == "byte":
            data[:, p] = raw
        else:
            data[:, p // 8] |= np.unpackbits(raw, count=n) << (p % 8)
    return data.reshape(-1).view("<u4")


class Writer:
    """Writes one file; ids are added text by text in any amounts."""

    def __init__(self, out, block_ids: int = 1 << 16, width: str = "bit", level: int = 3):
        self.out, self.block_ids, self.width = out, block_ids, width
        self.zip = zstandard.ZstdCompressor(level=level)
        self.place, self.index, self.held, self.n_held, self.nameless = len(MAGIC), [], [], 0, 0
        self.docs: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        out.write(MAGIC)

    def add(self, doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, nameless: int = 0) -> None:
        """Adds texts; the last ``nameless`` of them have no id, and after such only such may follow."""
        if self.nameless and nameless < len(doc_ids):
            raise ValueError("documents without an id come last")
        self.nameless += nameless
        self.docs.append(doc_ids)
        self.lengths.append(lengths)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block_ids:
            flat = np.concatenate(self.held)
            whole = len(flat) // self.block_ids * self.block_ids
            for i in range(0, whole, self.block_ids):
                self._block(flat[i : i + self.block_ids])
            self.held, self.n_held = [flat[whole:].copy()], len(flat) - whole

    def _block(self, ids: np.ndarray) -> None:
        planes = [self.zip.compress(p) for p in split_planes(ids, self.width)]
        self.index.append([self.place, len(ids), [len(p) for p in planes]])
        for p in planes:
            self.out.write(p)
            self.place += len(p)

    def close(self) -> tuple[int, int]:
        """Ends the file; how many documents and ids it has."""
        if self.n_held:
            self._block(np.concatenate(self.held))
        docs = np.concatenate(self.docs) if self.docs else np.zeros(0, np.int64)
        lengths = np.concatenate(self.lengths) if self.lengths else np.zeros(0, np.int64)
        steps = docs.astype("<i8")
        steps[1:] = docs[1:] - docs[:-1]
        parts = [self.zip.compress(x) for x in (json.dumps({"width": self.width, "blocks": self.index, "nameless": self.nameless}).encode(), steps.tobytes(), lengths.astype("<i8").tobytes())]
        tail = b"".join(struct.pack("<Q", len(p)) + p for p in parts)
        self.out.write(tail + struct.pack("<Q", len(tail)) + MAGIC)
        return len(docs), int(lengths.sum())


class Reader:
    """Reads a file's index, then any blocks of it."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        end = self._at(size - 12, 12)
        if end[8:] != MAGIC or self._at(0, 4) != MAGIC:
            raise ValueError("not a file of token ids, or cut off")
        tail = self._at(size - 12 - (n := struct.unpack("<Q", end[:8])[0]), n)
        parts = []
        while tail:
            n = struct.unpack("<Q", tail[:8])[0]
            parts.append(zstandard.ZstdDecompressor().decompress(tail[8 : 8 + n]))
            tail = tail[8 + n :]
        head = json.loads(parts[0])
        self.width, self.blocks, self.nameless = head["width"], head["blocks"], head["nameless"]
        self.doc_ids, self.lengths = np.cumsum(np.frombuffer(parts[1], "<i8")), np.frombuffer(parts[2], "<i8")

    def _at(self, place: int, n: int) -> bytes:
        self.file.seek(place)
        return self.file.read(n)

    def block(self, k: int) -> np.ndarray:
        place, n, sizes = self.blocks[k]
        data, planes, a = self._at(place, sum(sizes)), [], 0
        for s in sizes:
            planes.append(zstandard.ZstdDecompressor().decompress(data[a : a + s]))
            a += s
        return join_planes(planes, n, self.width)

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) one after another; memory holds a block and the document at hand."""
        held, n, k = [], 0, 0
        names = self.doc_ids.tolist()
        names[len(names) - self.nameless :] = [None] * self.nameless
        for doc, length in zip(names, self.lengths.tolist(), strict=True):
            while n < length:
                held.append(self.block(k))
                n, k = n + len(held[-1]), k + 1
            flat = held[0] if len(held) == 1 else np.concatenate(held)
            yield doc, flat[:length]
            held, n = [flat[length:]], n - length


def _write(batches: Iterator[pa.RecordBatch], folder: str, vocabulary: Vocabulary, block_ids: int, width: str) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    encode, part, writer, out, path = encoder(vocabulary), TaskContext.get().partitionId(), None, None, ""
    for batch in batches:
        doc_ids, named = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_valid().to_numpy(zero_copy_only=False)
        for i, j, buf, offsets in blocks(batch):
            if writer is None:
                path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.ltp"
                fs, at = pyarrow.fs.FileSystem.from_uri(path)
                fs.create_dir(at.rsplit("/", 1)[0])
                out = fs.open_output_stream(at)
                writer = Writer(out, block_ids, width)
            ids, at_ids = encode(buf, offsets)
            writer.add(doc_ids[i:j], np.diff(at_ids), ids, int((~named[i:j]).sum()))
    if writer is not None:
        documents, n = writer.close()
        out.close()
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [path], "documents": [documents], "ids": [n]})


def _parts(docs: DataFrame) -> int | None:
    """Files for the input's size, if the plan knows it."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return -(-size // PART_BYTES) if 0 < size < 1 << 60 else None


def write_ids(docs: DataFrame, vocabulary: Vocabulary, folder: str | None = None, parts: int | None = None, block_ids: int = 1 << 16, width: str = "bit") -> DataFrame:
    """Encodes and writes all documents in ascending doc_id order; the table of files: part, path, documents, ids.

    Rows are dealt out by ranges of (doc_id, hash of the text), so rows that share an id still spread.
    Equal ids keep the order of that hash; rows without an id come last, in that order. Null and empty texts are
    the end id alone. ``folder`` is a URI that all executors reach; by default it is a new one in the
    shared folder. ``parts`` follows the input's size as stored, PART_BYTES each. No documents: no files.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or fresh_path(spark, "ids")
    folder = folder if "://" in folder else f"file://{folder.removeprefix('file:')}"
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = parts or _parts(docs)
    own = own.withColumn("h", F.xxhash64("text"))
    keys = (F.col("doc_id").isNull(), "doc_id", "h")
    dealt = own.repartitionByRange(parts, *keys) if parts else own.repartitionByRange(*keys)
    made = dealt.sortWithinPartitions(*keys).select("doc_id", "text").mapInArrow(Task(_write, folder=folder, vocabulary=vocabulary, block_ids=block_ids, width=width), FILES)
    return table(made, "files")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            fs, at = pyarrow.fs.FileSystem.from_uri(row["path"])
            with fs.open_input_file(at) as file:
                doc, start, n, crc, now = [], [], [], [], row["first"]
                for doc_id, ids in Reader(file).documents():
                    doc.append(doc_id)
                    start.append(now)
                    n.append(len(ids))
                    crc.append(zlib.crc32(np.ascontiguousarray(ids, "<u4")))
                    now += len(ids)
                    if len(doc) == 10_000:
                        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc, pa.int64()), "start": start, "n_tokens": n, "ids_crc32": crc})
                        doc, start, n, crc = [], [], [], []
            if doc:
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc, pa.int64()), "start": start, "n_tokens": n, "ids_crc32": crc})


def read_digest(files: DataFrame) -> DataFrame:
    """What the files hold, read back: doc_id, start (ids of all documents before), n_tokens, ids_crc32.

    The running total is over files, a row each, not over documents.
    """
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begun = files.withColumn("first", F.coalesce(F.sum("ids").over(order), F.lit(0)))
    rows = max(1, files.count())
    return begun.select("path", "first").repartition(rows, "path").mapInArrow(Task(_read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, files: DataFrame) -> DataFrame:
    """The documents' ids themselves: doc_id, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = pyarrow.fs.FileSystem.from_uri(path)
                with fs.open_input_file(at) as file:
                    for doc_id, ids in Reader(file).documents():
                        yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([ids.astype(np.int64)], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return files.select("path").mapInArrow(run, "doc_id long, ids array<long>")
