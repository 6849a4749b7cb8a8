"""Token ids as binary files: fixed-width bit packing with block offsets.

File: 8 bytes ``IDPACK01``; little-endian unsigned 32-bit bits, ids per block, documents, blocks; unsigned 64-bit ids;
then per document its id (signed 64-bit), whether it has one (1 byte) and its number of ids (unsigned 64-bit); then one
unsigned 64-bit offset per block, counted from the file's start; then the blocks. A block holds 4096 ids of ``bits``
bits each, the lowest bit first; the last block is filled up with zeros. Any id range is read by its blocks alone.

Nulls and empty texts are documents of the end id alone. Documents without an id come first; rows that share an id
stand in the order of their texts. An empty table gives no files. Other columns are not read.
"""

from __future__ import annotations

import io
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prevuelo.llm.store import prepare, shared_path
from prevuelo.llm.tokens import encoder, ids_of

MAGIC = b"IDPACK01"
BLOCK = 4096
#: A file is closed once it holds this many ids; a document is never split between files.
FILE_IDS = 16_000_000

#: Pieces that an encoding worker remembers; it is alone in its task, so more than elsewhere.
PIECES = 500_000

_HEAD = struct.Struct("<8sIIIIQ")
_LINE = pa.schema([("part", pa.int32()), ("file_no", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
_GROUP = 64  # so many ids fill a whole number of 64-bit words, whatever the width


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` at ``bits`` bits each, filled up to whole blocks."""
    padded = np.zeros(-(-len(ids) // BLOCK) * BLOCK, np.uint64)
    padded[: len(ids)] = ids
    if bits in (8, 16, 32):  # the same bytes as below
        return padded.astype(f"<u{bits // 8}").tobytes()
    rows = padded.reshape(-1, _GROUP)
    out = np.zeros((len(rows), bits), np.uint64)
    for i in range(_GROUP):
        word, shift = divmod(i * bits, 64)
        out[:, word] |= rows[:, i] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= rows[:, i] >> np.uint64(64 - shift)
    return out.astype("<u8").tobytes()


def unpack(raw: bytes, bits: int) -> np.ndarray:
    """All ids of whole blocks, fill included."""
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}").astype(np.uint32)
    rows = np.frombuffer(raw, "<u8").reshape(-1, bits)
    out = np.empty((len(rows), _GROUP), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for i in range(_GROUP):
        word, shift = divmod(i * bits, 64)
        value = rows[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            value = value | (rows[:, word + 1] << np.uint64(64 - shift))
        out[:, i] = value & mask
    return out.reshape(-1)


def dump(doc_ids: list[int | None], texts_ids: list[bytes], bits: int) -> bytes:
    """One file."""
    ids = ids_of(b"".join(texts_ids))
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    blocks = -(-len(ids) // BLOCK)
    named = np.array([d is not None for d in doc_ids], np.uint8)
    out = io.BytesIO()
    out.write(_HEAD.pack(MAGIC, bits, BLOCK, len(doc_ids), blocks, len(ids)))
    out.write(np.array([d or 0 for d in doc_ids], "<i8").tobytes() + named.tobytes())
    out.write(np.array([len(t) // 4 for t in texts_ids], "<u8").tobytes())
    size = BLOCK * bits // 8
    out.write((out.tell() + 8 * blocks + size * np.arange(blocks, dtype="<u8")).astype("<u8").tobytes())
    out.write(pack(ids, bits))
    return out.getvalue()


class IdFile:
    """Random access to one file; only the asked blocks are read."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        magic, self.bits, self.block, docs, blocks, self.n_ids = _HEAD.unpack(self.file.read_at(_HEAD.size, 0))
        if magic != MAGIC:
            raise ValueError(f"not an id file: {uri}")
        index = self.file.read_at(17 * docs + 8 * blocks, _HEAD.size)
        self.doc_ids = np.frombuffer(index, "<i8", docs)
        self.named = np.frombuffer(index, np.uint8, docs, 8 * docs).astype(bool)
        self.lengths = np.frombuffer(index, "<u8", docs, 9 * docs).astype(np.int64)
        self.offsets = np.frombuffer(index, "<u8", blocks, 17 * docs)

    def read(self, start: int, count: int) -> np.ndarray:
        """Ids ``start`` to ``start + count`` of the file."""
        if count <= 0:
            return np.empty(0, np.uint32)
        first, last = start // self.block, (start + count - 1) // self.block
        size = self.block * self.bits // 8
        at = int(self.offsets[first])
        ids = unpack(self.file.read_at(int(self.offsets[last]) + size - at, at), self.bits)
        return ids[start - first * self.block :][:count]

    def close(self) -> None:
        self.file.close()


def write_ids(df: DataFrame, tokenizer: str, out: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every text, append ``end_id``, write files in ascending ``doc_id`` order below ``out``.

    Returns the manifest, one line per file: its name, place in the order, documents, ids, and the ids before it.
    Documents are range-partitioned; each task encodes and writes its own range. Names carry the task attempt, so what
    a lost or repeated attempt leaves behind is in no manifest.
    """

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, PIECES)
        bits = max(1, max(enc.tokenizer.get_vocab_size() - 1, end_id).bit_length())
        end = np.array([end_id], "<u4").tobytes()
        task = TaskContext.get()
        fs, root = pafs.FileSystem.from_uri(out)
        part, files = task.partitionId(), 0
        ids: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            name = f"part-{part:06d}-{files:04d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.ids"
            raw = dump(ids, held, bits)
            with fs.open_output_stream(f"{root}/{name}") as sink:
                sink.write(raw)
            row = {"part": part, "file_no": files, "name": name, "n_docs": len(ids), "n_ids": size}
            return pa.RecordBatch.from_pylist([row], _LINE)

        for batch in batches:
            found = enc.encode(batch["text"].to_pylist())
            for doc, raw in zip(batch["doc_id"].to_pylist(), found):
                ids.append(doc)
                held.append(raw + end)
                size += len(raw) // 4 + 1
                if size >= FILE_IDS:
                    yield close()
                    ids, held, size, files = [], [], 0, files + 1
        if ids:
            yield close()

    spark = df.sparkSession
    prepare(spark)
    jvm = spark._jvm
    jvm.org.apache.hadoop.fs.Path(out).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(jvm.org.apache.hadoop.fs.Path(out))
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    lines = rows.mapInArrow(save, "part int, file_no int, name string, n_docs long, n_ids long")
    lines.write.parquet(f"{out}/manifest")
    lines = spark.read.parquet(f"{out}/manifest")
    # one line per file, so one task orders them
    before = Window.orderBy("part", "file_no").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_ids(manifest: DataFrame, out: str) -> DataFrame:
    """One row per document of the files: doc_id, start (ids before it), ids (binary, unsigned 32-bit)."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch["name"].to_pylist(), batch["start"].to_pylist()):
                file = IdFile(f"{out}/{name}")
                ends = np.cumsum(file.lengths)
                first = 0
                while first < len(ends):  # about a megabyte of ids at a time
                    done = int(ends[first] - file.lengths[first])
                    last = max(first + 1, int(np.searchsorted(ends, done + 250_000, "right")))
                    ids = file.read(done, int(ends[last - 1]) - done).astype("<u4")
                    cuts = (ends[first:last] - done).tolist()
                    raw = ids.tobytes()
                    starts = [0, *cuts[:-1]]
                    named = pa.array(file.doc_ids[first:last], pa.int64(), mask=~file.named[first:last])
                    before = pa.array([start + done + x for x in starts], pa.int64())
                    ids = pa.array([raw[4 * x : 4 * y] for x, y in zip(starts, cuts)], pa.binary())
                    yield pa.RecordBatch.from_arrays([named, before, ids], ["doc_id", "start", "ids"])
                    first = last
                file.close()

    # a file a task: so few bytes of names would else all be read by one
    files = manifest.select("name", "start").repartition(max(1, manifest.count()), "name")
    return files.mapInArrow(load, "doc_id long, start long, ids binary")


def digests(read: DataFrame) -> DataFrame:
    """Length and crc32 of each document's ids, JVM-side."""
    return read.select(
        "doc_id",
        "start",
        F.expr("CAST(octet_length(ids) DIV 4 AS LONG)").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


def op10(df: DataFrame, tokenizer: str) -> DataFrame:
    out = shared_path(df.sparkSession, "ids")
    return digests(read_ids(write_ids(df, tokenizer, out, end_id=2), out))

