"""Token-id files by bit-plane shuffling.

A shard file holds the ids of documents in order.  Ids are cut into blocks of ``BLOCK_IDS``; a block is
transposed into bit planes (plane b holds bit b of every id) or byte planes, each plane is compressed with
zstandard, and a chunk index at the end of the file gives each block's place and its planes' sizes.

    file   = MAGIC, block*, index, u64 offset of the index, u64 its length, MAGIC
    block  = its planes, one after another, each a zstandard frame
    index  = zstandard frame of JSON {"blocks": [[offset, n_ids, [plane sizes]]], "mode", "docs", "doc_bytes"}
             followed, inside the same frame, by the documents' ids and lengths (int64 each)

Documents go to shards by ranges of doc_id (rows that repeat one may be dealt to several), sorted inside, about ``SHARD_BYTES`` of text to each; a shard is written under a name of its own
for each task attempt, and the manifest names the file of the attempt that succeeded, so lost executors
leave nothing but an unread file.  Reading opens only files that the manifest names.

Defined cases: a null or empty text has the end id alone; a null doc_id sorts first; rows that repeat a doc_id are
written as often as they come, in the order of their texts' hash; an empty table gives no shard and no row.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import prepare, scratch, shuffle_width
from brindle.llm.tokens import crc32_of, default_path, encoder

MAGIC = b"BRPLANE1"
BLOCK_IDS = 1 << 16
NO_DOC = -(1 << 63)
#: Text bytes of a shard at most, on average, and ids read by a task.
SHARD_BYTES, TASK_IDS = 64 << 20, 32 << 20


def to_planes(ids: np.ndarray, mode: str) -> list[bytes]:
    """Planes of a block, lowest first; the highest planes that are zero throughout are left out."""
    wide = np.ascontiguousarray(ids, "<u4")
    n_bytes = max(1, (int(wide.max(initial=0)).bit_length() + 7) // 8)
    octets = wide.view(np.uint8).reshape(-1, 4)[:, :n_bytes]
    if mode == "byte":
        return [np.ascontiguousarray(octets[:, b]).tobytes() for b in range(n_bytes)]
    out = []
    for b in range(n_bytes):
        column = np.ascontiguousarray(octets[:, b])
        out += [np.packbits((column >> bit) & 1, bitorder="little").tobytes() for bit in range(8)]
    while len(out) > 1 and not any(out[-1]):
        out.pop()
    return out


def from_planes(planes: list[bytes], n: int, mode: str) -> np.ndarray:
    out = np.zeros(n, "<u4")
    for i, plane in enumerate(planes):
        if mode == "byte":
            out |= np.frombuffer(plane, np.uint8, n).astype("<u4") << np.uint32(8 * i)
        else:
            out |= np.unpackbits(np.frombuffer(plane, np.uint8), bitorder="little", count=n).astype("<u4") << np.uint32(i)
    return out


class ShardWriter:
    """Writes one shard to a binary stream, block by block."""

    def __init__(self, stream, mode: str = "bit", level: int = 3) -> None:
        self.stream, self.mode, self.press = stream, mode, zstandard.ZstdCompressor(level=level)
        self.at, self.blocks, self.waiting, self.n_waiting = len(MAGIC), [], [], 0
        self.doc_ids: list[int] = []
        self.lengths: list[int] = []
        stream.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(NO_DOC if doc_id is None else doc_id)
        self.lengths.append(len(ids))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= BLOCK_IDS:
            joined = np.concatenate(self.waiting)
            whole = len(joined) // BLOCK_IDS * BLOCK_IDS
            for i in range(0, whole, BLOCK_IDS):
                self._block(joined[i : i + BLOCK_IDS])
            self.waiting, self.n_waiting = [joined[whole:]], len(joined) - whole

    def _block(self, ids: np.ndarray) -> None:
        frames = [self.press.compress(p) for p in to_planes(ids, self.mode)]
        self.stream.write(b"".join(frames))
        self.blocks.append([self.at, len(ids), [len(f) for f in frames]])
        self.at += sum(map(len, frames))

    def close(self) -> None:
        if self.n_waiting:
            self._block(np.concatenate(self.waiting))
        head = json.dumps({"blocks": self.blocks, "mode": self.mode, "docs": len(self.doc_ids)}).encode()
        body = np.asarray([*self.doc_ids, *self.lengths], "<i8").tobytes()
        index = self.press.compress(struct.pack("<Q", len(head)) + head + body)
        self.stream.write(index + struct.pack("<QQ", self.at, len(index)) + MAGIC)


class ShardReader:
    """Reads a shard by its chunk index; blocks are fetched one at a time."""

    def __init__(self, stream, size: int) -> None:
        self.stream, self.unpress = stream, zstandard.ZstdDecompressor()
        tail = self._read(size - 24, 24)
        at, length = struct.unpack("<QQ", tail[:16])
        if tail[16:] != MAGIC:
            raise ValueError("not a token shard, or one cut short")
        raw = self.unpress.decompress(self._read(at, length))
        n = struct.unpack("<Q", raw[:8])[0]
        self.head = json.loads(raw[8 : 8 + n])
        table = np.frombuffer(raw[8 + n :], "<i8")
        self.doc_ids, self.lengths = table[: self.head["docs"]], table[self.head["docs"] :]

    def _read(self, at: int, n: int) -> bytes:
        self.stream.seek(at)
        return self.stream.read(n)

    def block(self, i: int) -> np.ndarray:
        at, n, sizes = self.head["blocks"][i]
        raw, planes, pos = self._read(at, sum(sizes)), [], 0
        for s in sizes:
            planes.append(self.unpress.decompress(raw[pos : pos + s]))
            pos += s
        return from_planes(planes, n, self.head["mode"])

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, ids before it in the shard, its ids) in file order."""
        rest, at, start = np.empty(0, "<u4"), 0, 0
        for doc_id, length in zip(self.doc_ids.tolist(), self.lengths.tolist(), strict=True):
            parts, have = [rest], len(rest)
            while have < length:
                parts.append(self.block(at))
                have += len(parts[-1])
                at += 1
            joined = np.concatenate(parts) if len(parts) > 1 else rest
            yield (None if doc_id == NO_DOC else doc_id), start, joined[:length]
            rest = joined[length:]
            start += length


def _opened(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _write(tokenizer: str, folder: str, mode: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, writer, n = TaskContext.get().partitionId(), None, 0
        made = encoder(tokenizer)
        for batch in batches:
            if writer is None and batch.num_rows:
                name = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex[:8]}.planes"
                filesystem, path = _opened(name)
                filesystem.create_dir(path.rpartition("/")[0], recursive=True)
                stream = filesystem.open_output_stream(path)
                writer = ShardWriter(stream, mode)
            for doc_id, ids in zip(batch.column(0).to_pylist(), made.encode_documents(batch.column(1).to_pylist()), strict=True):
                writer.add(doc_id, ids)
                n += len(ids)
        if writer:
            writer.close()
            stream.close()
            yield pa.record_batch([pa.array([shard], pa.int64()), pa.array([name]), pa.array([n], pa.int64())], ["shard", "path", "n_ids"])

    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, mode: str = "bit") -> DataFrame:
    """Encodes (doc_id, text) and writes shards in ascending doc_id order.

    Returns the manifest (shard, path, n_ids, base): one row a shard, base being the ids of all shards before it.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    held = rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    tied = rows.withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())  # so that one doc_id can be split; equal rows may come in any order
    dealt = tied.repartitionByRange(shuffle_width(spark, held, SHARD_BYTES), "doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    rows = dealt.mapInArrow(_write(tokenizer or default_path(), folder, mode), "shard long, path string, n_ids long").collect()  # a few bytes for each shard
    manifest, base = [], 0
    for shard, path, n in sorted(map(tuple, rows)):
        manifest.append((shard, path, n, base))
        base += n
    return spark.createDataFrame(manifest, "shard long, path string, n_ids long, base long")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
            filesystem, path = _opened(name)
            with filesystem.open_input_file(path) as stream:
                out: list[tuple] = []
                for doc_id, start, ids in ShardReader(stream, stream.size()).documents():
                    out.append((doc_id, base + start, len(ids), crc32_of(ids), name))
                    if len(out) >= 4096:
                        yield _rows(out)
                        out = []
                if out:
                    yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.string()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32", "path"])


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, path) of every document, from the files."""
    spark = manifest.sparkSession
    n = manifest.agg(F.sum("n_ids").alias("n")).first().n or 0
    return manifest.select("path", "base").repartition(shuffle_width(spark, n, TASK_IDS)).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long, path string")


def qualified(spark: SparkSession, path: str) -> str:
    """A full address, by which workers find the same folder as Spark does."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toUri().toString()
    return "file://" + found.removeprefix("file:") if found.startswith("file:/") and not found.startswith("file:///") else found


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    return read_token_files(write_token_files(docs, qualified(spark, scratch(spark, "planes")), tokenizer))
