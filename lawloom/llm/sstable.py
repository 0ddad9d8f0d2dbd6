"""Sorted-string-table shards of token ids, keyed by document id.

A shard file holds, in this order:

* data blocks, each Zstandard-compressed: entries ``shared, rest, size`` (varints: bytes
  of the key shared with the entry before, bytes of the rest of the key, bytes of the
  value), the rest of the key, the value. The first entry of a block shares nothing.
* the Bloom filter of all keys, 10 bits a key, 7 probes.
* the sparse index: for each block its first key (length as varint, bytes), offset and
  size in the file (varints), Zstandard-compressed.
* the footer of 56 bytes: offsets and sizes of filter and index, documents, tokens (six
  little-endian unsigned 64-bit integers), then the magic ``LLSST001``.

Keys are ids as big-endian unsigned 64-bit integers with the sign bit flipped, so bytes
sort like ids; a null id has the empty key. A value is one byte for the width of an id
(2 or 4 bytes) and the ids in that width, little-endian.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of, materialise, new_path
from .tokens import tokenizer

MAGIC = b"LLSST001"
_FOOTER = struct.Struct("<6Q8s")
_PROBES, _BITS_A_KEY = 7, 10
MANIFEST = "part int, seq int, path string, first_key binary, last_key binary, n_docs long, n_tokens long, bytes long"


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def pack_ids(ids: np.ndarray) -> bytes:
    small = not len(ids) or int(ids.max()) < 1 << 16
    return (b"\x02" if small else b"\x04") + ids.astype("<u2" if small else "<u4").tobytes()


def unpack_ids(value: bytes) -> np.ndarray:
    return np.frombuffer(value, "<u2" if value[0] == 2 else "<u4", offset=1).astype("<u4")


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = data[at]
        at += 1
        n |= (byte & 127) << shift
        if byte < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())
    return [(a + i * b) % bits for i in range(_PROBES)]


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and name of a path as Hadoop writes it; its names for object stores are told in Arrow's."""
    if ":" not in path:
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))


class Writer:
    """Writes one shard file; keys must come in ascending order."""

    def __init__(self, path: str, block_bytes: int = 1 << 16) -> None:
        self.path, self.block_bytes = path, block_bytes
        system, name = _open(path)
        system.create_dir(name.rpartition("/")[0], recursive=True)
        self.file = system.open_output_stream(name)
        self.pack = zstandard.ZstdCompressor(level=3).compress
        self.block, self.index, self.keys = bytearray(), [], []
        self.first = self.last = b""
        self.at = self.tokens = 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.keys and key < self.keys[-1]:
            raise ValueError("keys must ascend")
        if not self.block:
            self.first, self.last = key, b""
        shared = next((i for i, (a, b) in enumerate(zip(key, self.last, strict=False)) if a != b), min(len(key), len(self.last)))
        value = pack_ids(ids)
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.keys.append(key)
        self.last = key
        self.tokens += len(ids)
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            data = self.pack(bytes(self.block))
            self.index.append((self.first, self.at, len(data)))
            self.file.write(data)
            self.at += len(data)
            self.block = bytearray()

    def close(self) -> dict:
        self._flush()
        bits = max(64, _BITS_A_KEY * len(self.keys)) // 8 * 8
        bloom = np.zeros(bits, bool)
        bloom[[p for k in self.keys for p in _probes(k, bits)]] = True
        filter_ = np.packbits(bloom).tobytes()
        index = self.pack(b"".join(_varint(len(k)) + k + _varint(at) + _varint(n) for k, at, n in self.index))
        footer = _FOOTER.pack(self.at, len(filter_), self.at + len(filter_), len(index), len(self.keys), self.tokens, MAGIC)
        self.file.write(filter_ + index + footer)
        self.file.close()
        size = self.at + len(filter_) + len(index) + _FOOTER.size
        return {"path": self.path, "first_key": self.keys[0], "last_key": self.keys[-1], "n_docs": len(self.keys), "n_tokens": self.tokens, "bytes": size}


class Reader:
    """Reads one shard: in order, or one key by filter, index and block."""

    def __init__(self, path: str) -> None:
        system, name = _open(path)
        self.file = system.open_input_file(name)
        size = self.file.size()
        bloom_at, bloom_n, index_at, index_n, self.n_docs, self.n_tokens, magic = _FOOTER.unpack(self.file.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} isn't a shard")
        self.unpack = zstandard.ZstdDecompressor().decompress
        self.bloom = np.unpackbits(np.frombuffer(self.file.read_at(bloom_n, bloom_at), np.uint8)).astype(bool)
        self.index: list[tuple[bytes, int, int]] = []
        data, at = self.unpack(self.file.read_at(index_n, index_at)), 0
        while at < len(data):
            n, at = _read_varint(data, at)
            key, at = data[at : at + n], at + n
            offset, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            self.index.append((key, offset, size))

    def _block(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        _, offset, size = self.index[k]
        data, at, key = self.unpack(self.file.read_at(size, offset)), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, data[at : at + n]
            at += n

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for k in range(len(self.index)):
            for key, value in self._block(k):
                yield key, unpack_ids(value)

    def get(self, key: bytes) -> list[np.ndarray]:
        """The ids stored under key, one array for each document that has it."""
        if not all(self.bloom[p] for p in _probes(key, len(self.bloom))):
            return []
        found = []
        for k in range(max(0, bisect.bisect_left(self.index, (key, 0, 0)) - 1), len(self.index)):
            if self.index[k][0] > key:
                break
            found += [unpack_ids(value) for other, value in self._block(k) if other == key]
        return found


def write_sstables(
    docs: DataFrame, tokenizer_path: str, *, end_id: int = 2, path: str | None = None, shard_bytes: int = 64 << 20, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Tokenise docs and write them as shards in ascending order of id; returns the manifest.

    Texts are dealt once, by ranges of ids (of rows with equal ids, by a hash of the text and the
    place in the input, so that many such rows don't meet in one task); each task sorts its
    range, tokenises it and streams it into files of about ``shard_bytes``. A file's name holds the task attempt, and only the
    manifest (one row a file, written as Parquet in the shared folder) makes it part of the table,
    so repeated attempts leave at most unnamed files. ``start`` in the manifest is the number of
    tokens in all shards before.

    Cases: null text is empty, so it has the end id only; a null id sorts first; rows with equal
    ids stand side by side, ordered by a hash of the text; an empty table gives no shard.
    """
    spark = docs.sparkSession
    batches_of(spark, 500)
    folder = path or new_path(spark, "sstable")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, words, end = TaskContext.get(), tokenizer(tokenizer_path), np.array([end_id], "<u4")
        part, seq, writer, done = task.partitionId(), 0, None, []

        def closed() -> dict:
            return {"part": part, "seq": seq, **writer.close()}

        for batch in batches:
            texts = batch.column(1).to_pylist()
            for doc_id, ids in zip(batch.column(0).to_pylist(), words.encode(texts), strict=True):
                if writer is None:
                    writer = Writer(f"{folder}/shard-{part:06d}-{seq:04d}-{task.taskAttemptId()}.sst")
                writer.add(key_of(doc_id), np.concatenate((np.frombuffer(ids, "<u4"), end)))
                if writer.at >= shard_bytes:
                    done.append(closed())
                    writer, seq = None, seq + 1
        if writer is not None:
            done.append(closed())
        yield pa.RecordBatch.from_pylist(done, schema=out)

    out = pa.schema(
        [("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("first_key", pa.binary()), ("last_key", pa.binary())]
        + [("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("bytes", pa.int64())]
    )
    order = ["doc_id", "hash", "place"]
    written = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        .withColumns({"hash": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
        .mapInArrow(run, MANIFEST)
    )
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return materialise(written, "manifest").withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_sstables(manifest: DataFrame, *, with_ids: bool = True) -> DataFrame:
    """One row per document: doc_id, start (tokens of all documents before it), n_tokens, ids_crc32, ids.

    Each task reads some shards block by block, so its memory is that of a block and a batch.
    """
    shards = max(1, manifest.count())
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, start in zip(batch["path"], batch["start"], strict=True):
                rows, held = [], 0
                for key, ids in Reader(path):
                    rows.append((id_of(key), start, len(ids), zlib.crc32(ids.tobytes())) + ((ids.astype("i4"),) if with_ids else ()))
                    start += len(ids)
                    held += len(ids) if with_ids else 1
                    if held > 200_000:
                        yield _frame(rows, names)
                        rows, held = [], 0
                yield _frame(rows, names)

    names = [x.split()[0] for x in schema.split(", ")]
    return manifest.select("path", "start").repartition(shards, "path").mapInPandas(run, schema)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names)
    out["doc_id"] = out["doc_id"].astype("Int64")
    return out


def lookup(manifest: DataFrame, ids: DataFrame, *, max_shards: int = 1_000_000) -> DataFrame:
    """The stored ids of the documents in ``ids`` (column doc_id): doc_id, ids; others give no row.

    The shards' key ranges (one small row a file, checked against ``max_shards``) are broadcast;
    each task finds a key's shards by binary search, then uses filter, index and one block.
    """
    rows = manifest.select("first_key", "last_key", "path").orderBy("part", "seq").limit(max_shards + 1).collect()
    if len(rows) > max_shards:
        raise ValueError(f"over {max_shards} shards")
    shards = manifest.sparkSession.sparkContext.broadcast([(bytes(r.first_key), bytes(r.last_key), r.path) for r in rows])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranges, readers = shards.value, {}
        lasts = [last for _, last, _ in ranges]
        for batch in batches:
            found = []
            for doc_id in batch["doc_id"]:
                key = key_of(None if pd.isna(doc_id) else int(doc_id))
                for first, _, path in ranges[bisect.bisect_left(lasts, key) :]:
                    if first > key:
                        break
                    if path not in readers:
                        readers[path] = Reader(path)
                    found += [(id_of(key), x.astype("i4")) for x in readers[path].get(key)]
            yield _frame(found, ["doc_id", "ids"])

    return ids.select("doc_id").repartition("doc_id").sortWithinPartitions("doc_id").mapInPandas(run, "doc_id long, ids array<int>")
