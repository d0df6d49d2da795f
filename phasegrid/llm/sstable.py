"""Operator 6: token ids in sorted-string-table shards.

A shard is a file of blocks, a sparse index of them, a Bloom filter over its keys and a footer. A key is the
document's identifier as eight big-endian bytes with the sign bit flipped, so that bytes sort as numbers do; a null
identifier is the empty key and comes first. In a block, a key is written as the length it shares with the
one before it and the rest; each RESTART-th key is whole, and the block ends with those keys' places, which
a lookup searches. A value is the document's ids, in two bytes each if all of them fit.

Spark sorts the documents into ranges of identifiers, each of which one task writes, under a name of its
own attempt. The manifest names the files that count, so a task that ran twice leaves no trace in the results.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, rows, shared_dir, stored, table
from .tokens import encoder

MAGIC = b"PGRIDSST"
FOOTER = struct.Struct("<QQQQQQI4x8s")  # places and lengths of index and filter, documents, tokens, hashes, magic
RESTART, BLOCK, KEY_BITS, HASHES = 16, 1 << 16, 10, 7
#: Bytes and documents after which a shard ends.
SHARD, SHARD_DOCS = 256 << 20, 1 << 20


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else ((doc_id ^ (1 << 63)) & (2**64 - 1)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    if not key:
        return None
    n = int.from_bytes(key, "big") ^ (1 << 63)
    return n - (1 << 64) if n >= 1 << 63 else n


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_number(data: memoryview, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bits(keys: list[bytes], size: int) -> np.ndarray:
    """Places in a filter of `size` bits, HASHES for each key, by double hashing."""
    a = np.array([xxhash.xxh64_intdigest(k, 1) for k in keys], np.uint64)
    b = np.array([xxhash.xxh64_intdigest(k, 2) for k in keys], np.uint64) | np.uint64(1)
    return ((a[:, None] + np.arange(HASHES, dtype=np.uint64) * b[:, None]) % np.uint64(size)).astype(np.int64)


def pack_ids(ids: bytes) -> bytes:
    """ids (32-bit) as a width byte and numbers of that width."""
    wide = np.frombuffer(ids, "<u4")
    return b"\x02" + wide.astype("<u2").tobytes() if not len(wide) or wide.max() < 1 << 16 else b"\x04" + ids


def unpack_ids(value: bytes) -> bytes:
    return np.frombuffer(value[1:], "<u2").astype("<u4").tobytes() if value[0] == 2 else bytes(value[1:])


class Writer:
    """Writes one shard; keys must come in ascending order, equal keys are allowed."""

    def __init__(self, out):
        self.out, self.at, self.index, self.keys = out, 0, [], []
        self.n_tokens, self.codec = 0, pa.Codec("zstd", compression_level=1)
        self._open()

    def _open(self) -> None:
        self.block, self.restarts, self.last, self.n = bytearray(), [], b"", 0

    def add(self, key: bytes, value: bytes, n_tokens: int) -> None:
        if self.keys and key < self.keys[-1]:
            raise ValueError("keys must ascend")
        shared = 0
        if self.n % RESTART == 0:
            self.restarts.append(len(self.block))
        else:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        self.block += _number(shared) + _number(len(key) - shared) + _number(len(value)) + key[shared:] + value
        self.last, self.n = key, self.n + 1
        self.keys.append(key)
        self.n_tokens += n_tokens
        if len(self.block) >= BLOCK:
            self._flush()

    def _flush(self) -> None:
        if not self.n:
            return
        raw = bytes(self.block) + struct.pack(f"<{len(self.restarts)}II", *self.restarts, len(self.restarts))
        data = self.codec.compress(raw, asbytes=True)
        self.index.append((self.last, self.at, len(data), len(raw)))
        self._write(data)
        self._open()

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        self._flush()
        index_at = self.at
        for key, at, size, raw in self.index:
            self._write(_number(len(key)) + key + struct.pack("<QII", at, size, raw))
        bloom_at, size = self.at, max(64, KEY_BITS * len(self.keys))
        bits = np.zeros(size, np.uint8)
        if self.keys:
            bits[_bits(self.keys, size).ravel()] = 1
        self._write(struct.pack("<Q", size) + np.packbits(bits).tobytes())
        self._write(FOOTER.pack(index_at, bloom_at - index_at, bloom_at, self.at - bloom_at, len(self.keys), self.n_tokens, HASHES, MAGIC))


class Shard:
    """Reads one shard: get() by filter and binary search, iteration block by block."""

    def __init__(self, file):
        self.file, self.codec = file, pa.Codec("zstd")
        size = file.size()
        index_at, index_size, bloom_at, bloom_size, self.n_docs, self.n_tokens, _, magic = FOOTER.unpack(file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        self.lasts, self.places, at, data = [], [], 0, memoryview(file.read_at(index_size, index_at))
        while at < index_size:
            n, at = _read_number(data, at)
            self.lasts.append(bytes(data[at : at + n]))
            self.places.append(struct.unpack_from("<QII", data, at + n))
            at += n + 16
        bloom = file.read_at(bloom_size, bloom_at)
        self.bits, self.bloom = struct.unpack_from("<Q", bloom)[0], np.frombuffer(bloom, np.uint8, offset=8)

    def may_have(self, key: bytes) -> bool:
        at = _bits([key], self.bits)[0]
        return bool((self.bloom[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).all())

    def _block(self, i: int) -> tuple[memoryview, tuple[int, ...]]:
        at, size, raw = self.places[i]
        data = self.codec.decompress(self.file.read_at(size, at), raw, asbytes=True)
        n = struct.unpack_from("<I", data, len(data) - 4)[0]
        end = len(data) - 4 - 4 * n
        return memoryview(data)[:end], struct.unpack_from(f"<{n}I", data, end)

    @staticmethod
    def _entries(data: memoryview, at: int) -> Iterator[tuple[bytes, memoryview]]:
        key = b""
        while at < len(data):
            shared, at = _read_number(data, at)
            rest, at = _read_number(data, at)
            size, at = _read_number(data, at)
            key = key[:shared] + bytes(data[at : at + rest])
            yield key, data[at + rest : at + rest + size]
            at += rest + size

    def __iter__(self) -> Iterator[tuple[bytes, memoryview]]:
        for i in range(len(self.places)):
            yield from self._entries(self._block(i)[0], 0)

    def get(self, key: bytes) -> list[bytes]:
        """The values of a key, in the order written."""
        if not self.may_have(key):
            return []
        found = []
        for i in range(bisect_left(self.lasts, key), len(self.lasts)):
            data, restarts = self._block(i)
            whole = [next(self._entries(data, at))[0] for at in restarts]
            for k, v in self._entries(data, restarts[max(0, bisect_left(whole, key) - 1)]):
                if k > key:
                    return found
                if k == key:
                    found.append(bytes(v))
        return found


def open_shard(path: str) -> Shard:
    where, at = fs.FileSystem.from_uri(path)
    return Shard(where.open_input_file(at))


MANIFEST = "shard long, path string, first_id long, last_id long, n_docs long, n_tokens long"


def write_shards(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, end_id: int = 2, shard_bytes: int = SHARD) -> DataFrame:
    """The manifest of the shards that hold the ids of docs(doc_id, text), with end_id after each document's.

    folder: a URI that all executors reach. Shards ascend by identifier, null first; equal identifiers go by text. Null texts
    are empty. Other columns are not read. An empty table gives an empty manifest. The manifest is stored. A task begins
    another shard after shard_bytes, or SHARD_DOCS documents, whose keys it holds.
    """
    spark, vocabulary = docs.sparkSession, tokenizer
    folder = f"{folder or shared_dir(spark)}/sst-{uuid.uuid4().hex}"
    end = struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, writer, shard = encoder(vocabulary), None, TaskContext.get().partitionId() << 24
        for ids, texts in rows(batches, 64):
            for doc_id, value in zip(ids, encode.many(texts)):
                if writer is None:
                    path = f"{folder}/{shard:012d}-{uuid.uuid4().hex}.sst"
                    where, at = fs.FileSystem.from_uri(path)
                    where.create_dir(at.rpartition("/")[0], recursive=True)
                    writer = Writer(out := where.open_output_stream(at))
                value += end
                writer.add(key_of(doc_id), pack_ids(value), len(value) // 4)
                if writer.at >= shard_bytes or len(writer.keys) >= SHARD_DOCS:
                    yield closed(shard, path, writer, out)
                    writer, shard = None, shard + 1
        if writer is not None:
            yield closed(shard, path, writer, out)

    def closed(shard: int, path: str, writer: Writer, out) -> pa.RecordBatch:
        writer.close()
        out.close()
        row = (shard, path, id_of(writer.keys[0]), id_of(writer.keys[-1]), len(writer.keys), writer.n_tokens)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], [c.split()[0] for c in MANIFEST.split(", ")])

    ordered = docs.select("doc_id", "text").repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    return stored(ordered.mapInArrow(write, MANIFEST), "manifest")


def read_shards(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), and ids if asked for, of each document, read from the files."""
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    places = manifest.select("path", F.coalesce(before, F.lit(0)).alias("base")).repartition(partitions(manifest.sparkSession))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for paths, bases in rows(batches):
            for path, at in zip(paths, bases):
                out = []
                for key, value in open_shard(path):
                    ids = unpack_ids(value)
                    out.append((id_of(key), at, len(ids) // 4, zlib.crc32(ids), ids if with_ids else None))
                    at += len(ids) // 4
                    if len(out) == 256:
                        yield _batch(out)
                        out = []
                if out:
                    yield _batch(out)

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    got = places.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
    return got if with_ids else got.drop("ids")


def lookup(manifest: DataFrame, doc_ids: list[int | None]) -> dict[int | None, list[bytes]]:
    """The ids (32-bit) of a few documents, by the manifest's ranges, the filters and binary search."""
    files = sorted(manifest.collect(), key=lambda r: r.shard)
    lasts, found = [key_of(r.last_id) for r in files], {}
    for doc_id in doc_ids:
        key, found[doc_id] = key_of(doc_id), []
        for r in files[bisect_left(lasts, key) : bisect_right([key_of(r.first_id) for r in files], key)]:
            found[doc_id] += [unpack_ids(v) for v in open_shard(r.path).get(key)]
    return found


def op6_sstable(spark, sf_dir):
    return read_shards(write_shards(table(spark, sf_dir, "documents")))
