"""Sorted-string-table shards.

A shard is one binary: data blocks, a Bloom filter, a sparse block index and a
footer.  Entries are ordered by key; a block keeps of each key only what differs
from the key before, with a whole key at every ``RESTART`` th entry; the index
holds each block's last key, so a lookup asks the filter, searches the index
by bisection, reads one block and bisects its restart points.  Blocks are zstd
frames with an xxh64 checksum.

Writing range-partitions the rows by identifier, sorts within partitions and
streams each into shards of about ``SHARD_BYTES``; only filter and index stay in
memory.  The result has one row for each section; sections of a shard in order of
``seq`` make up the file.

``write_files`` stores the shards as files, and ``Shards`` looks keys up in them.

Defined results: integers are ordered by value, identifiers of any other type by
the bytes of their text; rows of equal keys lie together, ordered by their values;
a null identifier has the smallest key and can be looked up;
rows that repeat an identifier are all stored, and a lookup gives them all; null
columns, empty and very long texts are stored as they are; an empty table gives
no shards; all other columns go into the value as JSON under their own names.
"""

from __future__ import annotations

import bisect
import json
import struct
import sys
import uuid

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from .common import columns, kind_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])
MAGIC = b"SSTSHRD1"
BLOCK_BYTES = 32 << 10
SHARD_BYTES = 64 << 20
RESTART = 16
BITS_PER_KEY = 10
PROBES = 7
FOOTER = "<QQQQQ8s"  # where the filter and the index are, how long they are, entries, magic
SCHEMA = "shard long, seq int, kind string, first_key binary, last_key binary, entries long, bytes binary"


def key_of(value) -> bytes:
    """Order-preserving key: nulls, then integers by value, then strings by their bytes."""
    if value is None:
        return b"\x00"
    if isinstance(value, int):
        return b"\x01" + (value + (1 << 63)).to_bytes(8, "big")
    return b"\x02" + value.encode()


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = data[at]
        n |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return n, at


def common_prefix(a: bytes, b: bytes) -> int:
    """How many bytes two keys begin with together: the place of the first difference, by one comparison of numbers."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


class Builder:
    """Takes entries in order of their keys; ``add`` and ``finish`` give the sections that are complete."""

    def __init__(self, shard: int, block_bytes: int = BLOCK_BYTES):
        self.shard, self.block_bytes = shard, block_bytes
        self.squeeze = zstandard.ZstdCompressor(level=1)
        self.at = self.seq = self.entries = 0
        self.index: list[tuple[bytes, int, int]] = []
        self.hashes: list[int] = []
        self.first = b""
        self.begin()

    def begin(self):
        self.block, self.restarts, self.count, self.last, self.block_first = bytearray(), [], 0, b"", b""

    def add(self, key: bytes, value: bytes):
        if self.count % RESTART:
            shared = common_prefix(key, self.last)
        else:
            shared = 0
            self.restarts.append(len(self.block))
        if not self.count:
            self.block_first = key
        if not self.entries:
            self.first = key
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        if not self.hashes or key != self.last or not self.count:
            self.hashes.append(xxhash.xxh64_intdigest(key))
        self.last, self.count, self.entries = key, self.count + 1, self.entries + 1
        return self.flush() if len(self.block) >= self.block_bytes else None

    def section(self, kind: str, data: bytes, first: bytes, last: bytes, entries: int):
        row = (self.shard, self.seq, kind, first, last, entries, data)
        self.at, self.seq = self.at + len(data), self.seq + 1
        return row

    def flush(self):
        body = bytes(self.block) + struct.pack(f"<{len(self.restarts)}I", *self.restarts) + struct.pack("<I", len(self.restarts))
        packed = self.squeeze.compress(body)
        packed += struct.pack("<Q", xxhash.xxh64_intdigest(packed))
        self.index.append((self.last, self.at, len(packed)))
        row = self.section("data", packed, self.block_first, self.last, self.count)
        self.begin()
        return row

    def finish(self):
        if self.count:
            yield self.flush()
        last = self.index[-1][0]
        hashes = np.array(self.hashes, np.uint64)
        bits = max(64, -(-len(hashes) * BITS_PER_KEY // 64) * 64)
        table = np.zeros(bits, bool)
        for probe in range(PROBES):
            table[((hashes + np.uint64(probe) * ((hashes >> np.uint64(17)) | np.uint64(1))) % np.uint64(bits)).astype(np.int64)] = True
        where_filter, packed = self.at, np.packbits(table).tobytes()
        yield self.section("filter", packed, self.first, last, len(hashes))
        where_index, index = self.at, b"".join(varint(len(k)) + k + varint(at) + varint(size) for k, at, size in self.index)
        yield self.section("index", index, self.first, last, len(self.index))
        yield self.section("footer", struct.pack(FOOTER, where_filter, len(packed), where_index, len(index), self.entries, MAGIC), self.first, last, self.entries)


class Reader:
    """Looks keys up in a shard: its bytes, or an open file (with ``size`` and ``read_at``), of which only footer, filter, index and single blocks are read."""

    def __init__(self, data):
        self.data = data
        size = len(data) if isinstance(data, (bytes, memoryview)) else data.size()
        foot = struct.calcsize(FOOTER)
        filter_at, filter_size, index_at, index_size, self.entries, magic = struct.unpack(FOOTER, self.fetch(size - foot, size)) if size >= foot else (0,) * 6
        if magic != MAGIC:
            raise ValueError("not a sorted-string-table shard")
        self.filter, index = self.fetch(filter_at, filter_at + filter_size), self.fetch(index_at, index_at + index_size)
        self.keys, self.blocks, at = [], [], 0
        while at < index_size:
            n, at = read_varint(index, at)
            self.keys.append(index[at : at + n])
            where, at = read_varint(index, at + n)
            length, at = read_varint(index, at)
            self.blocks.append((where, length))

    def fetch(self, begin: int, end: int) -> bytes:
        return bytes(self.data[begin:end]) if isinstance(self.data, (bytes, memoryview)) else self.data.read_at(end - begin, begin)

    def may_contain(self, key: bytes) -> bool:
        h, bits = xxhash.xxh64_intdigest(key), len(self.filter) * 8
        for probe in range(PROBES):
            slot = ((h + probe * ((h >> 17) | 1)) & 0xFFFFFFFFFFFFFFFF) % bits
            if not self.filter[slot >> 3] >> (7 - (slot & 7)) & 1:
                return False
        return True

    def block(self, number: int) -> tuple[bytes, list[int], int]:
        where, size = self.blocks[number]
        packed = self.fetch(where, where + size)
        packed, (check,) = packed[:-8], struct.unpack("<Q", packed[-8:])
        if xxhash.xxh64_intdigest(packed) != check:
            raise ValueError(f"block {number} is damaged")
        body = zstandard.ZstdDecompressor().decompress(packed)
        (n,) = struct.unpack("<I", body[-4:])
        end = len(body) - 4 - 4 * n
        return body, list(struct.unpack(f"<{n}I", body[end:-4])), end

    def entries_from(self, number: int, key: bytes = b""):
        """The entries of a block, from the restart point before ``key`` on."""
        body, restarts, end = self.block(number)
        low, high = 0, len(restarts) - 1
        while low < high:  # the last restart point whose key is less than the key
            middle = (low + high + 1) // 2
            _, at = read_varint(body, restarts[middle])
            size, at = read_varint(body, at)
            _, at = read_varint(body, at)
            low, high = (middle, high) if body[at : at + size] < key else (low, middle - 1)
        at, last = restarts[low], b""
        while at < end:
            shared, at = read_varint(body, at)
            rest, at = read_varint(body, at)
            size, at = read_varint(body, at)
            last = last[:shared] + body[at : at + rest]
            yield last, body[at + rest : at + rest + size]
            at += rest + size

    def get(self, value) -> list[dict]:
        """The values stored under an identifier."""
        key, found = key_of(value), []
        if not self.may_contain(key):
            return found
        for number in range(bisect.bisect_left(self.keys, key), len(self.keys)):
            for k, v in self.entries_from(number, key):
                if k == key:
                    found.append(json.loads(v))
                elif k > key:
                    return found
        return found

    def scan(self):
        for number in range(len(self.keys)):
            yield from self.entries_from(number)


def shard_writer(shard_bytes: int, block_bytes: int):
    def rows_of(batches):
        from pyspark import TaskContext

        base, made, builder = TaskContext.get().partitionId() << 20, 0, None
        for batch in batches:
            for value, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                key = key_of(value)
                if builder and builder.at >= shard_bytes and key != builder.last:
                    yield from builder.finish()
                    builder = None
                if builder is None:
                    builder, made = Builder(base + made, block_bytes), made + 1
                row = builder.add(key, data)
                if row:
                    yield row
                    builder.last = key
        if builder:
            yield from builder.finish()

    def run(batches):
        held, size = [], 0
        for row in rows_of(batches):
            held.append(row)
            size += len(row[-1])
            if size >= 4 << 20:
                yield to_batch(held)
                held, size = [], 0
        if held:
            yield to_batch(held)

    return run


def to_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["shard", "seq", "kind", "first_key", "last_key", "entries", "bytes"])


def shards(docs: DataFrame, id_col: str = "doc_id", shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(shard, seq, kind, first_key, last_key, entries, bytes): the sections of all shards, in key order over the shards."""
    kind = "long" if kind_of(docs, id_col) in ("tinyint", "smallint", "int", "bigint") else "string"
    value = F.to_json(F.struct(*columns(docs)), {"ignoreNullFields": "false"}).cast("binary")
    rows = docs.select(F.col(f"`{id_col}`").cast(kind).alias("key"), value.alias("value"))
    return rows.repartitionByRange("key").sortWithinPartitions("key", "value").mapInArrow(shard_writer(shard_bytes, block_bytes), SCHEMA)


def file_batches(folder: str):
    """Writes the sections of each shard to a file of its own, under another name until it is whole."""

    def run(batches):
        import pyarrow.fs as pafs

        filesystem, base = pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)
        filesystem.create_dir(base, recursive=True)
        stream = first = None
        size = 0
        for batch in batches:
            for shard, kind, low, high, entries, data in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5, 6))):
                if stream is None:
                    part = f"{base}/{uuid.uuid4().hex}.part"
                    stream, first, size = filesystem.open_output_stream(part), low, 0
                stream.write(data)
                size += len(data)
                if kind == "footer":
                    stream.close()
                    stream, path = None, f"{base}/{shard:016x}.sst"
                    filesystem.move(part, path)
                    yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([path]), pa.array([first], pa.binary()), pa.array([high], pa.binary()), pa.array([entries]), pa.array([size])], names=["shard", "path", "first_key", "last_key", "entries", "size"])

    return run


def write_files(docs: DataFrame, folder: str, **options) -> DataFrame:
    """The shards of docs as files of a folder that all executors share; their list (shard, path, first_key, last_key, entries, size) is stored beside them and returned."""
    found = shards(docs, **options).mapInArrow(file_batches(folder), "shard long, path string, first_key binary, last_key binary, entries long, size long")
    found.write.mode("overwrite").parquet(f"{folder}/list")
    return docs.sparkSession.read.parquet(f"{folder}/list")


class Shards:
    """Looks keys up over all files of a folder: bisects their list, then reads one block of one file."""

    def __init__(self, spark, folder: str):
        import pyarrow.fs as pafs

        self.filesystem, _ = pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)
        rows = sorted((bytes(r.first_key), bytes(r.last_key), r.path) for r in spark.read.parquet(f"{folder}/list").toLocalIterator())  # one row for each 64 MB
        self.firsts, self.lasts, self.paths = ([r[i] for r in rows] for i in range(3))
        self.opened: dict[str, Reader] = {}

    def get(self, value) -> list[dict]:
        """The values stored under an identifier, in all shards that can have it."""
        key, found = key_of(value), []
        for at in range(bisect.bisect_left(self.lasts, key), len(self.paths)):
            if self.firsts[at] > key:
                break
            path = self.paths[at]
            if path not in self.opened:
                self.opened[path] = Reader(self.filesystem.open_input_file(path))
            found += self.opened[path].get(value)
        return found
