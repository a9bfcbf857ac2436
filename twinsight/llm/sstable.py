"""Token ids in sorted-string tables: documents keyed by identifier, so that one document is found by binary search.

A shard holds data blocks, then a sparse index, a Bloom filter and a footer:

    block   zstd of entries; an entry is the varints (bytes shared with the key before, further key bytes, value bytes,
            1 if ids take four bytes else 0), the further key bytes and the ids; keys start anew at restart points,
            whose offsets close the block
    index   the last key, offset, size and CRC-32 of each block
    bloom   bits and number of probes over all keys
    footer  places of index and Bloom filter, documents, ids and a magic number, of fixed size

A key is the identifier as eight bytes in order, or empty for null, so null sorts first. Rows with the same identifier
follow each other in the order of their texts. Shards are cut by ranges of the identifier. A block goes to its file as
soon as it is full; the file has a temporary name until it is whole, so a task that is run again replaces its own files
only. The manifest is a table beside the shards: name, documents, ids, first and last identifier, ids before it.

Defined results: null text counts as empty and has the end id alone; a null identifier stays null and comes first;
repeated rows and identifiers are all kept; texts of any length are encoded whole; other columns are left out; an empty
table gives a manifest without rows.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import NewFile, arrow_map, by_pieces, file_system, materialise, scratch
from .tokens import encoder

MAGIC = b"TWSSTAB1"
FOOTER = struct.Struct("<QQQQQQ8s")
BLOCK_BYTES, RESTART, BITS_PER_KEY, PROBES = 64 << 10, 16, 10, 7
SHARD_BYTES = 64 << 20


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
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if not key else struct.unpack(">Q", key)[0] - (1 << 63)


def probes(key: bytes, bits: int) -> list[int]:
    import xxhash

    a, b = xxhash.xxh64_intdigest(key), xxhash.xxh64_intdigest(key, 1) | 1
    return [(a + k * b) % bits for k in range(PROBES)]


class Writer:
    """Takes documents in key order and writes one shard; ids come as little-endian unsigned 32-bit integers."""

    def __init__(self, write: Callable[[bytes], object]):
        import zstandard

        self.zstd, self.write = zstandard.ZstdCompressor(level=1), write
        self.index: list[tuple[bytes, int, int, int]] = []
        self.keys: list[bytes] = []
        self.size = self.ids = 0
        self._new_block()

    def _new_block(self) -> None:
        self.block, self.restarts, self.last, self.entries = bytearray(), [], b"", 0

    def add(self, key: bytes, ids: bytes) -> None:
        values = np.frombuffer(ids, "<u4")
        wide = bool(len(values)) and int(values.max()) > 0xFFFF
        value = ids if wide else values.astype("<u2").tobytes()
        shared = 0
        if self.entries % RESTART:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.restarts.append(len(self.block))
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + bytes([wide]) + key[shared:] + value
        self.last, self.entries, self.ids = key, self.entries + 1, self.ids + len(values)
        self.keys.append(key)
        if len(self.block) >= BLOCK_BYTES:
            self._close_block()

    def _close_block(self) -> None:
        if self.entries:
            raw = bytes(self.block) + struct.pack(f"<{len(self.restarts)}II", *self.restarts, len(self.restarts))
            packed = self.zstd.compress(raw)
            self.index.append((self.last, self.size, len(packed), zlib.crc32(packed)))
            self.write(packed)
            self.size += len(packed)
            self._new_block()

    def finish(self) -> None:
        self._close_block()
        index = b"".join(varint(len(k)) + k + struct.pack("<QII", at, n, crc) for k, at, n, crc in self.index)
        bits = max(64, len(self.keys) * BITS_PER_KEY)
        bloom = np.zeros((bits + 7) // 8, np.uint8)
        for key in self.keys:
            for p in probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        bloom = struct.pack("<Q", bits) + bloom.tobytes()
        for part in (index, bloom, FOOTER.pack(self.size, len(index), self.size + len(index), len(bloom), len(self.keys), self.ids, MAGIC)):
            self.write(part)


class Table:
    """Reads a shard from anything with size(), seek() and read()."""

    def __init__(self, source):
        import zstandard

        self.source, self.zstd = source, zstandard.ZstdDecompressor()
        at, n, self.bloom_at, self.bloom_size, self.documents, self.ids, magic = FOOTER.unpack(self._read(source.size() - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of token ids, or cut short")
        data, self.index, p = self._read(at, n), [], 0
        while p < n:
            k, p = read_varint(data, p)
            self.index.append((data[p : p + k], *struct.unpack_from("<QII", data, p + k)))
            p += k + 16
        self.bloom = None

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def _block(self, k: int) -> tuple[bytes, list[int]]:
        _, at, n, crc = self.index[k]
        packed = self._read(at, n)
        if zlib.crc32(packed) != crc:
            raise ValueError(f"block {k} is damaged")
        raw = self.zstd.decompress(packed)
        (count,) = struct.unpack_from("<I", raw, len(raw) - 4)
        end = len(raw) - 4 - 4 * count
        return raw[:end], list(struct.unpack_from(f"<{count}I", raw, end))

    @staticmethod
    def _entries(raw: bytes, at: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < len(raw):
            shared, at = read_varint(raw, at)
            more, at = read_varint(raw, at)
            size, at = read_varint(raw, at)
            wide = raw[at]
            key = key[:shared] + raw[at + 1 : at + 1 + more]
            at += 1 + more
            value = raw[at : at + size]
            at += size
            yield key, value if wide else np.frombuffer(value, "<u2").astype("<u4").tobytes()

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for k in range(len(self.index)):
            yield from self._entries(self._block(k)[0], 0)

    def may_hold(self, key: bytes) -> bool:
        if self.bloom is None:
            data = self._read(self.bloom_at, self.bloom_size)
            self.bits, self.bloom = struct.unpack_from("<Q", data)[0], data[8:]
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in probes(key, self.bits))

    def get(self, key: bytes) -> bytes | None:
        """The ids of the first document with this key, or None."""
        k = bisect_left(self.index, key, key=lambda x: x[0])
        if k == len(self.index) or not self.may_hold(key):
            return None
        raw, restarts = self._block(k)
        at_restart = lambda r: next(self._entries(raw, r))[0]
        r = bisect_left(restarts, key, key=at_restart)
        for found, ids in self._entries(raw, restarts[max(0, r - 1)]):
            if found >= key:
                return ids if found == key else None
        return None


_MANIFEST = "shard string, documents long, ids long, first long, last long"


def write_shards(df: DataFrame, folder: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode and write all rows below folder; returns the manifest: each shard's name, documents, ids, range and base.

    base counts the ids of all shards before. It is a running sum over the manifest, which has a row for each shard.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), []
        encode, end = encoder(tokenizer).encode, end_id.to_bytes(4, "little")
        file: NewFile | None = None
        writer: Writer | None = None

        def close() -> None:
            writer.finish()
            file.commit()
            made.append((file.name.rpartition("/")[2], len(writer.keys), writer.ids, id_of(writer.keys[0]), id_of(writer.keys[-1])))

        for batch in by_pieces(batches, "t"):
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if writer is None:
                    file = NewFile(folder, f"shard-{part:06d}-{len(made):04d}.tws")
                    writer = Writer(file.write)
                writer.add(key_of(key), encode(body) + end)
                if writer.size >= shard_bytes:
                    close()
                    writer = None
        if writer is not None:
            close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), [pa.string()] + [pa.int64()] * 4, strict=True)], names=["shard", "documents", "ids", "first", "last"])

    rows = df.select(F.col(doc_id).cast("long").alias("k"), F.col(text).cast("string").alias("t")).repartitionByRange("k").sortWithinPartitions("k", "t")
    made = materialise(arrow_map(rows, run, _MANIFEST), "shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    made.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0))).write.parquet(f"{folder}/manifest")
    return manifest(df.sparkSession, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(f"{_MANIFEST}, base long").parquet(f"{folder}/manifest")


#: Rows that a reader gives at once.
_ROWS = 4096


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Rows doc_id, start, n_tokens, ids_crc32 from the files; start counts the ids of all documents before."""
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = file_system(folder)
        for batch in batches:
            for name, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                with system.open_input_file(f"{path}/{name}") as f:
                    for key, ids in Table(f).scan():
                        rows.append((id_of(key), at, len(ids) // 4, zlib.crc32(ids)))
                        at += len(ids) // 4
                        if len(rows) == _ROWS:
                            yield batch_of(rows)
                            rows = []
                if rows:
                    yield batch_of(rows)

    shards = manifest(spark, folder).select("shard", "base")
    tasks = max(1, min(shards.count(), 8 * spark.sparkContext.defaultParallelism))
    return arrow_map(shards.repartition(tasks), run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(spark: SparkSession, folder: str, doc_id: int | None) -> list[int] | None:
    """Token ids of one document: shards whose range holds its identifier, then Bloom filter, sparse index and a block."""
    system, path = file_system(folder)
    own = F.lit(doc_id).cast("long")
    inside = F.col("first").isNull() if doc_id is None else (F.col("first").isNull() | (F.col("first") <= own)) & (F.col("last") >= own)
    for row in manifest(spark, folder).where(inside).orderBy("shard").select("shard").toLocalIterator():
        with system.open_input_file(f"{path}/{row['shard']}") as f:
            if (ids := Table(f).get(key_of(doc_id))) is not None:
                return np.frombuffer(ids, "<u4").tolist()
    return None


def op6_token_shards(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    folder = scratch(spark, "sstable")
    write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, tokenizer, end_id=0)
    return read_shards(spark, folder)
