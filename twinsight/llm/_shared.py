"""Helpers shared by the corpus operators: shared storage, Arrow plumbing and vectorised text splitting."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: space and \x09-\x0D. Everything else belongs to a word.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Used only where the session names no spark.checkpoint.dir, as in tests.
LOCAL_FALLBACK = "/tmp/checkpoints"

#: Bytes of a text that are hashed at a time.
BLOCK = 1 << 18

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; without one, a cluster is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{LOCAL_FALLBACK}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; Spark deletes it when the session ends."""
    path = f"{shared_dir(spark)}/twinsight/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: later reads recompute nothing and survive a lost executor."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(table: DataFrame) -> None:
    """Delete the files of a table from materialise() that nothing will read again."""
    spark = table.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table._scratch_path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the identifier as text is divisible by 5; a null identifier is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def by_pieces(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Split batches so that one piece holds about max_bytes of the column, or one row if that row is larger."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + max_bytes, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def utf8(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def arrow_map(df: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(make, schema)


class Words:
    """Words of many texts at once: byte spans, the text each belongs to, and 64-bit hashes, computed with numpy."""

    def __init__(self, texts: list[bytes], blanks: np.ndarray = SPACE):
        self.texts = len(texts)
        joined = b" ".join(texts) + b" "
        self.bytes = np.frombuffer(joined, np.uint8)
        lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.text_start = np.concatenate(([0], np.cumsum(lengths + 1)))
        blank = blanks[self.bytes]
        before = np.concatenate(([True], blank[:-1]))
        self.start = np.flatnonzero(before & ~blank)
        self.end = np.flatnonzero(~before & blank)
        self.text = np.searchsorted(self.text_start, self.start, side="right") - 1
        self.count = np.bincount(self.text, minlength=self.texts)
        self.first = np.concatenate(([0], np.cumsum(self.count)))

    def hashes(self, lower: bool = True) -> np.ndarray:
        """A 64-bit hash of each word's bytes, with A-Z read as a-z if lower; made in blocks, so temporaries stay small."""
        out = np.empty(len(self.start), np.uint64)
        cuts = np.unique(np.searchsorted(self.start, np.arange(0, len(self.bytes) + BLOCK, BLOCK)))
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            at = self.start[i]
            data = self.bytes[at : self.end[j - 1]]
            if lower:
                data = np.where((data >= 65) & (data <= 90), data + 32, data)
            out[i:j] = span_hashes(data, self.start[i:j] - at, self.end[i:j] - at)
        return out


_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, 2 * BLOCK)
        with np.errstate(over="ignore"):
            up, down = np.full(size, _PRIME, np.uint64), np.full(size, _INVERSE, np.uint64)
            up[0] = down[0] = 1
            _powers["up"], _powers["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers["up"], _powers["down"]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def span_hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hashes modulo 2**64 of codes[start:end] for many spans, from one running sum."""
    up, down = _power_table(len(codes) + 1)
    with np.errstate(over="ignore"):
        terms = (codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)]
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))
        return mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of width consecutive values; the last width - 1 places are left out."""
    if len(hashes) < width:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(len(hashes) - width + 1, np.uint64)
        for k in range(width):
            out = mix64(out * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + len(out)])
        return out


def file_system(uri: str):
    """The Arrow file system of a folder's address, and the folder's path in it."""
    from pyarrow import fs

    found, path = fs.FileSystem.from_uri(uri)
    return found, path.rstrip("/")


class NewFile:
    """A file that is written under a temporary name as its bytes come and then moved: readers never see half of it."""

    def __init__(self, uri: str, name: str):
        self.system, folder = file_system(uri)
        self.system.create_dir(folder, recursive=True)
        self.name, self.temporary = f"{folder}/{name}", f"{folder}/.{name}.{uuid.uuid4().hex}.tmp"
        self.out = self.system.open_output_stream(self.temporary)

    def write(self, part: bytes) -> None:
        self.out.write(part)

    def commit(self) -> None:
        from pyarrow.fs import FileType

        self.out.close()
        if self.system.get_file_info(self.name).type != FileType.NotFound:
            self.system.delete_file(self.name)  # of an attempt that was lost; some systems do not move onto a file
        self.system.move(self.temporary, self.name)


def put_file(uri: str, name: str, parts: list[bytes]) -> None:
    new = NewFile(uri, name)
    for part in parts:
        new.write(part)
    new.commit()


def let(value, body):
    """Evaluate a column once for each row and hand it to body, which may use it many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
