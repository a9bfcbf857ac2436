"""WARC archives: a deterministic sharded writer and its reader.

Shards are ranges of the page identifier: all pages that share its bits above some place. The place is the largest at
which no shard's payloads exceed RANGE_BYTES, so cuts depend on the pages alone, not on the session or a sample. A
shard's records are sorted, each is one gzip member, and a file is closed when its compressed size passes a bound.
Headers and digests are made anew from the payload. Files are written as records come, under temporary names, and then
moved; the manifest, a table beside them that is written last, lists each with its records and size, and readers take
only listed files.

Of records with equal payloads the one with the largest identifier is the response and the others are revisits, which
carry no payload but its digest, its length and the response's identifier. Payloads meet by SHA-1 over pre-aggregated
rows; then the few revisit decisions travel beside the pages to the writer, so that pages are shuffled once.

Defined results: null html counts as empty; of rows that repeat an identifier and a payload the first is the response
and the others revisit it; a null identifier sorts first and is never referred to by another identifier's rows while
one with an identifier exists; records of one identifier stay in one task, which holds one at a time; other columns are
left out; an empty table gives no archive and an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import NewFile, arrow_map, by_pieces, file_system, materialise, scratch

FILE_BYTES = 64 << 20
#: Payload bytes of a shard, with HEADERS for each record.
RANGE_BYTES, HEADERS = 32 << 20, 512
#: Payloads of fewer bytes are never revisits.
MIN_DEDUP_BYTES = 0
#: Records carry a fixed date, so that the same pages always make the same bytes.
DATE = "2000-01-01T00:00:00Z"
#: Bytes that a reader takes at once.
CHUNK = 1 << 16


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, revisit: bool, refers_to: int | None) -> bytes:
    """One record as a gzip member without a time stamp."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'null' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", "".join(c for c in url or "about:blank" if c >= " ")),
        ("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"),
        ("WARC-Block-Digest", f"sha1:{digest_of(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if revisit:
        headers[4:4] = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + b"\r\n" + block + b"\r\n\r\n"
    return gzip.compress(raw, 6, mtime=0)


def records(read: Callable[[int], bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive, read in chunks."""
    data = b""
    while data := data or read(CHUNK):
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            if not data and not (data := read(CHUNK)):
                raise ValueError("the archive is cut short")
            parts.append(member.decompress(data))
            data = member.unused_data
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = dict(line.split(": ", 1) for line in lines)
        yield headers, rest[: int(headers["Content-Length"])]


def _page(urn: str) -> int | None:
    inner = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if inner == "null" else int(inner)


def revisits(light: DataFrame) -> DataFrame:
    """page_id, sha, refers_to of rows (page_id, sha, size) whose payload also is a page's with a larger identifier."""
    own = light.where(F.col("size") >= MIN_DEDUP_BYTES).select("page_id", "sha")
    groups = own.groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 and refers_to is not null").drop("n")
    # Both sides are tables, so a payload that very many pages share can be split over tasks.
    return own.join(materialise(groups, "payloads").hint("merge"), "sha").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "sha", "refers_to").distinct()


def shard_shift(light: DataFrame, range_bytes: int) -> tuple[int, int]:
    """By how many bits to shift an identifier for its shard, and the smallest identifier's shard."""
    ends = light.agg(F.min("page_id"), F.max("page_id"), F.sum(F.col("size") + HEADERS)).first()
    if ends[0] is None:
        return 0, 0
    shift = max(0, min(63, (ends[0] ^ ends[1]).bit_length()) - max(0, (int(ends[2]) // range_bytes).bit_length() - 1))
    while shift:
        heaviest = light.groupBy(F.shiftright("page_id", shift)).agg(F.sum(F.col("size") + HEADERS).alias("bytes")).agg(F.max("bytes")).first()[0]
        if heaviest <= range_bytes:
            break
        shift -= 1
    return shift, ends[0] >> shift


def write_archives(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Write all rows (page_id, url, html) below folder, then the manifest, which is returned: file, records, bytes."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    pages = pages.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    light = materialise(pages.select("page_id", "sha", F.octet_length("html").cast("long").alias("size")), "payload-digests")
    shift, first = shard_shift(light, range_bytes)
    full = pages.select("page_id", "sha", F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("long").alias("refers_to"))
    marks = revisits(light).select("page_id", "sha", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "refers_to")
    rows = full.unionByName(marks).withColumn("shard", F.coalesce(F.shiftright("page_id", shift) - F.lit(first) + 1, F.lit(0)))
    rows = rows.repartition("shard").sortWithinPartitions("shard", "page_id", "sha", "kind", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple[str, int, int]] = []
        file: NewFile | None = None
        at = nth = size = count = 0
        mark: tuple = ()
        seen: tuple | None = None

        def close() -> None:
            nonlocal file, nth
            if file is not None:
                file.commit()
                made.append((file.name.rpartition("/")[2], count, size))
                file, nth = None, nth + 1

        for batch in by_pieces(batches, "html"):
            for page_id, sha, kind, url, html, refers_to, shard in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not kind:
                    mark = (page_id, sha, refers_to)
                    continue
                if shard != at:
                    close()
                    at, nth = shard, 0
                if file is None:
                    file, size, count = NewFile(folder, f"part-{shard:012d}-{nth:04d}.warc.gz"), 0, 0
                payload = html.encode()
                again = seen == (page_id, sha) and len(payload) >= MIN_DEDUP_BYTES
                seen = (page_id, sha)
                marked = mark[:2] == seen
                raw = record(page_id, url, payload, marked or again, mark[2] if marked else page_id)
                file.write(raw)
                size, count = size + len(raw), count + 1
                if size >= file_bytes:
                    close()
        close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made, strict=True)], names=["file", "records", "bytes"])

    arrow_map(rows, run, _MANIFEST).write.parquet(f"{folder}/manifest")
    return manifest(pages.sparkSession, folder)


_MANIFEST = "file string, records long, bytes long"


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


#: Rows that a reader gives at once.
_ROWS = 4096


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record that the manifest's files hold."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = file_system(folder)
        for batch in batches:
            for name, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, count = [], 0
                with system.open_input_file(f"{path}/{name}") as f:
                    for headers, block in records(f.read):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        length = int(http.rsplit(b"Content-Length: ", 1)[1])
                        if f"sha1:{digest_of(block)}" != headers["WARC-Block-Digest"] or kind == "response" and (digest_of(payload) != digest or len(payload) != length):
                            raise ValueError(f"{name}: a digest does not hold for {headers['WARC-Record-ID']}")
                        rows.append((_page(headers["WARC-Record-ID"]), length, digest, kind, _page(headers["WARC-Refers-To"]) if kind == "revisit" else None))
                        if len(rows) == _ROWS:
                            yield batch_of(rows)
                            count, rows = count + len(rows), []
                if rows:
                    yield batch_of(rows)
                if count + len(rows) != n:
                    raise ValueError(f"{name}: {count + len(rows)} records, the manifest says {n}")

    files = manifest(spark, folder).select("file", "records")
    tasks = max(1, min(files.count(), 8 * spark.sparkContext.defaultParallelism))
    return arrow_map(files.repartition(tasks), run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op8_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archives(spark, folder)
