"""Secret scan: an Aho-Corasick pass finds keywords, anchored patterns run only at hits, checksums confirm token formats.

Kinds of the base rules, in their order: assign, access, hex. Kinds that the method adds: github and npm, whose last
six characters are a checksum of the thirty before them; a token with a wrong checksum is no finding.

Runs of hexadecimal digits have no keyword. A run of 32 covers four places in a row among every eighth byte, so these
places are looked up first and the pattern runs only where four in a row hold digits.

Defined results: null text counts as empty and has no finding; repeated rows give repeated results; an empty table
gives an empty table; a null identifier stays null. Texts are scanned whole, whatever their length.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._shared import arrow_map, by_pieces, utf8

KINDS = ("assign", "access", "hex", "github", "npm")
BASE = KINDS[:3]
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
CHECKED = {"github": re.compile(rb"gh[pousr]_([0-9A-Za-z]{36})(?![0-9A-Za-z])"), "npm": re.compile(rb"npm_([0-9A-Za-z]{36})(?![0-9A-Za-z])")}
KEYWORDS = {"assign": ("password", "passwd", "secret", "token", "apikey", "api_key"), "access": ("akia",), "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "npm": ("npm_",)}
MIN_ASSIGN, MIN_ACCESS, MIN_HEX, STRIDE = 8, 16, 32, 8
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_IS_HEX = np.zeros(256, bool)
_IS_HEX[[*b"0123456789abcdef"]] = True
_automaton = None


def base62(n: int, width: int) -> str:
    digits = []
    for _ in range(width):
        n, d = divmod(n, 62)
        digits.append(ALPHABET[d])
    return "".join(reversed(digits))


def checksum_holds(body: bytes) -> bool:
    """Whether the last six of 36 characters are the base-62 CRC-32 of the others."""
    return base62(zlib.crc32(body[:-6]), 6).encode() == body[-6:]


def keywords():
    global _automaton
    if _automaton is None:
        import ahocorasick

        _automaton = ahocorasick.Automaton()
        for kind, words in KEYWORDS.items():
            for word in words:
                _automaton.add_word(word, (kind, len(word)))
        _automaton.make_automaton()
    return _automaton


def hex_runs(data: bytes) -> list[tuple[int, int]]:
    """Maximal runs of at least MIN_HEX lower-case hexadecimal digits."""
    probe = _IS_HEX[np.frombuffer(data, np.uint8)[STRIDE - 1 :: STRIDE]]
    rows = MIN_HEX // STRIDE
    if len(probe) < rows:
        return []
    full = probe[: len(probe) - rows + 1].copy()
    for k in range(1, rows):
        full &= probe[k : len(probe) - rows + 1 + k]
    found, end = [], 0
    for at in (np.flatnonzero(full) * STRIDE + STRIDE - 1).tolist():
        if at < end:
            continue
        start = at
        while start > end and _IS_HEX[data[start - 1]]:
            start -= 1
        end = HEX.match(data, start).end()
        if end - start >= MIN_HEX:
            found.append((start, end))
    return found


def scan_bytes(data: bytes) -> list[tuple[int, int, str]]:
    """All findings as byte start, end and kind, in order."""
    found, past = [], dict.fromkeys(KINDS, 0)
    hits = sorted((end - n + 1, kind) for end, (kind, n) in keywords().iter(data.lower().decode("latin-1")))
    for at, kind in hits:
        if at < past[kind]:
            continue
        m = (ASSIGN if kind == "assign" else ACCESS if kind == "access" else CHECKED[kind]).match(data, at)
        if not m:
            continue
        past[kind] = m.end()
        holds = m.end(2) - m.start(2) >= MIN_ASSIGN if kind == "assign" else m.end() - at >= MIN_ACCESS if kind == "access" else checksum_holds(m[1])
        if holds:
            found.append((at, m.end(), kind))
    found += [(a, b, "hex") for a, b in hex_runs(data)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def code_points(data: bytes, found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    if not found or data.isascii():
        return found
    starts = np.concatenate(([0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)))
    return [(int(starts[a]), int(starts[b]), kind) for a, b, kind in found]


def redacted(data: bytes, found: list[tuple[int, int, str]]) -> str:
    """The text with each stretch of overlapping findings replaced by its first kind in brackets."""
    out, at = [], 0
    for a, b, kind in found:
        if a >= at:
            out += [data[at:a], f"[{kind}]".encode()]
        at = max(at, b)
    return b"".join([*out, data[at:]]).decode()


def joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in found)


def find_secrets(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row: doc_id, counts, base_sha256, spans in code points."""
    kind = df.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_pieces(batches, text):
            rows = []
            for data in utf8(batch.column(1)):
                spans = code_points(data, scan_bytes(data))
                base = [s for s in spans if s[2] in BASE]
                rows.append([*(sum(s[2] == k for s in spans) for k in BASE), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)])
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), *(pa.array(c, pa.string()) for c in columns[3:])], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return arrow_map(df.select(doc_id, text), run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows with every finding in the text column replaced; null text stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_pieces(batches, text):
            at = batch.schema.get_field_index(text)
            texts = [None if data is None else redacted(data, scan_bytes(data)) for data in batch.column(at).cast(pa.binary()).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return arrow_map(df, run, df.schema)


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
