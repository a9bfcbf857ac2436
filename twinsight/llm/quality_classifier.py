"""Quality scores by regularised quadratic discriminant analysis of document statistics.

Each text becomes a short vector of transformed statistics. Two Gaussians, one for each label, are fitted to sums and
sums of products over all labelled rows outside the held-out fifth; these sums are the only thing that reaches the
driver. Each class covariance is shrunk towards the pooled one and towards its own diagonal. A score is the logistic
of the difference of log densities, whose Mahalanobis distances use Cholesky factors made once.

Defined results: null text counts as empty and is scored like any text; null labels and null identifiers are not
learned from; of repeated labels for one document the largest counts; with only one label or none in the training
rows every score is the share of label 1 (one half without any); an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Words, arrow_map, by_pieces, held_out, materialise, mix64, utf8

THRESHOLD = 0.3
#: Bytes of text whose statistics are made at a time; a longer text is one piece.
PIECE = 1 << 19
FEATURES = ("log_words", "word_length", "word_spread", "symbols", "upper", "digits", "marks", "bars", "distinct_words", "top_word", "distinct_pairs", "repeated_lines", "line_words", "unended_lines")

_CLASS = np.zeros(256, np.uint8)
_CLASS[[*b"#*$%&<>^~_={}[]\\@"]] = 1
_CLASS[[*range(65, 91)]] = 2
_CLASS[[*range(48, 58)]] = 3
_CLASS[[*b"!?.,;:"]] = 4
_CLASS[[*b"|"]] = 5


def _per_text(keys: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each owner, and how often its commonest occurs."""
    # A short word's key is mix64 of a small number; the offset keeps owners' numbers away from these.
    own = mix64(owner.astype(np.uint64) + np.uint64(0xA24BAED4963EE407))
    _, first, count = np.unique(mix64(keys ^ own), return_index=True, return_counts=True)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, owner[first], count)
    return np.bincount(owner[first], minlength=n), top


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of FEATURES for each text."""
    w, n = Words(texts), len(texts)
    words = w.count
    hashes = w.hashes()
    lengths = (w.end - w.start).astype(float)
    kind_of_byte = _CLASS[w.bytes]
    kinds = np.column_stack([np.add.reduceat(kind_of_byte == k, w.text_start[:-1], dtype=np.int64) for k in range(1, 6)])
    chars = np.bincount(w.text, lengths, n)
    squares = np.bincount(w.text, lengths * lengths, n)
    at_least_1 = np.maximum(words, 1)
    mean = chars / at_least_1
    distinct, top = _per_text(hashes, w.text, n)
    same = w.text[1:] == w.text[:-1]
    pairs = mix64(hashes[:-1] * np.uint64(3) + hashes[1:])[same]
    distinct_pairs, _ = _per_text(pairs, w.text[:-1][same], n)
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    n_lines = np.array([max(1, len(x)) for x in lines])
    new_lines = np.array([max(1, len(set(x))) for x in lines])
    unended = np.array([sum(x.rstrip()[-1:] not in b".!?:;\"'" for x in ls) for ls in lines])
    share = kinds / np.maximum(chars, 1)[:, None]
    return np.column_stack([
        np.log1p(words), np.log1p(mean), np.log1p(np.sqrt(np.maximum(squares / at_least_1 - mean * mean, 0))),
        *np.sqrt(np.minimum(share, 1)).T,
        distinct / at_least_1, np.sqrt(top / at_least_1), distinct_pairs / np.maximum(words - 1, 1),
        1 - new_lines / n_lines, np.log1p(words / n_lines), unended / n_lines,
    ])


def features(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and x, the statistics of the text."""
    kind = df.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_pieces(batches, text, PIECE):
            x = statistics(utf8(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "x"])

    return arrow_map(df.select(doc_id, text), run, f"doc_id {kind}, x array<double>")


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors, log determinants and log priors of both classes; a constant if unfitted."""

    constant: float | None = None
    means: tuple = ()
    factors: tuple = ()
    offsets: tuple = ()

    @classmethod
    def fit(cls, sums: dict[int, tuple[float, np.ndarray, np.ndarray]], pooled: float = 0.3, diagonal: float = 0.1, floor: float = 1e-3) -> Discriminant:
        """sums: for each label its rows, sum of vectors and sum of outer products; the others are shrinkage weights."""
        total = sum(s[0] for s in sums.values())
        if len(sums) < 2:
            return cls(constant=0.5 if not total else float(1 in sums))
        means = [sums[k][1] / sums[k][0] for k in (0, 1)]
        own = [sums[k][2] / sums[k][0] - np.outer(m, m) for k, m in zip((0, 1), means, strict=True)]
        both = sum(sums[k][0] * s for k, s in zip((0, 1), own, strict=True)) / total
        factors, offsets = [], []
        for k, s in zip((0, 1), own, strict=True):
            s = (1 - pooled) * s + pooled * both
            s = (1 - diagonal) * s + diagonal * np.diag(np.diag(s)) + floor * np.eye(len(s))
            low = np.linalg.cholesky(s)
            factors.append(np.linalg.inv(low))
            offsets.append(np.log(sums[k][0] / total) - np.log(np.diag(low)).sum())
        return cls(None, tuple(means), tuple(factors), tuple(offsets))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        logs = [o - 0.5 * (((x - m) @ f.T) ** 2).sum(1) for m, f, o in zip(self.means, self.factors, self.offsets, strict=True)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def class_sums(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Rows, sums and outer products of x for each y in {0, 1}, added up on the executors."""
    d = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            if batch.num_rows:
                x, y = np.array(batch.column(0).to_pylist()), np.array(batch.column(1).to_pylist())
                for k in (0, 1):
                    own = x[y == k]
                    total[k] += np.concatenate(([len(own)], own.sum(0), (own.T @ own).ravel()))
        at = np.tile(np.arange(total.shape[1]), 2)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], total.shape[1])), pa.array(at), pa.array(total.ravel())], names=["y", "at", "v"])

    out = np.zeros((2, 1 + d + d * d))
    for y, at, v in arrow_map(labelled.select("x", "y"), run, "y long, at long, v double").groupBy("y", "at").agg(F.sum("v")).collect():
        out[y, at] = v
    return {k: (out[k, 0], out[k, 1 : 1 + d], out[k, 1 + d :].reshape(d, d)) for k in (0, 1) if out[k, 0]}


def score_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each document."""
    stats = materialise(features(documents), "quality-features")
    known = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    model = Discriminant.fit(class_sums(stats.where(~held_out()).join(known, "doc_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = model.score(np.array(batch.column(2).to_pylist()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = stats.schema["doc_id"].dataType.simpleString()
    return arrow_map(stats.select("doc_id", held_out().alias("held_out"), "x"), run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
