"""Verification of candidate pairs by anti-unification; the one place where pairs of texts meet in Python."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds
from ..functions.anti_unify import anti_unify, fingerprint, text_tree


def verify(pairs: DataFrame, texts: DataFrame, t: Thresholds = DEFAULT, max_holes: int = 5) -> DataFrame:
    """unit_a, unit_b, divergence, holes, verdict, template for pairs (unit_a, unit_b) and texts (unit_id, text).

    verdict: near up to max_holes holes, weak beyond, reject if too divergent. Candidates are filtered before this, as
    the optimizer knows nothing of its cost.
    """
    a = texts.select(F.col("unit_id").alias("unit_a"), F.col("text").alias("ta"))
    b = texts.select(F.col("unit_id").alias("unit_b"), F.col("text").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x, y, ta, tb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                r = anti_unify(text_tree(ta), text_tree(tb))
                verdict = "reject" if r.divergence > t.max_divergence else "near" if r.holes <= max_holes else "weak"
                rows.append((x, y, round(r.divergence, 6), r.holes, verdict, fingerprint(r.template)))
            columns = zip(*rows, strict=True) if rows else [()] * 6
            types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types, strict=True)], names=["unit_a", "unit_b", "divergence", "holes", "verdict", "template"])

    both = pairs.select("unit_a", "unit_b").join(a, "unit_a").join(b, "unit_b").select("unit_a", "unit_b", "ta", "tb")
    return both.mapInArrow(run, "unit_a long, unit_b long, divergence double, holes long, verdict string, template string")
