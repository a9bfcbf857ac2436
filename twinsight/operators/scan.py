"""Scan of source files: units, exact families, and near pairs that anti-unification confirms."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds
from ..functions.anti_unify import Tree, anti_unify, fingerprint, render
from ..functions.python_profile import masked, tokens, units_of
from . import findings, retrieval
from .graph import connected_components, cut, group_summary

#: Subtrees of so many tokens or more make up a unit's bag. Fixed value.
MIN_SUBTREE = 6

UNITS = "path string, dir string, lang string, name string, line0 int, line1 int, token_count long, degraded boolean, is_test boolean, accept_drift boolean, fp string, tree string, bag array<string>, n_repeats int"


def _dump(t: Tree) -> list:
    return [t.kind, t.label, [_dump(c) for c in t.children]]


def _load(x: list) -> Tree:
    return Tree(x[0], x[1], tuple(map(_load, x[2])))


def _subtrees(t: Tree) -> Iterator[Tree]:
    yield t
    for c in t.children:
        yield from _subtrees(c)


#: Languages that extract() can read.
PROFILES = ("python",)


def without_profile(files: DataFrame) -> dict[str | None, int]:
    """How many files there are of each language that extract() has no profile for."""
    rows = files.where(~F.coalesce(F.col("lang").isin(*PROFILES), F.lit(False))).groupBy("lang").count().collect()
    return {r["lang"]: r["count"] for r in rows}


def extract(files: DataFrame) -> DataFrame:
    """The units of all files, numbered by a hash of place and name; a language without a profile is an error."""
    if missing := without_profile(files):
        raise ValueError("no profile for " + ", ".join(f"{n} {lang} file(s)" for lang, n in sorted(missing.items(), key=str)) + "; leave them out of the table to scan the rest")
    names = [c.split()[0] for c in UNITS.split(", ")]
    types = [pa.string()] * 4 + [pa.int32()] * 2 + [pa.int64()] + [pa.bool_()] * 3 + [pa.string()] * 2 + [pa.list_(pa.string()), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, folder, lang, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for u in units_of(content or "", path or ""):
                    bag = sorted({fingerprint(masked(s)) for s in _subtrees(u.tree) if tokens(s) >= MIN_SUBTREE})
                    rows.append((path, folder, lang, u.name, u.line0, u.line1, u.tokens, u.degraded, u.is_test, u.accept_drift, u.fp, json.dumps(_dump(u.tree)), bag, len(u.repeats)))
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    own = files.select("path", "dir", "lang", "content")
    return own.mapInArrow(run, UNITS).withColumn("unit_id", F.xxhash64("path", "line0", "name"))


def scan(files: DataFrame, t: Thresholds = DEFAULT, max_holes: int = 5) -> tuple[DataFrame, DataFrame]:
    """Findings (group_id, tier, section, rank, value, ...) and their members."""
    return scan_units(cut(extract(files)), t, max_holes)


def scan_units(units: DataFrame, t: Thresholds = DEFAULT, max_holes: int = 5) -> tuple[DataFrame, DataFrame]:
    """scan() of units that are extracted; fingerprint names a group by what its members share, not by where they are."""
    exact = findings.exact_groups(units, t).withColumn("group_id", F.concat("lang", F.lit("-"), "fingerprint"))
    family = findings.exact_members(units, t).select(F.concat("lang", F.lit("-"), "fingerprint").alias("group_id"), "unit_id")
    first = units.where(F.col("token_count") >= t.min_unit_tokens).groupBy("lang", "fp").agg(F.min("unit_id").alias("unit_id"))
    reps = units.join(first.select("unit_id"), "unit_id", "left_semi")
    bags = reps.select("unit_id", "lang", F.size("bag").cast("long").alias("bag"), F.explode("bag").alias("g"))
    pairs = retrieval.jaccard(retrieval.shared_count_pairs(bags, t.df_cap), bags.select("unit_id", "bag").distinct(), 0.3)
    pairs = retrieval.size_gate(pairs, reps.select("unit_id", "token_count"), t)
    near = cut(confirmed(pairs, reps).where((F.col("divergence") <= t.max_divergence) & (F.col("holes") <= max_holes)))
    parts = connected_components(near)
    summary = group_summary(near.withColumn("similarity", 1 - F.col("divergence")), parts)
    near_members = parts.select(F.concat(F.lit("near-"), F.col("component")).alias("group_id"), "unit_id")
    sized = near_members.join(units.select("unit_id", "token_count", "dir"), "unit_id").groupBy("group_id").agg(F.count(F.lit(1)).alias("n_members"), F.max("token_count").alias("token_count"), F.count_distinct("dir").alias("n_dirs"), F.min("unit_id").alias("first_unit"))
    sized = sized.withColumn("value", findings.value(F.col("n_members"), F.col("token_count"), F.col("n_dirs")))
    best = summary.select(F.concat(F.lit("near-"), F.col("component")).alias("group_id"), F.col("best_a").alias("unit_a"), F.col("best_b").alias("unit_b"), F.col("max_div").alias("divergence"))
    sized = sized.join(best, "group_id").join(near.select("unit_a", "unit_b", "template"), ["unit_a", "unit_b"])
    columns = ["group_id", "fingerprint", "tier", "n_members", "token_count", "first_unit", "value", "divergence", "template"]
    groups = exact.withColumns({"tier": F.lit("exact-normalized"), "divergence": F.lit(0.0), "template": F.lit(None).cast("string")}).select(columns)
    groups = groups.unionByName(sized.withColumns({"tier": F.lit("near-normalized"), "fingerprint": F.md5("template")}).select(columns))
    members = cut(family.unionByName(near_members))
    ranked = findings.ranked(findings.sectioned(cut(groups), members, units.where("is_test").select("unit_id")))
    return ranked, members.join(units.select("unit_id", "path", "name", "lang", "line0", "line1", "degraded"), "unit_id")


def confirmed(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """unit_a, unit_b, divergence, holes, template of pairs of units, from their trees."""
    a = units.select(F.col("unit_id").alias("unit_a"), F.col("tree").alias("ta"))
    b = units.select(F.col("unit_id").alias("unit_b"), F.col("tree").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x, y, ta, tb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                r = anti_unify(_load(json.loads(ta)), _load(json.loads(tb)))
                rows.append((x, y, round(r.divergence, 6), r.holes, render(r.template)))
            columns = zip(*rows, strict=True) if rows else [()] * 5
            types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types, strict=True)], names=["unit_a", "unit_b", "divergence", "holes", "template"])

    both = pairs.select("unit_a", "unit_b").join(a, "unit_a").join(b, "unit_b").select("unit_a", "unit_b", "ta", "tb")
    return both.mapInArrow(run, "unit_a long, unit_b long, divergence double, holes long, template string")
