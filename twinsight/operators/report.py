"""A scan's report: gated findings, members in order, and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds
from ..sinks.documents import Report
from . import findings
from .graph import cut
from .scan import extract, scan_units


def statistics(files: DataFrame, units: DataFrame, found: DataFrame, members: DataFrame, t: Thresholds = DEFAULT) -> dict:
    """Counters and duplication ratios: lines that a main finding's member covers, tokens that one copy each would save."""
    f = files.agg(F.count(F.lit(1)).alias("files_scanned"), F.coalesce(F.sum(F.size(F.split("content", "\n")) - F.when(F.endswith("content", F.lit("\n")), 1).otherwise(0)), F.lit(0)).alias("total_lines")).first()
    u = units.agg(F.count(F.lit(1)).alias("units_indexed"), F.count_if(F.col("token_count") < t.min_unit_tokens).alias("units_below_floor"), F.count_if("degraded").alias("parse_degraded_units"), F.count_if("is_test").alias("test_units"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("total_tokens")).first()
    main = found.where("section = 'main'")
    g = main.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("token_count") * (F.col("n_members") - 1)), F.lit(0)).alias("tokens")).first()
    spans = members.join(main.select("group_id"), "group_id", "left_semi").select("path", "line0", "line1").distinct()
    lines = spans.select("path", F.explode(F.sequence("line0", "line1")).alias("line")).distinct().count()
    out = f.asDict() | u.asDict()
    out |= {
        "findings_by_tier": {r["tier"]: r["count"] for r in found.groupBy("tier").count().collect()},
        "duplicated_lines": lines, "duplicated_lines_pct": 100 * lines / max(out["total_lines"], 1),
        "duplicated_tokens": g["tokens"], "duplicated_tokens_pct": 100 * g["tokens"] / max(out["total_tokens"], 1),
        "clones_per_kloc": 1000 * g["n"] / max(out["total_lines"], 1),
    }
    return out


def report(files: DataFrame, t: Thresholds = DEFAULT, fail_on: str = "exact-normalized") -> Report:
    files = cut(files)
    units = cut(extract(files))
    found, members = map(cut, scan_units(units, t))
    ordered = findings.numbered(members, ["group_id"], [F.asc("path"), F.asc("line0"), F.asc("line1"), F.asc("unit_id")], "place")
    return Report(findings.gate(found, fail_on).withColumn("primary", F.lit(1).cast("long")), cut(ordered), files, statistics(files, units, found, members, t))
