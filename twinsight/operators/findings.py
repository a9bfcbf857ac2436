"""Groups of equal units, their value and rank, test policy, duplication ratios and the gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, FAIL_RANK, Thresholds
from .graph import cut


def value(members: Column, tokens: Column, dirs: Column) -> Column:
    """Consolidation value: tokens that one copy would save, half as much again across directories."""
    return ((members - 1) * tokens * F.when(dirs > 1, 1.5).otherwise(1.0)).cast("double")


def exact_groups(units_: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Families of units with one fingerprint; only counts and minima, so a huge family is one row from each task."""
    large = units_.where(F.col("token_count") >= t.min_unit_tokens)
    found = large.groupBy("lang", F.col("fp").alias("fingerprint")).agg(F.count(F.lit(1)).alias("n_members"), F.max("token_count").alias("token_count"), F.count_distinct("dir").alias("n_dirs"), F.min("unit_id").alias("first_unit"))
    return found.where("n_members >= 2").withColumn("value", value(F.col("n_members"), F.col("token_count"), F.col("n_dirs")))


def exact_members(units_: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """unit_id, lang, fingerprint, first_unit of every member of an exact family."""
    groups = exact_groups(units_, t).select("lang", "fingerprint", "first_unit")
    own = units_.where(F.col("token_count") >= t.min_unit_tokens).select("unit_id", "lang", F.col("fp").alias("fingerprint"))
    return own.join(groups, ["lang", "fingerprint"]).select("unit_id", "lang", "fingerprint", "first_unit")


def is_generated(text: Column, t: Thresholds = DEFAULT) -> Column:
    """A first line of so many bytes, or a marker in the first five lines."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    marked = F.exists(F.slice(lines, 1, 5), lambda x: F.expr("false") if not t.markers else _any([F.contains(x, F.lit(m)) for m in t.markers]))
    return (F.octet_length(F.get(lines, F.lit(0))) >= t.minified_bytes) | marked


def _any(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out | c
    return out


def sectioned(groups: DataFrame, members: DataFrame, tests: DataFrame, mode: str = "separate") -> DataFrame:
    """Add section: test if all members are tests; mode exclude drops these, any other mode but separate keeps them in main.

    groups and members share group_id.
    """
    marked = members.join(tests.withColumn("t", F.lit(1)), "unit_id", "left")
    all_tests = marked.groupBy("group_id").agg((F.count("t") == F.count(F.lit(1))).alias("all_tests"))
    out = groups.join(all_tests, "group_id", "left").withColumn("all_tests", F.coalesce("all_tests", F.lit(False)))
    if mode == "exclude":
        out = out.where("not all_tests")
    return out.withColumn("section", F.when(F.col("all_tests") & F.lit(mode == "separate"), "test").otherwise("main")).drop("all_tests")


def numbered(rows: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    """Add each row's number among those of equal keys, from 1.

    Rows are dealt by ranges of keys and order and counted in each range, so tasks share a group of any size.
    """
    dealt = cut(rows.repartitionByRange(*keys, *order).withColumn("range_no", F.spark_partition_id()))
    earlier = Window.partitionBy(*keys).orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*keys, "range_no").agg(F.count(F.lit(1)).alias("n_range"))
    counts = counts.withColumn("n_earlier", F.coalesce(F.sum("n_range").over(earlier), F.lit(0))).drop("n_range")
    inside = F.row_number().over(Window.partitionBy(*keys, "range_no").orderBy(*order))
    return dealt.withColumn(name, inside).join(counts, [*keys, "range_no"]).withColumn(name, (F.col(name) + F.col("n_earlier")).cast("long")).drop("range_no", "n_earlier")


def rank_order() -> list:
    return [F.desc("value"), F.desc("token_count"), F.asc("first_unit"), F.asc("tier")]


def ranked(findings: DataFrame) -> DataFrame:
    """Add rank within the section: value, then tokens, then first member, then tier."""
    return numbered(findings, ["section"], rank_order(), "rank")


def topk(findings: DataFrame, k: int) -> DataFrame:
    """The k best of each section, 0 for all; Spark limits each task's rows before they meet."""
    if k == 0:
        return ranked(findings)
    order = Window.partitionBy("section").orderBy(*rank_order())
    return findings.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def gate(findings: DataFrame, fail_on: str = "exact-normalized") -> DataFrame:
    """Add fail_rank and fails. A tier fails if it is as sure as fail_on or surer; none disables the gate."""
    if fail_on != "none" and fail_on not in FAIL_RANK:
        raise ValueError(f"fail_on must be none or one of {', '.join(FAIL_RANK)}")
    rank = F.create_map(*[F.lit(x) for pair in FAIL_RANK.items() for x in pair])
    out = findings.withColumn("fail_rank", F.try_element_at(rank, F.col("tier")))
    return out.withColumn("fails", F.coalesce(F.col("fail_rank") <= F.lit(FAIL_RANK.get(fail_on, -1)), F.lit(False)))


def internal_repeats(lines: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """unit_id, period, start_at, n_repeats, template_tokens: runs of a block of 1 to 8 lines, three times or more.

    A run is an island of lines equal to those a period before. One that lies in a run of a smaller period goes.
    """
    seq = Window.partitionBy("unit_id").orderBy("line_no")
    at = lines.select("unit_id", "line", "line_tokens", F.row_number().over(seq).alias("at"), *(F.lag("line", p).over(seq).alias(f"l{p}") for p in range(1, t.fold_max_period + 1)))
    # One pass for all periods: each line with the periods after which it comes again.
    periods = F.array_compact(F.array(*(F.when(F.col(f"l{p}") == F.col("line"), F.lit(p)) for p in range(1, t.fold_max_period + 1))))
    same = at.select("unit_id", "at", "line_tokens", F.explode(periods).alias("p"))
    same = same.withColumn("island", F.col("at") - F.row_number().over(Window.partitionBy("unit_id", "p").orderBy("at")))
    runs = same.groupBy("unit_id", "p", "island").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi"), F.sum("line_tokens").alias("toks"))
    found = runs.select("unit_id", F.col("p").cast("long").alias("period"), (F.col("lo") - F.col("p")).cast("long").alias("start_at"), F.col("hi").cast("long").alias("hi"), F.expr("(n + p) div p").cast("long").alias("n_repeats"), F.expr("toks * p div n").cast("long").alias("template_tokens"))
    found = found.where((F.col("n_repeats") >= t.fold_min_repeats) & (F.col("template_tokens") * F.col("n_repeats") >= t.min_seq_tokens))
    inside = "o.period < i.period and o.start_at <= i.start_at and i.hi <= o.hi"
    kept = found.alias("i").join(found.alias("o"), (F.col("i.unit_id") == F.col("o.unit_id")) & F.expr(inside), "left_anti")
    return kept.drop("hi")
