"""Candidate retrieval: inverted-index self-joins, landmarks, and the offset histogram that filters candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds


def document_frequency(bags: DataFrame) -> DataFrame:
    """lang, g, df: how many units hold a gram. Bags are distinct per unit, so this is a count with map-side sums."""
    return bags.groupBy("lang", "g").agg(F.count(F.lit(1)).alias("df"))


def owned_between(bags: DataFrame, low: int, high: int) -> DataFrame:
    """Rows of the grams that low to high units own.

    The frequency is counted by partial aggregation and joined back on the same key, so a gram that every unit has
    never gathers in one task; it is gone before the self-join.
    """
    frequent = document_frequency(bags).where(F.col("df").between(low, high))
    return bags.join(frequent.select("lang", "g"), ["lang", "g"], "left_semi")


def shared_count_pairs(bags: DataFrame, cap: int) -> DataFrame:
    """lang, unit_a, unit_b, shared: units with common grams of 2 to cap owners. The cap bounds pairs per gram."""
    capped = owned_between(bags, 2, cap).select("lang", "g", "unit_id")
    a, b = capped.withColumnRenamed("unit_id", "unit_a"), capped.withColumnRenamed("unit_id", "unit_b")
    return a.join(b, ["lang", "g"]).where("unit_a < unit_b").groupBy("lang", "unit_a", "unit_b").agg(F.count(F.lit(1)).alias("shared"))


def bag_jaccard(bags: DataFrame, cap: int, least: float) -> DataFrame:
    """Pairs of shared_count_pairs whose shared grams reach the share of all; each row carries its unit's bag size."""
    capped = owned_between(bags, 2, cap).select("lang", "g", "unit_id", "bag")
    a, b = (capped.withColumnsRenamed({"unit_id": f"unit_{k}", "bag": f"bag_{k}"}) for k in "ab")
    pairs = a.join(b, ["lang", "g"]).where("unit_a < unit_b").groupBy("lang", "unit_a", "unit_b").agg(F.count(F.lit(1)).alias("shared"), F.first("bag_a").alias("bag_a"), F.first("bag_b").alias("bag_b"))
    sim = F.col("shared").cast("double") / (F.col("bag_a") + F.col("bag_b") - F.col("shared")).cast("double")
    return pairs.withColumn("sim", sim).where(F.col("sim") >= least).select("lang", "unit_a", "unit_b", "shared", F.round("sim", 6).alias("similarity"))


def jaccard(pairs: DataFrame, sizes: DataFrame, least: float) -> DataFrame:
    """Pairs whose shared grams reach the share of all; sizes has unit_id and bag, over-frequent grams included."""
    a = sizes.select(F.col("unit_id").alias("unit_a"), F.col("bag").alias("bag_a"))
    b = sizes.select(F.col("unit_id").alias("unit_b"), F.col("bag").alias("bag_b"))
    sim = F.col("shared").cast("double") / (F.col("bag_a") + F.col("bag_b") - F.col("shared")).cast("double")
    return pairs.join(a, "unit_a").join(b, "unit_b").withColumn("sim", sim).where(F.col("sim") >= least).select("lang", "unit_a", "unit_b", "shared", F.round("sim", 6).alias("similarity"))


def landmarks(grams: DataFrame, bags: DataFrame, n_units: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """unit_id, lang, g: distinct pairs of rare grams, each with the next few, hashed with their coarse distance."""
    # The bound depends on the number of units of a language: a handful of rows, one for each language.
    rare = document_frequency(bags).join(n_units, "lang").where("df <= greatest(3, n_units div 20)").select("lang", "g")
    here = grams.join(rare, ["lang", "g"], "left_semi")
    order = Window.partitionBy("unit_id").orderBy("pos")
    ahead = [F.struct(F.lead("g", k).over(order).alias("h"), F.lead("pos", k).over(order).alias("p")) for k in range(1, t.landmark_fan_out + 1)]
    wide = here.select("unit_id", "lang", "g", "pos", F.array(*ahead).alias("ahead"))
    pairs = wide.select("unit_id", "lang", "g", "pos", F.explode("ahead").alias("n")).where("n.h is not null")
    key = F.xxhash64("g", "n.h", F.expr(f"(n.p - pos) div {t.landmark_step}"))
    return pairs.select("unit_id", "lang", key.alias("g")).distinct()


def candidate_union(bag_pairs: DataFrame, landmark_pairs: DataFrame) -> DataFrame:
    """Pairs of either source, with where they come from."""
    both = bag_pairs.select("unit_a", "unit_b", F.lit(True).alias("bag"), F.lit(False).alias("landmark")).unionByName(landmark_pairs.select("unit_a", "unit_b", F.lit(False).alias("bag"), F.lit(True).alias("landmark")))
    return both.groupBy("unit_a", "unit_b").agg(F.bool_or("bag").alias("by_bag"), F.bool_or("landmark").alias("by_landmark"))


def size_gate(pairs: DataFrame, sizes: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Pairs whose sizes are near enough for an alignment to pass; sizes has unit_id and token_count."""
    a = sizes.select(F.col("unit_id").alias("unit_a"), F.col("token_count").alias("ta"))
    b = sizes.select(F.col("unit_id").alias("unit_b"), F.col("token_count").alias("tb"))
    room = 1 + 2 * t.max_divergence + 0.15
    return pairs.join(a, "unit_a").join(b, "unit_b").where(F.greatest("ta", "tb") <= F.least("ta", "tb") * room + 64)


def offset_histogram(pairs: DataFrame, grams: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """unit_a, unit_b, votes, needed, passed: votes of the best diagonal bin, one for each gram and bin."""
    first = Window.partitionBy("unit_id", "g").orderBy("pos")
    offsets = grams.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= t.histogram_offsets)
    inventory = grams.groupBy("unit_id").agg(F.count_distinct("g").alias("inv"))
    a = offsets.select(F.col("unit_id").alias("unit_a"), "g", F.col("pos").alias("pa"))
    b = offsets.select(F.col("unit_id").alias("unit_b"), "g", F.col("pos").alias("pb"))
    keys = pairs.select("unit_a", "unit_b")
    bins = keys.join(a, "unit_a").join(b, ["unit_b", "g"]).select("unit_a", "unit_b", "g", F.expr(f"(pa - pb) div {t.histogram_bin}").alias("bin")).distinct()
    votes = bins.groupBy("unit_a", "unit_b", "bin").agg(F.count(F.lit(1)).alias("n")).groupBy("unit_a", "unit_b").agg(F.max("n").alias("votes"))
    ia = inventory.select(F.col("unit_id").alias("unit_a"), F.col("inv").alias("ia"))
    ib = inventory.select(F.col("unit_id").alias("unit_b"), F.col("inv").alias("ib"))
    out = keys.join(votes, ["unit_a", "unit_b"], "left").join(ia, "unit_a").join(ib, "unit_b")
    out = out.withColumn("votes", F.coalesce("votes", F.lit(0)).cast("long")).withColumn("needed", F.expr(f"greatest({t.histogram_min_votes}, least(ia, ib) div 8)").cast("long"))
    return out.select("unit_a", "unit_b", "votes", "needed", (F.col("votes") >= F.col("needed")).alias("passed"))
