"""One query for each operator over the driver's tables; every query reads its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..operators import api_profile, drift, findings, graph, inverted, offsets, regions, retrieval, verification, weighted
from ..sinks import cpd_files, cpd_heads, first_pairs, sarif_results
from . import tables as T

LAND = DEFAULT.landmark_gram


def _units(spark: SparkSession, d: str) -> DataFrame:
    return T.units(T.table(spark, d, "documents"))


def _reps(spark: SparkSession, d: str) -> DataFrame:
    return T.representatives(_units(spark, d))


def _n_units(reps: DataFrame) -> DataFrame:
    return reps.groupBy("lang").agg(F.count(F.lit(1)).alias("n_units"))


def exact_groups(spark, d):
    return findings.exact_groups(_units(spark, d))


def exact_members(spark, d):
    return findings.exact_members(_units(spark, d))


def generated_filter(spark, d):
    docs = T.table(spark, d, "documents")
    first = F.octet_length(F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)).cast("long")
    return docs.where(findings.is_generated(F.col("text"))).select(F.col("doc_id").alias("unit_id"), first.alias("first_line_bytes"))


def size_floor_stats(spark, d):
    below = F.count_if(F.col("token_count") < DEFAULT.min_unit_tokens)
    return _units(spark, d).groupBy("lang").agg(F.count(F.lit(1)).alias("n_units"), below.alias("below_floor"), F.sum("token_count").alias("tokens"))


def first_representative(spark, d):
    return _reps(spark, d).select("unit_id", "lang", "fp", "token_count")


def document_frequency(spark, d):
    df = retrieval.document_frequency(T.bags(_reps(spark, d), DEFAULT.gram))
    return df.groupBy("lang", "df").agg(F.count(F.lit(1)).alias("n_grams"))


def bag_pairs(spark, d):
    return retrieval.shared_count_pairs(T.bags(_reps(spark, d), DEFAULT.gram), DEFAULT.df_cap)


def bag_jaccard(spark, d):
    return retrieval.bag_jaccard(T.bags(_reps(spark, d), DEFAULT.gram), DEFAULT.df_cap, DEFAULT.candidate_sim)


def _landmarks(spark, d):
    reps = _reps(spark, d)
    return retrieval.landmarks(T.grams(reps, LAND), T.bags(reps, LAND), _n_units(reps))


def landmark_pairs(spark, d):
    return _landmarks(spark, d).groupBy("unit_id", "lang").agg(F.count(F.lit(1)).alias("n_landmarks"))


def _some_units(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """Units of a table of unit_id; whole texts meet it by a hash join."""
    return T.units(documents.join(ids.select(F.col("unit_id").alias("doc_id")).hint("shuffle_hash"), "doc_id", "left_semi"))


def _words(spark: SparkSession, d: str) -> DataFrame:
    docs = T.table(spark, d, "documents")
    return inverted.word_hashes(T.units(docs), only=lambda ids: _some_units(docs, ids))


def landmark_candidates(spark, d):
    return inverted.landmark_pairs(_words(spark, d))


def _near_and_marked(spark, d, words: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairs that bags find and pairs that landmarks find, from one table of words."""
    words = words or _words(spark, d)
    near = retrieval.jaccard(inverted.bag_pairs(words), inverted.bag_sizes(words, DEFAULT.gram), DEFAULT.candidate_sim)
    with inverted.tidy(spark):
        near = graph.cut(near)
    return near, inverted.landmark_pairs(words)


def candidate_union(spark, d):
    return retrieval.candidate_union(*_near_and_marked(spark, d))


def _gated(spark: SparkSession, d: str, words: DataFrame) -> DataFrame:
    """Candidates of near enough sizes; both units of a candidate have their words in the table."""
    with inverted.tidy(spark):
        sizes = graph.cut(words.select("unit_id", F.size("w").cast("long").alias("token_count")))
    pairs = retrieval.candidate_union(*_near_and_marked(spark, d, words))
    return retrieval.size_gate(pairs, sizes).select("unit_a", "unit_b", "ta", "tb")


def size_gate(spark, d):
    return _gated(spark, d, _words(spark, d))


def offset_histogram(spark, d):
    words = _words(spark, d)
    out = offsets.offset_histogram(_gated(spark, d, words), words)
    graph.discard(words)  # votes are written
    return out


def pair_exclusion(spark, d):
    """Landmark candidates that the bags have not found already."""
    near, marked = _near_and_marked(spark, d)
    return marked.join(near, ["unit_a", "unit_b"], "left_anti").select("unit_a", "unit_b", "shared")


def pair_parity(spark, d):
    """How many pairs of each language both ways find, and how many only bags or only landmarks."""
    found = [x.select("lang", "unit_a", "unit_b", F.lit(1).alias(k)) for k, x in zip(("bag", "mark"), _near_and_marked(spark, d), strict=True)]
    both = found[0].join(found[1], ["lang", "unit_a", "unit_b"], "full")
    count = lambda a, b: F.count_if((F.col("bag").isNotNull() == F.lit(a)) & (F.col("mark").isNotNull() == F.lit(b)))
    return both.groupBy("lang").agg(count(True, True).alias("n_both"), count(True, False).alias("n_bag_only"), count(False, True).alias("n_landmark_only"))


def kgram_regions(spark, d):
    return regions.neighbour_regions(_reps(spark, d))


def region_containment(spark, d):
    return regions.maximal_regions(graph.cut(kgram_regions(spark, d)))


def nested_exclusion(spark, d):
    found = graph.cut(kgram_regions(spark, d))
    spans = [found.select(F.col(f"unit_{k}").alias("unit_id"), F.col(f"pos_{k}").alias("b0"), (F.col(f"pos_{k}") + F.col("length")).alias("b1")) for k in "ab"]
    return regions.outermost_spans(spans[0].unionByName(spans[1]))


def components(spark, d):
    return graph.connected_components(bag_jaccard(spark, d))


def group_template_min_by(spark, d):
    pairs = graph.cut(bag_jaccard(spark, d))
    return graph.group_summary(pairs, graph.connected_components(pairs))


def group_containment(spark, d):
    """Groups of equal lines, and whether all their members lie in members of one exact family."""
    lines = T.lines(T.table(spark, d, "documents")).where("line_tokens >= 5")
    family = exact_members(spark, d).select("unit_id", "fingerprint")
    own = lines.groupBy(F.md5("line").alias("h"), "unit_id").agg(F.count(F.lit(1)).alias("n")).join(family, "unit_id", "left")
    inside = (F.count("fingerprint") == F.count(F.lit(1))) & (F.min("fingerprint") == F.max("fingerprint"))
    return own.groupBy("h").agg(F.count(F.lit(1)).alias("n_members"), F.coalesce(inside, F.lit(False)).alias("contained")).where("n_members >= 2")


def subset_dedupe(spark, d):
    """Near groups (rank 1) and groups of landmark candidates (rank 2), each a set of units."""
    near, marked = _near_and_marked(spark, d)
    near = graph.connected_components(near).select(F.concat(F.lit("near-"), F.col("component")).alias("group_id"), F.lit(1).alias("rank"), "unit_id")
    marks = graph.connected_components(marked).select(F.concat(F.lit("mark-"), F.col("component")).alias("group_id"), F.lit(2).alias("rank"), "unit_id")
    return graph.subset_groups(graph.cut(near.unionByName(marks)))


def internal_repeats(spark, d):
    return findings.internal_repeats(graph.cut(T.lines(T.table(spark, d, "documents"))))


def _findings(spark, d) -> tuple[DataFrame, DataFrame]:
    """Exact families and near groups, with their members."""
    exact, family = exact_groups(spark, d), exact_members(spark, d)
    key = F.concat("lang", F.lit("-"), "fingerprint")
    groups = exact.select(key.alias("group_id"), F.lit("exact-normalized").alias("tier"), "n_members", "token_count", "first_unit", "value")
    members = family.select(key.alias("group_id"), "unit_id")
    near = graph.connected_components(bag_jaccard(spark, d)).withColumn("group_id", F.concat(F.lit("near-"), F.col("component")))
    sized = near.join(_units(spark, d).select("unit_id", "dir", "token_count"), "unit_id").groupBy("group_id", "component").agg(F.count(F.lit(1)).alias("n_members"), F.max("token_count").alias("token_count"), F.count_distinct("dir").alias("n_dirs"))
    sized = sized.withColumn("value", findings.value(F.col("n_members"), F.col("token_count"), F.col("n_dirs")))
    groups = groups.unionByName(sized.select("group_id", F.lit("near-normalized").alias("tier"), "n_members", "token_count", F.col("component").alias("first_unit"), "value"))
    return graph.cut(groups), graph.cut(members.unionByName(near.select("group_id", "unit_id")))


def consolidation_value(spark, d):
    return _findings(spark, d)[0].select("group_id", "tier", "n_members", "token_count", "value")


def _sections(spark, d):
    return findings.sectioned(*_findings(spark, d), T.tests(T.table(spark, d, "labels")))


def test_policy(spark, d):
    return _sections(spark, d).select("group_id", "section")


def rank_sections(spark, d):
    return findings.ranked(_sections(spark, d)).select("group_id", "section", "tier", "value", "rank")


def topk(spark, d):
    return findings.topk(_sections(spark, d), DEFAULT.top).select("group_id", "section", "rank")


def findings_by_tier(spark, d):
    return _findings(spark, d)[0].groupBy("tier").agg(F.count(F.lit(1)).alias("n_findings"), F.sum("value").alias("value"))


def gate(spark, d):
    return findings.gate(_findings(spark, d)[0], "internal-repeat").select("group_id", "tier", F.col("fail_rank").cast("long").alias("fail_rank"), "fails")


def dup_line_ratio(spark, d):
    """Lines of members of exact families, against all lines."""
    lines = T.lines(T.table(spark, d, "documents")).groupBy("unit_id", "lang").agg(F.count(F.lit(1)).alias("n"))
    own = lines.join(exact_members(spark, d).select("unit_id", F.lit(1).alias("dup")), "unit_id", "left")
    dup = F.sum(F.when(F.col("dup") == 1, F.col("n")).otherwise(0))
    return own.groupBy("lang").agg(F.sum("n").alias("n_lines"), dup.alias("dup_lines"), F.round(dup.cast("double") / F.sum("n").cast("double"), 6).alias("ratio"))


def dup_token_ratio(spark, d):
    """Tokens that removing all copies but one would save, against all tokens."""
    saved = exact_groups(spark, d).groupBy("lang").agg(F.sum((F.col("n_members") - 1) * F.col("token_count")).alias("saved"))
    every = _units(spark, d).groupBy("lang").agg(F.sum("token_count").alias("tokens"))
    out = every.join(saved, "lang", "left").withColumn("saved", F.coalesce("saved", F.lit(0)).cast("long"))
    return out.select("lang", "tokens", "saved", F.round(F.when(F.col("tokens") > 0, F.col("saved").cast("double") / F.col("tokens").cast("double")).otherwise(0.0), 6).alias("ratio"))


def _api(spark, d):
    docs = T.table(spark, d, "documents")
    large = T.units(docs).where(F.col("token_count") >= DEFAULT.min_unit_tokens)
    each = api_profile.elements(T.lines(docs)).join(large.select("unit_id"), "unit_id", "left_semi")
    found = graph.cut(api_profile.weighted(each, _n_units(large)))
    return found, graph.cut(api_profile.signatures(found))


def api_signatures(spark, d):
    return _api(spark, d)[1].select("unit_id", "lang", "n_elements", "n_rare", "mass")


def api_pairs(spark, d):
    return api_profile.pairs(*_api(spark, d))


def weighted_jaccard(spark, d):
    docs = T.table(spark, d, "documents")
    words = docs.select(F.coalesce("doc_id", F.lit(weighted.NO_ID)).cast("long").alias("unit_id"), F.xxhash64(F.coalesce("lang", F.lit(""))).alias("seed"), F.transform(T.tokens_and_ends(F.col("text")), lambda w: F.xxhash64(w)).alias("w"))
    line_end = spark.range(1).select(F.xxhash64(F.lit(T.LINE_END))).first()[0]
    return weighted.weighted_jaccard(words, line_end)


def call_resolution(spark, d):
    """A document defines its first line's first word; the first words of its other lines call such names."""
    lines = T.lines(T.table(spark, d, "documents")).withColumn("name", F.element_at(F.split("line", " "), 1))
    defs = lines.where("line_no = 1").select("lang", "dir", "unit_id", "name", F.col("unit_id").alias("def_id"))
    calls = lines.where("line_no > 1").select("lang", "dir", "unit_id", "line_no", "name")
    return api_profile.resolve_calls(calls, defs).where("tier is not null").select("unit_id", "line_no", "name", "tier", "n_candidates", "target")


def _diffs(spark, d) -> DataFrame:
    """A unified diff for each labelled document that is toxic (changed) or bad (deleted)."""
    labels = T.table(spark, d, "labels").where("toxic = 1 or quality = 0").dropDuplicates(["doc_id"])
    name = F.col("doc_id").cast("string")
    first = (1 + 2 * F.col("quality")).cast("string")
    changed = F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name, F.lit("\n--- a/"), name, F.lit("\n+++ b/"), name, F.lit("\n@@ -"), first, F.lit(" +"), first, F.lit(",2 @@\n+x\n+y\n@@ -9,2 +12,0 @@\n-z\n"))
    deleted = F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name, F.lit("\n--- a/"), name, F.lit("\n+++ /dev/null\n@@ -1,3 +0,0 @@\n-x\n"))
    return labels.select(F.when(F.col("toxic") == 1, changed).otherwise(deleted).alias("diff"))


def diff_hunks(spark, d):
    return drift.parse_diff(_diffs(spark, d))


def _spans(spark, d) -> DataFrame:
    return T.table(spark, d, "documents").select(F.col("doc_id").alias("unit_id"), F.col("doc_id").cast("string").alias("file"), F.lit(1).cast("long").alias("line0"), F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("line1"))


def touched_units(spark, d):
    return drift.touched(_spans(spark, d), diff_hunks(spark, d)).select("unit_id")


def _member_spans(spark, d) -> DataFrame:
    family = exact_members(spark, d).select("unit_id", F.concat("lang", F.lit("-"), "fingerprint").alias("fingerprint"))
    return family.join(_spans(spark, d), "unit_id")


def inconsistent_update(spark, d):
    return drift.inconsistent_updates(_member_spans(spark, d), diff_hunks(spark, d))


def _earlier(spark, d) -> DataFrame:
    """The state before labelled documents were added."""
    docs = T.table(spark, d, "documents")
    return T.units(docs.join(T.table(spark, d, "labels").select("doc_id").distinct(), "doc_id", "left_anti"))


def check_new(spark, d):
    base = findings.exact_groups(_earlier(spark, d)).select(F.concat("lang", F.lit("-"), "fingerprint").alias("fingerprint"))
    return drift.new_groups(_member_spans(spark, d), base, diff_hunks(spark, d))


#: Words at the end of a labelled document that its earlier wording lacks.
CHANGED_WORDS = 20


def _near_state(units_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Near groups by their smallest unit (fingerprint, n_members, divergence), and their members."""
    pairs = graph.cut(retrieval.bag_jaccard(T.bags(T.representatives(units_), DEFAULT.gram), DEFAULT.df_cap, DEFAULT.candidate_sim))
    parts = graph.connected_components(pairs)
    return graph.group_summary(pairs, parts).select(F.col("component").alias("fingerprint"), "n_members", F.col("max_div").alias("divergence")), parts


def _earlier_wording(spark, d) -> DataFrame:
    """All units as they were before the change: labelled documents lack their last words."""
    labelled = T.table(spark, d, "labels").select(F.col("doc_id").alias("unit_id"), F.lit(True).alias("labelled")).distinct()
    toks = F.when(F.col("labelled"), F.slice("toks", 1, F.greatest(F.size("toks") - CHANGED_WORDS, F.lit(0)))).otherwise(F.col("toks"))
    own = _units(spark, d).join(labelled, "unit_id", "left").withColumn("toks", toks).drop("labelled")
    return own.withColumns({"token_count": F.size("toks").cast("long"), "fp": F.md5(F.array_join("toks", " "))})


def _near_change(spark, d) -> tuple[DataFrame, DataFrame]:
    """Near groups now, with how many members the change touched, and before."""
    now, parts = _near_state(_units(spark, d))
    spans = parts.withColumnRenamed("component", "fingerprint").join(_spans(spark, d), "unit_id")
    touched = drift.counted(spans, diff_hunks(spark, d)).select("fingerprint", "n_touched")
    return graph.cut(now.join(touched, "fingerprint")), _near_state(_earlier_wording(spark, d))[0]


def check_worsened(spark, d):
    """Touched groups that gained members or whose divergence grew: exact families since the state without labelled
    documents, near groups since the earlier wording."""
    base = findings.exact_groups(_earlier(spark, d)).select(F.concat("lang", F.lit("-"), "fingerprint").alias("fingerprint"), "n_members", F.lit(0.0).alias("divergence"))
    exact = drift.worsened(drift.counted(_member_spans(spark, d), diff_hunks(spark, d)).withColumn("divergence", F.lit(0.0)), base)
    near = drift.worsened(*_near_change(spark, d))
    return exact.unionByName(near.withColumn("fingerprint", F.concat(F.lit("near-"), "fingerprint")))


def check_drifting(spark, d):
    """Untouched near groups whose divergence grew since the earlier wording."""
    return drift.drifting(*_near_change(spark, d))


def base_member_mapping(spark, d):
    """Documents are members of files by source; their names are their first words, their spans follow identifiers."""
    docs = T.table(spark, d, "documents")
    name = F.array_join(F.slice(T.words(F.col("text")), 1, 3), " ")
    spans = docs.select(F.col("doc_id").alias("unit_id"), F.coalesce("source", F.lit("")).alias("file"), name.alias("name"), (F.col("doc_id") * 10).alias("line0"), (F.col("doc_id") * 10 + 9).alias("line1"))
    base = exact_members(spark, d).select("unit_id").join(spans, "unit_id").withColumnRenamed("unit_id", "member_id")
    labelled = T.table(spark, d, "labels").select(F.col("doc_id").alias("unit_id")).distinct()
    return drift.map_members(base, spans.join(labelled, "unit_id", "left_anti"))


def scc(spark, d):
    """Event types that follow one another at least as often as an average pair does."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    step = T.table(spark, d, "events").select(F.col("event_type").alias("src"), F.lead("event_type").over(order).alias("dst")).where("dst is not null")
    counts = graph.cut(step.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")))
    mean = counts.agg(F.avg("n").alias("mean"))
    return graph.strongly_connected(counts.join(mean, F.col("n") >= F.col("mean"), "left_semi").select("src", "dst"))


def jscpd_pairs(spark, d):
    members = exact_members(spark, d).select(F.concat("lang", F.lit("-"), "fingerprint").alias("group_id"), "unit_id")
    return first_pairs(members)


def _cpd(spark, d):
    members = _member_spans(spark, d).select(F.col("fingerprint").alias("group_id"), "unit_id", F.concat("file", F.lit(".txt")).alias("path"), "line0", "line1")
    return graph.cut(members)


def cpd_file_elements(spark, d):
    return cpd_files(_cpd(spark, d))


def cpd_xml(spark, d):
    groups = exact_groups(spark, d).select(F.concat("lang", F.lit("-"), "fingerprint").alias("group_id"), F.col("token_count").alias("tokens"), "first_unit")
    text = T.table(spark, d, "documents").select(F.col("doc_id").alias("first_unit"), F.coalesce("text", F.lit("")).alias("fragment"))
    return cpd_heads(groups.join(text, "first_unit").withColumn("lines", F.size(F.split("fragment", "\n")).cast("long")))


def sarif(spark, d):
    groups = exact_groups(spark, d).select(F.concat("lang", F.lit("-"), "fingerprint").alias("group_id"), F.lit("exact-normalized").alias("tier"), "n_members", F.col("first_unit").alias("unit_id"))
    return sarif_results(findings.gate(groups.join(_spans(spark, d), "unit_id").withColumn("path", F.concat("file", F.lit(".txt")))))


def anti_unify(spark, d):
    """Verdicts on the pairs that bags find, from templates over lines and words."""
    texts = T.table(spark, d, "documents").select(F.col("doc_id").alias("unit_id"), "text")
    return verification.verify(bag_jaccard(spark, d), texts)


QUERIES = {f.__name__: f for f in (
    exact_groups, exact_members, generated_filter, size_floor_stats, first_representative, document_frequency, bag_pairs, bag_jaccard, landmark_pairs, landmark_candidates, candidate_union, size_gate,
    offset_histogram, pair_exclusion, pair_parity, kgram_regions, region_containment, nested_exclusion, components, group_template_min_by, group_containment, subset_dedupe, internal_repeats,
    consolidation_value, test_policy, rank_sections, topk, findings_by_tier, gate, dup_line_ratio, dup_token_ratio, api_signatures, api_pairs, weighted_jaccard, call_resolution, diff_hunks, touched_units,
    inconsistent_update, check_new, check_worsened, check_drifting, base_member_mapping, scc, jscpd_pairs, cpd_file_elements, cpd_xml, sarif, anti_unify,
)}
