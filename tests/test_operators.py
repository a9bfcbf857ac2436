"""Operators of the text profile on small tables, against plain versions and hand-worked cases."""

import random

import pytest
from pyspark.sql import functions as F

from twinsight.operators import api_profile, drift, findings, graph, regions, retrieval
from twinsight.plans import tables as T
from twinsight.sinks import cdata_escape, first_pairs, xml_escape


def docs(spark, texts, lang="en"):
    return spark.createDataFrame([(k, t, lang, f"s{k % 2}", None) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def test_units_normalise_words(spark):
    rows = T.units(docs(spark, [None, "", "Ab  12x 0 1 10\n"])).orderBy("unit_id").collect()
    assert [r["toks"] for r in rows] == [[], [], ["ab", "INTx", "0", "1", "INT"]]
    assert [r["token_count"] for r in rows] == [0, 0, 5]


def test_grams_of_short_units(spark):
    units = T.units(docs(spark, ["a b", "a b c", "a b c a b c", ""]))
    rows = T.grams(units, 3).groupBy("unit_id").count().collect()
    assert {r["unit_id"]: r["count"] for r in rows} == {1: 1, 2: 4}
    assert {(r["unit_id"], r["bag"]) for r in T.bags(units, 3).collect()} == {(1, 1), (2, 3)}


def test_representatives_and_exact_groups(spark):
    long = " ".join(f"w{k}" for k in range(40))
    units = T.units(docs(spark, [long, long.upper(), "short", "short", long + " x"]))
    assert [r["unit_id"] for r in T.representatives(units).orderBy("unit_id").collect()] == [0, 4]
    (g,) = findings.exact_groups(units).collect()
    assert (g["n_members"], g["token_count"], g["n_dirs"], g["first_unit"], g["value"]) == (2, 40, 2, 0, 60.0)
    assert findings.exact_groups(units.limit(0)).count() == 0


@pytest.mark.parametrize("owners, pairs", [(1, 0), (2, 1), (50, 1225), (51, 0)])
def test_owner_cap(spark, owners, pairs):
    bags = spark.range(owners).select(F.col("id").alias("unit_id"), F.lit("en").alias("lang"), F.lit(7).cast("long").alias("g"))
    assert retrieval.shared_count_pairs(bags, 50).count() == pairs


def test_size_gate_and_histogram(spark):
    sizes = spark.createDataFrame([(1, 100), (2, 214), (3, 216)], "unit_id long, token_count long")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "unit_a long, unit_b long")
    assert [r["unit_b"] for r in retrieval.size_gate(pairs, sizes).collect()] == [2]
    grams = spark.createDataFrame([(1, g, g) for g in range(8)] + [(2, g, g + 100) for g in range(5)] + [(3, 99, 0)], "unit_id long, g long, pos int")
    rows = retrieval.offset_histogram(pairs, grams).orderBy("unit_b").collect()
    assert [(r["votes"], r["needed"], r["passed"]) for r in rows] == [(5, 5, True), (0, 5, False)]


def test_components_equal_plain_union(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(k, k + 1) for k in range(100, 130)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = graph.connected_components(spark.createDataFrame(edges, "unit_a long, unit_b long")).collect()
    assert {r["unit_id"]: r["component"] for r in got} == {x: find(x) for x in parent}
    assert graph.connected_components(spark.createDataFrame([], "unit_a long, unit_b long")).count() == 0


def test_strong_components(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d")], "src string, dst string")
    assert sorted(tuple(r) for r in graph.strongly_connected(edges).collect()) == [("a", "a", 3), ("b", "a", 3), ("c", "a", 3)]


def test_subset_groups(spark):
    rows = [("a", 1, u) for u in (1, 2, 3)] + [("b", 2, u) for u in (1, 2)] + [("c", 2, u) for u in (1, 2, 3)] + [("d", 1, u) for u in (3, 4)]
    got = graph.subset_groups(spark.createDataFrame(rows, "group_id string, rank int, unit_id long")).collect()
    assert {r["group_id"]: r["dropped"] for r in got} == {"a": False, "b": True, "c": True, "d": False}


def test_regions_are_left_maximal_runs(spark):
    run = " ".join("r" + "abcdefghij"[k % 10] + "xyzw"[k // 10] for k in range(35))
    units = T.units(docs(spark, [f"a b {run} c", f"x {run} y z", f"{run}", "q"]))
    rows = {(r["unit_a"], r["unit_b"]): (r["pos_a"], r["pos_b"], r["length"]) for r in regions.neighbour_regions(units).collect()}
    assert rows and all(v[2] == 35 for v in rows.values())
    assert set(rows.values()) <= {(2, 1, 35), (2, 0, 35), (1, 0, 35)} and len(rows) == 2
    spans = spark.createDataFrame([(1, 0, 10), (1, 2, 5), (1, 0, 10), (1, 8, 12), (2, 2, 5)], "unit_id long, b0 long, b1 long")
    assert sorted(tuple(r) for r in regions.outermost_spans(spans).collect()) == [(1, 0, 10), (1, 8, 12), (2, 2, 5)]


def test_regions_order_by_whole_suffixes(spark):
    # Pairs share 400, 250 and 100 words; the first unit's closest one comes last by identifier.
    w = [f"{a}{b}" for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrst"]
    units = T.units(docs(spark, [" ".join(w) + " u", " ".join(w[:100]) + " v", " ".join(w[:250]) + " w", " ".join(w) + " x", " ".join(w)]))
    rows = {(r["unit_a"], r["unit_b"], r["length"]) for r in regions.neighbour_regions(units).collect()}
    assert rows == plain_regions(units.collect(), 30) and max(r[2] for r in rows) == 400


def plain_regions(units, k):
    at = sorted((u["toks"][p:], u["unit_id"], p, u["toks"][p - 1] if p else None) for u in units for p in range(len(u["toks"])))
    out = set()
    for (s, a, _, x), (t, b, _, y) in zip(at, at[1:], strict=False):
        n = next((i for i, (c, d) in enumerate(zip(s, t, strict=False)) if c != d), min(len(s), len(t)))
        if n >= k and a != b and (x is None or y is None or x != y):
            out.add((min(a, b), max(a, b), n))
    return out


def test_internal_repeats(spark):
    line = "one two three four five six"
    pair = f"{line}\nother words stand here now again"
    lines = T.lines(docs(spark, ["\n".join([line] * 5), "\n".join([pair] * 3), "\n".join([line] * 2), None]))
    rows = {r["unit_id"]: (r["period"], r["n_repeats"]) for r in findings.internal_repeats(lines).collect()}
    assert rows == {0: (1, 5), 1: (2, 3)}


def test_sections_ranks_and_gate(spark):
    groups = spark.createDataFrame([("a", "exact-normalized", 5.0, 1, 3), ("b", "near-normalized", 5.0, 1, 2), ("c", "weak-similarity", 9.0, 1, 1)], "group_id string, tier string, value double, token_count long, first_unit long")
    members = spark.createDataFrame([("a", 3), ("b", 2), ("b", 3), ("c", 1)], "group_id string, unit_id long")
    tests = spark.createDataFrame([(3,)], "unit_id long")
    ranked = {r["group_id"]: (r["section"], r["rank"]) for r in findings.ranked(findings.sectioned(groups, members, tests)).collect()}
    assert ranked == {"a": ("test", 1), "b": ("main", 2), "c": ("main", 1)}
    assert {r["group_id"] for r in findings.sectioned(groups, members, tests, "exclude").collect()} == {"b", "c"}
    assert {r["group_id"]: r["fails"] for r in findings.gate(groups, "near-normalized").collect()} == {"a": True, "b": True, "c": False}
    assert not any(r["fails"] for r in findings.gate(groups, "none").collect())
    with pytest.raises(ValueError):
        findings.gate(groups, "sure")


def test_generated_files(spark):
    texts = ["x" * 512, "x" * 511, "é" * 256, "a\nb\nc\nd\n@generated", "a\nb\nc\nd\ne\n@generated", None]
    rows = docs(spark, texts).where(findings.is_generated(F.col("text"))).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in rows] == [0, 2, 3]


DIFF = """diff --git a/x.py b/x.py
--- a/x.py
+++ b/x.py
@@ -10,2 +12,3 @@ def f
+++ b/not-a-header
@@ -39 +40,0 @@
diff --git a/gone.py b/gone.py
--- a/gone.py
+++ /dev/null
@@ -1,3 +0,0 @@
"""


def test_diffs_and_touch(spark):
    hunks = drift.parse_diff(spark.createDataFrame([(DIFF,), ("",)], "diff string"))
    assert sorted(map(str, (tuple(r) for r in hunks.collect()))) == ["('gone.py', None, None)", "('x.py', 12, 14)", "('x.py', 40, 41)"]
    members = spark.createDataFrame([("g", "x.py", 1, 11), ("g", "x.py", 14, 20), ("g", "gone.py", 5, 6), ("h", "x.py", 41, 60)], "fingerprint string, file string, line0 long, line1 long")
    assert {r["fingerprint"]: (r["n_members"], r["n_touched"]) for r in drift.counted(members, hunks).collect()} == {"g": (3, 2), "h": (1, 1)}
    assert [r["fingerprint"] for r in drift.inconsistent_updates(members, hunks).collect()] == ["g"]


def test_diff_lines_are_no_headers(spark):
    diff = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +1,2 @@\n+++ /dev/null\n+--- b\ndiff --git y y\n--- y\t2020-01-01\n+++ y\t2020-01-02\n@@ -3,0 +4 @@\n+z\ndiff --git a/w b/w\n--- a/w\n+++ /dev/null\n@@ -1 +0,0 @@\n-q\n"
    rows = drift.parse_diff(spark.createDataFrame([(diff,)], "diff string")).collect()
    assert {(r["file"], r["l0"], r["l1"]) for r in rows} == {("w", None, None), ("x", 1, 2), ("y", 4, 4)}


def test_member_mapping_prefers_names(spark):
    base = spark.createDataFrame([(1, "f", "a", 1, 5), (2, "f", "gone", 10, 12), (3, "g", "x", 1, 2)], "member_id long, file string, name string, line0 long, line1 long")
    now = spark.createDataFrame([("f", "a", 7, 40, 50), ("f", "b", 5, 3, 11), ("f", "a", 9, 1, 5)], "file string, name string, unit_id long, line0 long, line1 long")
    assert {r["member_id"]: (r["unit_id"], r["matched_by"]) for r in drift.map_members(base, now).collect()} == {1: (7, "name"), 2: (5, "span"), 3: (None, "none")}


def test_calls_resolve_to_the_nearest_pool(spark):
    defs = spark.createDataFrame([("en", d, u, n, u) for u, d, n in [(1, "p", "f"), (2, "q", "f"), (3, "q", "g"), (4, "r", "h"), (5, "r", "h"), (6, "r", "h"), (7, "r", "h")]], "lang string, dir string, unit_id long, name string, def_id long")
    calls = spark.createDataFrame([("en", "p", 1, "f"), ("en", "q", 9, "f"), ("en", "z", 9, "f"), ("en", "r", 9, "h"), ("en", "p", 9, "nope")], "lang string, dir string, unit_id long, name string")
    got = {(r["dir"], r["name"]): (r["tier"], r["n_candidates"], r["target"]) for r in api_profile.resolve_calls(calls, defs).collect()}
    assert got == {("p", "f"): ("file", 1, 1), ("q", "f"): ("dir", 1, 2), ("z", "f"): ("repo", 2, 1), ("r", "h"): ("dir", 4, None), ("p", "nope"): (None, None, None)}


def test_sinks(spark):
    members = spark.createDataFrame([("g", 3), ("g", 1), ("g", 2), ("h", 5)], "group_id string, unit_id long")
    assert sorted(tuple(r) for r in first_pairs(members).collect()) == [("g", 1, 2), ("g", 1, 3)]
    row = spark.createDataFrame([('a<b>&"c"]]>',)], "t string").select(xml_escape(F.col("t")).alias("x"), cdata_escape(F.col("t")).alias("c")).first()
    assert row["x"] == "a&lt;b&gt;&amp;&quot;c&quot;]]&gt;" and row["c"] == 'a<b>&"c"]]]]><![CDATA[>'
