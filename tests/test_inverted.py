"""Pairs made in rounds equal those of the joins, and no query on landmarks shuffles every gram at once."""

import random

import pytest
from pyspark.sql import functions as F
from twinsight.config import DEFAULT
from twinsight.operators import inverted, retrieval
from twinsight.plans import queries
from twinsight.plans import tables as T


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(5)
    texts: list[str | None] = [None, "", "a " * 300]
    for _ in range(40):
        own = [f"w{rng.randrange(300):x}q" for _ in range(rng.randrange(30, 150))]
        texts.append(" ".join(own))
        texts.append(" ".join(own[: len(own) // 2] + ["new"] + own[len(own) // 2 :]))
    texts += texts[:20]
    rows = [(i - 40, t, rng.choice(["en", "fr", None]), "s") for i, t in enumerate(texts)]
    out = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3).write.parquet(f"{out}/documents.parquet")
    return out


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


@pytest.mark.parametrize("bucket", [700, inverted.BUCKET])
def test_rounds_find_the_pairs_of_joins(spark, folder, monkeypatch, bucket):
    monkeypatch.setattr(inverted, "BUCKET", bucket)  # 700: several rounds and buckets
    reps = T.representatives(T.units(T.table(spark, folder, "documents")))
    marks = retrieval.landmarks(T.grams(reps, 3), T.bags(reps, 3), reps.groupBy("lang").count().withColumnRenamed("count", "n_units"))
    columns = ["lang", "unit_a", "unit_b", "shared"]
    wanted = rows(retrieval.shared_count_pairs(marks, DEFAULT.df_cap).where("shared >= 2"), *columns)
    assert len(wanted) > 10 and rows(queries.landmark_candidates(spark, folder), *columns) == wanted
    wanted = rows(retrieval.bag_jaccard(T.bags(reps, 5), DEFAULT.df_cap, DEFAULT.candidate_sim), *columns, "similarity")
    near, _ = queries._near_and_marked(spark, folder)
    assert len(wanted) > 5 and rows(near, *columns, "similarity") == wanted


def test_common_grams_are_counted_over_all_pieces(spark, folder):
    words = inverted.word_hashes(T.units(T.table(spark, folder, "documents")))
    bags = T.bags(T.representatives(T.units(T.table(spark, folder, "documents"))), 1)
    n = bags.groupBy("lang").agg({"unit_id": "max"}).select("lang").join(words.groupBy("lang").count(), "lang")
    wanted = retrieval.document_frequency(bags).join(n, "lang").where("df > greatest(3, count div 20)").count()
    assert len(inverted.common_grams(words, 1)) == wanted > 0


@pytest.mark.parametrize("query", ["landmark_candidates", "candidate_union", "pair_exclusion", "pair_parity", "size_gate", "subset_dedupe"])
def test_grams_are_not_shuffled_at_once(spark, folder, query):
    plan = queries.QUERIES[query](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan
    assert spark.conf.get(inverted._CLEANUP) == "false"


def test_first_units_meet_whole_texts_by_a_hash_join(spark, folder):
    ids = spark.range(3).select(F.col("id").alias("unit_id"))
    plan = queries._some_units(T.table(spark, folder, "documents"), ids)._jdf.queryExecution()
    assert "SortMergeJoin" not in plan.sparkPlan().toString()
    join = plan.optimizedPlan().toString().split("Join LeftSemi")
    assert len(join) == 2 and "regexp_replace" in join[0] and "regexp_replace" not in join[1]


def test_size_gate_reads_sizes_of_words(spark, folder):
    plan = queries.size_gate(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan
