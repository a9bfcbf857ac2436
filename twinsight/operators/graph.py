"""Connected and strongly connected components, groups' summaries and subset tests."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_FALLBACK = "/tmp/checkpoints"


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; local mode alone has one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{LOCAL_FALLBACK}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write to the folder in spark.checkpoint.dir and read back, so that lineage ends and a lost executor costs nothing."""
    spark: SparkSession = df.sparkSession
    path = f"{checkpoint_folder(spark)}/twinsight/{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def discard(table: DataFrame) -> None:
    """Delete the files of a table from cut() that nothing will read again."""
    spark: SparkSession = table.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table._cut_path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def connected_components(edges: DataFrame, a: str = "unit_a", b: str = "unit_b") -> DataFrame:
    """unit_id, component: each vertex of the edges with its component's smallest one.

    Labels spread over edges and jump to their labels' labels, so rounds grow with the logarithm of the longest way.
    """
    one = edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = cut(one.unionByName(one.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = cut(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("unit_id"), F.least("x", "m").alias("component")))
    while True:
        told = both.join(labels.withColumnRenamed("unit_id", "y"), "y").groupBy(F.col("x").alias("unit_id")).agg(F.min("component").alias("told"))
        step = cut(labels.join(told, "unit_id").select("unit_id", F.least("component", "told").alias("component"), F.col("component").alias("old")))
        jump = step.select(F.col("unit_id").alias("component"), F.col("component").alias("above"))
        step = cut(step.join(jump, "component", "left").select("unit_id", F.least("component", F.coalesce("above", "component")).alias("component"), "old"))
        if step.where("component <> old").isEmpty():
            return labels
        labels = step.drop("old")


def reachability(edges: DataFrame) -> DataFrame:
    """src, dst: all pairs joined by a way of one edge or more, doubling its length each round. For small graphs."""
    reach = cut(edges.select("src", "dst").distinct())
    n = reach.count()
    while True:
        longer = reach.join(reach.select(F.col("src").alias("dst"), F.col("dst").alias("next")), "dst").select("src", F.col("next").alias("dst"))
        reach = cut(reach.unionByName(longer).distinct())
        if (m := reach.count()) == n:
            return reach
        n = m


def strongly_connected(edges: DataFrame) -> DataFrame:
    """node, scc, scc_size: components of two nodes or more by mutual reachability, named by their smallest node."""
    reach = reachability(edges)
    mutual = reach.join(reach.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"])
    return mutual.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("scc"), F.count(F.lit(1)).alias("scc_size")).where("scc_size > 1")


def group_summary(pairs: DataFrame, components: DataFrame) -> DataFrame:
    """For each component its members, closest pair and largest divergence; ties go to the first pair."""
    own = pairs.join(components.withColumnRenamed("unit_id", "unit_a"), "unit_a").withColumn("div", F.round(1 - F.col("similarity"), 6))
    found = own.groupBy("component").agg(F.min(F.struct("div", "unit_a", "unit_b")).alias("best"), F.max("div").alias("max_div"))
    members = components.groupBy("component").agg(F.count(F.lit(1)).alias("n_members"))
    return found.join(members, "component").select("component", "n_members", F.col("best.unit_a").alias("best_a"), F.col("best.unit_b").alias("best_b"), F.col("best.div").alias("min_div"), "max_div")


def subset_groups(members: DataFrame) -> DataFrame:
    """group_id, size, dropped for rows (group_id, rank, unit_id): a group goes if its members are a strict subset of
    another's, or equal to those of one that comes first by rank and identifier."""
    sizes = members.groupBy("group_id", "rank").agg(F.count(F.lit(1)).alias("size"))
    sized = members.join(sizes, ["group_id", "rank"])
    x, y = (sized.select("unit_id", F.col("group_id").alias(f"{k}_id"), F.col("rank").alias(f"{k}_rank"), F.col("size").alias(f"{k}_size")) for k in "xy")
    common = x.join(y, "unit_id").where("x_id <> y_id and y_size >= x_size").groupBy("x_id", "x_rank", "x_size", "y_id", "y_rank", "y_size").agg(F.count(F.lit(1)).alias("n"))
    inside = common.where("n = x_size and (y_size > x_size or struct(y_rank, y_id) < struct(x_rank, x_id))")
    gone = inside.select(F.col("x_id").alias("group_id")).distinct().withColumn("dropped", F.lit(True))
    return sizes.join(gone, "group_id", "left").select("group_id", "size", F.coalesce("dropped", F.lit(False)).alias("dropped"))
