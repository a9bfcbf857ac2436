"""Report formats, built as columns: one row for each finding, so a report of any size is written by all tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_pairs(members: DataFrame) -> DataFrame:
    """A group of n members as n - 1 pairs with its first one: group_id, first_id, second_id."""
    first = members.groupBy("group_id").agg(F.min("unit_id").alias("first_id"))
    return members.join(first, "group_id").where("unit_id <> first_id").select("group_id", "first_id", F.col("unit_id").alias("second_id"))


def xml_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def cdata_escape(text: Column) -> Column:
    return F.replace(text, F.lit("]]>"), F.lit("]]]]><![CDATA[>"))


def cpd_files(members: DataFrame) -> DataFrame:
    """group_id, unit_id, xml: the file element of each member (group_id, unit_id, path, line0, line1)."""
    xml = F.concat(F.lit('<file path="'), xml_escape(F.col("path")), F.lit('" line="'), F.col("line0").cast("string"), F.lit('" endline="'), F.col("line1").cast("string"), F.lit('"/>'))
    return members.select("group_id", "unit_id", xml.alias("xml"))


def cpd_heads(groups: DataFrame) -> DataFrame:
    """group_id, head, tail: what stands around the file elements of a group (group_id, lines, tokens, fragment)."""
    head = F.concat(F.lit('<duplication lines="'), F.col("lines").cast("string"), F.lit('" tokens="'), F.col("tokens").cast("string"), F.lit('">'))
    tail = F.concat(F.lit("<codefragment><![CDATA["), cdata_escape(F.col("fragment")), F.lit("]]></codefragment></duplication>"))
    return groups.select("group_id", head.alias("head"), tail.alias("tail"))


def sarif_results(groups: DataFrame) -> DataFrame:
    """group_id, result: one SARIF 2.1.0 result for each group (group_id, tier, fails, path, line0, line1, n_members)."""
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.col("line0").alias("startLine"), F.col("line1").alias("endLine")).alias("region")).alias("physicalLocation"))
    result = F.struct(
        F.col("tier").alias("ruleId"), F.when(F.col("fails"), "error").otherwise("note").alias("level"),
        F.struct(F.concat(F.col("n_members").cast("string"), F.lit(" members")).alias("text")).alias("message"),
        F.array(place).alias("locations"), F.struct(F.col("group_id").alias("structural/v1")).alias("partialFingerprints"),
    )
    return groups.select("group_id", F.to_json(result).alias("result"))
