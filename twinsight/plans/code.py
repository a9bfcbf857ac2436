"""Queries over source code: a Python file for each part, whose families are known from how it is written.

A part's number decides the function and the form it is written in, its brand the attribute that the function uses.
Forms of one function that differ in names, literals, loops, operands or dead statements must meet in one family, so the
SQL groups by function and brand and never reads the code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import cut
from ..operators.scan import extract
from .tables import table

_ROUTE = """def route_{K}(items_{K}, depot):
    lanes = {}
    for item_{K} in items_{K}:
        zone = item_{K}.{B} % {L} + depot
        if zone in lanes:
            lanes[zone].append(item_{K}.label)
        else:
            lanes[zone] = [item_{K}.label]
            announce(zone)
    return lanes
"""
_LOOP = """def steps_{K}(a, b_{K}, seen):
    while b_{K} != 0:
        seen.{B}((a, b_{K}))
        a, b_{K} = b_{K}, a % b_{K}
    return a
"""
_TAIL = """def steps_{K}(a, b_{K}, seen):
    if b_{K} == 0:
        return a
    seen.{B}((a, b_{K}))
    return steps_{K}(b_{K}, a % b_{K}, seen)
"""
#: Written forms of the two functions; a part takes one by its number.
FORMS = {
    "route": (_ROUTE, _ROUTE.replace("for item_{K} in items_{K}:", "for n in range(len(items_{K})):").replace("item_{K}.", "items_{K}[n]."), _ROUTE.replace("item_{K}.{B} % {L} + depot", "depot + item_{K}.{B} % {L}"), _ROUTE.replace("(zone)\n", "(zone)\n            pass\n")),
    "steps": (_LOOP, _TAIL),
}


def _written(key: Column, forms: tuple[str, ...]) -> Column:
    """The form of a number: its remainder by the number of forms."""
    out = F.lit(forms[-1])
    for k in range(len(forms) - 1):
        out = F.when(key % len(forms) == k, F.lit(forms[k])).otherwise(out)
    return out


def files(spark: SparkSession, d: str) -> DataFrame:
    """path, dir, lang, content of a file for each part."""
    key = F.col("p_partkey")
    code = F.when(key % 3 == 0, _written(key, FORMS["steps"])).otherwise(_written(key, FORMS["route"]))
    for name, by in (("{K}", key.cast("string")), ("{B}", F.regexp_replace(F.lower("p_brand"), "[^a-z0-9]", "")), ("{L}", (F.col("p_size") + 2).cast("string"))):
        code = F.replace(code, F.lit(name), by)
    head = F.when(key % 5 == 0, F.lit("import parts\n\n")).otherwise("")
    pragma = F.when(key % 11 == 0, F.lit("# tool:ignore\n")).when(key % 11 == 1, F.lit("# tool:accept-drift\n")).otherwise("")
    folder = F.when(key % 13 == 0, F.lit("tests")).otherwise(F.lower("p_type"))
    # Parsing costs far more than reading numbers: a file of parts is dealt to all cores before code is written.
    parts = table(spark, d, "part").select("p_partkey", "p_brand", "p_size", "p_type").repartition(spark.sparkContext.defaultParallelism)
    out = parts.select(folder.alias("dir"), F.lit("python").alias("lang"), F.concat(head, pragma, code).alias("content"), key)
    return out.select(F.concat("dir", F.lit("/part_"), "p_partkey", F.lit(".py")).alias("path"), "dir", "lang", "content")


def code_units(spark, d):
    """Every function with its place, and what pragmas and paths say of it."""
    return extract(files(spark, d)).select("path", "name", F.col("line0").cast("long").alias("line0"), F.col("line1").cast("long").alias("line1"), "degraded", "is_test", "accept_drift")


def code_normalize(spark, d):
    """The family of every function, of any size: the smallest path with its fingerprint, and how many share it."""
    units = cut(extract(files(spark, d)).select("path", "name", "fp"))
    families = units.groupBy("fp").agg(F.min("path").alias("family"), F.count(F.lit(1)).alias("n_members"))
    return units.join(families, "fp").select("path", "name", "family", "n_members")


QUERIES = {f.__name__: f for f in (code_units, code_normalize)}

_PARTS = """WITH written AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 13 = 0 THEN 'tests' ELSE lower(p_type) END || '/part_' || p_partkey || '.py' AS path,
        regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS brand, CASE WHEN p_partkey % 3 = 0 THEN 'steps' ELSE 'route' END AS shape,
        CASE WHEN p_partkey % 5 = 0 THEN 2 ELSE 0 END + CASE WHEN p_partkey % 11 = 1 THEN 1 ELSE 0 END + 1 AS line0,
        CASE WHEN p_partkey % 3 = 0 THEN 5 WHEN p_partkey % 4 = 3 THEN 11 ELSE 10 END AS n_lines FROM part WHERE p_partkey % 11 <> 0)"""

SQL = {
    "code_units": f"""{_PARTS} SELECT path, shape || '_' || k AS name, line0::BIGINT AS line0, (line0 + n_lines - 1)::BIGINT AS line1, false AS degraded,
        k % 13 = 0 AS is_test, k % 11 = 1 AS accept_drift FROM written""",
    "code_normalize": f"{_PARTS} SELECT path, shape || '_' || k AS name, min(path) OVER w AS family, count(*) OVER w AS n_members FROM written WINDOW w AS (PARTITION BY shape, brand)",
}
