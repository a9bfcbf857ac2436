"""Source files as a table: language by extension, hidden and ignored paths left out, generated files dropped."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds
from ..operators.findings import is_generated

#: Extension to language; other files are not read. Fixed values.
LANGUAGES = {"rs": "rust", "py": "python", "ts": "typescript", "tsx": "tsx", "go": "go", "kt": "kotlin", "kts": "kotlin"}
#: Paths of generated code. Fixed values.
GENERATED_PATHS = ("**/generated/**", "*.pb.go", "*_pb2.py")


def glob_regex(pattern: str) -> str:
    """A regular expression for paths below the root; a pattern without a slash matches names at any depth."""
    anchored = "/" in pattern.rstrip("/")
    body = pattern.strip("/")
    parts = []
    for part in body.split("/"):
        parts.append(".*" if part == "**" else re.sub(r"^\(\?s:(.*)\)(\\Z|\\z)$", r"\1", fnmatch.translate(part)).replace(".*", "[^/]*"))
    joined = "/".join(parts).replace(".*/", "(?:.*/)?").replace("/.*", "/.*")
    return f"^(?:{'' if anchored else '(?:.*/)?'}{joined})(?:/.*)?$"


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether the last ignore pattern that matches is not a negated one."""
    out = F.lit(False)
    for line in patterns:
        line = line.strip()
        if line and not line.startswith("#"):
            keep = line.startswith("!")
            out = F.when(path.rlike(glob_regex(line.lstrip("!"))), F.lit(not keep)).otherwise(out)
    return out


def read_files(spark: SparkSession, root: str, exclude: tuple[str, ...] = (), ignore: tuple[str, ...] = (), t: Thresholds = DEFAULT) -> DataFrame:
    """path, dir, lang, content of the files below root; a missing root is an error, text that isn't UTF-8 is left out.

    ignore takes lines of an ignore file; exclude and the generated paths take away from what is left.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    # The root as Spark names it: everything after its last component's place in the path.
    base = root.rstrip("/").split("://")[-1]
    path = F.regexp_replace(F.col("path"), "^.*?" + re.escape(base) + "/", "")
    lang = F.try_element_at(F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair]), F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))
    out = raw.select(path.alias("path"), lang.alias("lang"), "content").where(F.col("lang").isNotNull() & ~F.col("path").rlike(r"(^|/)\.[^/]"))
    out = out.where(~ignored(F.col("path"), list(ignore)))
    for pattern in (*exclude, *GENERATED_PATHS):
        out = out.where(~F.col("path").rlike(glob_regex(pattern)))
    out = out.where(F.expr("is_valid_utf8(content)")).withColumn("content", F.col("content").cast("string"))
    return out.where(~is_generated(F.col("content"), t)).select("path", F.regexp_replace("path", "/?[^/]*$", "").alias("dir"), "lang", "content")
