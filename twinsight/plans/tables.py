"""Long-form tables of the text profile: documents as units, words as tokens, lines as statements.

Words are split at ASCII white space and lower-cased; runs of digits become INT, except in the words 0 and 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds

SPACES = r"[ \t\n\x0B\f\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


_SPACE = r" \t\n\x0B\f\r"
#: A run of digits, unless it is the whole word 0 or 1; looks around only at a digit.
_DIGITS = rf"[0-9](?<!(?<![^{_SPACE}])[01](?![^{_SPACE}]))[0-9]*"


def tokens(text: Column) -> Column:
    """Normalised words, made from the whole text so that no step runs for each word."""
    return words(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _DIGITS, "INT"))


#: Stands for a line's end among tokens; no token is this word, as all are in lower case but for INT.
LINE_END = "NL"


def tokens_and_ends(text: Column) -> Column:
    """Normalised words with LINE_END at every line's end but the last one's."""
    return words(F.replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _DIGITS, "INT"), F.lit("\n"), F.lit(f" {LINE_END} ")))


def units(documents: DataFrame) -> DataFrame:
    """unit_id, lang, dir, toks, token_count, fp: one for each row, the fingerprint over normalised words."""
    out = documents.select(F.col("doc_id").alias("unit_id"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("dir"), tokens(F.col("text")).alias("toks"))
    return out.withColumns({"token_count": F.size("toks").cast("long"), "fp": F.md5(F.array_join("toks", " "))})


def representatives(units_: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """The first unit of each (lang, fp) of at least the floor size.

    Which one is first is found on identifiers alone; the tokens join back, so a large family is one aggregated row.
    """
    large = units_.where(F.col("token_count") >= t.min_unit_tokens)
    first = large.groupBy("lang", "fp").agg(F.min("unit_id").alias("unit_id"))
    return large.join(first.select("unit_id"), "unit_id", "left_semi")


def let(value: Column, body) -> Column:
    """Evaluate a column once for each row and hand it to body; a name inside a lambda would be evaluated at each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def gram_hashes(toks: Column, k: int) -> Column:
    """The 64-bit hash of every run of k tokens, in order; null if there is none."""
    run = lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (k - 1)), lambda i: F.xxhash64(F.slice(h, i, k)))
    return F.when(F.size(toks) >= k, let(F.transform(toks, lambda w: F.xxhash64(w)), run))


def grams(units_: DataFrame, k: int) -> DataFrame:
    """unit_id, lang, pos, g, before: every run of k tokens, as a 64-bit hash, its 0-based place, and the hash of the token
    before it, null at the start."""
    found = units_.select("unit_id", "lang", "toks", F.posexplode(gram_hashes(F.col("toks"), k)).alias("pos", "g"))
    return found.select("unit_id", "lang", "pos", "g", F.when(F.col("pos") > 0, F.xxhash64(F.get("toks", F.col("pos") - 1))).alias("before"))


def bags(units_: DataFrame, k: int) -> DataFrame:
    """unit_id, lang, bag, g: distinct grams, made distinct inside each row, so nothing is shuffled for it."""
    bag = let(F.array_distinct(gram_hashes(F.col("toks"), k)), lambda h: F.transform(h, lambda g: F.struct(F.size(h).cast("long").alias("bag"), g.alias("g"))))
    return units_.select("unit_id", "lang", F.explode(bag).alias("x")).select("unit_id", "lang", "x.bag", "x.g")


def lines(documents: DataFrame) -> DataFrame:
    """unit_id, lang, dir, line_no (from 1), n_lines, line (normalised), line_tokens of lines with a word."""
    split = F.split(F.coalesce("text", F.lit("")), "\n")
    out = documents.select(F.col("doc_id").alias("unit_id"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("dir"), F.size(split).alias("n_lines"), F.posexplode(split).alias("at", "raw"))
    out = out.withColumn("toks", tokens(F.col("raw"))).where(F.size("toks") > 0)
    return out.select("unit_id", "lang", "dir", (F.col("at") + 1).cast("long").alias("line_no"), F.col("n_lines").cast("long").alias("n_lines"), F.array_join("toks", " ").alias("line"), F.size("toks").cast("long").alias("line_tokens"))


def tests(labels: DataFrame) -> DataFrame:
    """Units that count as tests: those labelled with quality 0."""
    return labels.where("quality = 0").select(F.col("doc_id").alias("unit_id")).distinct()


def hunks(labels: DataFrame) -> DataFrame:
    """file, l0, l1: lines that a change touches; toxic documents are changed in lines 1 to 2, or 3 to 4 if good."""
    first = F.lit(1) + 2 * F.col("quality")
    return labels.where("toxic = 1").select(F.col("doc_id").alias("file"), first.cast("long").alias("l0"), (first + 1).cast("long").alias("l1"))
