"""Line-first cleaning: judge each line, remove those that fail, then reject documents that lost too much text.

Only DataFrame functions are used. Each document is one row from end to end, so there is no shuffle at all.

Defined results: null text counts as no words and fails; empty text likewise; repeated rows give repeated results;
an empty table gives an empty table; other columns pass through, and those named like a result are replaced.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import let

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class LineRules:
    """Thresholds of the rules. A line fails if any rule fails it; lines without a word are neither kept nor lost."""

    min_words: int = 20
    max_repeat_percent: int = 30
    #: A line with more than this share of symbols among its non-space characters fails the punctuation rule.
    max_symbol_percent: int = 8
    #: A line with this many runs of two or more exclamation or question marks fails the punctuation rule.
    shouts: int = 4
    #: A line of fewer words must end in a terminal mark.
    short_line: int = 4
    #: Separators between short entries that make a line navigation.
    separators: int = 3
    #: The document is rejected if less than this share of its word characters is left.
    min_left_percent: int = 50
    terminal: str = r"""[.!?:;,"'”’»)\]。！？…]$"""
    separator: str = r"(^|\x20)[|»›•>·]\x20"
    navigation: str = r"^(home|menu|log ?in|sign (in|up)|next|previous|back to top|skip to content|share|search|contact us|about us)$"
    boilerplate: str = r"(cookie policy|accept (all )?cookies|privacy policy|terms of (use|service)|all rights reserved|enable javascript|subscribe to our newsletter|click here|lorem ipsum)"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def repeated_words(words: Column) -> Column:
    """Words in windows of WINDOW words found twice or more, first ones included."""

    def covered(found: Column) -> Column:
        at = F.transform(found, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
        return let(F.sort_array(at), of_sorted)

    def of_sorted(s: Column) -> Column:
        same = F.filter(s, lambda x, k: (F.get(s, k - 1)["w"] == x["w"]) | (F.get(s, k + 1)["w"] == x["w"]))
        return let(F.sort_array(F.transform(same, lambda x: x["i"])), spread)

    def spread(p: Column) -> Column:
        step = F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(step, F.lit(0).cast("long"), lambda total, x: total + x)

    def of_windows(found: Column) -> Column:
        return F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0).cast("long")).otherwise(covered(found))

    def of_hashes(h: Column) -> Column:
        places = F.sequence(F.lit(1), F.size(h) - (WINDOW - 1))
        return let(F.transform(places, lambda i: F.xxhash64(F.slice(h, i, WINDOW))), of_windows)

    return F.when(F.size(words) < WINDOW, F.lit(0).cast("long")).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes))


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


BLANKS = " \t\n\x0b\x0c\r"


def line_fails(line: Column, rules: LineRules) -> Column:
    """Whether a line with a word fails one of the rules."""
    trimmed = F.btrim(line, F.lit(BLANKS))
    plain = F.translate(trimmed, string.ascii_uppercase, string.ascii_lowercase)
    solid = F.char_length(without(line, BLANKS))
    symbols = F.char_length(line) - F.char_length(without(line, SYMBOLS))
    n_words = F.size(words_of(line))
    shouts = F.size(F.split(line, "[!?]{2,}")) - 1
    separators = F.size(F.split(trimmed, rules.separator)) - 1
    punctuation = (100 * symbols > rules.max_symbol_percent * solid) | (shouts >= rules.shouts) | ((n_words < rules.short_line) & ~trimmed.rlike(rules.terminal))
    navigation = ((separators >= rules.separators) & (n_words <= 6 * separators)) | plain.rlike(rules.navigation)
    return punctuation | navigation | plain.rlike(rules.boilerplate)


def clean_lines(df: DataFrame, rules: LineRules = LineRules(), text: str = "text") -> DataFrame:
    """Add the counts, the verdict (base_failed, kept) and clean_text: the lines that pass, joined again."""
    body = F.coalesce(F.col(text), F.lit(""))
    # DataFrame columns below are each used once, or are cheap; words are bound once for the counts that need them.
    counts = let(words_of(body), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(WORD))
    judged = let(lines, lambda ls: F.struct(
        (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
        F.filter(ls, lambda x: ~line_fails(x, rules)).alias("kept_lines"),
    ))
    out = df.withColumns({"__counts": counts, "__judged": judged}).withColumns({
        "n_words": F.col("__counts.n_words"),
        "word_chars": F.char_length(without(body, BLANKS)).cast("long"),
        "n_symbols": (F.char_length(body) - F.char_length(without(body, SYMBOLS))).cast("long"),
        "n_dup_lines": F.col("__judged.n_dup_lines"),
        "n_repeat_words": F.col("__counts.n_repeat_words"),
        "clean_text": F.array_join(F.col("__judged.kept_lines"), "\n"),
    })
    left = F.char_length(without(F.col("clean_text"), BLANKS))
    out = out.withColumn("base_failed", (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & (100 * left >= rules.min_left_percent * F.col("word_chars"))).drop("__counts", "__judged")


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return clean_lines(documents).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_R = LineRules()
_BLANK_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP10_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, list_filter(regexp_split_to_array(text, '{SPACES}'), lambda x: x <> '') AS words FROM d),
p AS (SELECT rid, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS win FROM (SELECT rid, words, unnest(generate_series(1, len(words) - {WINDOW - 1})) AS i FROM w)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM p) WHERE n > 1),
c AS (SELECT rid, count(DISTINCT i + k) AS n FROM (SELECT rid, i, unnest(range(0, {WINDOW})) AS k FROM r) GROUP BY rid),
l0 AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
l1 AS (SELECT rid, line, trim(line, {_BLANK_SQL}) AS t, translate(line, {_BLANK_SQL}, '') AS solid FROM l0 WHERE regexp_matches(line, '{WORD}')),
l2 AS (SELECT rid, line, t, solid, translate(t, '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS plain,
    length(line) - length(translate(line, '{SYMBOLS}', '')) AS symbols,
    len(list_filter(regexp_split_to_array(line, '{SPACES}'), lambda x: x <> '')) AS nw,
    len(regexp_split_to_array(line, '[!?]{{2,}}')) - 1 AS shouts, len(regexp_extract_all(t, '{_R.separator}')) AS seps FROM l1),
l3 AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup, sum(CASE WHEN 100 * symbols > {_R.max_symbol_percent} * length(solid) OR shouts >= {_R.shouts}
    OR (nw < {_R.short_line} AND NOT regexp_matches(t, '{_R.terminal.replace("'", "''")}')) OR (seps >= {_R.separators} AND nw <= 6 * seps)
    OR regexp_matches(plain, '{_R.navigation}') OR regexp_matches(plain, '{_R.boilerplate}') THEN 0 ELSE length(solid) END) AS left_chars FROM l2 GROUP BY rid),
s AS (SELECT d.doc_id, len(w.words) AS n_words, length(translate(d.text, {_BLANK_SQL}, '')) AS word_chars, length(d.text) - length(translate(d.text, '{SYMBOLS}', '')) AS n_symbols,
    coalesce(l3.n_dup, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, coalesce(l3.left_chars, 0) AS left_chars
    FROM d JOIN w USING (rid) LEFT JOIN c USING (rid) LEFT JOIN l3 USING (rid)),
b AS (SELECT *, n_words < {_R.min_words} OR 100 * n_repeat_words > {_R.max_repeat_percent} * n_words AS base_failed FROM s)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
    n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND 100 * left_chars >= {_R.min_left_percent} * word_chars AS kept FROM b
"""
