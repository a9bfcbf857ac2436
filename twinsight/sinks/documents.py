"""Whole reports of a scan or a check: JSON, SARIF 2.1.0, CPD XML, jscpd JSON and text, as tables of fragments.

A fragment is a row (section_no, rank, part, place, text). In this order, joined by the format's separator, fragments are
the document. No group is ever one value, so a group of any size is written by many tasks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cdata_escape, xml_escape

ORDER = ("section_no", "rank", "part", "place")
#: Between two fragments of each format.
SEPARATOR = {"json": " ", "sarif": " ", "cpd": "\n", "jscpd": " ", "terminal": "\n"}
#: Names of the sections in the JSON report, and the letter that begins their findings' ids. Fixed values.
SECTION_KEYS = {"main": "groups", "test": "test_groups", "api": "api_groups", "weak": "weak_groups"}
SECTION_LETTERS = {"main": "g", "test": "t", "api": "a", "weak": "w"}
#: Lines of a template and of a member's source that the terminal shows, and findings of a side section. Fixed values.
TEMPLATE_LINES, SOURCE_LINES, SIDE_TOP = 12, 24, 3
#: Tiers and what their SARIF rules say.
RULES = {
    "inconsistent-update": "Some members of a known group were changed and others were not.",
    "exact-normalized": "Units that are equal once names and literals are normalised.",
    "internal-repeat": "A block of statements that follows itself several times in one unit.",
    "near-normalized": "Units that share a template with few holes.",
    "exact-region": "A run of tokens that parts of two units have in common.",
    "inline-assisted": "Units that are alike once helpers are expanded.",
    "api-profile": "Units that call the same rare names; a hint, never a failure.",
    "weak-similarity": "Units that are alike with more holes than a template may have; never a failure.",
}
_HINTS = ("api-profile", "weak-similarity")
_LAST = 1 << 62


@dataclass(frozen=True)
class Report:
    """findings: group_id, fingerprint, tier, section, rank, value, divergence, template, n_members, token_count, fails and
    primary (the place of the member that is named first). members: group_id, place (from 1), path, lang, name, line0,
    line1, degraded. files: path, content."""

    findings: DataFrame
    members: DataFrame
    files: DataFrame
    stats: dict


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _ordered(report: Report, sections: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Findings of the sections with section_no and id, and their members with the findings' place in the document."""
    number = F.try_element_at(_map({s: k for k, s in enumerate(sections)}), F.col("section"))
    groups = report.findings.withColumn("section_no", number.cast("long")).where("section_no is not null")
    groups = groups.withColumn("id", F.concat(F.element_at(_map(SECTION_LETTERS), F.col("section")), F.col("rank").cast("string")))
    return groups, report.members.join(groups.select("group_id", "section_no", "rank", "n_members", "primary"), "group_id")


def _shared(report: Report, verbose: bool) -> tuple[DataFrame, DataFrame]:
    """What formats of copied text hold: findings of two places or more that share text."""
    groups, members = _ordered(report, ("main", "test", *(("weak",) if verbose else ())))
    groups = groups.where((F.col("n_members") >= 2) & (F.col("tier") != "api-profile"))
    return groups, members.join(groups.select("group_id"), "group_id", "left_semi")


def _rows(df: DataFrame, part: int, text: Column, place: Column | None = None) -> DataFrame:
    return df.select(F.col("section_no").cast("long").alias("section_no"), F.col("rank").cast("long").alias("rank"), F.lit(part).alias("part"), (F.lit(0) if place is None else place).cast("long").alias("place"), text.alias("text"))


def _edge(spark: SparkSession, section_no: int, rank: int, text: str) -> DataFrame:
    return _rows(spark.range(1).select(F.lit(section_no).alias("section_no"), F.lit(rank).alias("rank")), 0, F.lit(text))


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _quoted(text: Column) -> Column:
    """The inside of a JSON string that holds text."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("t"))), r'(?s)^\{"t":"(.*)"\}$', 1)


def _open(value: Column) -> Column:
    """A JSON object without its last brace."""
    return F.regexp_replace(F.to_json(value), r"\}$", "")


def _comma(groups: DataFrame, also: Column | None = None) -> Column:
    """A comma before every row but those of the document's first finding."""
    first = groups.agg(F.min(F.struct("section_no", "rank")).alias("f")).first()["f"]
    if first is None:
        return F.lit("")
    is_first = (F.col("section_no") == first["section_no"]) & (F.col("rank") == first["rank"])
    return F.when(is_first if also is None else is_first & also, "").otherwise(",")


def _span() -> Column:
    return F.concat(F.col("name"), F.lit(" @ "), F.col("path"), F.lit(":"), F.col("line0").cast("string"), F.lit("-"), F.col("line1").cast("string"))


def _location() -> Column:
    start = F.greatest(F.col("line0"), F.lit(1))
    return F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(start.alias("startLine"), F.greatest(F.col("line1"), start).alias("endLine")).alias("region"))


def _source(members: DataFrame, files: DataFrame) -> DataFrame:
    """Add fragment: the member's lines, empty if its file is gone."""
    lines = F.split("content", "\r?\n")
    start = F.greatest(F.col("line0"), F.lit(1))
    text = F.array_join(F.slice(lines, start, F.greatest(F.col("line1") - start + 1, F.lit(0))), "\n")
    return members.join(files.select("path", "content"), "path", "left").withColumn("fragment", F.coalesce(text, F.lit(""))).drop("content")


def json_report(report: Report, verbose: bool = False) -> DataFrame:
    """All sections in full, with the statistics."""
    spark = report.findings.sparkSession
    groups, members = _ordered(report, tuple(SECTION_KEYS))
    head = _open(F.struct("id", "tier", "fingerprint", "token_count", "value", "divergence", "template"))
    member = F.to_json(F.struct(F.col("path").alias("file"), "lang", "name", F.array("line0", "line1").alias("line_span"), F.col("degraded").alias("parse_degraded")))
    parts = [
        _rows(groups, 1, F.concat(F.when(F.col("rank") > 1, ",").otherwise(""), head, F.lit(',"members":['))),
        _rows(members, 2, F.concat(F.when(F.col("place") > 1, ",").otherwise(""), member), F.col("place")),
        _rows(groups, 3, F.lit("]}")),
    ]
    for k, key in enumerate(SECTION_KEYS.values()):
        parts += [_edge(spark, k, 0, ("{" if k == 0 else "") + f'"{key}":['), _edge(spark, k, _LAST, "],")]
    return _all([*parts, _edge(spark, len(SECTION_KEYS), 0, f'"stats":{json.dumps(report.stats)}}}')])


def sarif(report: Report, verbose: bool = False, fingerprints: str = "structural") -> DataFrame:
    """One result for each finding: the primary member is its location, the others are related ones.

    fingerprints "line" leaves out the structural fingerprint; the level says nothing but what the gate does.
    """
    spark = report.findings.sparkSession
    groups, members = _ordered(report, ("main", "api", "test", *(("weak",) if verbose else ())))
    primary = members.where("place = primary").select("group_id", "path", "name", "line0", "line1")
    full = groups.join(primary, "group_id")
    level = F.when((F.col("section") != "main") | F.col("tier").isin(*_HINTS), "note").when(F.col("fails"), "error").otherwise("warning")
    extra = [c for c in ("kind",) if c in groups.columns]
    fields = [F.col("tier").alias("ruleId"), level.alias("level"), F.array(F.struct(_location().alias("physicalLocation"))).alias("locations")]
    fields.append(F.struct("tier", "section", "divergence", "value", F.col("token_count").alias("tokenCount"), *extra).alias("properties"))
    if fingerprints != "line":
        fields.append(F.struct(F.col("fingerprint").alias("structural/v1")).alias("partialFingerprints"))
    similar = F.when(F.col("divergence") > 0, F.concat(F.lit(", similarity "), F.round((1 - F.col("divergence")) * 100).cast("int").cast("string"), F.lit("%"))).otherwise("")
    # The wording is a fixed value.
    text = F.concat(F.lit("Duplicate group ("), F.col("n_members").cast("string"), F.lit(" members, tier `"), F.col("tier"), F.lit("`"), similar, F.lit("). Primary: "), _span(), F.lit("."))
    others = members.where("place <> primary").withColumn("id", F.col("place") - F.when(F.col("place") > F.col("primary"), 1).otherwise(0))
    link = F.concat(F.when(F.col("id") == 1, "Also: ").otherwise(""), F.lit("["), _quoted(_span()), F.lit("]("), F.col("id").cast("string"), F.lit(")"), F.when(F.col("id") == F.col("n_members") - 1, ".").otherwise(","))
    related = F.to_json(F.struct("id", _location().alias("physicalLocation"), F.struct(_span().alias("text")).alias("message")))
    template = F.coalesce(_quoted(F.concat(F.lit("\n\nShared template:\n"), F.col("template"))), F.lit(""))
    rules = [{"id": k, "name": "".join(w.title() for w in k.split("-")), "shortDescription": {"text": v}} for k, v in RULES.items()]
    driver = {"name": "twinsight", "version": "0.1.0", "rules": rules}
    top = f'{{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{{"tool":{{"driver":{json.dumps(driver)}}},"results":['
    return _all([
        _edge(spark, -1, 0, top),
        _rows(full, 1, F.concat(_comma(full), _open(F.struct(*fields)), F.lit(',"message":{"text":"'), _quoted(text))),
        _rows(others, 2, link, F.col("id")),
        _rows(full, 3, F.concat(template, F.lit('"},"relatedLocations":['))),
        _rows(others, 4, F.concat(F.when(F.col("id") > 1, ",").otherwise(""), related), F.col("id")),
        _rows(full, 5, F.lit("]}")),
        _edge(spark, 99, 0, "]}]}"),
    ])


def cpd(report: Report, verbose: bool = False) -> DataFrame:
    """One duplication element for each finding of two places or more, with the first member's lines."""
    spark = report.findings.sparkSession
    groups, members = _shared(report, verbose)
    first = _source(members.where("place = 1").select("group_id", "path", "line0", "line1"), report.files)
    full = groups.join(first, "group_id")
    head = F.concat(F.lit('<duplication lines="'), (F.greatest(F.col("line1") - F.col("line0"), F.lit(0)) + 1).cast("string"), F.lit('" tokens="'), F.col("token_count").cast("string"), F.lit('">'))
    place = F.concat(F.lit('<file line="'), F.col("line0").cast("string"), F.lit('" endline="'), F.col("line1").cast("string"), F.lit('" path="'), xml_escape(F.col("path")), F.lit('"/>'))
    return _all([
        _edge(spark, -1, 0, '<?xml version="1.0" encoding="UTF-8"?>\n<pmd-cpd>'),
        _rows(full, 1, head),
        _rows(members, 2, place, F.col("place")),
        _rows(full, 3, F.concat(F.lit("<codefragment><![CDATA["), cdata_escape(F.col("fragment")), F.lit("]]></codefragment>\n</duplication>"))),
        _edge(spark, 99, 0, "</pmd-cpd>"),
    ])


def jscpd(report: Report, verbose: bool = False) -> DataFrame:
    """Each finding as pairs of its first member with each other one, after the statistics."""
    spark = report.findings.sparkSession
    groups, members = _shared(report, verbose)
    first = _source(members.where("place = 1").select("group_id", "path", "line0", "line1", "lang"), report.files)
    first = first.select("group_id", "lang", "fragment", (F.greatest(F.col("line1") - F.col("line0"), F.lit(0)) + 1).alias("lines"), _jscpd_file().alias("firstFile"))
    pairs = members.where("place > 1").select("group_id", "section_no", "rank", "place", _jscpd_file().alias("secondFile")).join(first, "group_id").join(groups.select("group_id", F.col("token_count").alias("tokens")), "group_id")
    pair = F.to_json(F.struct(F.col("lang").alias("format"), "lines", "tokens", "fragment", "firstFile", "secondFile"))
    s = report.stats
    clones = groups.agg(F.sum(F.col("n_members") - 1).alias("n")).first()["n"] or 0
    total = {"lines": s["total_lines"], "sources": s["files_scanned"], "clones": clones, "duplicatedLines": s["duplicated_lines"], "percentage": round(s["duplicated_lines_pct"], 2), "duplicatedTokens": s["duplicated_tokens"], "tokensPercentage": round(s["duplicated_tokens_pct"], 2)}
    top = _edge(spark, -1, 0, f'{{"statistics":{{"total":{json.dumps(total)}}},"duplicates":[')
    return _all([top, _rows(pairs, 1, F.concat(_comma(groups, F.col("place") == 2), pair), F.col("place")), _edge(spark, 99, 0, "]}")])


def _jscpd_file() -> Column:
    at = lambda c: F.struct(F.col(c).alias("line"), F.lit(1).alias("column"), F.col(c).alias("position"))
    return F.struct(F.col("path").alias("name"), F.col("line0").alias("start"), F.col("line1").alias("end"), at("line0").alias("startLoc"), at("line1").alias("endLoc"))


def terminal(report: Report, verbose: bool = False, top: int = 20) -> DataFrame:
    """Counters, then the top findings of each section, 0 for all; weak ones, and members' source, only if verbose."""
    spark, s = report.findings.sparkSession, report.stats
    shown = ("main", "test", "api", *(("weak",) if verbose else ()))
    limit = {k: top if k == "main" or verbose else SIDE_TOP for k in shown}
    groups, members = _ordered(report, shown)
    sizes = {r["section"]: r["count"] for r in groups.groupBy("section").count().collect()}
    cap = F.element_at(_map(limit), F.col("section"))
    groups = groups.where((cap == 0) | (F.col("rank") <= cap))
    members = members.join(groups.select("group_id"), "group_id", "left_semi")
    tiers = ", ".join(f"{k}: {n}" for k, n in sorted(s["findings_by_tier"].items())) or "none"
    top_line = f"{s['files_scanned']} files, {s['units_indexed']} units ({s['units_below_floor']} below floor, {s['parse_degraded_units']} parse-degraded, {s['test_units']} in tests), findings [{tiers}]"
    parts = [_edge(spark, -1, 0, top_line)]
    for k, name in enumerate(shown):
        n, most = sizes.get(name, 0), limit[name]
        if name == "main" and not n:
            parts.append(_edge(spark, k, 0, "\nno duplicate groups found"))
        elif name != "main" and n:
            parts.append(_edge(spark, k, 0, f"\n-- {name} ({n} groups; never fails the gate) --"))
        if most and n > most:
            parts.append(_edge(spark, k, _LAST, f"\n… and {n - most} more groups"))
    kind = F.concat(F.col("kind"), F.lit(" ")) if "kind" in groups.columns else F.lit("")
    head = F.concat(F.lit("\n"), F.col("id"), F.lit(" "), kind, F.col("tier"), F.format_string("  value %.1f  tokens %d  members %d  similarity %.0f%%", F.col("value"), F.col("token_count"), F.col("n_members"), (1 - F.col("divergence")) * 100))
    line = F.concat(F.lit("  "), F.col("path"), F.lit(":"), F.col("line0").cast("string"), F.lit("-"), F.col("line1").cast("string"), F.lit("  "), F.col("name"), F.when(F.col("degraded"), "  (parse-degraded)").otherwise(""))
    if verbose:
        members = _source(members, report.files)
        line = F.concat(line, F.lit("\n"), _capped(F.col("fragment"), SOURCE_LINES, "      "))
    parts += [_rows(groups, 1, head), _rows(members, 2, line, F.col("place")), _rows(groups.where("template is not null"), 3, _capped(F.col("template"), TEMPLATE_LINES, "    | "))]
    return _all(parts)


def _capped(text: Column, most: int, indent: str) -> Column:
    lines = F.split(text, "\n")
    more = F.when(F.size(lines) > most, F.concat(F.lit(f"\n{indent}… "), (F.size(lines) - most).cast("string"), F.lit(" more lines"))).otherwise("")
    return F.concat(F.array_join(F.transform(F.slice(lines, 1, most), lambda x: F.concat(F.lit(indent), x)), "\n"), more)


FORMATS = {"terminal": terminal, "json": json_report, "sarif": sarif, "cpd": cpd, "jscpd": jscpd}


def stream(fragments: DataFrame, fmt: str) -> Iterator[str]:
    """The document piece by piece; the driver holds one partition at a time."""
    for k, row in enumerate(fragments.orderBy(*ORDER).select("text").toLocalIterator()):
        yield (SEPARATOR[fmt] if k else "") + row["text"]
    yield "\n"


def save(fragments: DataFrame, fmt: str, path: str) -> None:
    """The document as files of a folder; in the order of their names they are the whole."""
    fragments.orderBy(*ORDER).select("text").write.option("lineSep", SEPARATOR[fmt]).text(path)
