"""Check of a working tree against a git ref: its findings then and now, and what the change did to them."""

from __future__ import annotations

import hashlib
import subprocess
import tarfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, FAIL_RANK, Thresholds
from ..sources.files import read_files
from ..sinks.documents import Report
from . import drift, findings
from .graph import checkpoint_folder, cut
from .report import statistics
from .scan import extract, scan_units

#: Changes when findings of equal files may change; earlier states are not read then.
SCHEME = 1
#: Tiers of earlier groups whose members ought to change together. Fixed values.
TOGETHER = ("exact-normalized", "near-normalized", "inline-assisted", "exact-region")
#: Kinds of findings in the order of a report.
KINDS = ("inconsistent-update", "new", "worsened", "drifting")


def _git(root: str, *arguments: str) -> str:
    done = subprocess.run(["git", "-C", root, *arguments], capture_output=True, text=True, errors="replace")
    if done.returncode:
        raise ValueError(f"git {arguments[0]}: {done.stderr.strip()}")
    return done.stdout


def _exists(spark: SparkSession, uri: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def base_checkout(spark: SparkSession, root: str, ref: str) -> str:
    """The address of a folder with the files of ref, below the shared folder; written once for each commit.

    An archive of the commit is read as a stream and put down file by file; links and other odd entries are left out.
    """
    from pyarrow import fs

    sha = _git(root, "rev-parse", "--verify", f"{ref}^{{commit}}").strip()
    prefix = _git(root, "rev-parse", "--show-prefix").strip()
    place = hashlib.md5(f"{_git(root, 'rev-parse', '--show-toplevel')}{prefix}".encode()).hexdigest()[:12]
    folder = f"{checkpoint_folder(spark)}/base-{sha}-{place}"
    if _exists(spark, f"{folder}/_DONE"):
        return f"{folder}/tree"
    system, path = fs.FileSystem.from_uri(folder)
    with subprocess.Popen(["git", "-C", root, "archive", "--format=tar", sha], stdout=subprocess.PIPE) as git, tarfile.open(fileobj=git.stdout, mode="r|") as entries:
        system.create_dir(f"{path}/tree", recursive=True)
        for entry in entries:
            if not entry.isfile() or ".." in entry.name.split("/"):
                continue
            name = f"{path}/tree/{entry.name}"
            system.create_dir(name.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(name) as out:
                data = entries.extractfile(entry)
                while part := data.read(1 << 20):
                    out.write(part)
        while git.stdout.read(1 << 20):
            pass  # padding after the archive's end; git fails if nobody reads it
    if git.returncode:
        raise ValueError(f"git archive of {ref} failed with code {git.returncode}")
    with system.open_output_stream(f"{path}/_DONE") as out:
        out.write(b"")
    return f"{folder}/tree"


def base_state(spark: SparkSession, root: str, ref: str, t: Thresholds = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Findings and members of ref: a table for each commit, thresholds and SCHEME, made when first asked for."""
    tree = base_checkout(spark, root, ref)
    key = hashlib.md5(f"{SCHEME} {t!r}".encode()).hexdigest()[:12]
    folder = f"{tree.rsplit('/', 1)[0]}/state-{key}"
    if not _exists(spark, f"{folder}/members/_SUCCESS"):
        found, members = scan_units(cut(extract(read_files(spark, tree, t=t))), t)
        found.write.mode("overwrite").parquet(f"{folder}/findings")
        members.write.mode("overwrite").parquet(f"{folder}/members")
    return spark.read.parquet(f"{folder}/findings"), spark.read.parquet(f"{folder}/members")


def hunks_of(spark: SparkSession, root: str, ref: str) -> DataFrame:
    """Places of the working tree's tracked files that differ from ref."""
    text = _git(root, "-c", "core.quotePath=false", "diff", "--relative", "--no-color", "--no-ext-diff", "--src-prefix=a/", "--dst-prefix=b/", "-U0", ref, "--", ".")
    return drift.parse_diff(spark.createDataFrame([(text,)], "diff string"))


def classify(now: tuple[DataFrame, DataFrame], base: tuple[DataFrame, DataFrame], units: DataFrame, hunks: DataFrame, t: Thresholds = DEFAULT, fail_on: str = "exact-normalized") -> DataFrame:
    """fingerprint, tier, kind, fail_rank, fails, n_members, n_touched, was, now, value, token_count, template and rank.

    now and base are findings and members of main sections; units are those of now (unit_id, path, name, line0, line1,
    accept_drift). inconsistent-update: an earlier group of which the change touched some members and not all, each found
    again by name or place; it informs only if all touched ones accept drift, or if it is a region. new: no earlier
    group, and touched. worsened: touched, and members or divergence grew, unless the first kind has it already and no
    member came. drifting: untouched, and divergence grew.
    """
    mine, theirs = (f.where("section = 'main'") for f, _ in (now, base))
    my_members, their_members = (m.join(f.select("group_id", "fingerprint"), "group_id") for (_, m), f in ((now, mine), (base, theirs)))
    # What became of earlier members.
    old = their_members.join(theirs.where(F.col("tier").isin(*TOGETHER) & (F.col("n_members") >= 2)).select("group_id", "tier"), "group_id")
    old = cut(old.select("fingerprint", "tier", F.col("unit_id").alias("old_unit"), F.col("path").alias("file"), "name", "line0", "line1"))
    places = old.select(F.xxhash64("file", "name", "line0", "line1").alias("member_id"), "file", "name", "line0", "line1").distinct()
    own = units.select("unit_id", F.col("path").alias("file"), "name", "line0", "line1", "accept_drift")
    mapped = drift.map_members(places, own).join(own.select("unit_id", F.col("line0").alias("now0"), F.col("line1").alias("now1"), "accept_drift"), "unit_id", "left")
    region = F.col("tier") == "exact-region"
    old = old.withColumn("member_id", F.xxhash64("file", "name", "line0", "line1")).join(mapped.select("member_id", "now0", "now1", "accept_drift"), "member_id")
    old = cut(old.withColumns({"at0": F.when(region, F.col("line0")).otherwise(F.col("now0")), "at1": F.when(region, F.col("line1")).otherwise(F.col("now1"))}))
    hit = (F.col("m.file") == F.col("h.file")) & F.expr("m.at0 is null or h.l0 is null or (h.l0 <= m.at1 and m.at0 <= h.l1)")
    hits = old.alias("m").join(hunks.alias("h"), hit, "left_semi").groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n_touched"), F.min(F.coalesce("accept_drift", F.lit(False))).alias("accepted"))
    uneven = old.groupBy("fingerprint", "tier").agg(F.count(F.lit(1)).alias("n_members")).join(hits, "fingerprint").where("n_touched < n_members")
    # Groups as they are now.
    counts = drift.counted(my_members.withColumn("file", F.col("path")), hunks)
    current = cut(mine.select("fingerprint", "tier", "divergence", "value", "token_count", "template").join(counts, "fingerprint"))
    before = cut(theirs.select("fingerprint", F.col("n_members").alias("n_before"), F.col("divergence").alias("was"), F.col("value").alias("base_value"), F.col("token_count").alias("base_tokens"), F.col("template").alias("base_template")))
    uneven = cut(uneven.join(before, "fingerprint").join(current.select("fingerprint", F.col("divergence").alias("now")), "fingerprint", "left"))
    drifted = F.round(F.col("divergence") - F.col("was"), 6) > t.drift_epsilon
    came = F.col("n_members") > F.col("n_before")
    both = current.join(before, "fingerprint", "left").join(uneven.select("fingerprint", F.lit(True).alias("told")), "fingerprint", "left").withColumn("told", F.coalesce("told", F.lit(False)))
    kind = F.when(F.col("n_before").isNull(), F.when(F.col("n_touched") > 0, "new"))
    kind = kind.when(F.col("n_touched") > 0, F.when(came | (drifted & ~F.col("told")), "worsened")).when(drifted & ~F.col("told"), "drifting")
    columns = ["fingerprint", "tier", "kind", "gate", "accepted", "n_members", "n_touched", "was", "now", "value", "token_count", "template"]
    told = uneven.withColumns({"kind": F.lit("inconsistent-update"), "gate": F.lit("inconsistent-update"), "accepted": F.col("accepted") | region, "value": F.col("base_value"), "token_count": F.col("base_tokens"), "template": F.col("base_template"), "now": F.coalesce("now", "was")})
    rest = both.withColumns({"kind": kind, "now": F.col("divergence")}).where("kind is not null").withColumns({"gate": F.col("tier"), "accepted": F.col("kind") == "drifting"})
    out = findings.gate(told.select(columns).unionByName(rest.select(columns)).withColumnRenamed("tier", "own_tier").withColumnRenamed("gate", "tier"), fail_on)
    out = out.withColumn("fails", F.col("fails") & ~F.col("accepted")).drop("tier").withColumnRenamed("own_tier", "tier")
    last = F.lit(len(FAIL_RANK))
    out = out.withColumns({"fail_rank": F.coalesce("fail_rank", last), "section": F.lit("main")}).drop("accepted")
    return findings.numbered(out, ["section"], [F.asc("fail_rank"), F.desc(F.floor(F.col("value") * 1000)), F.asc("fingerprint"), F.asc("kind")], "rank")


def located(out: DataFrame, now: tuple[DataFrame, DataFrame], base: tuple[DataFrame, DataFrame], hunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings and members of a report: earlier members of the first kind, present ones of the others; a touched one leads."""
    uneven = F.col("kind") == "inconsistent-update"

    def of(state: tuple[DataFrame, DataFrame], which) -> DataFrame:
        keys = state[0].where("section = 'main'").select("group_id", "fingerprint")
        return state[1].join(keys, "group_id").drop("group_id").join(out.where(which).select("fingerprint", "kind"), "fingerprint")

    group = F.concat("kind", F.lit("-"), "fingerprint").alias("group_id")
    members = of(base, uneven).unionByName(of(now, ~uneven)).select(group, "path", "lang", "name", "line0", "line1", "degraded")
    members = cut(findings.numbered(members, ["group_id"], [F.asc("path"), F.asc("line0"), F.asc("line1"), F.asc("name")], "place"))
    first = drift.touched(members.withColumn("file", F.col("path")), hunks).groupBy("group_id").agg(F.min("place").alias("primary"))
    rows = out.withColumn("divergence", F.col("now")).select("*", group).join(first, "group_id", "left")
    return rows.withColumn("primary", F.coalesce("primary", F.lit(1)).cast("long")), members


def check(spark: SparkSession, root: str, ref: str, fail_on: str = "exact-normalized", t: Thresholds = DEFAULT) -> tuple[Report, dict]:
    """A report of the change since ref, and counters; exit_code is 1 if any finding fails and 0 else."""
    if fail_on != "none" and fail_on not in FAIL_RANK:
        raise ValueError(f"fail_on must be none or one of {', '.join(FAIL_RANK)}")
    base = base_state(spark, root, ref, t)
    files = cut(read_files(spark, root, t=t))
    units = cut(extract(files))
    now = tuple(map(cut, scan_units(units, t)))
    hunks = cut(hunks_of(spark, root, ref))
    out = cut(classify(now, base, units, hunks, t, fail_on))
    row = out.agg(F.count(F.lit(1)).alias("findings"), F.count_if("fails").alias("failing")).first()
    matched = now[0].where("section = 'main'").join(base[0].where("section = 'main'").select("fingerprint"), "fingerprint", "left_semi").join(out.where("kind <> 'inconsistent-update'").select("fingerprint"), "fingerprint", "left_anti").count()
    rows, members = located(out, now, base, hunks)
    return Report(cut(rows), members, files, statistics(files, units, *now, t)), {"findings": row["findings"], "failing": row["failing"], "exempt": matched, "exit_code": int(row["failing"] > 0)}
