"""Whole documents of a scan, and the check of a change."""

import io
import json
import subprocess
import xml.etree.ElementTree as ET

import pytest

from pyspark.sql import functions as F

from twinsight.__main__ import arguments, run
from twinsight.operators import findings
from twinsight.operators.check import check
from twinsight.operators.report import report
from twinsight.sinks.documents import FORMATS, save, stream
from twinsight.sources.files import read_files

BASE = '''def invoice(entries, rebate):
    total = {"net": 0, "<&>]]>": ""}
    for entry in entries:
        amount = entry.price * entry.count - rebate
        if amount > entry.limit:
            total["net"] += entry.limit
            flag(entry.key, amount)
        else:
            total["net"] += amount
            store(entry.key, amount)
    return total
'''
NEAR = BASE.replace("invoice", "bill").replace("entry.price * entry.count", "entry.price * entry.count * entry.rate")


def put(root, name, text):
    (root / name).parent.mkdir(parents=True, exist_ok=True)
    (root / name).write_text(text)


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    put(root, "a/one.py", BASE)
    put(root, "b/it's.py", BASE.replace("invoice", "other").replace("rebate", "cut"))
    put(root, "c/three.py", BASE.replace("entry", "e"))
    put(root, "d/near.py", NEAR)
    put(root, "tests/t1.py", BASE.replace("- rebate", "+ rebate % 3 // 4 - abs(rebate)").replace("flag", "wave"))
    put(root, "tests/t2.py", BASE.replace("- rebate", "+ rebate % 3 // 4 - abs(rebate)").replace("flag", "wave"))
    return root


def text(found, fmt, **options):
    return "".join(stream(FORMATS[fmt](found, **options), fmt))


def test_documents(spark, tree, tmp_path):
    found = report(read_files(spark, str(tree)))
    rows = {(r["section"], r["tier"]): r for r in found.findings.collect()}
    exact = rows["main", "exact-normalized"]
    assert exact["n_members"] == 3 and ("test", "exact-normalized") in rows

    doc = json.loads(text(found, "json"))
    assert {len(g["members"]) for g in doc["groups"] if g["tier"] == "exact-normalized"} == {3}
    assert [m["file"] for m in doc["test_groups"][0]["members"]] == ["tests/t1.py", "tests/t2.py"] and doc["test_groups"][0]["id"] == "t1"
    assert doc["stats"]["files_scanned"] == 6 and doc["stats"]["total_lines"] == 66 and 0 < doc["stats"]["duplicated_lines"] <= 66

    log = json.loads(text(found, "sarif"))
    assert log["version"] == "2.1.0" and log["runs"][0]["tool"]["driver"]["rules"]
    results = log["runs"][0]["results"]
    assert len(results) == len(rows)
    one = next(r for r in results if r["ruleId"] == "exact-normalized" and r["properties"]["section"] == "main")
    assert one["level"] == "error" and [x["id"] for x in one["relatedLocations"]] == [1, 2] and one["partialFingerprints"] == {"structural/v1": exact["fingerprint"]}
    assert one["message"]["text"].startswith("Duplicate group (3 members, tier `exact-normalized`). Primary: invoice @ a/one.py:1-11. Also: [other @ b/it's.py:1-11](1), [invoice @ c/three.py:1-11](2).")
    assert {r["level"] for r in results if r["properties"]["section"] == "test"} == {"note"}
    assert all("partialFingerprints" not in r for r in json.loads(text(found, "sarif", fingerprints="line"))["runs"][0]["results"])

    pmd = ET.fromstring(text(found, "cpd"))
    triple = next(d for d in pmd if len(d.findall("file")) == 3)
    assert [f.get("path") for f in triple.findall("file")] == ["a/one.py", "b/it's.py", "c/three.py"] and triple.get("lines") == "11"
    assert triple.find("codefragment").text == BASE.rstrip("\n")

    pairs = json.loads(text(found, "jscpd"))
    assert pairs["statistics"]["total"]["clones"] == len(pairs["duplicates"]) == sum(r["n_members"] - 1 for r in rows.values())
    assert pairs["duplicates"][0]["format"] == "python" and "def " in pairs["duplicates"][0]["fragment"]

    shown = text(found, "terminal", top=1)
    assert "g1 exact-normalized" in shown and "-- test (1 groups" in shown and "a/one.py:1-11  invoice" in shown
    assert "      def invoice(entries, rebate):" in text(found, "terminal", verbose=True)

    save(FORMATS["json"](found), "json", str(tmp_path / "saved"))
    assert json.loads("".join(p.read_text() for p in sorted((tmp_path / "saved").glob("part-*")))) == doc


def test_documents_without_findings(spark, tmp_path):
    put(tmp_path / "tree", "a.py", "def f(x):\n    return x\n")
    found = report(read_files(spark, str(tmp_path / "tree")))
    assert json.loads(text(found, "json"))["groups"] == json.loads(text(found, "sarif"))["runs"][0]["results"] == json.loads(text(found, "jscpd"))["duplicates"] == []
    assert len(ET.fromstring(text(found, "cpd"))) == 0 and "no duplicate groups found" in text(found, "terminal")


def test_numbers_of_a_group_over_many_ranges(spark):
    rows = spark.range(1000).selectExpr("if(id < 900, 'a', 'b') AS k", "id * 7919 % 1000 AS v").repartition(7)
    got = findings.numbered(rows, ["k"], [F.desc("v")], "n").collect()
    for k in "ab":
        own = sorted((r for r in got if r["k"] == k), key=lambda r: -r["v"])
        assert [r["n"] for r in own] == list(range(1, len(own) + 1))


def git(root, *words):
    subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@example.com", *words], check=True, capture_output=True)


def test_check_of_a_change(spark, tree):
    git(tree, "init", "-q")
    git(tree, "add", "-A")
    git(tree, "commit", "-qm", "first")
    found, counters = check(spark, str(tree), "HEAD")
    assert counters["findings"] == counters["failing"] == counters["exit_code"] == 0 and counters["exempt"] >= 1

    put(tree, "c/three.py", BASE.replace("entry", "e").replace("store(", "keep("))
    found, counters = check(spark, str(tree), "HEAD")
    uneven = next(r for r in found.findings.collect() if r["kind"] == "inconsistent-update" and r["tier"] == "exact-normalized")
    assert (uneven["n_members"], uneven["n_touched"], uneven["fails"], uneven["primary"]) == (3, 1, True, 3) and counters["exit_code"] == 1
    log = json.loads(text(found, "sarif"))["runs"][0]["results"]
    assert log[0]["properties"]["kind"] == "inconsistent-update" and log[0]["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] == "c/three.py"

    put(tree, "c/three.py", "# twinsight:accept-drift\n" + BASE.replace("entry", "e").replace("store(", "keep("))
    rows = [r for r in check(spark, str(tree), "HEAD")[0].findings.collect() if r["kind"] == "inconsistent-update" and r["tier"] == "exact-normalized"]
    assert len(rows) == 1 and not rows[0]["fails"]

    put(tree, "c/three.py", BASE.replace("entry", "e"))
    put(tree, "e/four.py", BASE)
    git(tree, "add", "-A")
    rows = {r["kind"]: r for r in check(spark, str(tree), "HEAD")[0].findings.where("tier = 'exact-normalized'").collect()}
    assert rows["worsened"]["n_members"] == 4 and rows["worsened"]["fails"]
    with pytest.raises(ValueError, match="git"):
        check(spark, str(tree), "no-such-ref")
    with pytest.raises(ValueError, match="fail_on"):
        check(spark, str(tree), "HEAD", "sometimes")


def test_command_line(spark, tree):
    out = io.StringIO()
    assert run(arguments(["scan", str(tree), "--format", "json"]), spark, out) == 0
    assert json.loads(out.getvalue())["groups"]
    with pytest.raises(SystemExit) as stop:
        arguments(["scan", str(tree), "--format", "pdf"])
    assert stop.value.code == 2
