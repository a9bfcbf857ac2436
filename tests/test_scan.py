import pytest

from twinsight.operators.scan import scan
from twinsight.sources.files import glob_regex, read_files

BASE = """def route(parcels, depot):
    lanes = {}
    for parcel in parcels:
        zone = parcel.zone % 10 + depot
        if zone in lanes:
            lanes[zone].append(parcel.label)
        else:
            lanes[zone] = [parcel.label]
            announce(zone, parcel.due)
    return lanes
"""


@pytest.fixture
def repo(tmp_path):
    put = lambda name, text: ((tmp_path / name).parent.mkdir(parents=True, exist_ok=True), (tmp_path / name).write_text(text))
    put("src/a.py", BASE)
    put("other/b.py", BASE.replace("parcel", "box").replace("% 10", "% 7"))
    put("src/c.py", BASE.replace("route", "near").replace("parcel.zone % 10 + depot", "parcel.zone % 10 + depot - parcel.floor"))
    put("src/gen.py", "# @generated\n" + BASE)
    put("src/generated/g.py", BASE)
    put(".hidden/h.py", BASE)
    put("build/i.py", BASE)
    put("src/notes.txt", BASE)
    put("src/far.py", "def far(x):\n    return x\n")
    (tmp_path / "src/bad.py").write_bytes(b"\xff\xfe\x00")
    return tmp_path


def test_files_are_filtered(spark, repo):
    rows = read_files(spark, str(repo), ignore=("build/", "# note")).collect()
    assert sorted((r["path"], r["dir"], r["lang"]) for r in rows) == [("other/b.py", "other", "python"), ("src/a.py", "src", "python"), ("src/c.py", "src", "python"), ("src/far.py", "src", "python")]
    with pytest.raises(Exception):
        read_files(spark, str(repo / "none")).count()


def test_scan_finds_exact_and_near_groups(spark, repo):
    ranked, members = scan(read_files(spark, str(repo), ignore=("build/",)))
    groups = {r["tier"]: r for r in ranked.collect()}
    assert set(groups) == {"exact-normalized", "near-normalized"}
    assert groups["exact-normalized"]["n_members"] == groups["near-normalized"]["n_members"] == 2
    assert "⟨h1⟩" in groups["near-normalized"]["template"] and 0 < groups["near-normalized"]["divergence"] <= 0.18
    paths = {r["path"] for r in members.collect() if r["group_id"] == groups["exact-normalized"]["group_id"]}
    assert paths == {"src/a.py", "other/b.py"}


def test_files_without_a_profile_are_an_error(spark, repo):
    (repo / "src/d.go").write_text("package d\n")
    files = read_files(spark, str(repo), ignore=("build/",))
    with pytest.raises(ValueError, match="1 go file"):
        scan(files)


@pytest.mark.parametrize("pattern, path, hit", [("*.pb.go", "a/b.pb.go", True), ("**/generated/**", "generated/x.py", True), ("**/generated/**", "a/generated/b/x.py", True), ("build/", "build/x", True), ("a/*.py", "a/b/c.py", False), ("a/*.py", "a/c.py", True)])
def test_globs(pattern, path, hit):
    import re

    assert bool(re.match(glob_regex(pattern), path)) is hit
