import pytest

from twinsight.functions.anti_unify import anti_unify
from twinsight.functions.python_profile import units_of


def fps(*sources):
    return [units_of(s)[0].fp for s in sources]


def same(a, b):
    x, y = fps(a, b)
    return x == y


BASE = "def route(parcels, depot):\n    lanes = {}\n    for parcel in parcels:\n        zone = parcel.zone % 10 + depot\n        if zone in lanes:\n            lanes[zone].append(parcel.label)\n        else:\n            lanes[zone] = [parcel.label]\n            announce(zone)\n    return lanes\n"


@pytest.mark.parametrize("other", [
    BASE.replace("    ", "  "),
    "# note\n" + BASE.replace("lanes = {}", "lanes = {}  # by zone"),
    BASE.replace("parcels", "boxes").replace("parcel", "box").replace("lanes", "bins").replace("zone =", "place =").replace("if zone", "if place").replace("[zone]", "[place]").replace("(zone)", "(place)"),
    BASE.replace("% 10", "% 7"),
    BASE.replace("parcel.zone % 10 + depot", "depot + parcel.zone % 10"),
    BASE.replace("for parcel in parcels:", "for k in range(len(parcels)):").replace("parcel.", "parcels[k]."),
    BASE.replace("            announce(zone)\n", "            announce(zone)\n            pass\n"),
])
def test_equal_behaviour_converges(other):
    assert same(BASE, other)


@pytest.mark.parametrize("old, new", [("lanes = {}", "lanes = {0: []}"), ("announce(", "skip("), (" in lanes", " not in lanes"), (".label", ".weight"), ("    return lanes", "    done()\n    return lanes")])
def test_other_behaviour_differs(old, new):
    assert not same(BASE, BASE.replace(old, new))


@pytest.mark.parametrize("a, b", [
    ("g(a, key=1)", "g(a, other=1)"), ("g(a, True)", "g(a, False)"), ("a[1:]", "a[:1]"), ("f'{a!r}'", "f'{a!s}'"), ("g(a, *a)", "g(a, **a)"), ("lambda x, *y: x", "lambda x, **y: x"), ("lambda x, *, y=1: x", "lambda x, *, z=1: x"),
])
def test_other_expressions_differ(a, b):
    assert not same(f"def f(a):\n    return {a}\n", f"def f(a):\n    return {b}\n")


def test_other_declarations_differ():
    assert not same("def f():\n    global q\n    q = 1\n", "def f():\n    global z\n    z = 1\n")
    assert not same("def f(a=h):\n    return a\n", "def f(a=5):\n    return a\n") and not same("def f(a=5):\n    return a\n", "def f(a):\n    return a\n")


def test_deep_trees_are_opaque_units():
    deep = lambda n, op: f"def f(a):\n    return {f' {op} '.join(['a'] * n)}\n\ndef g(a):\n    return a\n"
    got = [units_of(deep(1000, op)) for op in "+-"]
    assert [[u.name for u in us] for us in got] == [["f", "g"]] * 2 and got[0][0].degraded and not got[0][1].degraded
    assert got[0][0].fp != got[1][0].fp and got[0][0].fp == units_of(deep(1000, "+"))[0].fp


LOOP = "def gcd_log(a, b, seen):\n    while b != 0:\n        seen.append((a, b))\n        a, b = b, a % b\n    return a\n"
TAIL = "def gcd_log(a, b, seen):\n    if b == 0:\n        return a\n    seen.append((a, b))\n    return gcd_log(b, a % b, seen)\n"
TREE = "def gcd_log(a, b, seen):\n    if b == 0:\n        return a\n    seen.append((a, b))\n    x = gcd_log(b, a % b, seen)\n    return max(x, gcd_log(b % 3, a, seen))\n"


def test_tail_recursion_is_a_loop_and_tree_recursion_is_not():
    assert same(LOOP, TAIL)
    assert not same(LOOP, TREE)


def test_unrolled_statements_fold():
    unrolled = "def f(w):\n    w.put('a', 3)\n    w.put('b', 4)\n    w.put('c', 5)\n    return w\n"
    more = unrolled.replace("    return w", "    w.put('d', 6)\n    return w")
    assert same(unrolled, more)
    assert units_of(unrolled)[0].repeats[0][0] == 3


def test_units_carry_lines_tests_and_pragmas():
    source = "class A:\n    def m(self):\n        def inner():\n            return 1\n        return inner\n\n# tool:ignore\ndef gone():\n    pass\n\n# tool:accept-drift\n@wraps\ndef test_x():\n    pass\n"
    got = [(u.name, u.line0, u.line1, u.is_test, u.accept_drift) for u in units_of(source, "pkg/a.py")]
    assert got == [("m", 2, 5, False, False), ("inner", 3, 4, False, False), ("test_x", 13, 14, True, True)]
    assert all(u.is_test for u in units_of(source, "tests/a.py"))


def test_broken_files_give_degraded_units():
    got = units_of("def ok(a):\n    return a\n\ndef broken(a)\n    if a:\n        return 1\n    return (\n")
    assert [u.name for u in got] == ["ok", "broken"] and all(u.degraded for u in got)
    assert units_of("") == []


def test_near_pair_has_a_small_hole():
    a, b = units_of(BASE)[0].tree, units_of(BASE.replace("announce(zone)", "announce(zone, parcel.extra)"))[0].tree
    r = anti_unify(a, b)
    assert 0 < r.divergence <= 0.18 and r.holes >= 1
