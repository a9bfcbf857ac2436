"""Python source as comparison units: every function becomes a canonical tree in which equal behaviour looks equal.

Rewrites run on the syntax tree in a fixed order: tail recursion to loops, index loops to element loops, loops to one
core form, exits of a last loop to returns. Then names become places of first use, literals kinds, operands of
commutative operators are sorted, dead statements go, and runs of equal statements fold into one.
"""

from __future__ import annotations

import ast
import copy
import hashlib
import re
import textwrap
from dataclasses import dataclass

from .anti_unify import Tree, fingerprint

#: Literals that keep their value. Fixed values.
KEEP = ("0", "1", "-1", "''")
#: Operators whose operands may change places. Fixed values.
COMMUTATIVE = ("Add", "Mult", "BitAnd", "BitOr", "BitXor", "Eq", "NotEq", "And", "Or")
MAX_PERIOD = 8
_NEGATED = {ast.Eq: ast.NotEq, ast.NotEq: ast.Eq, ast.Lt: ast.GtE, ast.GtE: ast.Lt, ast.Gt: ast.LtE, ast.LtE: ast.Gt, ast.Is: ast.IsNot, ast.IsNot: ast.Is, ast.In: ast.NotIn, ast.NotIn: ast.In}
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_LISTS = ("Module", "body", "orelse", "finalbody")


@dataclass
class Unit:
    name: str
    line0: int
    line1: int
    tree: Tree
    tokens: int
    degraded: bool
    is_test: bool
    accept_drift: bool
    repeats: list[tuple[int, int]]

    @property
    def fp(self) -> str:
        return fingerprint(self.tree)


def negated(test: ast.expr) -> ast.expr:
    if isinstance(test, ast.UnaryOp) and isinstance(test.op, ast.Not):
        return test.operand
    if isinstance(test, ast.Compare) and len(test.ops) == 1 and type(test.ops[0]) in _NEGATED:
        return ast.Compare(test.left, [_NEGATED[type(test.ops[0])]()], test.comparators)
    return ast.UnaryOp(ast.Not(), test)


def calls_to(node: ast.AST, name: str) -> int:
    return sum(isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id == name for n in ast.walk(node))


def tail_recursion_to_loop(f: ast.FunctionDef) -> ast.FunctionDef:
    """Only where every parameter is plain and every call of the function to itself is a returned one."""
    a = f.args
    if a.vararg or a.kwarg or a.kwonlyargs or a.defaults or a.posonlyargs or not a.args:
        return f
    names, tails = [x.arg for x in a.args], 0

    def rewrite(body: list[ast.stmt]) -> list[ast.stmt]:
        nonlocal tails
        out: list[ast.stmt] = []
        for s in body:
            call = s.value if isinstance(s, ast.Return) else None
            if isinstance(call, ast.Call) and isinstance(call.func, ast.Name) and call.func.id == f.name and not call.keywords and sum(calls_to(x, f.name) for x in call.args) == 0:
                tails += 1
                moved = [(n, v) for n, v in zip(names, call.args, strict=False) if not (isinstance(v, ast.Name) and v.id == n)] if len(call.args) == len(names) else []
                if len(moved) == 1:
                    out.append(ast.Assign([ast.Name(moved[0][0], ast.Store())], moved[0][1]))
                elif moved:
                    out.append(ast.Assign([ast.Tuple([ast.Name(n, ast.Store()) for n, _ in moved], ast.Store())], ast.Tuple([v for _, v in moved], ast.Load())))
                out.append(ast.Continue())
            elif isinstance(s, ast.If):
                out.append(ast.If(s.test, rewrite(s.body), rewrite(s.orelse)))
            else:
                out.append(s)
        return out

    body = rewrite(f.body)
    if not tails or tails != calls_to(f, f.name):
        return f
    if not isinstance(body[-1], (ast.Return, ast.Continue)):
        body.append(ast.Break())
    f.body = [ast.While(ast.Constant(True), body, [])]
    return f


class IndexLoops(ast.NodeTransformer):
    """for i in range(len(xs)), with i used as xs[i] alone, becomes a loop over the elements."""

    def visit_For(self, node: ast.For) -> ast.AST:
        self.generic_visit(node)
        r = node.iter
        if not (isinstance(r, ast.Call) and isinstance(r.func, ast.Name) and r.func.id == "range" and len(r.args) == 1 and isinstance(node.target, ast.Name)):
            return node
        n = r.args[0]
        if not (isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id == "len" and len(n.args) == 1 and isinstance(n.args[0], ast.Name)):
            return node
        index, items = node.target.id, n.args[0].id
        is_item = lambda x: isinstance(x, ast.Subscript) and isinstance(x.value, ast.Name) and x.value.id == items and isinstance(x.slice, ast.Name) and x.slice.id == index and isinstance(x.ctx, ast.Load)
        every = [x for s in node.body for x in ast.walk(s)]
        if sum(isinstance(x, ast.Name) and x.id == index for x in every) != sum(map(is_item, every)):
            return node

        class Items(ast.NodeTransformer):
            def visit_Subscript(self, x: ast.Subscript) -> ast.AST:
                return ast.Name(index, ast.Load()) if is_item(x) else self.generic_visit(x)

        body = [Items().visit(s) for s in node.body]
        return ast.For(ast.Name(index, ast.Store()), ast.Name(items, ast.Load()), body, node.orelse)


class CoreLoops(ast.NodeTransformer):
    """Loops without else become while True with a guarded break."""

    def visit_FunctionDef(self, node: ast.FunctionDef) -> ast.AST:
        return self.generic_visit(node)

    def _core(self, test: ast.expr | None, step: list[ast.stmt], body: list[ast.stmt]) -> ast.While:
        guard = [ast.If(test, [ast.Break()], [])] if test is not None else []
        return ast.While(ast.Constant(True), [*guard, *step, *body], [])

    def visit_While(self, node: ast.While) -> ast.AST:
        self.generic_visit(node)
        if node.orelse or isinstance(node.test, ast.Constant) and node.test.value is True:
            return node
        return self._core(negated(node.test), [], node.body)

    def visit_For(self, node: ast.For) -> ast.AST:
        self.generic_visit(node)
        if node.orelse:
            return node
        call = lambda name: ast.Call(ast.Name(name, ast.Load()), [node.iter], [])
        return self._core(ast.UnaryOp(ast.Not(), call("__has_next")), [ast.Assign([node.target], call("__next"))], node.body)


def loop_exits_to_returns(body: list[ast.stmt]) -> list[ast.stmt]:
    """A loop before a last return: its breaks return that value, and the return goes if there was one."""
    if len(body) < 2 or not isinstance(body[-1], ast.Return) or not isinstance(body[-2], ast.While):
        return body
    replaced = 0

    def rewrite(block: list[ast.stmt]) -> list[ast.stmt]:
        nonlocal replaced
        out = []
        for s in block:
            if isinstance(s, ast.Break):
                replaced += 1
                s = ast.Return(copy.deepcopy(body[-1].value))
            elif isinstance(s, ast.If):
                s = ast.If(s.test, rewrite(s.body), rewrite(s.orelse))
            out.append(s)
        return out

    loop = ast.While(body[-2].test, rewrite(body[-2].body), body[-2].orelse)
    return [*body[:-2], loop, *([] if replaced else body[-1:])]


def declared(f: ast.AST) -> set[str]:
    names = {n.arg for n in ast.walk(f) if isinstance(n, ast.arg)}
    names |= {n.id for n in ast.walk(f) if isinstance(n, ast.Name) and not isinstance(n.ctx, ast.Load)}
    return names | {n.name for n in ast.walk(f) if isinstance(n, ast.ExceptHandler) and n.name}


def literal(value: object) -> str:
    shown = repr(value) if not isinstance(value, bytes) else repr(value.decode("latin-1"))
    if shown in KEEP:
        return f"K{shown}"
    kind = {bool: "Bool", int: "Int", float: "Float", complex: "Float", str: "Str", bytes: "Str"}.get(type(value))
    return f"E{shown}" if isinstance(value, bool) or value is None or value is Ellipsis else f"B{kind}"


def masked(t: Tree, literals: bool = False) -> Tree:
    """The tree with local names alike, and literals too if asked."""
    label = t.label
    if label and (label[0] == "L" or literals and label[0] in "KB"):
        label = label[0] if label[0] == "L" else "M"
    return Tree(t.kind, label, tuple(masked(c, literals) for c in t.children))


class Canonical:
    """Converts a rewritten function; names are numbered in order of their first use."""

    def __init__(self, local: set[str]):
        self.local, self.places = local, {}
        self.repeats: list[tuple[int, int]] = []

    def name(self, n: str) -> str:
        if n not in self.local:
            return f"E{n}"
        return f"L{self.places.setdefault(n, len(self.places))}"

    def block(self, field: str, body: list[ast.stmt]) -> Tree:
        live = [s for s in body if not isinstance(s, ast.Pass)]
        return Tree(field, None, tuple(self.fold([self.node(s) for s in live])))

    def fold(self, children: list[Tree]) -> list[Tree]:
        keys = [masked(c, literals=True) for c in children]
        out, i = [], 0
        while i < len(children):
            for p in range(1, MAX_PERIOD + 1):
                n = 1
                while keys[i + n * p : i + (n + 1) * p] == keys[i : i + p] and i + (n + 1) * p <= len(keys):
                    n += 1
                if n >= 3:
                    part = tuple(children[i : i + p])
                    out.append(Tree("REPEAT", None, part))
                    self.repeats.append((n, sum(map(tokens, part))))
                    i += n * p
                    break
            else:
                out.append(children[i])
                i += 1
        return out

    def node(self, n: ast.AST) -> Tree:
        kind = type(n).__name__
        if isinstance(n, _FUNCTIONS):
            return Tree("FunctionDef", None, (self.arguments(n.args), self.block("body", n.body)))
        if isinstance(n, ast.arguments):
            return self.arguments(n)
        if isinstance(n, ast.keyword):
            return Tree(kind, f"E{n.arg or '**'}", (self.node(n.value),))
        if isinstance(n, ast.Slice):
            given = [(f, x) for f, x in ast.iter_fields(n) if x is not None]
            return Tree(kind, "E" + " ".join(f for f, _ in given), tuple(self.node(x) for _, x in given))
        if isinstance(n, (ast.Global, ast.Nonlocal)):
            return Tree(kind, "E" + " ".join(n.names))
        if isinstance(n, ast.alias):
            return Tree(kind, f"E{n.name} {n.asname or ''}".rstrip())
        if isinstance(n, ast.Name):
            return Tree("Name", self.name(n.id))
        if isinstance(n, ast.arg):
            return Tree("Name", self.name(n.arg))
        if isinstance(n, ast.Constant):
            return Tree("Constant", literal(n.value))
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.USub) and isinstance(n.operand, ast.Constant) and isinstance(n.operand.value, (int, float)):
            return Tree("Constant", literal(-n.operand.value))
        if isinstance(n, ast.Attribute):
            return Tree(kind, f"E{n.attr}", (self.node(n.value),))
        if isinstance(n, ast.BinOp):
            op = type(n.op).__name__
            if op in COMMUTATIVE:
                return Tree(kind, op, self.sorted([self.node(x) for x in self.chain(n, type(n.op))]))
            return Tree(kind, op, (self.node(n.left), self.node(n.right)))
        if isinstance(n, ast.BoolOp):
            return Tree(kind, type(n.op).__name__, self.sorted([self.node(x) for x in n.values]))
        if isinstance(n, ast.Compare):
            ops = [type(o).__name__ for o in n.ops]
            own = [self.node(n.left), *map(self.node, n.comparators)]
            return Tree(kind, " ".join(ops), self.sorted(own) if len(ops) == 1 and ops[0] in COMMUTATIVE else tuple(own))
        if isinstance(n, ast.Dict):
            pairs = [Tree("pair", None, tuple(self.node(x) for x in (k, v) if x is not None)) for k, v in zip(n.keys, n.values, strict=True)]
            return Tree(kind, None, tuple(sorted(pairs, key=lambda p: repr(p.children[0]))) if all(n.keys) else tuple(pairs))
        label = next((f"E{getattr(n, f)}" for f in ("name", "attr", "module") if isinstance(getattr(n, f, None), str)), None)
        if isinstance(n, ast.FormattedValue):
            label = f"E{n.conversion}"
        if isinstance(n, ast.MatchClass):
            label = "E" + " ".join(n.kwd_attrs)
        children = []
        for field, value in ast.iter_fields(n):
            if field in ("ctx", "type_comment", "returns", "annotation", "decorator_list", "lineno") or value is None:
                continue
            if isinstance(value, list):
                if field in _LISTS:
                    if value:
                        children.append(self.block(field, value))
                else:
                    children += [self.node(x) for x in value if isinstance(x, ast.AST)]
            elif isinstance(value, ast.operator | ast.unaryop):
                label = type(value).__name__
            elif isinstance(value, ast.AST):
                children.append(self.node(value))
        if isinstance(n, ast.While) and children and children[-1].kind == "body" and children[-1].children[-1:] == (Tree("Continue"),):
            children[-1] = Tree("body", None, children[-1].children[:-1])
        return Tree(kind, label, tuple(children))

    def arguments(self, a: ast.arguments) -> Tree:
        """Parameters in order of their kinds; a default is below its parameter."""
        plain = [*a.posonlyargs, *a.args]
        values = dict(zip([x.arg for x in plain[len(plain) - len(a.defaults) :]], a.defaults, strict=True))
        values |= {x.arg: v for x, v in zip(a.kwonlyargs, a.kw_defaults, strict=True) if v is not None}
        own = []
        for kind, found in (("Name", a.posonlyargs), ("Name", a.args), ("Star", [a.vararg]), ("Keyword", a.kwonlyargs), ("Stars", [a.kwarg])):
            for x in found:
                if x is not None:
                    below = (self.node(values[x.arg]),) if x.arg in values else ()
                    own.append(Tree(kind, f"E{x.arg}" if kind == "Keyword" else self.name(x.arg), below))
        return Tree("args", None, tuple(own))

    def chain(self, n: ast.expr, op: type) -> list[ast.expr]:
        return [*self.chain(n.left, op), n.right] if isinstance(n, ast.BinOp) and isinstance(n.op, op) else [n]

    def sorted(self, own: list[Tree]) -> tuple[Tree, ...]:
        return tuple(sorted(own, key=lambda t: (repr(masked(t)), repr(t))))


def tokens(t: Tree) -> int:
    return 1 + sum(map(tokens, t.children))


#: Trees of more levels are one opaque node: what recurses over trees must not run out of stack on odd files.
MAX_DEPTH = 120


def depth(n: ast.AST) -> int:
    """Levels of a syntax tree, without recursion."""
    level, deep = [n], 0
    while level:
        level, deep = [c for x in level for c in ast.iter_child_nodes(x)], deep + 1
    return deep


def opaque(f: ast.AST) -> Tree:
    """A function whose tree is too deep: equal to itself alone, by its nodes in the order of their levels."""
    shown = hashlib.md5()
    for n in ast.walk(f):
        shown.update(type(n).__name__.encode())
        for field, value in ast.iter_fields(n):
            if not isinstance(value, (ast.AST, list)) or isinstance(value, list) and not any(isinstance(x, ast.AST) for x in value):
                shown.update(f"{field}={value!r};".encode())
    return Tree("FunctionDef", f"E{shown.hexdigest()}")


def canonical(f: ast.AST) -> tuple[Tree, list[tuple[int, int]]]:
    """The canonical tree of a function, and repeats (count, tokens of one) that were folded."""
    if depth(f) > MAX_DEPTH:
        return opaque(f), []
    f = tail_recursion_to_loop(copy.deepcopy(f))
    f = CoreLoops().visit(IndexLoops().visit(f))
    f.body = loop_exits_to_returns(f.body)
    c = Canonical(declared(f))
    # Operands are sorted by names' places, so places are settled in a first pass in the order of the source.
    tree = c.node(f)
    return tree, c.repeats


def pragma(lines: list[str], first: int) -> str | None:
    """The nearest pragma on the function's first line or right above it, over decorators."""
    k = first - 1
    while 0 <= k < len(lines):
        for word in ("ignore", "accept-drift"):
            if re.search(rf"#\s*\w+:{word}\b", lines[k]):
                return word
        k -= 1
        if k >= 0 and not (lines[k].strip().startswith(("#", "@"))):
            break
    return None


def units_of(source: str, path: str = "memory.py") -> list[Unit]:
    """The units of one file; a file that does not parse gives those functions that parse on their own, as degraded."""
    degraded = False
    try:
        found = [(f, 0) for f in ast.walk(ast.parse(source)) if isinstance(f, _FUNCTIONS)]
    except (SyntaxError, ValueError, RecursionError):
        degraded, found = True, list(_tolerant(source))
    lines, out = source.split("\n"), []
    testy = bool({"test", "tests", "testing"} & set(re.split(r"[/\\]", path)[:-1]))
    for f, shift in sorted(found, key=lambda x: x[0].lineno + x[1]):
        if (word := pragma(lines, f.lineno + shift)) == "ignore":
            continue
        tree, repeats = canonical(f)
        deep = not tree.children
        decorated = any("test" in ast.unparse(d) for d in f.decorator_list if depth(d) <= MAX_DEPTH)
        test = testy or f.name.startswith("test_") or f.name.endswith("_test") or decorated
        out.append(Unit(f.name, f.lineno + shift, (f.end_lineno or f.lineno) + shift, tree, tokens(tree), degraded or deep, test, word == "accept-drift", repeats))
    return out


def _tolerant(source: str):
    """Functions by indentation: lines that do not parse are left out one by one from the end of a body."""
    lines = source.split("\n")
    for k, line in enumerate(lines):
        head = re.match(r"(\s*)(async\s+)?def\s+\w+\s*\(.*\)\s*(->.*)?:?\s*$", line)
        if not head:
            continue
        indent, end = len(head[1]), k + 1
        while end < len(lines) and (not lines[end].strip() or len(lines[end]) - len(lines[end].lstrip()) > indent):
            end += 1
        first = line.rstrip() if line.rstrip().endswith(":") else line.rstrip() + ":"
        body = lines[k + 1 : end]
        for stop in range(len(body), 0, -1):
            try:
                yield ast.parse(textwrap.dedent("\n".join([first, *body[:stop]]))).body[0], k
                break
            except (SyntaxError, ValueError, IndexError):
                continue
