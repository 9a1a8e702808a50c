"""Syntax trees as rows: one row for each node, in the order of a walk from the top.

A node's descendants are the rows with node_id in (node_id, post]. What checks need of ancestors is computed in the same
walk: the complexity and nesting of each function's body, the class that a method belongs to, whether a literal begins
on a line of a const initialiser, and the tests that an assertion is in.
"""

from __future__ import annotations

import bisect
import sys
from collections.abc import Iterator

import pyarrow as pa

from .lexer import SyntaxFailure
from .parser import Node, parse

# Node types that decide results.
COMPLEXITY_TYPES = {"IfStatement", "ForStatement", "ForInStatement", "ForOfStatement", "WhileStatement", "DoWhileStatement", "CatchClause", "SwitchCase", "ConditionalExpression"}
NESTING_TYPES = {"IfStatement", "ForStatement", "ForInStatement", "ForOfStatement", "WhileStatement", "DoWhileStatement", "SwitchStatement", "TryStatement"}
FUNCTION_LIKE = {"FunctionExpression", "ArrowFunctionExpression"}
ANONYMOUS = "<anonymous>"
ASSERT_SOURCES = {"assert", "node:assert", "assert/strict", "node:assert/strict"}
TEST_REGISTRARS = {"test", "it"}

SCHEMA = (
    "project string, rel_path string, error string, node_id int, post int, parent_id int, parent_type string, field string, type string, start_line int, end_line int, "
    "start_off int, end_off int, name string, value string, raw string, operator string, kind string, is_static boolean, computed boolean, has_body boolean, "
    "method_name string, complexity int, nesting int, in_const boolean, test_name string, asserts_in array<int>"
)
_TYPES = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}
FIELDS = [tuple(c.split()) for c in SCHEMA.split(", ")]


def _named_declaration(n: Node) -> bool:
    return n.type == "FunctionDeclaration" and n.get("id") is not None


def _key_name(key: Node | None) -> str:
    return key.name if key is not None and key.type in ("Identifier", "PrivateName") else ANONYMOUS


def _left_name(n: Node | None) -> str:
    """Name of an assignment's left side: what isn't a chain of names is anonymous, what isn't a plain property <anon>."""
    parts: list[str] = []
    while n is not None and n.type == "MemberExpression":
        p = n.get("property")
        parts.append(p.name if p.type == "Identifier" and not n.computed else "<anon>")
        n = n.get("object")
    parts.append(n.name if n is not None and n.type == "Identifier" else ANONYMOUS)
    return ".".join(reversed(parts))


class Walk:
    """Measures over a tree, children before parents, without recursion."""

    def __init__(self, top: Node) -> None:
        self.order: list[tuple[Node, Node | None, str]] = []
        stack: list[tuple[Node, Node | None, str]] = [(top, None, "")]
        while stack:
            n, parent, field = stack.pop()
            self.order.append((n, parent, field))
            stack += [(c, n, f) for f, c in reversed(n.children)]
        self.branches: dict[int, int] = {}
        self.depth: dict[int, int] = {}
        self.size: dict[int, int] = {}
        for n, _, _ in reversed(self.order):
            own = n.type in COMPLEXITY_TYPES or n.type == "LogicalExpression" and n.operator in ("&&", "||")
            below = [c for _, c in n.children]
            self.branches[id(n)] = own + sum(self.branches[id(c)] for c in below if not _named_declaration(c))
            self.depth[id(n)] = (n.type in NESTING_TYPES) + max((self.depth[id(c)] for c in below), default=0)
            self.size[id(n)] = 1 + sum(self.size[id(c)] for c in below)
        self.names: dict[int, str] = {}
        self._methods(top)

    def _methods(self, top: Node) -> None:
        """Names of the functions that are reported, by node. Exports are transparent, of a class only the body counts."""
        stack: list[tuple[Node, str | None]] = [(top, None)]
        while stack:
            n, owner = stack.pop()
            inside = [c for _, c in n.children]
            if n.type == "FunctionDeclaration":
                if n.has_body:
                    self.names[id(n)] = n.name or ANONYMOUS
            elif n.type in ("ClassMethod", "ClassPrivateMethod"):
                if n.kind != "constructor" and n.has_body:
                    name = _key_name(n.get("key"))
                    self.names[id(n)] = f"{owner}.{name}" if owner else name
            elif n.type == "ObjectMethod":
                if n.has_body:
                    self.names[id(n)] = _key_name(n.get("key"))
            elif n.type in ("VariableDeclarator", "AssignmentExpression", "ObjectProperty"):
                f = n.get({"VariableDeclarator": "init", "AssignmentExpression": "right"}.get(n.type, "value"))
                if f is not None and f.type in FUNCTION_LIKE:
                    key = n.get("id")
                    self.names[id(f)] = (
                        (key.name if key.type == "Identifier" else ANONYMOUS) if n.type == "VariableDeclarator" else _left_name(n.get("left")) if n.type == "AssignmentExpression" else _key_name(n.get("key"))
                    )
            elif n.type in ("ClassDeclaration", "ClassExpression"):
                owner, inside = n.name or owner, n.get("body").all("body")
            elif n.type in ("ExportNamedDeclaration", "ExportDefaultDeclaration"):
                inside = n.all("declaration")
            stack += [(c, owner) for c in reversed(inside)]


def _root(callee: Node | None) -> tuple[str | None, str | None]:
    """Of a call's callee: the name it begins with, if it is that or a member of that; the name whose assert object it is of."""
    if callee is not None and callee.type == "Identifier":
        return callee.name, None
    if callee is None or callee.type != "MemberExpression":
        return None, None
    o = callee.get("object")
    if o is not None and o.type == "Identifier":
        return o.name, None
    if o is not None and o.type == "MemberExpression" and (p := o.get("property")) is not None and p.name == "assert" and (c := o.get("object")) is not None and c.type == "Identifier":
        return None, c.name
    return None, None


class Tests:
    """Registrations of tests with a function, by node, and the tests that each asserting call is in.

    A call asserts if it begins with a name that an import binds to an assert module, or is of the assert object of the test
    function's first parameter. In a nested test it counts for the outer one too."""

    def __init__(self, walk: Walk, ids: dict[int, int]) -> None:
        self.names: dict[int, str] = {}
        self.asserts: dict[int, list[int]] = {}
        bound: set[str] = set()
        bodies: dict[int, tuple[int, str | None]] = {}
        for n, _, _ in walk.order:
            if n.type == "ImportDeclaration" and (s := n.get("source")) is not None and s.value in ASSERT_SOURCES:
                bound.update(c.name for _, c in n.children if c.type in ("ImportSpecifier", "ImportDefaultSpecifier", "ImportNamespaceSpecifier"))
            if n.type == "CallExpression" and (r := _root(n.get("callee"))[0]) in TEST_REGISTRARS:
                args = n.all("arguments")
                if (f := next((a for a in args if a.type in FUNCTION_LIKE), None)) is not None:
                    self.names[id(n)] = args[0].value if args[0].type == "StringLiteral" else r
                    p = next(iter(f.all("params")), None)
                    bodies[id(f)] = ids[id(n)], p.name if p is not None and p.type == "Identifier" else None
        inside: list[tuple[int, int, str | None]] = []  # tests that the walk is in: the last node, the test, its context
        for k, (n, _, _) in enumerate(walk.order):
            while inside and k > inside[-1][0]:
                inside.pop()
            if inside and n.type == "CallExpression":
                root, context = _root(n.get("callee"))
                own = [t for _, t, c in inside if root in bound or context is not None and context == c]
                if own:
                    self.asserts[id(n)] = own
            if id(n) in bodies:
                inside.append((k + walk.size[id(n)] - 1, *bodies[id(n)]))


def rows(src: str, extension: str) -> Iterator[dict]:
    """Rows of a source text; raises SyntaxFailure where it doesn't parse."""
    top = parse(src, extension)
    walk = Walk(top)
    starts = [0, *(i + 1 for i, c in enumerate(src) if c == "\n")]
    line = lambda off: bisect.bisect_right(starts, off)
    constant: set[int] = set()
    for n, _, _ in walk.order:
        if n.type == "VariableDeclaration" and n.kind == "const":
            for d in n.all("declarations"):
                if (init := d.get("init")) is not None:
                    constant.update(range(line(init.start), line(max(init.start, init.end - 1)) + 1))
    ids = {id(n): k for k, (n, _, _) in enumerate(walk.order)}
    tests = Tests(walk, ids)
    for k, (n, parent, field) in enumerate(walk.order):
        first, body = line(n.start), n.get("body")
        named = walk.names.get(id(n))
        whole = n.type.endswith("Method") or n.type in FUNCTION_LIKE or n.type == "FunctionDeclaration"
        measured = whole and body is not None
        yield {
            "error": None, "node_id": k, "post": k + walk.size[id(n)] - 1, "parent_id": ids[id(parent)] if parent else None, "parent_type": parent.type if parent else None,
            "field": field or None, "type": n.type, "start_line": first, "end_line": line(max(n.start, n.end - 1)), "start_off": n.start, "end_off": n.end, "name": n.name,
            "value": n.value, "raw": n.raw, "operator": n.operator, "kind": n.kind, "is_static": n.is_static, "computed": n.computed, "has_body": n.has_body,
            "method_name": named, "complexity": 1 + walk.branches[id(body)] if measured else None, "nesting": 1 + walk.depth[id(body)] if measured else None, "in_const": first in constant,
            "test_name": tests.names.get(id(n)), "asserts_in": tests.asserts.get(id(n)),
        }


def flattened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Node rows of batches of (project, rel_path, ext, content); a file that doesn't parse gives one row with its error."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))
    out: list[dict] = []

    def flush() -> pa.RecordBatch:
        b = pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in out], _TYPES[t]) for c, t in FIELDS], names=[c for c, _ in FIELDS])
        out.clear()
        return b

    for batch in batches:
        for f in batch.to_pylist():
            key = {"project": f["project"], "rel_path": f["rel_path"]}
            try:
                out.extend([key | r for r in rows(f["content"] or "", f["ext"] or "js")])
            except (SyntaxFailure, RecursionError) as e:
                out.append(key | {"error": str(e) or type(e).__name__})
            if len(out) >= 20_000:
                yield flush()
    if out:
        yield flush()
