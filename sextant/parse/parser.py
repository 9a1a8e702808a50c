"""A tolerant recursive-descent parser for JavaScript modules with JSX, decorators and Flow or TypeScript annotations.

Written from the public ECMAScript grammar. It builds nodes of the usual names and leaves out what no check looks at:
comments, directives, and the inner structure of types, of which names and literals are kept. Types are skipped with
balanced brackets. Source that the grammar doesn't cover raises SyntaxFailure.
"""

from __future__ import annotations

from collections.abc import Callable

from .lexer import SyntaxFailure, Token, blank_end, regex, token, unescape

_RESERVED = set("break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false enum".split())
_ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??="}
_BINARY = {
    "??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8,
    "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12,
}
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
_MODIFIERS = {"public", "private", "protected", "readonly", "abstract", "override", "declare", "static", "async", "get", "set", "accessor"}


class Node:
    """A syntax node: children by field in source order, and the few attributes that checks read."""

    __slots__ = ("type", "start", "end", "children", "name", "value", "raw", "operator", "kind", "is_static", "computed", "has_body")

    def __init__(self, type_: str, start: int) -> None:
        self.type, self.start, self.end = type_, start, start
        self.children: list[tuple[str, Node]] = []
        self.name = self.value = self.raw = self.operator = self.kind = None
        self.is_static = self.computed = self.has_body = False

    def add(self, field: str, child: Node | list[Node] | None) -> Node:
        for c in child if isinstance(child, list) else [child]:
            if c is not None:
                self.children.append((field, c))
        return self

    def get(self, field: str) -> Node | None:
        return next((c for f, c in self.children if f == field), None)

    def all(self, field: str) -> list[Node]:
        return [c for f, c in self.children if f == field]


class Parser:
    def __init__(self, src: str, typescript: bool = False) -> None:
        self.src, self.ts = src, typescript
        self.no_in = self.plain_arrows = False
        self.arrows: dict[int, bool] = {}
        self.tok = token(src, src.find("\n") if src.startswith("#!") and "\n" in src else 0)
        self.last = 0

    # tokens

    def move(self, pos: int) -> None:
        self.tok = token(self.src, pos)

    def next(self) -> Token:
        t = self.tok
        self.last = t.end
        self.move(t.end)
        return t

    def peek(self) -> Token:
        return token(self.src, self.tok.end)

    def at(self, *texts: str) -> bool:
        return self.tok.text in texts and self.tok.kind in ("punct", "name")

    def eat(self, text: str) -> bool:
        if self.at(text):
            self.next()
            return True
        return False

    def need(self, text: str) -> Token:
        if not self.at(text):
            raise SyntaxFailure(f"expected {text} at {self.tok.start}, found {self.tok.text!r}")
        return self.next()

    def done(self, node: Node) -> Node:
        node.end = self.last
        return node

    def semicolon(self) -> None:
        if not self.eat(";") and not (self.at("}") or self.tok.kind == "end" or self.tok.newline):
            raise SyntaxFailure(f"expected ; at {self.tok.start}, found {self.tok.text!r}")

    def attempt(self, f: Callable[[], Node]) -> Node | None:
        """f's node, or None and nothing read where it fails."""
        kept = self.tok, self.last, self.no_in
        try:
            return f()
        except SyntaxFailure:
            self.tok, self.last, self.no_in = kept
            return None

    # types

    def skip_type(self, stops: tuple[str, ...], brace: bool = True) -> Node:
        """A type up to one of the stops outside brackets; its names and literals become children."""
        out, depth, angle, before = Node("TypeAnnotation", self.tok.start), 0, 0, ""
        while self.tok.kind != "end":
            t = self.tok
            if depth == 0 and angle <= 0:
                ends = t.text in stops and t.kind in ("punct", "name") and not (t.text == "=>" and before == ")" and "=>" not in stops)
                if ends or (t.text in _CLOSE and t.kind == "punct"):
                    break
                if t.text == "{" and t.kind == "punct" and not brace and before not in ("", "|", "&", "=>", ":"):
                    break
                if t.newline and before and before not in ("|", "&", "=>", ":", ",", ".", "?", "keyof", "typeof", "extends", "is", "infer", "readonly", "new") and t.text not in ("|", "&", "=>", ".", "?", ":", "[", "extends", "is"):
                    break
            if t.kind == "punct":
                if t.text == "`":
                    out.add("type", self.template())
                    before = "`"
                    continue
                if t.text in _OPEN:
                    depth += 1
                elif t.text in _CLOSE:
                    depth -= 1
                elif t.text == "<":
                    angle += 1
                elif set(t.text) == {">"}:
                    angle -= len(t.text)
            elif t.kind == "name" and t.text not in _RESERVED:
                out.add("type", self.leaf("Identifier", t, name=t.text))
            elif t.kind == "string":
                out.add("type", self.leaf("StringLiteral", t, value=unescape(t.text[1:-1]), raw=t.text))
            elif t.kind == "number":
                out.add("type", self.leaf("NumericLiteral", t, value=t.text, raw=t.text))
            before = t.text
            self.next()
            if angle < 0:
                raise SyntaxFailure(f"unbalanced > at {t.start}")
        if not before:
            raise SyntaxFailure(f"expected a type at {self.tok.start}")
        return self.done(out)

    def leaf(self, type_: str, t: Token, **attributes) -> Node:
        n = Node(type_, t.start)
        n.end = t.end
        for k, v in attributes.items():
            setattr(n, k, v)
        return n

    def annotation(self, stops: tuple[str, ...], brace: bool = True) -> Node | None:
        """A type after a colon, if there is one."""
        if self.at(":"):
            self.next()
            return self.skip_type(stops, brace)
        return None

    def type_arguments(self) -> Node | None:
        """Balanced angle brackets."""
        if not self.at("<"):
            return None
        out, angle, depth = Node("TypeParameters", self.tok.start), 0, 0
        while True:
            t = self.tok
            if t.kind == "end" or t.text == ";" and depth == 0:
                raise SyntaxFailure(f"unbalanced < at {out.start}")
            if t.kind == "punct" and t.text == "<":
                angle += 1
            elif t.kind == "punct" and set(t.text) == {">"}:
                angle -= len(t.text)
                if angle <= 0:
                    if angle < 0:  # >> closes an outer pair as well
                        self.last = t.end + angle
                        self.move(self.last)
                        return self.done(out)
                    self.next()
                    return self.done(out)
            elif t.kind == "punct" and t.text in _OPEN:
                depth += 1
            elif t.kind == "punct" and t.text in _CLOSE:
                depth -= 1
                if depth < 0:
                    raise SyntaxFailure(f"unbalanced < at {out.start}")
            elif t.kind == "name" and t.text not in _RESERVED:
                out.add("params", self.leaf("Identifier", t, name=t.text))
            elif t.kind == "string":
                out.add("params", self.leaf("StringLiteral", t, value=unescape(t.text[1:-1]), raw=t.text))
            elif t.kind == "number":
                out.add("params", self.leaf("NumericLiteral", t, value=t.text, raw=t.text))
            self.next()

    # program and statements

    def program(self) -> Node:
        n = Node("Program", 0)
        n.add("body", self.body(lambda: self.tok.kind == "end"))
        n.end = len(self.src)
        return n

    def body(self, over: Callable[[], bool]) -> list[Node]:
        """Statements without the directives that they start with."""
        out, first = [], True
        while not over():
            if self.tok.kind == "end":
                raise SyntaxFailure("unexpected end")
            directive = first and self.tok.kind == "string"
            s = self.statement()
            e = s.get("expression") if s.type == "ExpressionStatement" else None
            first = directive and e is not None and e.type == "StringLiteral" and self.src[s.start] in "\"'"
            if not first:
                out.append(s)
        return out

    def block(self, directives: bool = False) -> Node:
        n = Node("BlockStatement", self.need("{").start)
        if directives:
            n.add("body", self.body(lambda: self.at("}")))
        else:
            while not self.at("}"):
                if self.tok.kind == "end":
                    raise SyntaxFailure("unexpected end")
                n.add("body", self.statement())
        self.need("}")
        return self.done(n)

    def statement(self) -> Node:
        t = self.tok
        if t.kind == "punct":
            if t.text == "{":
                return self.block()
            if t.text == ";":
                self.next()
                return self.done(Node("EmptyStatement", t.start))
            if t.text == "@":
                return self.decorated()
        if t.kind == "name":
            f = getattr(self, f"s_{t.text}", None)
            if f:
                n = f()
                if n is not None:
                    return n
            p = self.peek()
            if t.text not in _RESERVED and p.text == ":" and p.kind == "punct":
                n = Node("LabeledStatement", t.start).add("label", self.identifier())
                self.need(":")
                return self.done(n.add("body", self.statement()))
            if t.text in ("type", "interface", "opaque", "declare", "namespace", "module", "abstract", "enum") and not p.newline and (p.kind in ("name", "string") or p.text == "{"):
                n = self.attempt(self.type_statement)
                if n is not None:
                    return n
        n = Node("ExpressionStatement", t.start).add("expression", self.expression())
        self.semicolon()
        return self.done(n)

    def type_statement(self) -> Node:
        t = self.next()
        n = Node("TypeDeclaration", t.start)
        n.kind = t.text
        if t.text == "declare":
            inner = self.tok.text
            if inner == "export" or inner in ("type", "interface", "opaque", "namespace", "module", "abstract", "enum"):
                return self.done(n.add("declaration", self.statement()))
            if inner in ("var", "let", "const"):
                return self.done(n.add("declaration", self.statement()))
            if inner in ("function", "class"):
                if inner == "class":
                    return self.done(n.add("declaration", self.class_(True)))
                self.next()
                self.identifier()
                self.type_arguments()
                self.need("(")
                n.add("params", self.parameters())
                n.add("returnType", self.annotation((";", "%checks"), True))
                self.semicolon()
                return self.done(n)
            raise SyntaxFailure(f"unexpected {inner!r}")
        if t.text == "abstract":
            if not self.at("class"):
                raise SyntaxFailure("not a class")
            return self.class_(True, t.start)
        if t.text == "opaque":
            self.need("type")
        if t.text in ("namespace", "module"):
            n.type = "TSModuleDeclaration"
            if self.tok.kind == "string":
                n.add("id", self.primary())
            else:
                n.add("id", self.identifier())
                while self.eat("."):
                    self.identifier()
            return self.done(n.add("body", self.block()))
        n.add("id", self.identifier())
        if t.text == "enum":
            n.type = "TSEnumDeclaration"
            self.need("{")
            while not self.at("}"):
                m = Node("TSEnumMember", self.tok.start).add("id", self.primary())
                if self.eat("="):
                    m.add("initializer", self.assignment())
                n.add("members", self.done(m))
                if not self.eat(","):
                    break
            self.need("}")
            return self.done(n)
        n.add("typeParameters", self.type_arguments())
        if t.text == "interface":
            while not self.at("{"):
                if self.tok.kind not in ("name", "punct") or self.at(";"):
                    raise SyntaxFailure("expected a body")
                if self.at("<"):
                    n.add("extends", self.type_arguments())
                elif self.tok.kind == "name" and self.tok.text not in _RESERVED:
                    n.add("extends", self.identifier())
                else:
                    self.next()
            n.add("body", self.skip_type((";",)))
            return self.done(n)
        if self.at(":"):
            n.add("supertype", self.annotation(("=", ";")))
        if self.eat("="):
            n.add("right", self.skip_type((";",)))
        elif t.text == "type":
            raise SyntaxFailure("expected =")
        self.semicolon()
        return self.done(n)

    def s_var(self) -> Node | None:
        n = self.variables()
        self.semicolon()
        return self.done(n)

    def s_const(self) -> Node | None:
        if self.peek().text == "enum":
            self.next()
            return self.type_statement()
        return self.s_var()

    def s_let(self) -> Node | None:
        p = self.peek()
        return self.s_var() if p.text in ("[", "{") or p.kind == "name" and p.text not in ("in", "instanceof", "of") else None

    def s_using(self) -> Node | None:
        p = self.peek()
        return self.s_var() if p.kind == "name" and not p.newline and p.text not in _RESERVED and p.text != "of" else None

    def variables(self) -> Node:
        n = Node("VariableDeclaration", self.tok.start)
        n.kind = self.next().text
        while True:
            d = Node("VariableDeclarator", self.tok.start).add("id", self.pattern())
            self.eat("!")
            d.add("typeAnnotation", self.annotation(("=", ",", ";", "in", "of")))
            if self.eat("="):
                d.add("init", self.assignment())
            n.add("declarations", self.done(d))
            if not self.eat(","):
                return self.done(n)

    def s_function(self) -> Node:
        return self.function("FunctionDeclaration")

    def s_async(self) -> Node | None:
        p = self.peek()
        return self.function("FunctionDeclaration") if p.text == "function" and not p.newline else None

    def s_class(self) -> Node:
        return self.class_(True)

    def decorated(self) -> Node:
        start, ds = self.tok.start, self.decorators()
        if self.at("export"):
            n = self.s_export()
            target = n.get("declaration") or n
        else:
            if self.at("abstract"):
                self.next()
            n = target = self.class_(True, start)
        target.children[:0] = [("decorators", d) for d in ds]
        return n

    def decorators(self) -> list[Node]:
        out = []
        while self.at("@"):
            n = Node("Decorator", self.next().start)
            out.append(self.done(n.add("expression", self.subscripts(self.primary(), True))))
        return out

    def s_if(self) -> Node:
        n = Node("IfStatement", self.next().start)
        n.add("test", self.in_parens()).add("consequent", self.statement())
        if self.eat("else"):
            n.add("alternate", self.statement())
        return self.done(n)

    def in_parens(self) -> Node:
        self.need("(")
        kept, self.no_in = self.no_in, False
        e = self.expression()
        self.no_in = kept
        self.need(")")
        return e

    def s_for(self) -> Node:
        start = self.next().start
        self.eat("await")
        self.need("(")
        first = None
        if not self.at(";"):
            self.no_in = True
            declares = self.at("var", "const") or (self.at("let", "using") and (self.peek().kind == "name" and self.peek().text not in ("in", "of") or self.peek().text in ("[", "{")))
            first = self.variables() if declares else self.expression()
            self.no_in = False
        if self.at("of", "in") and first is not None:
            n = Node("ForOfStatement" if self.next().text == "of" else "ForInStatement", start).add("left", first)
            n.add("right", self.expression())
        else:
            n = Node("ForStatement", start).add("init", first)
            self.need(";")
            n.add("test", None if self.at(";") else self.expression())
            self.need(";")
            n.add("update", None if self.at(")") else self.expression())
        self.need(")")
        return self.done(n.add("body", self.statement()))

    def s_while(self) -> Node:
        n = Node("WhileStatement", self.next().start)
        return self.done(n.add("test", self.in_parens()).add("body", self.statement()))

    def s_do(self) -> Node:
        n = Node("DoWhileStatement", self.next().start).add("body", self.statement())
        self.need("while")
        n.add("test", self.in_parens())
        self.eat(";")
        return self.done(n)

    def s_with(self) -> Node:
        n = Node("WithStatement", self.next().start)
        return self.done(n.add("object", self.in_parens()).add("body", self.statement()))

    def _jump(self, type_: str, field: str, label: bool) -> Node:
        n = Node(type_, self.next().start)
        if not (self.at(";", "}") or self.tok.kind == "end" or self.tok.newline):
            n.add(field, self.identifier() if label else self.expression())
        self.semicolon()
        return self.done(n)

    def s_return(self) -> Node:
        return self._jump("ReturnStatement", "argument", False)

    def s_throw(self) -> Node:
        return self._jump("ThrowStatement", "argument", False)

    def s_break(self) -> Node:
        return self._jump("BreakStatement", "label", True)

    def s_continue(self) -> Node:
        return self._jump("ContinueStatement", "label", True)

    def s_debugger(self) -> Node:
        return self._jump("DebuggerStatement", "label", True)

    def s_try(self) -> Node:
        n = Node("TryStatement", self.next().start).add("block", self.block())
        if self.at("catch"):
            c = Node("CatchClause", self.next().start)
            if self.eat("("):
                c.add("param", self.pattern()).add("typeAnnotation", self.annotation((")",)))
                self.need(")")
            n.add("handler", self.done(c.add("body", self.block())))
        if self.eat("finally"):
            n.add("finalizer", self.block())
        elif n.get("handler") is None:
            raise SyntaxFailure("try without catch")
        return self.done(n)

    def s_switch(self) -> Node:
        n = Node("SwitchStatement", self.next().start).add("discriminant", self.in_parens())
        self.need("{")
        while not self.at("}"):
            c = Node("SwitchCase", self.tok.start)
            if self.eat("case"):
                c.add("test", self.expression())
            else:
                self.need("default")
            self.need(":")
            while not self.at("case", "default", "}"):
                c.add("consequent", self.statement())
            n.add("cases", self.done(c))
        self.need("}")
        return self.done(n)

    # modules

    def s_import(self) -> Node | None:
        p = self.peek()
        if p.text in ("(", "."):
            return None
        n = Node("ImportDeclaration", self.next().start)
        if self.tok.kind != "string":
            if self.at("type", "typeof") and (self.peek().text in ("{", "*") or self.peek().kind == "name" and self.peek().text != "from"):
                n.kind = self.next().text
            if self.tok.kind == "name":
                i = self.identifier()
                if self.eat("="):  # import name = require(...)
                    n.type = "TSImportEqualsDeclaration"
                    if self.at("require") and self.peek().text == "(":
                        self.next(), self.next()
                        n.add("moduleReference", self.primary())
                        self.need(")")
                    else:
                        n.add("moduleReference", self.subscripts(self.primary(), True))
                    self.semicolon()
                    return self.done(n.add("id", i))
                n.add("specifiers", self._specifier("ImportDefaultSpecifier", i))
                self.eat(",")
            if self.at("*"):
                self.next()
                self.need("as")
                n.add("specifiers", self._specifier("ImportNamespaceSpecifier", self.identifier()))
            elif self.eat("{"):
                n.add("specifiers", self.specifiers("ImportSpecifier", "imported", "local"))
            self.need("from")
        self.source(n)
        return self.done(n)

    def _specifier(self, type_: str, local: Node) -> Node:
        n = Node(type_, local.start).add("local", local)
        n.end = local.end
        n.name = local.name
        return n

    def source(self, n: Node) -> None:
        if self.tok.kind != "string":
            raise SyntaxFailure(f"expected a module at {self.tok.start}")
        n.add("source", self.primary())
        if self.at("with", "assert") and not self.tok.newline and self.peek().text == "{":
            self.next()
            n.add("attributes", self.primary())
        self.semicolon()

    def specifiers(self, type_: str, outer: str, inner: str) -> list[Node]:
        """Names in braces; both identifiers of a short form are there, as in the tree that checks count in."""
        out = []
        while not self.at("}"):
            n = Node(type_, self.tok.start)
            p = self.peek()
            if self.at("type", "typeof") and p.text not in (",", "}", "as"):
                self.next()
            a = self.module_name()
            b = self.module_name() if self.eat("as") else None
            if b is None:
                b = self.leaf(a.type, Token("name", "", a.start, a.end, False), name=a.name, value=a.value, raw=a.raw)
            n.add(outer, a).add(inner, b)
            n.name = b.name if inner == "local" else a.name
            out.append(self.done(n))
            if not self.eat(","):
                break
        self.need("}")
        return out

    def module_name(self) -> Node:
        return self.primary() if self.tok.kind == "string" else self.identifier(True)

    def s_export(self) -> Node:
        start = self.next().start
        if self.eat("*"):
            n = Node("ExportAllDeclaration", start)
            if self.eat("as"):
                n.type = "ExportNamedDeclaration"
                n.add("specifiers", self._specifier("ExportNamespaceSpecifier", self.module_name()))
            self.need("from")
            self.source(n)
            return self.done(n)
        if self.eat("default"):
            n = Node("ExportDefaultDeclaration", start)
            if self.at("function") or self.at("async") and self.peek().text == "function" and not self.peek().newline:
                n.add("declaration", self.function("FunctionDeclaration"))
            elif self.at("class", "@") or self.at("abstract") and self.peek().text == "class":
                n.add("declaration", self.decorated() if self.at("@", "abstract") else self.class_(True))
            elif self.at("interface", "enum") and self.peek().kind == "name":
                n.add("declaration", self.type_statement())
            else:
                n.add("declaration", self.assignment())
                self.semicolon()
            return self.done(n)
        if self.at("="):
            self.next()
            n = Node("TSExportAssignment", start).add("expression", self.expression())
            self.semicolon()
            return self.done(n)
        n = Node("ExportNamedDeclaration", start)
        if self.at("as") and self.peek().text == "namespace":
            self.next(), self.next()
            n.type = "TSNamespaceExportDeclaration"
            n.add("id", self.identifier())
            self.semicolon()
            return self.done(n)
        if self.at("type") and self.peek().text in ("{", "*"):
            self.next()
            if self.at("*"):
                self.next()
                if self.eat("as"):
                    self.identifier()
                self.need("from")
                n.type = "ExportAllDeclaration"
                self.source(n)
                return self.done(n)
        if self.eat("{"):
            n.add("specifiers", self.specifiers("ExportSpecifier", "local", "exported"))
            if self.eat("from"):
                self.source(n)
            else:
                self.semicolon()
            return self.done(n)
        return self.done(n.add("declaration", self.statement()))

    # functions and classes

    def parameters(self) -> list[Node]:
        """After the opening parenthesis, up to and over the closing one."""
        out = []
        kept, self.no_in = self.no_in, False
        while not self.at(")"):
            ds = self.decorators()
            start, modified = self.tok.start, False
            while self.tok.kind == "name" and self.tok.text in _MODIFIERS and self.peek().kind == "name":
                self.next()
                modified = True
            p = self.binding((",", ")", "="))
            if modified:
                q = Node("TSParameterProperty", start).add("parameter", p)
                p = self.done(q)
            p.children[:0] = [("decorators", d) for d in ds]
            out.append(p)
            if not self.eat(","):
                break
        self.need(")")
        self.no_in = kept
        return out

    def binding(self, stops: tuple[str, ...]) -> Node:
        """A pattern with an annotation and a default."""
        start = self.tok.start
        if self.eat("..."):
            n = Node("RestElement", start).add("argument", self.pattern())
            self.eat("?")
            return self.done(n.add("typeAnnotation", self.annotation(stops)))
        p = self.pattern()
        self.eat("?")
        a = self.annotation(stops)
        if a is not None:
            p.add("typeAnnotation", a)
        if self.eat("="):
            n = Node("AssignmentPattern", start).add("left", p).add("right", self.assignment())
            return self.done(n)
        return p

    def pattern(self) -> Node:
        t = self.tok
        if self.eat("["):
            n = Node("ArrayPattern", t.start)
            while not self.at("]"):
                if not self.eat(","):
                    n.add("elements", self.binding((",", "]", "=")))
                    if not self.at("]"):
                        self.need(",")
            self.need("]")
            return self.done(n)
        if self.eat("{"):
            n = Node("ObjectPattern", t.start)
            while not self.at("}"):
                s = self.tok.start
                if self.eat("..."):
                    n.add("properties", self.done(Node("RestElement", s).add("argument", self.pattern())))
                else:
                    q = Node("ObjectProperty", s)
                    key, q.computed = self.key()
                    q.add("key", key)
                    if self.eat(":"):
                        q.add("value", self.binding((",", "}", "=")))
                    else:
                        v = self.leaf("Identifier", Token("name", "", key.start, key.end, False), name=key.name)
                        if self.eat("="):
                            a = Node("AssignmentPattern", s).add("left", v).add("right", self.assignment())
                            v = self.done(a)
                        q.add("value", v)
                    n.add("properties", self.done(q))
                if not self.eat(","):
                    break
            self.need("}")
            return self.done(n)
        if t.kind == "name" and t.text == "this":
            return self.primary()
        return self.identifier()

    def identifier(self, reserved: bool = False) -> Node:
        t = self.tok
        if t.kind != "name" or (t.text in _RESERVED and not reserved):
            raise SyntaxFailure(f"expected a name at {t.start}, found {t.text!r}")
        self.next()
        return self.leaf("Identifier", t, name=unescape(t.text))

    def function(self, type_: str) -> Node:
        n = Node(type_, self.tok.start)
        self.eat("async")
        self.need("function")
        self.eat("*")
        if not self.at("(", "<"):
            n.add("id", self.identifier())
            n.name = n.children[-1][1].name
        return self.rest_of_function(n)

    def rest_of_function(self, n: Node) -> Node:
        """From the type parameters on; without a body where types only declare it."""
        n.add("typeParameters", self.type_arguments())
        self.need("(")
        n.add("params", self.parameters())
        n.add("returnType", self.annotation(("{", ";", "=>"), False))
        if self.at("{"):
            n.has_body = True
            n.add("body", self.function_body())
        else:
            self.semicolon()
        return self.done(n)

    def function_body(self) -> Node:
        kept, self.no_in = self.no_in, False
        b = self.block(True)
        self.no_in = kept
        return b

    def class_(self, declaration: bool, start: int | None = None) -> Node:
        n = Node("ClassDeclaration" if declaration else "ClassExpression", self.tok.start if start is None else start)
        self.need("class")
        if self.tok.kind == "name" and not self.at("extends", "implements") or self.at("implements") and self.peek().text in ("{", "extends", "implements", "<"):
            n.add("id", self.identifier())
            n.name = n.children[-1][1].name
        n.add("typeParameters", self.type_arguments())
        if self.eat("extends"):
            n.add("superClass", self.subscripts(self.primary(), True))
            n.add("superTypeParameters", self.type_arguments())
        if self.eat("implements"):
            while not self.at("{"):
                if self.at("<"):
                    n.add("implements", self.type_arguments())
                elif self.tok.kind == "name":
                    n.add("implements", self.identifier(True))
                elif self.at(",", "."):
                    self.next()
                else:
                    raise SyntaxFailure(f"unexpected {self.tok.text!r}")
        b = Node("ClassBody", self.need("{").start)
        while not self.at("}"):
            if not self.eat(";"):
                b.add("body", self.member())
        self.need("}")
        return self.done(n.add("body", self.done(b)))

    def member(self) -> Node:
        start, ds = self.tok.start, self.decorators()
        n = Node("ClassProperty", start).add("decorators", ds)
        accessor = False
        while self.tok.kind == "name" and self.tok.text in _MODIFIERS or self.at("*"):
            p = self.peek()
            if not self.at("*") and (p.text in ("(", "=", ";", "}", "?", "!", ":", "<", ",") and p.kind == "punct" or p.kind == "end"):
                break
            if self.at("static") and p.text == "{":
                self.next()
                n.type = "StaticBlock"
                return self.done(n.add("body", self.function_body().all("body")))
            word = self.tok.text
            if word in ("async", "get", "set", "accessor", "declare") and p.newline:
                break
            self.next()
            n.is_static |= word == "static"
            accessor |= word == "accessor"
            if word in ("get", "set"):
                n.kind = word
        if self.at("["):  # an index signature of types, or a computed key
            s = self.attempt(self.index_signature)
            if s is not None:
                return s
        key, n.computed = self.key()
        n.add("key", key)
        n.name = key.name
        private = key.type == "PrivateName"
        if not self.eat("?"):
            self.eat("!")
        if self.at("(", "<"):
            n.type = "ClassPrivateMethod" if private else "ClassMethod"
            if n.kind is None:
                n.kind = "constructor" if not n.is_static and not n.computed and (key.name == "constructor" or key.value == "constructor") else "method"
            n = self.rest_of_function(n)
            if not n.has_body:
                n.type = "TSDeclareMethod"
            return n
        n.type = "ClassAccessorProperty" if accessor else "ClassPrivateProperty" if private else "ClassProperty"
        n.kind = None
        n.add("typeAnnotation", self.annotation(("=", ";")))
        if self.eat("="):
            n.add("value", self.assignment())
        self.semicolon()
        return self.done(n)

    def index_signature(self) -> Node:
        n = Node("TSIndexSignature", self.need("[").start).add("parameters", self.identifier())
        n.add("typeAnnotation", self.annotation(("]",)) or self._fail())
        self.need("]")
        n.add("typeAnnotation", self.annotation((";", ",")))
        self.semicolon()
        return self.done(n)

    def _fail(self) -> Node:
        raise SyntaxFailure(f"unexpected {self.tok.text!r} at {self.tok.start}")

    def key(self) -> tuple[Node, bool]:
        t = self.tok
        if self.eat("["):
            kept, self.no_in = self.no_in, False
            e = self.assignment()
            self.no_in = kept
            self.need("]")
            return e, True
        if t.kind == "private":
            return self.private(), False
        if t.kind in ("string", "number"):
            return self.primary(), False
        return self.identifier(True), False

    def private(self) -> Node:
        t = self.next()
        n = self.leaf("PrivateName", t, name=t.text)
        return n.add("id", self.leaf("Identifier", Token("name", "", t.start + 1, t.end, False), name=t.text[1:]))

    # expressions

    def expression(self) -> Node:
        e = self.assignment()
        if not self.at(","):
            return e
        n = Node("SequenceExpression", e.start).add("expressions", e)
        while self.eat(","):
            n.add("expressions", self.assignment())
        return self.done(n)

    def assignment(self) -> Node:
        t = self.tok
        if t.kind == "name" and t.text == "yield":
            n = Node("YieldExpression", self.next().start)
            self.eat("*")
            if not (self.tok.newline or self.at(")", "]", "}", ",", ";", ":", "in", "of") or self.tok.kind == "end"):
                n.add("argument", self.assignment())
            return self.done(n)
        arrow = self.arrow()
        if arrow is not None:
            return arrow
        left = self.conditional()
        if self.tok.kind == "punct" and self.tok.text in _ASSIGN:
            n = Node("AssignmentExpression", left.start)
            n.operator = self.next().text
            if n.operator == "=" and left.type in ("ObjectExpression", "ArrayExpression"):
                left.type = left.type.replace("Expression", "Pattern")
            return self.done(n.add("left", left).add("right", self.assignment()))
        return left

    def arrow(self) -> Node | None:
        """An arrow function, if one starts here."""
        t = self.tok
        if t.kind == "name" and t.text not in _RESERVED:
            p = self.peek()
            if p.text == "=>" and not p.newline:
                n = Node("ArrowFunctionExpression", t.start).add("params", self.identifier())
                return self.arrow_body(n)
            if t.text == "async" and not p.newline:
                if p.kind == "name" and p.text not in _RESERVED and token(self.src, p.end).text == "=>":
                    n = Node("ArrowFunctionExpression", self.next().start).add("params", self.identifier())
                    return self.arrow_body(n)
                if p.text in ("(", "<") and self.may_be_arrow(p.start):
                    return self.attempt(self.arrow_function)
            return None
        if t.kind == "punct" and (t.text == "(" and self.may_be_arrow(t.start) or t.text == "<"):
            return self.attempt(self.arrow_function)
        return None

    def may_be_arrow(self, start: int) -> bool:
        """Whether what follows the matching parenthesis allows an arrow; each place is looked at once."""
        if self.src[start] == "<":
            return True
        if start not in self.arrows:
            at, depth, spots = start, 0, []
            try:
                while True:
                    t = token(self.src, at)
                    if t.kind == "end":
                        break
                    if t.text == "/" and t.kind == "punct":
                        try:
                            r = regex(self.src, t.start)
                            before = self.src[:t.start].rstrip()[-1:]
                            t = r if before in "(,=:[!&|?{};+-*%<>~^" else t
                        except SyntaxFailure:
                            pass
                    if t.kind == "punct" and t.text == "`":
                        at = self.template_end(t.start)
                        continue
                    if t.kind == "punct" and t.text == "(":
                        spots.append(t.start)
                    elif t.kind == "punct" and t.text == ")":
                        f = token(self.src, t.end)
                        self.arrows.setdefault(spots.pop(), f.text in ("=>", ":") and not (f.text == "=>" and f.newline))
                        if not spots:
                            break
                    at = t.end
                    depth += 1
            except SyntaxFailure:
                pass
            for s in [start, *spots]:
                self.arrows.setdefault(s, True)
        return self.arrows[start]

    def template_end(self, start: int) -> int:
        """Where a template ends, without its parse."""
        i, src = start + 1, self.src
        while i < len(src) and src[i] != "`":
            if src[i] == "\\":
                i += 2
            elif src.startswith("${", i):
                depth, i = 1, i + 2
                while depth and i < len(src):
                    if src[i] in "\"'":
                        i = token(src, i).end
                    elif src[i] == "`":
                        i = self.template_end(i)
                    else:
                        depth += (src[i] == "{") - (src[i] == "}")
                        i += 1
            else:
                i += 1
        return i + 1

    def arrow_function(self) -> Node:
        n = Node("ArrowFunctionExpression", self.tok.start)
        self.eat("async")
        n.add("typeParameters", self.type_arguments())
        self.need("(")
        n.add("params", self.parameters())
        if self.at(":") and not self.plain_arrows:
            n.add("returnType", self.annotation(("=>",), True))
        if not self.at("=>") or self.tok.newline:
            raise SyntaxFailure("not an arrow")
        return self.arrow_body(n)

    def arrow_body(self, n: Node) -> Node:
        self.need("=>")
        n.has_body = True
        n.add("body", self.function_body() if self.at("{") else self.assignment())
        return self.done(n)

    def conditional(self) -> Node:
        e = self.binary(self.unary(), 0)
        if self.at("?"):
            n = Node("ConditionalExpression", e.start).add("test", e)
            self.next()
            kept, self.no_in = self.no_in, False
            here = self.tok, self.last
            c = self.attempt(self.consequent)
            if c is None:  # an arrow function took the colon for that of its return type
                self.tok, self.last, self.no_in = *here, False
                plain, self.plain_arrows = self.plain_arrows, True
                c = self.consequent()
                self.plain_arrows = plain
            n.add("consequent", c)
            self.no_in = kept
            self.need(":")
            return self.done(n.add("alternate", self.assignment()))
        return e

    def consequent(self) -> Node:
        e = self.assignment()
        if not self.at(":"):
            raise SyntaxFailure(f"expected : at {self.tok.start}")
        return e

    def binary(self, left: Node, level: int) -> Node:
        while True:
            t = self.tok
            if t.kind == "name" and t.text in ("as", "satisfies") and not t.newline:
                self.next()
                n = Node("TSAsExpression", left.start).add("expression", left)
                left = self.done(n.add("typeAnnotation", self.skip_type((")", "]", "}", ",", ";", ":", "?", "=", "&&", "||", "??", "as", "satisfies", "===", "!==", "==", "!=", "+", "-", "*", "/", "in", "instanceof", "=>", ">=", "<="))))
                continue
            power = _BINARY.get(t.text, 0) if t.kind in ("punct", "name") else 0
            if power <= level or t.text == "in" and self.no_in:
                return left
            self.next()
            right = self.binary(self.unary(), power - (t.text == "**"))
            n = Node("LogicalExpression" if t.text in ("&&", "||", "??") else "BinaryExpression", left.start)
            n.operator = t.text
            left = self.done(n.add("left", left).add("right", right))

    def unary(self) -> Node:
        t = self.tok
        if t.kind == "punct" and t.text in ("!", "~", "+", "-") or t.kind == "name" and t.text in ("typeof", "void", "delete"):
            n = Node("UnaryExpression", self.next().start)
            n.operator = t.text
            return self.done(n.add("argument", self.unary()))
        if t.kind == "punct" and t.text in ("++", "--"):
            n = Node("UpdateExpression", self.next().start)
            n.operator = t.text
            return self.done(n.add("argument", self.unary()))
        if t.kind == "name" and t.text == "await":
            p = self.peek()
            if p.kind in ("name", "string", "number", "private") and p.text not in ("in", "of", "instanceof") or p.text in ("(", "[", "{", "!", "~", "`", "/", "<", "+", "-") and not p.newline:
                n = Node("AwaitExpression", self.next().start)
                return self.done(n.add("argument", self.unary()))
        e = self.subscripts(self.primary(), False)
        if self.at("++", "--") and not self.tok.newline:
            n = Node("UpdateExpression", e.start)
            n.operator = self.next().text
            return self.done(n.add("argument", e))
        return e

    def arguments(self) -> list[Node]:
        self.need("(")
        kept, self.no_in = self.no_in, False
        out = []
        while not self.at(")"):
            out.append(self.spread_or())
            if self.eat(":"):  # a cast of Flow types inside parentheses is met elsewhere
                raise SyntaxFailure(f"unexpected : at {self.tok.start}")
            if not self.eat(","):
                break
        self.need(")")
        self.no_in = kept
        return out

    def spread_or(self) -> Node:
        t = self.tok
        if self.eat("..."):
            return self.done(Node("SpreadElement", t.start).add("argument", self.assignment()))
        return self.assignment()

    def subscripts(self, e: Node, no_call: bool) -> Node:
        optional = False
        if e.type == "ArrowFunctionExpression":
            return e
        while True:
            t = self.tok
            if t.kind != "punct":
                return e
            if t.text == "?." :
                self.next()
                optional = True
                if self.at("("):
                    n = Node("OptionalCallExpression", e.start).add("callee", e)
                    e = self.done(n.add("arguments", self.arguments()))
                elif self.at("["):
                    e = self.index(e, True)
                else:
                    n = Node("OptionalMemberExpression", e.start).add("object", e)
                    e = self.done(n.add("property", self.private() if self.tok.kind == "private" else self.identifier(True)))
            elif t.text == ".":
                self.next()
                n = Node("OptionalMemberExpression" if optional else "MemberExpression", e.start).add("object", e)
                e = self.done(n.add("property", self.private() if self.tok.kind == "private" else self.identifier(True)))
            elif t.text == "[":
                e = self.index(e, optional)
            elif t.text == "(" and not (no_call and e.type == "ClassExpression"):
                n = Node("OptionalCallExpression" if optional else "CallExpression", e.start).add("callee", e)
                e = self.done(n.add("arguments", self.arguments()))
            elif t.text == "`":
                n = Node("TaggedTemplateExpression", e.start).add("tag", e)
                e = self.done(n.add("quasi", self.template()))
            elif t.text == "!" and self.ts and not t.newline:
                self.next()
                e = self.done(Node("TSNonNullExpression", e.start).add("expression", e))
            elif t.text == "<" and (call := self.attempt(lambda e=e: self.generic_call(e))) is not None:
                e = call
            else:
                return e

    def generic_call(self, e: Node) -> Node:
        types = self.type_arguments()
        if not self.at("(", "`"):
            raise SyntaxFailure("not a call")
        n = Node("CallExpression", e.start).add("callee", e).add("typeParameters", types)
        return self.done(n.add("arguments", self.arguments() if self.at("(") else self.template()))

    def index(self, e: Node, optional: bool) -> Node:
        self.need("[")
        kept, self.no_in = self.no_in, False
        n = Node("OptionalMemberExpression" if optional else "MemberExpression", e.start).add("object", e)
        n.computed = True
        n.add("property", self.expression())
        self.no_in = kept
        self.need("]")
        return self.done(n)

    def primary(self) -> Node:
        t = self.tok
        if t.kind == "number":
            self.next()
            return self.leaf("BigIntLiteral" if t.text.endswith("n") and not t.text.lower().startswith("0x") or t.text.lower().startswith("0x") and t.text.endswith("n") else "NumericLiteral", t, value=t.text, raw=t.text)
        if t.kind == "string":
            self.next()
            return self.leaf("StringLiteral", t, value=unescape(t.text[1:-1]), raw=t.text)
        if t.kind == "private":
            return self.private()
        if t.kind == "punct":
            f = {"(": self.parenthesised, "[": self.array, "{": self.object, "`": self.template, "<": self.markup_or_cast, "/": self.regular, "/=": self.regular}.get(t.text)
            if f:
                return f()
            if t.text == "@":
                ds = self.decorators()
                n = self.class_(False)
                n.children[:0] = [("decorators", d) for d in ds]
                return n
            raise SyntaxFailure(f"unexpected {t.text!r} at {t.start}")
        if t.kind == "end":
            raise SyntaxFailure("unexpected end")
        p = self.peek() if t.text in ("async", "import", "new") else None
        if t.text == "function" or t.text == "async" and p.text == "function" and not p.newline:
            return self.function("FunctionExpression")
        if t.text == "class":
            return self.class_(False)
        if t.text == "new":
            return self.new()
        if t.text == "import":
            self.next()
            if self.eat("."):
                if self.at("meta"):
                    n = Node("MetaProperty", t.start).add("meta", self.leaf("Identifier", t, name="import"))
                    return self.done(n.add("property", self.identifier()))
                self.identifier()
            n = Node("ImportExpression", t.start)
            args = self.arguments()
            return self.done(n.add("source", args[:1]).add("options", args[1:]))
        simple = {"this": "ThisExpression", "super": "Super", "null": "NullLiteral", "true": "BooleanLiteral", "false": "BooleanLiteral"}.get(t.text)
        if simple:
            self.next()
            return self.leaf(simple, t, value=t.text if simple == "BooleanLiteral" else None)
        return self.identifier()

    def regular(self) -> Node:
        t = regex(self.src, self.tok.start)
        self.last = t.end
        self.move(t.end)
        return self.leaf("RegExpLiteral", t, raw=t.text)

    def new(self) -> Node:
        start = self.next().start
        if self.eat("."):
            n = Node("MetaProperty", start).add("meta", self.leaf("Identifier", Token("name", "new", start, start + 3, False), name="new"))
            return self.done(n.add("property", self.identifier()))
        e = self.new() if self.at("new") else self.primary()
        while self.at(".", "["):
            if self.at("["):
                e = self.index(e, False)
            else:
                self.next()
                m = Node("MemberExpression", e.start).add("object", e)
                e = self.done(m.add("property", self.private() if self.tok.kind == "private" else self.identifier(True)))
        n = Node("NewExpression", start).add("callee", e)
        if self.at("<"):
            types = self.attempt(self.type_arguments)
            n.add("typeParameters", types)
        if self.at("("):
            n.add("arguments", self.arguments())
        return self.done(n)

    def parenthesised(self) -> Node:
        self.need("(")
        kept, self.no_in = self.no_in, False
        e = self.expression()
        if self.at(":"):
            n = Node("TypeCastExpression", e.start).add("expression", e)
            e = self.done(n.add("typeAnnotation", self.annotation((")",))))
        self.no_in = kept
        self.need(")")
        return e

    def array(self) -> Node:
        n = Node("ArrayExpression", self.next().start)
        kept, self.no_in = self.no_in, False
        while not self.at("]"):
            if not self.eat(","):
                n.add("elements", self.spread_or())
                if not self.at("]"):
                    self.need(",")
        self.need("]")
        self.no_in = kept
        return self.done(n)

    def object(self) -> Node:
        n = Node("ObjectExpression", self.next().start)
        kept, self.no_in = self.no_in, False
        while not self.at("}"):
            n.add("properties", self.spread_or() if self.at("...") else self.property())
            if not self.eat(","):
                break
        self.need("}")
        self.no_in = kept
        return self.done(n)

    def property(self) -> Node:
        start, kind = self.tok.start, "method"
        self.decorators()
        while self.at("async", "get", "set", "*"):
            p = self.peek()
            if not self.at("*") and p.kind == "punct" and p.text in (",", "}", ":", "(", "=", "<"):
                break
            word = self.next().text
            kind = word if word in ("get", "set") else kind
        n = Node("ObjectProperty", start)
        key, n.computed = self.key()
        n.add("key", key)
        n.name = key.name
        if self.at("(", "<"):
            n.type, n.kind = "ObjectMethod", kind
            return self.rest_of_function(n)
        if self.eat(":"):
            return self.done(n.add("value", self.assignment()))
        if key.type != "Identifier" or n.computed:
            raise SyntaxFailure(f"expected : at {self.tok.start}")
        v = self.leaf("Identifier", Token("name", "", key.start, key.end, False), name=key.name)
        if self.eat("="):  # only where an assignment will make a pattern of the object
            a = Node("AssignmentPattern", start).add("left", v).add("right", self.assignment())
            v = self.done(a)
        return self.done(n.add("value", v))

    def template(self) -> Node:
        n = Node("TemplateLiteral", self.tok.start)
        i, start, quasis, plain = self.tok.start + 1, self.tok.start + 1, 0, True
        src = self.src
        while True:
            if i >= len(src):
                raise SyntaxFailure("unterminated template")
            if src[i] == "\\":
                i += 2
            elif src[i] == "`" or src.startswith("${", i):
                q = Node("TemplateElement", start)
                q.end = i
                n.add("quasis", q)
                quasis += 1
                if src[i] == "`":
                    if plain:
                        n.value = unescape(src[start:i].replace("\r\n", "\n"))
                    self.last = i + 1
                    self.move(i + 1)
                    return self.done(n)
                plain = False
                self.move(i + 2)
                kept, self.no_in = self.no_in, False
                n.add("expressions", self.expression())
                self.no_in = kept
                if not self.at("}"):
                    raise SyntaxFailure(f"expected }} at {self.tok.start}")
                i = start = self.tok.end
            else:
                i += 1

    # markup

    def markup_or_cast(self) -> Node:
        m = self.attempt(self.element)
        if m is not None:
            return m
        n = Node("TSTypeAssertion", self.tok.start).add("typeAnnotation", self.type_arguments())
        return self.done(n.add("expression", self.unary()))

    def element_name(self) -> Node | None:
        """A name with dashes, points and colons; None for a fragment."""
        if self.at(">"):
            return None
        start = i = self.tok.start
        while i < len(self.src) and (self.src[i].isalnum() or self.src[i] in "_$-.:"):
            i += 1
        if i == start:
            raise SyntaxFailure(f"expected a name at {start}")
        n = Node("JSXIdentifier", start)
        n.end, n.name = i, self.src[start:i]
        self.last = i
        self.move(i)
        return n

    def element(self) -> Node:
        start = self.need("<").start
        name = self.element_name()
        n = Node("JSXElement" if name else "JSXFragment", start)
        o = Node("JSXOpeningElement" if name else "JSXOpeningFragment", start).add("name", name)
        if name and self.at("<"):
            o.add("typeParameters", self.type_arguments())
        while not self.at(">", "/"):
            if self.at("{"):
                s = self.next().start
                self.need("...")
                o.add("attributes", Node("JSXSpreadAttribute", s).add("argument", self.assignment()))
                self.need("}")
                continue
            a = Node("JSXAttribute", self.tok.start).add("name", self.element_name() or self._fail())
            if self.at("="):
                i = blank_end(self.src, self.tok.end)
                if self.src[i : i + 1] in ("'", '"'):  # no escapes in here, and lines may end
                    j = self.src.find(self.src[i], i + 1)
                    if j < 0:
                        raise SyntaxFailure("unterminated attribute")
                    v = Node("StringLiteral", i)
                    v.end, v.value, v.raw = j + 1, self.src[i + 1 : j], self.src[i : j + 1]
                    self.last = j + 1
                    self.move(j + 1)
                    a.add("value", v)
                else:
                    self.next()
                    a.add("value", self.container() if self.at("{") else self.element())
            o.add("attributes", self.done(a))
        closed = self.at("/")
        if closed:
            self.next()
        if not self.at(">"):
            raise SyntaxFailure(f"expected > at {self.tok.start}")
        i = self.last = self.tok.end
        n.add("openingElement", self.done(o))
        while not closed:
            i = self.children_of(n, i)
            if self.src.startswith("/", blank_end(self.src, self.tok.end)):
                self.next(), self.next()
                c = self.element_name()
                if (c.name if c else None) != (name.name if name else None):
                    raise SyntaxFailure(f"unbalanced element at {start}")
                if not self.at(">"):
                    raise SyntaxFailure(f"expected > at {self.tok.start}")
                i, closed = self.tok.end, True
                self.last = i
            else:
                n.add("children", self.element())
                i = self.last
        self.last = i
        n.end = i
        self.move_over(i)
        return n

    def move_over(self, i: int) -> None:
        """The token after markup; inside other markup there may be none, and it isn't looked at."""
        try:
            self.move(i)
        except SyntaxFailure:
            self.tok = Token("text", "", i, i, False)

    def children_of(self, n: Node, i: int) -> int:
        """Text and containers from i on, up to the next opening angle."""
        while True:
            start = i
            while i < len(self.src) and self.src[i] not in "<{":
                i += 1
            if i >= len(self.src):
                raise SyntaxFailure("unterminated element")
            if i > start:
                x = Node("JSXText", start)
                x.end, x.value = i, self.src[start:i]
                n.add("children", x)
            self.move(i)
            if self.src[i] == "<":
                return i
            n.add("children", self.container(True))
            i = self.last

    def container(self, text_follows: bool = False) -> Node:
        n = Node("JSXExpressionContainer", self.need("{").start)
        if self.at("}"):
            n.add("expression", Node("JSXEmptyExpression", self.tok.start))
        elif self.at("..."):
            self.next()
            n.add("expression", self.expression())
        else:
            n.add("expression", self.expression())
        if not self.at("}"):
            raise SyntaxFailure(f"expected }} at {self.tok.start}")
        self.last = self.tok.end
        if text_follows:
            self.tok = Token("text", "", self.last, self.last, False)
        else:
            self.move(self.last)
        return self.done(n)


def parse(src: str, extension: str = "js") -> Node:
    """The program of a source text; .ts and .tsx take TypeScript's forms."""
    return Parser(src, extension.lstrip(".") in ("ts", "tsx", "mts", "cts")).program()
