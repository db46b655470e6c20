"""The pattern language: tokens, syntax tree and parser."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


class QueryError(ValueError):
    """A query that can't be read or planned."""


@dataclass
class NodePattern:
    var: str | None
    labels: list[str]
    props: dict[str, tuple]


@dataclass
class RelPattern:
    var: str | None
    types: list[str]
    props: dict[str, tuple]
    way: str  # out, in or both


@dataclass
class Path:
    nodes: list[NodePattern]
    rels: list[RelPattern]


@dataclass
class Projection:
    items: list[tuple[tuple, str | None]]
    distinct: bool = False
    order: list[tuple[tuple, bool]] = field(default_factory=list)
    skip: tuple | None = None
    limit: tuple | None = None
    where: tuple | None = None
    final: bool = False


@dataclass
class Match:
    paths: list[Path]
    where: tuple | None = None
    optional: bool = False


@dataclass
class Create:
    paths: list[Path]


@dataclass
class SetProps:
    items: list[tuple[str, str, tuple]]


@dataclass
class Delete:
    names: list[str]


@dataclass
class Unwind:
    expr: tuple
    var: str


@dataclass
class Call:
    name: str
    args: list[tuple]
    wanted: list[str]


TOKEN = re.compile(
    r"""\s+|(?P<number>\d+\.\d+|\d+)|(?P<string>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(?P<param>\$\w+)|(?P<name>[A-Za-z_]\w*|`[^`]+`)
    |(?P<sign><>|<=|>=|<-|->|[-+*/=<>()\[\]{},.:;|])""",
    re.X | re.S,
)
UNSUPPORTED = {"MERGE", "REMOVE", "DETACH", "LOAD"}
LARGEST = (1 << 63) - 1


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise QueryError(f"unexpected {text[at]!r} at {at}")
        at = m.end()
        if m.lastgroup:
            out.append((m.lastgroup, m[m.lastgroup]))
    return [*out, ("end", "")]


class Parser:
    def __init__(self, text: str) -> None:
        self.tokens, self.at = tokens(text), 0

    def peek(self, *words: str) -> bool:
        kind, text = self.tokens[self.at]
        return (text.upper() if kind == "name" else text) in words and kind in ("name", "sign")

    def take(self, *words: str) -> bool:
        if self.peek(*words):
            self.at += 1
            return True
        return False

    def need(self, word: str) -> None:
        if not self.take(word):
            raise QueryError(f"expected {word!r}, found {self.tokens[self.at][1] or 'the end'!r}")

    def name(self) -> str:
        kind, text = self.tokens[self.at]
        if kind != "name":
            raise QueryError(f"expected a name, found {text or 'the end'!r}")
        self.at += 1
        return text.strip("`")

    def some(self, one, sep: str = ",") -> list:
        out = [one()]
        while self.take(sep):
            out.append(one())
        return out

    # clauses

    def query(self) -> list:
        out: list = []
        while self.tokens[self.at][0] != "end":
            if self.take(";"):
                continue
            out.append(self.clause())
        if not out:
            raise QueryError("empty query")
        return out

    def clause(self):
        word = self.tokens[self.at][1].upper()
        if word in UNSUPPORTED:
            raise QueryError(f"{word} is not supported")
        if self.take("OPTIONAL"):
            self.need("MATCH")
            return self.match(True)
        if self.take("MATCH"):
            return self.match(False)
        if self.take("CREATE"):
            return Create(self.some(self.path))
        if self.take("SET"):
            return SetProps(self.some(self.assignment))
        if self.take("DELETE"):
            return Delete(self.some(self.name))
        if self.take("UNWIND"):
            expr = self.expr()
            self.need("AS")
            return Unwind(expr, self.name())
        if self.take("WITH"):
            return self.projection(False)
        if self.take("RETURN"):
            return self.projection(True)
        if self.take("CALL"):
            return self.call()
        raise QueryError(f"unexpected {self.tokens[self.at][1]!r}")

    def match(self, optional: bool) -> Match:
        paths = self.some(self.path)
        return Match(paths, self.expr() if self.take("WHERE") else None, optional)

    def assignment(self) -> tuple[str, str, tuple]:
        var = self.name()
        self.need(".")
        prop = self.name()
        self.need("=")
        return var, prop, self.expr()

    def projection(self, final: bool) -> Projection:
        out = Projection([], final=final, distinct=self.take("DISTINCT"))
        out.items = self.some(self.item)
        if self.take("ORDER"):
            self.need("BY")
            out.order = self.some(self.sort_item)
        if self.take("SKIP"):
            out.skip = self.expr()
        if self.take("LIMIT"):
            out.limit = self.expr()
        if not final and self.take("WHERE"):
            out.where = self.expr()
        return out

    def item(self) -> tuple[tuple, str | None]:
        expr = self.expr()
        return expr, self.name() if self.take("AS") else None

    def sort_item(self) -> tuple[tuple, bool]:
        expr = self.expr()
        return expr, not self.take("DESC", "DESCENDING") and (self.take("ASC", "ASCENDING") or True)

    def call(self) -> Call:
        parts = self.some(self.name, ".")
        if len(parts) != 2 or parts[0] not in ("vector", "kv"):
            raise QueryError(f"unknown procedure {'.'.join(parts)}")
        args = self.arguments()
        return Call(".".join(parts), args, self.some(self.name) if self.take("YIELD") else [])

    def arguments(self) -> list[tuple]:
        self.need("(")
        args = [] if self.peek(")") else self.some(self.expr)
        self.need(")")
        return args

    # patterns

    def path(self) -> Path:
        nodes, rels = [self.node()], []
        while self.peek("-", "<-"):
            rels.append(self.rel())
            nodes.append(self.node())
        return Path(nodes, rels)

    def node(self) -> NodePattern:
        self.need("(")
        var = self.name() if self.tokens[self.at][0] == "name" else None
        labels = []
        while self.take(":"):
            labels.append(self.name())
        props = self.map() if self.peek("{") else {}
        self.need(")")
        return NodePattern(var, labels, props)

    def rel(self) -> RelPattern:
        back = self.take("<-")
        if not back:
            self.need("-")
        var, types, props = None, [], {}
        if self.take("["):
            var = self.name() if self.tokens[self.at][0] == "name" else None
            if self.take(":"):
                types = self.some(lambda: (self.take(":"), self.name())[1], "|")
            props = self.map() if self.peek("{") else {}
            self.need("]")
        if self.take("->"):
            if back:
                raise QueryError("a relationship can't point both ways")
            return RelPattern(var, types, props, "out")
        self.need("-")
        return RelPattern(var, types, props, "in" if back else "both")

    def map(self) -> dict[str, tuple]:
        self.need("{")
        out = {}
        while not self.take("}"):
            key = self.name()
            self.need(":")
            out[key] = self.expr()
            if not self.take(","):
                self.need("}")
                break
        return out

    # expressions, loosest first

    def expr(self) -> tuple:
        left = self.conjunction()
        while self.take("OR"):
            left = ("or", left, self.conjunction())
        return left

    def conjunction(self) -> tuple:
        left = self.negation()
        while self.take("AND"):
            left = ("and", left, self.negation())
        return left

    def negation(self) -> tuple:
        return ("not", self.negation()) if self.take("NOT") else self.comparison()

    def comparison(self) -> tuple:
        left = self.sum()
        for op in ("=", "<>", "<=", ">=", "<", ">"):
            if self.take(op):
                return ("cmp", op, left, self.sum())
        return ("in", left, self.sum()) if self.take("IN") else left

    def sum(self) -> tuple:
        left = self.product()
        while self.peek("+", "-"):
            op = self.tokens[self.at][1]
            self.at += 1
            left = ("math", op, left, self.product())
        return left

    def product(self) -> tuple:
        left = self.primary()
        while self.peek("*", "/"):
            op = self.tokens[self.at][1]
            self.at += 1
            left = ("math", op, left, self.primary())
        return left

    def primary(self) -> tuple:
        kind, text = self.tokens[self.at]
        if self.take("-"):
            return ("neg", self.primary())
        if self.take("("):
            inner = self.expr()
            self.need(")")
            return inner
        if self.take("["):
            items = [] if self.peek("]") else self.some(self.expr)
            self.need("]")
            return ("list", items)
        if self.peek("{"):
            return ("map", self.map())
        self.at += 1
        if kind == "number":
            return ("lit", float(text) if "." in text else min(int(text), LARGEST))
        if kind == "string":
            return ("lit", re.sub(r"\\(.)", r"\1", text[1:-1], flags=re.S))
        if kind == "param":
            return ("param", text[1:])
        if kind == "name":
            if text.upper() in ("TRUE", "FALSE", "NULL"):
                return ("lit", {"TRUE": True, "FALSE": False, "NULL": None}[text.upper()])
            name = text.strip("`")
            if self.take("."):
                prop = self.name()
                return ("call", f"{name}.{prop}", self.arguments()) if self.peek("(") else ("prop", name, prop)
            return ("var", name)
        raise QueryError(f"unexpected {text or 'end'!r}")


def parse(text: str) -> list:
    return Parser(text).query()


def statements(text: str) -> list[str]:
    """Statements that end in semicolons, with // comments left out; neither counts inside a string."""
    parts = re.findall(r"""'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*"|//[^\n]*|;|[^'";/]+|.""", text, re.S)
    out = [""]
    for part in parts:
        if part == ";":
            out.append("")
        elif not part.startswith("//"):
            out[-1] += part
    return [x for x in out if x.strip()]
