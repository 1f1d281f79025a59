"""Text of CEL expressions: tokens, syntax trees, macros and message templates."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodegraph.functions.numeric import shown


class CelError(ValueError):
    """A formula that can't be compiled."""


@dataclass(frozen=True)
class Node:
    """kind: lit, name, list, map, op, not, neg, if, call, method, field or index."""

    kind: str
    value: object = None
    args: tuple[Node, ...] = field(default=())


_TOKEN = re.compile(
    r"""\s*(?:(?P<comment>//[^\n]*)|(?P<float>\d+\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+|\.\d+(?:[eE][+-]?\d+)?)|(?P<int>0[xX][\da-fA-F]+|\d+)(?P<uint>[uU])?
    |(?P<text>[rR]?(?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'))|(?P<name>[A-Za-z_]\w*)|(?P<op>\|\||&&|==|!=|<=|>=|[-+*/%<>!?:.,()\[\]{}]))""",
    re.X,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}


def _tokens(source: str) -> list[tuple[str, object]]:
    out, at = [], 0
    source = source.rstrip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise CelError(f"unexpected {source[at:].strip()[:1]!r} at {at}")
        at = m.end()
        if m["float"]:
            out.append(("float", float(m["float"])))
        elif m["int"]:
            out.append(("int", int(m["int"], 0)))
        elif m["text"]:
            raw = m["text"][0] in "rR"
            body = m["text"][2:-1] if raw else m["text"][1:-1]
            out.append(("text", body if raw else re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), body)))
        elif m["name"]:
            out.append(("name", m["name"]))
        elif m["op"]:
            out.append(("op", m["op"]))
    return [*out, ("end", None)]


#: Binary operators from the loosest to the tightest.
_LEVELS = [("||",), ("&&",), ("==", "!=", "<", "<=", ">", ">=", "in"), ("+", "-"), ("*", "/", "%")]


class _Parser:
    def __init__(self, source: str) -> None:
        self.tokens, self.at = _tokens(source), 0

    def next(self) -> tuple[str, object]:
        self.at += 1
        return self.tokens[self.at - 1]

    def take(self, *values: str) -> str | None:
        kind, value = self.tokens[self.at]
        if kind in ("op", "name") and value in values:
            self.at += 1
            return value
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise CelError(f"expected {value!r}, found {self.tokens[self.at][1]!r}")

    def whole(self) -> Node:
        node = self.condition()
        if self.tokens[self.at][0] != "end":
            raise CelError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def condition(self) -> Node:
        test = self.binary(0)
        if not self.take("?"):
            return test
        yes = self.condition()
        self.need(":")
        return Node("if", None, (test, yes, self.condition()))

    def binary(self, level: int) -> Node:
        if level == len(_LEVELS):
            return self.unary()
        left = self.binary(level + 1)
        while op := self.take(*_LEVELS[level]):
            left = Node("op", op, (left, self.binary(level + 1)))
        return left

    def unary(self) -> Node:
        if op := self.take("!", "-"):
            return Node("not" if op == "!" else "neg", None, (self.unary(),))
        return self.postfix(self.primary())

    def postfix(self, node: Node) -> Node:
        while op := self.take(".", "["):
            if op == "[":
                node = Node("index", None, (node, self.condition()))
                self.need("]")
                continue
            kind, name = self.next()
            if kind != "name":
                raise CelError("expected a name after '.'")
            node = Node("method", name, (node, *self.list(")"))) if self.take("(") else Node("field", name, (node,))
        return node

    def list(self, end: str) -> tuple[Node, ...]:
        items = []
        while not self.take(end):
            items.append(self.condition())
            if not self.take(","):
                self.need(end)
                break
        return tuple(items)

    def primary(self) -> Node:
        kind, value = self.next()
        if kind in ("int", "float", "text"):
            return Node("lit", value)
        if kind == "name":
            if value in ("true", "false", "null"):
                return Node("lit", {"true": True, "false": False, "null": None}[value])
            return Node("call", value, self.list(")")) if self.take("(") else Node("name", value)
        if value == "(":
            node = self.condition()
            self.need(")")
            return node
        if value == "[":
            return Node("list", None, self.list("]"))
        if value == "{":
            items: list[Node] = []
            while not self.take("}"):
                items.append(self.condition())
                self.need(":")
                items.append(self.condition())
                if not self.take(","):
                    self.need("}")
                    break
            return Node("map", None, tuple(items))
        raise CelError(f"unexpected {value!r}")


def parse(source: str) -> Node:
    """The syntax tree of a formula."""
    return _Parser(source).whole()


def names(node: Node) -> set[str]:
    """All names that a tree reads."""
    own = {node.value} if node.kind == "name" else set()
    return own.union(*(names(a) for a in node.args)) if node.args else own


def expand_defs(source: str, defs: dict[str, str]) -> str:
    """``source`` with whole-word macros replaced by their text in parentheses, until none is left; a macro in itself is an error."""

    def expand(text: str, open_: tuple[str, ...]) -> str:
        def put(m: re.Match) -> str:
            word = m[0]
            if word not in defs:
                return word
            if word in open_:
                raise CelError(f"macro {word} contains itself")
            return f"({expand(defs[word], (*open_, word))})"

        # Text literals are left alone.
        pieces = re.split(r"""("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')""", text)
        return "".join(p if i % 2 else re.sub(r"(?<![\w.])[A-Za-z_]\w*(?!\w)", put, p) for i, p in enumerate(pieces))

    return expand(source, ())


def interpolate(template: str, value: Callable[[str], Column | None], numeric: Callable[[str], bool]) -> Column:
    """A message with each ``{key}`` replaced by the value; unknown and absent keys stay as they are."""
    pieces = re.split(r"\{([A-Za-z_][\w.]*)\}", template)
    out = []
    for i, piece in enumerate(pieces):
        column = value(piece) if i % 2 else None
        if column is None:
            out.append(F.lit(f"{{{piece}}}" if i % 2 else piece))
        else:
            out.append(F.coalesce(shown(column.cast("double")) if numeric(piece) else column.cast("string"), F.lit(f"{{{piece}}}")))
    return F.concat(*out)
