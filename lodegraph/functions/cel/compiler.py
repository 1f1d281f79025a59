"""Columns for CEL trees. An evaluation error is a null: an absent metric, a check that doesn't fire."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from graphlib import CycleError, TopologicalSorter

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lodegraph.functions.cel.parser import CelError, Node, names, parse
from lodegraph.functions.numeric import exact_log2, finite

_KINDS = ("bool", "int", "float", "text", "list", "map", "null")


@dataclass(frozen=True)
class Typed:
    """A column with the CEL type of its values; ``items`` is the type of a list's elements."""

    column: Column
    kind: str
    items: str = "text"


#: agg(metric, reducer, population) as a column; the caller supplies it.
Aggregate = Callable[[str, str, str], Column]


class _Compiler:
    def __init__(self, scope: Mapping[str, Typed], aggregate: Aggregate | None = None, functions: Mapping[str, Callable[..., Typed]] | None = None, floats: bool = False) -> None:
        self.scope, self.aggregate, self.functions, self.floats = dict(scope), aggregate, functions or {}, floats

    def make(self, node: Node) -> Typed:
        return getattr(self, f"_{node.kind}")(node)

    def _lit(self, node: Node) -> Typed:
        v = node.value
        if v is None:
            return Typed(F.lit(None), "null")
        if isinstance(v, bool):
            return Typed(F.lit(v), "bool")
        if isinstance(v, int):
            # In metric formulas, and next to floats, whole literals are floats.
            return Typed(F.lit(float(v)), "float") if self.floats else Typed(F.lit(v).cast("bigint"), "int")
        return Typed(F.lit(v), "float" if isinstance(v, float) else "text")

    def _name(self, node: Node) -> Typed:
        if node.value not in self.scope:
            raise CelError(f"unknown name {node.value}")
        return self.scope[node.value]

    def _list(self, node: Node) -> Typed:
        items = [self.make(a) for a in node.args]
        kind = items[0].kind if items else "text"
        if any(i.kind != kind for i in items):
            items, kind = [self._float(i) for i in items], "float"
        spark = {"text": "string", "int": "bigint", "float": "double", "bool": "boolean"}.get(kind, "string")
        return Typed(F.array(*[i.column for i in items]).cast(f"array<{spark}>"), "list", kind)

    def _map(self, node: Node) -> Typed:
        return Typed(F.create_map(*[self.make(a).column for a in node.args]), "map", self.make(node.args[1]).kind if node.args else "text")

    def _float(self, t: Typed) -> Typed:
        if t.kind == "float" or t.kind == "null":
            return t
        if t.kind != "int":
            raise CelError(f"a {t.kind} is no number")
        return Typed(t.column.cast("double"), "float")

    def _truth(self, t: Typed) -> Column:
        if t.kind not in ("bool", "null"):
            raise CelError(f"a {t.kind} is no truth value")
        return t.column.cast("boolean")

    def _not(self, node: Node) -> Typed:
        return Typed(~self._truth(self.make(node.args[0])), "bool")

    def _neg(self, node: Node) -> Typed:
        t = self.make(node.args[0])
        if t.kind not in ("int", "float"):
            raise CelError(f"a {t.kind} can't be negated")
        return Typed(-t.column, t.kind)

    def _if(self, node: Node) -> Typed:
        test, yes, no = (self.make(a) for a in node.args)
        if yes.kind != no.kind and {yes.kind, no.kind} <= {"int", "float"}:
            yes, no = self._float(yes), self._float(no)
        if yes.kind != no.kind and "null" not in (yes.kind, no.kind):
            raise CelError("the branches differ in type")
        t = self._truth(test)
        kind = yes.kind if yes.kind != "null" else no.kind
        # An error in the condition is an error of the whole.
        return Typed(F.when(t, yes.column).when(~t, no.column), kind, yes.items)

    def _op(self, node: Node) -> Typed:
        op = node.value
        a, b = (self.make(x) for x in node.args)
        if op in ("&&", "||"):
            # Spark's three-valued logic absorbs an error as CEL does.
            x, y = self._truth(a), self._truth(b)
            return Typed(x & y if op == "&&" else x | y, "bool")
        if op == "in":
            if b.kind == "map":
                return Typed(F.map_contains_key(b.column, a.column), "bool")
            if b.kind != "list":
                raise CelError("'in' needs a list or map")
            return Typed(F.array_contains(b.column, a.column), "bool")
        if op in ("==", "!=", "<", "<=", ">", ">="):
            if {a.kind, b.kind} <= {"int", "float"} and a.kind != b.kind:
                a, b = self._float(a), self._float(b)
            if a.kind != b.kind and "null" not in (a.kind, b.kind):
                if op in ("==", "!="):
                    return Typed(F.lit(op == "!="), "bool")
                raise CelError(f"a {a.kind} can't be compared with a {b.kind}")
            x, y = (finite(a.column), finite(b.column)) if a.kind == b.kind == "float" else (a.column, b.column)
            made = {"==": x == y, "!=": x != y}.get(op) if op in ("==", "!=") else {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
            return Typed(made, "bool")
        if op == "+" and a.kind == b.kind == "text":
            return Typed(F.concat(a.column, b.column), "text")
        if op == "+" and a.kind == b.kind == "list":
            return Typed(F.concat(a.column, b.column), "list", a.items)
        if not {a.kind, b.kind} <= {"int", "float"}:
            raise CelError(f"{op} doesn't take {a.kind} and {b.kind}")
        if a.kind != b.kind:
            # Whole numbers and floats don't mix: an evaluation error, so an absent value.
            return Typed(F.lit(None).cast("double"), "float")
        x, y = a.column, b.column
        if a.kind == "int":
            whole = F.when(y != 0, F.try_subtract(x, F.try_mod(x, y)))
            made = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}.get(op)
            if made:
                return Typed(made(x, y), "int")
            return Typed(F.try_divide(whole, y).cast("bigint") if op == "/" else F.try_mod(x, y), "int")
        if op == "%":
            raise CelError("% takes whole numbers")
        return Typed({"+": x + y, "-": x - y, "*": x * y}.get(op) if op in "+-*" else F.try_divide(x, y), "float")

    def _field(self, node: Node) -> Typed:
        base = self.make(node.args[0])
        if base.kind != "map":
            raise CelError(f"a {base.kind} has no field {node.value}")
        return Typed(F.try_element_at(base.column, F.lit(node.value)), base.items)

    def _index(self, node: Node) -> Typed:
        base, at = (self.make(a) for a in node.args)
        if base.kind == "map":
            return Typed(F.try_element_at(base.column, at.column), base.items)
        if base.kind != "list" or at.kind not in ("int", "float"):
            raise CelError("only lists and maps have elements")
        return Typed(F.when(at.column >= 0, F.try_element_at(base.column, at.column.cast("int") + 1)), base.items)

    def _call(self, node: Node) -> Typed:
        name, args = node.value, node.args
        if name in self.functions:
            return self.functions[name](*[self.make(a) for a in args])
        if name == "has":
            try:
                return Typed(self.make(args[0]).column.isNotNull(), "bool")
            except CelError:
                return Typed(F.lit(False), "bool")
        if name == "agg":
            texts = [a.value for a in args if a.kind == "lit" and isinstance(a.value, str)]
            if self.aggregate is None or len(texts) != len(args) or len(args) not in (2, 3):
                raise CelError("agg takes the texts of a metric, a reducer and a population")
            return Typed(self.aggregate(*texts, *["not_empty"] * (3 - len(texts))), "float")
        made = [self.make(a) for a in args]
        if name in ("log2", "ln", "log10", "sqrt", "sin", "cos", "abs"):
            x = self._float(made[0]).column
            # What has no finite result is an error, so an absent value.
            return Typed({"log2": exact_log2, "ln": F.ln, "log10": F.log10, "sqrt": F.sqrt, "sin": F.sin, "cos": F.cos, "abs": F.abs}[name](x), "float")
        if name == "pow":
            return Typed(F.pow(self._float(made[0]).column, self._float(made[1]).column), "float")
        if name in ("min2", "max2", "min", "max"):
            if len(made) == 1 and made[0].kind == "list":
                return Typed((F.array_min if name == "min" else F.array_max)(made[0].column), made[0].items)
            columns = [self._float(t).column for t in made]
            some = (F.least if name.startswith("min") else F.greatest)(*columns) if len(columns) > 1 else columns[0]
            absent = columns[0].isNull()
            for c in columns[1:]:
                absent = absent | c.isNull()
            return Typed(F.when(~absent, some), "float")
        if name == "size":
            return self._size(made[0])
        if name == "double":
            return Typed(made[0].column.try_cast("double"), "float")
        if name in ("int", "uint"):
            return Typed(made[0].column.try_cast("bigint"), "int")
        if name == "string":
            return Typed(made[0].column.cast("string"), "text")
        if name == "bytes":
            return Typed(F.encode(made[0].column, "UTF-8"), "text")
        if name == "matches" and len(args) == 2:
            return self._matches(made[0], args[1])
        if name == "contains" and len(args) == 2:
            return self._method(Node("method", name, args))
        raise CelError(f"unknown function {name}")

    def _size(self, t: Typed) -> Typed:
        if t.kind == "text":
            return self._counted(F.octet_length(t.column))
        if t.kind in ("list", "map"):
            return self._counted(F.when(t.column.isNotNull(), F.size(t.column)))
        raise CelError(f"a {t.kind} has no size")

    def _counted(self, column: Column) -> Typed:
        return Typed(column.cast("double"), "float") if self.floats else Typed(column.cast("bigint"), "int")

    def _matches(self, subject: Typed, pattern: Node) -> Typed:
        if pattern.kind != "lit" or not isinstance(pattern.value, str):
            raise CelError("matches takes a literal pattern")
        if not _compiles(pattern.value):
            return Typed(F.lit(None).cast("boolean"), "bool")  # a bad pattern never fires
        return Typed(subject.column.rlike(pattern.value), "bool")

    def _method(self, node: Node) -> Typed:
        name, (target, *args) = node.value, node.args
        base = self.make(target)
        if name in ("exists", "all", "exists_one", "filter", "map"):
            if base.kind != "list" or len(args) < 2 or args[0].kind != "name":
                raise CelError(f"{name} takes a list, a name and an expression")
            return self._macro(name, base, args)
        if name == "size":
            return self._size(base)
        if name == "matches":
            return self._matches(base, args[0])
        if name in ("contains", "startsWith", "endsWith"):
            other = self.make(args[0])
            if base.kind == "list" and name == "contains":
                return Typed(F.array_contains(base.column, other.column), "bool")
            if base.kind != "text" or other.kind != "text":
                raise CelError(f"{name} takes texts")
            made = {"contains": F.contains, "startsWith": F.startswith, "endsWith": F.endswith}[name]
            return Typed(made(base.column, other.column), "bool")
        if name in ("double", "int", "uint", "string"):
            return self._call(Node("call", name, (target,)))
        if name in ("min", "max"):
            return self._call(Node("call", name, (target,)))
        raise CelError(f"unknown method {name}")

    def _macro(self, name: str, base: Typed, args: list[Node]) -> Typed:
        kinds: list[Typed] = []

        def body(at: int) -> Callable[[Column], Column]:
            def run(item: Column) -> Column:
                inner = _Compiler(self.scope | {args[0].value: Typed(item, base.items)}, self.aggregate, self.functions, self.floats)
                kinds.append(inner.make(args[at]))
                return kinds[-1].column

            return run

        if name == "exists":
            return Typed(F.exists(base.column, body(1)), "bool")
        if name == "all":
            return Typed(F.forall(base.column, body(1)), "bool")
        if name == "exists_one":
            return Typed(F.size(F.filter(base.column, body(1))) == 1, "bool")
        if name == "filter":
            return Typed(F.filter(base.column, body(1)), "list", base.items)
        source = F.filter(base.column, body(1)) if len(args) == 3 else base.column
        made = F.transform(source, body(len(args) - 1))
        return Typed(made, "list", kinds[-1].kind)


def _compiles(pattern: str) -> bool:
    """Whether the engine that runs a pattern takes it."""
    session = SparkSession.getActiveSession()
    try:
        session._jvm.java.util.regex.Pattern.compile(pattern) if session else re.compile(pattern)
    except (re.error, Py4JJavaError, IllegalArgumentException):
        return False
    return True


def compile_metric(source: str, scope: Mapping[str, Column], texts: Mapping[str, Column] | None = None, aggregate: Aggregate | None = None) -> Column:
    """A metric formula as a double column: all inputs are floats; null where the formula fails or isn't finite."""
    typed = {k: Typed(v.cast("double"), "float") for k, v in scope.items()} | {k: Typed(v, "text") for k, v in (texts or {}).items()}
    made = _Compiler(typed, aggregate, floats=True).make(parse(source))
    if made.kind not in ("float", "int", "null"):
        raise CelError(f"a metric is a number, not a {made.kind}")
    return finite(made.column.cast("double"))


def compile_check(source: str, scope: Mapping[str, Typed], aggregate: Aggregate | None = None, functions: Mapping[str, Callable[..., Typed]] | None = None) -> Column:
    """A predicate as a boolean column that is false where it fails or isn't a truth value."""
    made = _Compiler(scope, aggregate, functions).make(parse(source))
    if made.kind != "bool":
        return F.lit(False)
    return F.coalesce(made.column, F.lit(False))


def topological(formulas: Mapping[str, str]) -> list[str]:
    """The order in which formulas that read each other can be computed; a cycle is an error."""
    graph = {k: sorted((names(parse(f)) & formulas.keys()) - {k} | ({k} if k in names(parse(f)) else set())) for k, f in sorted(formulas.items())}
    try:
        return list(TopologicalSorter(graph).static_order())
    except CycleError as e:
        raise CelError(f"formulas read each other: {' -> '.join(e.args[1])}") from e
