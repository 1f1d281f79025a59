"""Measured counts of Python files and of their functions, from the standard library's syntax trees."""

from __future__ import annotations

import ast
import io
import tokenize
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from lodegraph.model import INPUTS

_SKIPPED = (tokenize.NEWLINE, tokenize.NL, tokenize.INDENT, tokenize.DEDENT, tokenize.ENDMARKER, tokenize.ENCODING, tokenize.COMMENT)
_WORD_OPERATORS = {"and", "or", "not", "in", "is", "if", "else", "elif", "for", "while", "return", "lambda", "yield", "await", "async", "with", "as", "try", "except", "finally", "raise", "assert", "del", "global", "nonlocal", "import", "from", "def", "class", "pass", "break", "continue"}
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_LOOPS = (ast.For, ast.AsyncFor, ast.While)


def _docstrings(tree: ast.AST) -> set[tuple[int, int]]:
    """Where docstrings begin: they are comments, neither operators nor operands."""
    found = set()
    for node in ast.walk(tree):
        body = getattr(node, "body", None)
        if isinstance(node, (ast.Module, ast.ClassDef, *_FUNCTIONS)) and body and isinstance(body[0], ast.Expr) and isinstance(body[0].value, ast.Constant) and isinstance(body[0].value.value, str):
            found.add((body[0].lineno, body[0].end_lineno or body[0].lineno))
    return found


def _runs(node: ast.BoolOp) -> int:
    """1 for an operator, and 1 for each different operator inside it."""
    inner = [v for v in node.values if isinstance(v, ast.BoolOp)]
    return 1 + sum(_runs(v) for v in inner if type(v.op) is not type(node.op))


def _cognitive(root: ast.AST) -> int:
    """Breaks of the flow: each costs one more for every level it is nested in; plain alternatives cost one. A stack of its own takes trees of any depth."""
    cost, todo = 0, [(root, 0)]
    while todo:
        node, depth = todo.pop()
        for child in ast.iter_child_nodes(node):
            inner = depth
            if isinstance(child, (ast.If, *_LOOPS, ast.ExceptHandler, ast.IfExp)):
                chained = isinstance(child, ast.If) and isinstance(node, ast.If) and node.orelse == [child]
                cost += 1 if chained else depth + 1
                inner = depth if chained else depth + 1
                rest = getattr(child, "orelse", None)
                cost += isinstance(rest, list) and bool(rest) and not (isinstance(child, ast.If) and len(rest) == 1 and isinstance(rest[0], ast.If))
            elif isinstance(child, ast.Try):
                cost += bool(child.finalbody)
            elif isinstance(child, (*_FUNCTIONS, ast.Lambda)):
                inner = depth + 1 if depth or isinstance(child, ast.Lambda) else 0
            elif isinstance(child, ast.BoolOp) and not isinstance(node, ast.BoolOp):
                cost += _runs(child)
            todo.append((child, inner))
    return cost


def _structure(tree: ast.AST, own_space: int) -> dict[str, int]:
    out = dict.fromkeys(("branches", "exits", "args", "closures"), 0) | {"spaces": own_space}
    for node in ast.walk(tree):
        if isinstance(node, (*_FUNCTIONS, ast.ClassDef)):
            out["spaces"] += 1
        if isinstance(node, ast.Lambda):
            out["closures"] += 1
        if isinstance(node, (*_FUNCTIONS, ast.Lambda)):
            a = node.args
            out["args"] += len(a.posonlyargs) + len(a.args) + len(a.kwonlyargs) + (a.vararg is not None) + (a.kwarg is not None)
        out["exits"] += isinstance(node, (ast.Return, ast.Raise))
        out["branches"] += isinstance(node, (ast.If, ast.IfExp, ast.ExceptHandler, ast.Assert, *_LOOPS))
        out["branches"] += len(node.values) - 1 if isinstance(node, ast.BoolOp) else 0
        out["branches"] += len(node.ifs) + 1 if isinstance(node, ast.comprehension) else 0
        out["branches"] += bool(node.orelse) if isinstance(node, _LOOPS) else 0
    return out


def _counts(tree: ast.AST, tokens: list[tokenize.TokenInfo], first: int, last: int, own_space: int) -> dict[str, float]:
    docs = _docstrings(tree)
    operators, operands, code, comments = [], [], set(), set()
    for t in tokens:
        if not first <= t.start[0] <= last:
            continue
        if t.type == tokenize.COMMENT:
            comments.add(t.start[0])
        elif t.type == tokenize.STRING and any(a <= t.start[0] <= b for a, b in docs):
            comments.update(range(t.start[0], t.end[0] + 1))
        elif t.type not in _SKIPPED:
            code.update(range(t.start[0], t.end[0] + 1))
            if t.type == tokenize.OP and t.string not in ")]}" or t.string in _WORD_OPERATORS:
                operators.append(t.string)
            elif t.type != tokenize.OP:
                operands.append(t.string)
    span = last - first + 1
    only = comments - code
    return {
        "eta1": len(set(operators)), "eta2": len(set(operands)), "n1": len(operators), "n2": len(operands), **_structure(tree, own_space), "cognitive": _cognitive(tree),
        "sloc": len(code), "lloc": sum(isinstance(n, ast.stmt) for n in ast.walk(tree)), "cloc": len(comments), "blank": max(span - len(code) - len(only), 0), "tloc": 0, "span_sloc": span,
    }


def measure_text(text: str | None) -> list[tuple[str, str, int, int, dict[str, float]]]:
    """(unit, kind, first line, last line, counts) of a file and of each function in it; nothing for a text that doesn't parse."""
    try:
        tree = ast.parse(text or "")
        tokens = list(tokenize.generate_tokens(io.StringIO(text or "").readline))
    except (SyntaxError, ValueError, RecursionError, tokenize.TokenError, MemoryError):
        return []
    lines = max((text or "").count("\n") + (not (text or "").endswith("\n")), 1)
    out = [("", "file", 1, lines, _counts(tree, tokens, 1, lines, 1))]
    for node in ast.walk(tree):
        if isinstance(node, _FUNCTIONS):
            kind = "method" if node.args.args and node.args.args[0].arg in ("self", "cls") else "fn"
            last = node.end_lineno or node.lineno
            out.append((f"#{node.name}@{node.lineno}", kind, node.lineno, last, _counts(node, tokens, node.lineno, last, 0)))
    return out


def measure_python(files: DataFrame, by: list[str], id: str = "id", text: str = "text") -> DataFrame:
    """(by, id, kind, parent, start_line, end_line, counts): a row per file, and one per function ``file#name@line`` below it.

    Null and empty texts count as empty files; a file that doesn't parse gives nothing. A text is parsed by itself, in Arrow batches.
    """
    keys = [*by, id]
    types = ", ".join([*(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in by), "id string, kind string, parent string, start_line int, end_line int", *(f"{c} double" for c in INPUTS)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch[[*keys, text]].itertuples(index=False):
                for unit, kind, first, last, counts in measure_text(r[-1]):
                    rows.append((*r[:-2], f"{r[-2]}{unit}", kind, r[-2] if unit else None, first, last, *(float(counts[c]) for c in INPUTS)))
            yield pd.DataFrame(rows, columns=[*by, "id", "kind", "parent", "start_line", "end_line", *INPUTS])

    return files.select(*keys, text).mapInPandas(run, types)
