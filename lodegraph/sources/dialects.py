"""Measured counts of source files by language tables and one lexer: no parser of a language is needed.

A dialect tells comments, texts, keywords and what its functions and branches look like; the counts of
a file, and of each function in it, come from its tokens and the nesting of its brackets. Python has syntax trees, see measure.py.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame

from lodegraph.model import INPUTS
from lodegraph.sources.measure import measure_text as measure_python_text

_OPERATORS = r"<<=|>>=|\.\.\.|\.\.=|===|!==|>>>|\*\*|\?\?=|\?\?|\?\.|&\^=|&\^|:=|<-|=>|->|::|\+\+|--|&&|\|\||[-+*/%&|^<>=!]=|<<|>>|\.\.|[^\s\w]"
_PAIRS = {"(": ")", "[": "]", "{": "}"}
#: Keywords that may also name a function.
_SOFT = frozenset("get set of from async static".split())


@dataclass(frozen=True)
class Dialect:
    """The tables of a language. Words are separated by blanks."""

    name: str
    extensions: tuple[str, ...]
    keywords: str
    #: Words that stand for values.
    values: str = "true false null nil this self super undefined None"
    texts: str = r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`[^`]*`'
    #: Words and signs that branch; words that nest in cognitive complexity; words that leave a function.
    branches: str = "if for while case catch && ||"
    nests: str = "if for while do switch catch"
    exits: str = "return"
    #: Words before a function's name, and before a name that opens a space of its own.
    functions: str = "function"
    spaces: str = ""
    #: Whether a name, round brackets and a block make a function, and at which depth of blocks at most; whether "=>" makes a closure.
    bare: int | None = None
    arrows: bool = False
    #: Whether a line's end ends a statement, parameters share types, and "|…|" begins a closure.
    lines: bool = False
    shared_types: bool = False
    bars: bool = False

    @cached_property
    def lexer(self) -> re.Pattern[str]:
        return re.compile(rf"(?P<c>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|\A#![^\n]*)|(?P<s>{self.texts})|(?P<n>\d[\w.]*)|(?P<w>[^\W\d]\w*)|(?P<o>{_OPERATORS})")

    def words(self, field: str) -> frozenset[str]:
        return frozenset(getattr(self, field).split())


_C_WORDS = "auto break case const continue default do else enum extern for goto if inline register restrict return sizeof static struct switch typedef union volatile"
_JS_WORDS = "async await break case catch class const continue debugger default delete do else export extends finally for from function get if import in instanceof let new of return set static switch throw try typeof var void while with yield"
DIALECTS = (
    Dialect("go", ("go",), "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var", functions="func", nests="if for switch select", lines=True, shared_types=True),
    Dialect("rust", ("rs",), "as async await break const continue dyn else enum extern fn for if impl in let loop match mod move mut pub ref return static struct trait type union unsafe use where while", texts=r'b?r#*"[\s\S]*?"#*|b?"(?:[^"\\]|\\.)*"|b?\'(?:[^\'\\\n]|\\.[^\']{0,8})\'|\'\w+', branches="if for while loop => && || ?", nests="if for while loop match", exits="return ?", functions="fn", spaces="impl trait", bars=True),
    Dialect("js", ("js", "mjs", "cjs", "jsx"), _JS_WORDS, branches="if for while case catch && || ?? ?", exits="return throw", spaces="class", bare=9, arrows=True),
    Dialect("ts", ("ts", "mts", "cts", "tsx"), _JS_WORDS + " abstract as declare enum implements interface is keyof namespace private protected public readonly type", branches="if for while case catch && || ?? ?", exits="return throw", spaces="class", bare=9, arrows=True),
    Dialect("c", ("c", "h", "cc", "cpp", "cxx", "hpp", "hh"), _C_WORDS, branches="if for while case && || ?", bare=0, functions=""),
    Dialect("csharp", ("cs",), "abstract as async await base break case catch class const continue default delegate do else enum event explicit extern finally fixed for foreach goto if implicit in interface internal is lock namespace new operator out override params private protected public readonly record ref return sealed sizeof static struct switch throw try typeof unsafe using virtual void volatile when where while yield", texts=r'\$?@"(?:[^"]|"")*"|\$?"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'', branches="if for foreach while case catch && || ?? ?", nests="if for foreach while do switch catch", exits="return throw", functions="", spaces="class struct interface record", bare=9, arrows=True),
)
BY_EXTENSION = {e: d for d in DIALECTS for e in d.extensions}


class _File:
    """The tokens of a text with the partners of its brackets."""

    def __init__(self, text: str, dialect: Dialect) -> None:
        self.d, self.tokens, self.comments = dialect, [], []
        line, at = 1, 0
        for m in dialect.lexer.finditer(text):
            line += text.count("\n", at, m.start())
            at = m.start()
            last = line + m[0].count("\n")
            (self.comments if m.lastgroup == "c" else self.tokens).append((m.lastgroup, m[0], line, last))
        self.texts = [t[1] for t in self.tokens]
        self.partner, stack, self.depth = {}, [], []
        blocks = 0
        for i, t in enumerate(self.texts):
            if t in _PAIRS and self.tokens[i][0] == "o":
                self.depth.append(blocks)
                blocks += t == "{"
                stack.append(i)
                continue
            if t in ")]}" and self.tokens[i][0] == "o" and stack and _PAIRS[self.texts[stack[-1]]] == t:
                self.partner[stack[-1]] = i
                blocks -= self.texts[stack.pop()] == "{"
            self.depth.append(blocks)

    def text(self, i: int) -> str:
        return self.texts[i] if 0 <= i < len(self.texts) else ""

    def _block(self, i: int, signs: str) -> int | None:
        """The block that follows a head from ``i`` on, before any of the signs."""
        while i < len(self.texts):
            t = self.texts[i]
            if t == "{":
                return i
            if t in signs.split():
                return None
            i = self.partner.get(i, i) + 1
        return None

    def _arguments(self, opens: int) -> int:
        """How many parameters stand in brackets."""
        pieces, i, end = [[]], opens + 1, self.partner.get(opens, opens)
        while i < end:
            if self.texts[i] == ",":
                pieces.append([])
            else:
                pieces[-1].append(self.texts[i])
            i = self.partner.get(i, i) + 1
        pieces = [p for p in pieces if p and p != ["void"]]
        if self.d.shared_types:
            typed = [p for p in pieces if len(p) > 1]
            return len(typed or pieces)
        return len(pieces)

    def units(self) -> list[tuple[str, str, int, int, int]]:
        """(kind, name, first token, last token, arguments) of functions, methods and closures."""
        d, found, keywords = self.d, [], self.d.words("keywords")
        for i, (kind, t, _, _) in enumerate(self.tokens):
            if kind == "w" and t in d.words("functions"):
                at, what, name = i + 1, "fn", ""
                if self.text(at) == "*":
                    at += 1
                if d.name == "go" and self.text(at) == "(":
                    after = self.partner.get(at, at) + 1
                    if self.tokens[after : after + 1] and self.tokens[after][0] == "w" and self.text(after + 1) in "([" and self.text(after) not in keywords:
                        at, what = after, "method"
                if at < len(self.tokens) and self.tokens[at][0] == "w":
                    name, at = self.text(at), at + 1
                if self.text(at) in ("<", "["):
                    while at < len(self.texts) and self.text(at) != "(":
                        at += 1
                if self.text(at) != "(":
                    continue
                block = self._block(self.partner.get(at, at) + 1, ";" if not d.lines else "")
                found.append((what if name else "closure", name, i, self.partner.get(block, block) if block is not None else at, self._arguments(at)))
            elif d.bare is not None and kind == "w" and self.text(i + 1) == "(" and (t not in keywords or t in _SOFT) and self.depth[i] <= d.bare:
                closes = self.partner.get(i + 1)
                if closes is None or self.text(i - 1) in (".", "new", "function", "=", "(", ",", "return", "?."):
                    continue
                block = self._block(closes + 1, "; , ) ] = => . ( && || ? + - * / return")
                if block is not None and (block == closes + 1 or self.text(closes + 1) in (":", "where", "const", "throws")):
                    found.append(("method" if self.depth[i] else "fn", t, i, self.partner.get(block, block), self._arguments(i + 1)))
            elif d.arrows and t == "=>" and kind == "o":
                body = i + 1
                before = next((o for o, c in self.partner.items() if c == i - 1), None) if self.text(i - 1) == ")" else None
                if d.name == "csharp" and before is not None and self.text(before - 1) and self.tokens[before - 1][0] == "w" and self.text(before - 1) not in keywords:
                    continue  # a member with an expression for its body
                if d.name == "csharp" and before is None and self.text(i - 2) not in ("(", ",", "=", "=>", "return", "?", ":", "??"):
                    continue  # a property, or an arm of a switch
                count = self._arguments(before) if before is not None else 1
                found.append(("closure", "", i, self.partner.get(body, body), count))
            elif d.bars and t in ("|", "||") and kind == "o" and (self.text(i - 1) in ("(", ",", "=", "{", ";", "move", "return", "=>", "&&", "")):
                end = i if t == "||" else next((j for j in range(i + 1, min(i + 200, len(self.texts))) if self.texts[j] == "|"), i)
                count = 0 if t == "||" else 1 + sum(x == "," for x in self.texts[i + 1 : end])
                found.append(("closure", "", i, self.partner.get(end + 1, end), count))
        return found

    def _cognitive(self, first: int, last: int, units: list[tuple[str, str, int, int, int]]) -> int:
        d = self.d
        nests, cost, ends, run = d.words("nests"), 0, [], ""
        closures = {u[2]: u[3] for u in units if u[0] == "closure"}
        for i in range(first, last + 1):
            t, kind = self.texts[i], self.tokens[i][0]
            ends = [e for e in ends if e >= i]
            if i in closures and i > first:
                ends.append(closures[i])
            if kind == "w" and t in nests:
                block = self._block(i + 1, "}" if d.lines else "; }")
                if t == "while" and self.text(i - 1) == "}" and (block is None or self.text(self.partner.get(i + 1, i)) + self.text(self.partner.get(i + 1, i) + 1) == ");"):
                    continue  # the end of a do loop
                chained = t == "if" and self.text(i - 1) == "else"
                cost += 1 if chained else 1 + len(ends)
                if block is not None:
                    ends.append(self.partner.get(block, block))
                run = ""
            elif kind == "w" and t == "else" and self.text(i + 1) != "if":
                cost += 1
                block = self._block(i + 1, "; }")
                if block is not None:
                    ends.append(self.partner.get(block, block))
            elif t in ("&&", "||", "??") and kind == "o":
                cost += t != run
                run = t
            elif t in (";", "{", "}") or (d.lines and i and self.tokens[i][2] > self.tokens[i - 1][3]):
                run = ""
        return cost

    def _statements(self, first: int, last: int) -> int:
        """Logical lines: simple statements and those that hold blocks."""
        d, count, i = self.d, 0, first
        if not d.lines:
            loops = [(j, self.partner.get(j + 1, j)) for j in range(first, last + 1) if self.texts[j] == "for" and self.text(j + 1) == "("]
            inside = {k for a, b in loops for k in range(a, b)}
            return sum(self.texts[j] == ";" and j not in inside or self.tokens[j][0] == "w" and self.texts[j] in d.words("nests") | {"try", "match"} for j in range(first, last + 1))
        headed = {"if", "for", "switch", "select"}
        plain = {"return", "go", "defer", "break", "continue", "goto", "fallthrough", "import", "const", "var", "type"}
        begins = True
        while i <= last:
            t = self.texts[i]
            new = i == first or self.tokens[i][2] > self.tokens[i - 1][3] and self.texts[i - 1] not in (",", "(", ".", "=", ":=", "&&", "||", "+", "-", "*", "/")
            if t in ("{", "}", ";"):
                begins = True
                i += 1
                continue
            if begins or new:
                if t in headed:
                    count += 1
                    block = self._block(i + 1, "")
                    head = self.texts[i + 1 : block if block is not None else i + 1]
                    if ";" in head or t != "for":
                        parts = " ".join(head).split(" ; ")
                        count += sum(bool(re.search(r"(?:^| )(?::=|[-+*/%&|^]?=|\+\+|--)(?: |$)", p)) for p in parts) if ";" in head else 0
                    i = block if block is not None else i + 1
                    begins = True
                    continue
                if t in plain:
                    count += 1
                    if t in ("import", "const", "var", "type") and self.text(i + 1) == "(":
                        i = self.partner.get(i + 1, i + 1)
                elif t not in ("package", "func", "case", "default", "else", ")") and self.depth[i] > 0:
                    count += 1
            begins = False
            # What stands in brackets belongs to the statement, but blocks of closures hold their own.
            i = self.partner.get(i, i) + 1 if t in ("(", "[") and "{" not in self.texts[i : self.partner.get(i, i)] else i + 1
        return count

    def counts(self, first: int, last: int, lines: tuple[int, int], own_space: int, units: list[tuple[str, str, int, int, int]]) -> dict[str, float]:
        d = self.d
        keywords, values = d.words("keywords"), d.words("values")
        operators, operands, code = [], [], set()
        for kind, t, a, b in self.tokens[first : last + 1]:
            code.update(range(a, b + 1))
            if kind == "o" and t not in ")]}" or kind == "w" and t in keywords and t not in values:
                operators.append(t)
            elif kind != "o":
                operands.append(t)
        comments = {n for _, _, a, b in self.comments if lines[0] <= a <= lines[1] for n in range(a, b + 1)}
        inner = [u for u in units if first <= u[2] and u[3] <= last]
        texts = [(self.tokens[i][0], self.texts[i]) for i in range(first, last + 1)]
        branches = sum((k in "wo") and t in d.words("branches") for k, t in texts)
        span = lines[1] - lines[0] + 1
        return {
            "eta1": len(set(operators)), "eta2": len(set(operands)), "n1": len(operators), "n2": len(operands),
            "spaces": own_space + len(inner) + sum(k == "w" and t in d.words("spaces") for k, t in texts), "branches": branches,
            "cognitive": self._cognitive(first, last, units), "exits": sum((k in "wo") and t in d.words("exits") for k, t in texts),
            "args": sum(u[4] for u in inner), "closures": sum(u[0] == "closure" for u in inner), "sloc": len(code), "lloc": self._statements(first, last) if last >= first else 0,
            "cloc": len(comments), "blank": max(span - len(code | comments), 0), "tloc": 0, "span_sloc": span,
        }


def measure_text(text: str | None, dialect: Dialect) -> list[tuple[str, str, int, int, dict[str, float]]]:
    """(unit, kind, first line, last line, counts) of a file and of each named function in it; texts are measured whether they are valid or not."""
    text = text or ""
    file = _File(text, dialect)
    units = file.units()
    lines = max(text.count("\n") + (not text.endswith("\n")), 1)
    out = [("", "file", 1, lines, file.counts(0, len(file.tokens) - 1, (1, lines), 1, units))]
    for kind, name, a, b, _ in units:
        if kind != "closure":
            first, last = file.tokens[a][2], file.tokens[b][3]
            out.append((f"#{name}@{first}", kind, first, last, file.counts(a, b, (first, last), 0, units)))
    return out


def measure_sources(files: DataFrame, by: list[str], id: str = "id", text: str = "text", path: str | None = None) -> DataFrame:
    """(by, id, kind, parent, start_line, end_line, counts): a row per file of a known language, by the extension of its path, and one per function ``file#name@line`` below it.

    Null and empty texts count as empty files; files of other languages, and Python files that don't parse, give nothing. A text is measured by itself, in Arrow batches.
    """
    keys = [*by, id]
    where = path or id
    types = ", ".join([*(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in by), "id string, kind string, parent string, start_line int, end_line int", *(f"{c} double" for c in INPUTS)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for *own, name, place, body in batch[[*keys, "_path", text]].itertuples(index=False):
                end = str(place or "").rsplit(".", 1)[-1].lower()
                found = measure_python_text(body) if end == "py" else measure_text(body, BY_EXTENSION[end]) if end in BY_EXTENSION else []
                for unit, kind, first, last, counts in found:
                    rows.append((*own, f"{name}{unit}", kind, name if unit else None, first, last, *(float(counts[c]) for c in INPUTS)))
            yield pd.DataFrame(rows, columns=[*by, "id", "kind", "parent", "start_line", "end_line", *INPUTS])

    return files.select(*keys, files[where].alias("_path"), text).mapInPandas(run, types)
