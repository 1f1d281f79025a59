"""The catalog: measured inputs, derived metrics, coupling, concern groups and principles."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Kinds of edges through which control or data flows.
FLOW_KINDS = ("uses",)

# The measured counts of a file.
INPUTS = ("eta1", "eta2", "n1", "n2", "spaces", "branches", "cognitive", "exits", "args", "closures", "sloc", "lloc", "cloc", "blank", "tloc", "span_sloc")


@dataclass(frozen=True)
class Metric:
    key: str
    formula: str
    omit_at: float = 0.0
    higher_better: bool = False
    group: str = "complexity"
    info: float | None = None
    warning: float | None = None


# Formulas of the derived metrics.
DERIVED = (
    Metric("vocabulary", "eta1 + eta2", group="halstead"),
    Metric("length", "n1 + n2", group="halstead"),
    Metric("volume", "vocabulary > 0.0 ? length * log2(vocabulary) : 0.0", group="halstead"),
    Metric("effort", "eta2 > 0.0 ? (eta1 / 2.0) * (n2 / eta2) * volume : 0.0", group="halstead"),
    Metric("time", "effort / 18.0", group="halstead"),
    Metric("bugs", "eta2 > 0.0 ? pow(effort, 2.0 / 3.0) / 3000.0 : 0.0", group="halstead"),
    Metric("cyclomatic", "spaces + branches", omit_at=1.0),
    Metric("mi", "171.0 - 5.2 * ln(volume) - 0.23 * cyclomatic - 16.2 * ln(span_sloc)", higher_better=True, group="maintainability"),
    Metric("mi_sei", "171.0 - 5.2 * log2(volume) - 0.23 * cyclomatic - 16.2 * log2(span_sloc) + 50.0 * sin(sqrt(cloc / span_sloc * 2.4))", higher_better=True, group="maintainability"),
)
# The coupling metric, its counts, the line counts, the metrics with a mean, the kinds of cycles.
HK = Metric("hk", "sloc * pow(fan_in * fan_out, 2.0)", group="coupling")
COUPLING = ("fan_in", "fan_out", "fan_out_external")
#: Counts that say something only about a file with code.
LOC_BLOCK = ("sloc", "lloc", "cloc", "blank")
#: Metrics whose mean over a graph is reported.
STATS = ("blank", "bugs", "cloc", "cognitive", "cyclomatic", "effort", "fan_in", "fan_out", "hk", "length", "mi", "mi_sei", "sloc", "time", "tloc", "vocabulary", "volume")
CYCLES = ("mutual", "chain")


@dataclass(frozen=True)
class MetricDef:
    """A user's metric: a formula per node, or per graph over aggregates."""

    key: str
    formula: str
    scope: str = "node"
    omit_at: float = 0.0
    higher_better: bool = False
    group: str = "custom"
    info: float | None = None
    warning: float | None = None

    def __post_init__(self) -> None:
        # Either threshold defaults to the other.
        object.__setattr__(self, "info", self.warning if self.info is None else self.info)
        object.__setattr__(self, "warning", self.info if self.warning is None else self.warning)


@dataclass(frozen=True)
class CheckDef:
    """A user's check of nodes: fires where ``when`` holds."""

    id: str
    when: str
    message: str
    group: str = "LNT"
    why: str | None = None
    fix: str | None = None


@dataclass(frozen=True)
class Principle:
    """A lens for ranking nodes by one metric."""

    id: str
    sort_metric: str
    label: str = ""
    title: str = ""
    prompt: str = ""
    connections: tuple[str, ...] = field(default=())


def concern(metric: str) -> str:
    """The concern group of a metric's threshold rule."""
    if metric in (*LOC_BLOCK, "tloc", "loc", "span_sloc"):
        return "SIZ"
    return "CPL" if metric in (*COUPLING, "hk") else "CPX"


def parse_cycle_rule(value: bool | int | str) -> int | None:
    """The budget of a cycle kind: 0 for true, None (off) for false, otherwise the number."""
    if isinstance(value, bool):
        return 0 if value else None
    number = int(value)
    if number < 0:
        raise ValueError("a cycle budget can't be negative")
    return number


def merge_principles(base: list[Principle], own: list[Principle]) -> list[Principle]:
    """A project's principles override those of the same id and follow the others."""
    merged = {p.id: p for p in base} | {p.id: p for p in own}
    return list(merged.values())
