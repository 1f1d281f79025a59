"""A compiler of CEL formulas and predicates to Spark columns."""

from lodegraph.functions.cel.compiler import CelError, compile_check, compile_metric, topological
from lodegraph.functions.cel.parser import expand_defs, interpolate, parse

__all__ = ["CelError", "compile_check", "compile_metric", "expand_defs", "interpolate", "parse", "topological"]
