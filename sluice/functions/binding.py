"""Naming a value inside an expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: str) -> Column:
    """The SQL expression ``body`` with ``v`` standing for a value that is computed once.

    Large expressions are written as SQL text: a Column is put together call by
    call, and copies of one inside another multiply.
    """
    return F.get(F.call_function("transform", F.array(value), F.expr(f"v -> {body}")), 0)


def text(s: str) -> str:
    """A SQL literal of a string, taken as it is."""
    return "r'" + s + "'" if "'" not in s else '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'
