"""Conditions on events, compiled to Columns that are never null.

A matcher is a mapping. All conditions that are set have to hold; the ones on
a value need ``field``. A missing value fails every condition but ``absent``
and ``exists: false``.
"""

from __future__ import annotations

import dataclasses
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.functions import regexes
from sluice.functions.values import Ref, equal_values, want_text
from sluice.schema import severity_number

UNSET: Any = object()


@dataclasses.dataclass
class Matcher:
    always: bool | None = None
    all: list[Matcher] = dataclasses.field(default_factory=list)
    any: list[Matcher] = dataclasses.field(default_factory=list)
    not_: Matcher | None = None
    severity: str = ""
    source: str = ""
    has_tag: str = ""
    field: str = ""
    absent: bool = False
    exists: bool | None = None
    equals: Any = UNSET
    prefix: str = ""
    suffix: str = ""
    contains: str = ""
    regex: str = ""
    in_: list[str] = dataclasses.field(default_factory=list)
    gt: float | None = None
    gte: float | None = None
    lt: float | None = None
    lte: float | None = None

    @staticmethod
    def of(spec: dict | None) -> Matcher | None:
        """Matcher of its mapping; ValueError for unknown keys."""
        if spec is None:
            return None
        known = {f.name.rstrip("_") for f in dataclasses.fields(Matcher)}
        if not isinstance(spec, dict) or (unknown := set(spec) - known):
            raise ValueError(f"unknown conditions: {sorted(unknown) if isinstance(spec, dict) else spec!r}")
        values = {k + "_" if k in ("not", "in") else k: v for k, v in spec.items() if v is not None or k == "equals"}
        for k in ("all", "any"):
            if k in values:
                values[k] = [Matcher.of(m) for m in values[k]]
        if "not_" in values:
            values["not_"] = Matcher.of(values["not_"])
        return Matcher(**values)

    def problems(self) -> list[str]:
        """Everything that keeps the matcher from compiling."""
        found = [p for m in (*self.all, *self.any, *([self.not_] if self.not_ else [])) for p in m.problems()]
        if self.severity:
            try:
                severity_number(self.severity)
            except ValueError as e:
                found.append(str(e))
        if self.regex:
            try:
                regexes.to_java(self.regex)
            except ValueError as e:
                found.append(str(e))
        return found


def compile(m: Matcher | None) -> Column:
    """The matcher as a Column; no matcher is true."""
    if m is None:
        return F.lit(True)
    sure = lambda c: F.coalesce(c, F.lit(False))
    parts: list[Column] = []
    if m.always is False:
        parts.append(F.lit(False))
    parts += [compile(x) for x in m.all]
    if m.any:
        parts.append(reduce(or_, [compile(x) for x in m.any]))
    if m.not_ is not None:
        parts.append(~compile(m.not_))
    if m.severity:
        parts.append(sure(F.col("severity") >= severity_number(m.severity)))
    if m.source:
        parts.append(sure(F.col("source_id") == m.source))
    if m.has_tag:
        parts.append(sure(F.array_contains("tags", m.has_tag)))
    if m.field:
        parts += _on_value(m, Ref(m.field), sure)
    return reduce(and_, parts) if parts else F.lit(True)


def _on_value(m: Matcher, ref: Ref, sure) -> list[Column]:
    found = ref.found()
    if m.absent or m.exists is False:
        return [~found]
    parts = [found]
    if m.equals is not UNSET:
        parts.append(sure(equal_values(ref, m.equals)))
    text = ref.text()
    for value, test in ((m.prefix, text.startswith), (m.suffix, text.endswith), (m.contains, text.contains)):
        if value:
            parts.append(sure(test(value)))
    if m.regex:
        parts.append(sure(text.rlike(regexes.to_java(m.regex))))
    if m.in_:
        parts.append(sure(text.isin([want_text(x) for x in m.in_])))
    bounds = ((m.gt, "__gt__"), (m.gte, "__ge__"), (m.lt, "__lt__"), (m.lte, "__le__"))
    if any(b is not None for b, _ in bounds):
        number = ref.number()
        parts += [sure(getattr(number, op)(float(b))) & ~sure(F.isnan(number)) for b, op in bounds if b is not None]
    return parts
