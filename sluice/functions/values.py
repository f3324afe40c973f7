"""Dynamic values: paths into events, and their text and number readings."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.functions.binding import bind, text
from sluice.schema import PATH_NAMES, SEVERITIES

NUMBER = r"^[+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|(?i:inf|infinity|nan))$"
TEXT_DEPTH = 2


def severity_name(n: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, SEVERITIES)), n), F.lit("unknown"))


def number_sql(t: str) -> str:
    """SQL of the number that the trimmed text ``t`` spells, else null; out-of-range numbers are none."""
    bare = f"regexp_replace(lower({t}), '^[+-]', '')"
    infinite = f"if(startswith({t}, '-'), double('-Infinity'), double('Infinity'))"
    finite = f"if(abs(try_cast({t} AS double)) < double('Infinity'), try_cast({t} AS double), NULL)"
    return f"CASE WHEN NOT {t} RLIKE {text(NUMBER)} THEN NULL WHEN {bare} IN ('inf', 'infinity') THEN {infinite} WHEN {bare} = 'nan' THEN double('NaN') ELSE {finite} END"


def parse_number(value: Column) -> Column:
    """Number that a text spells, else null."""
    return bind(F.trim(value, F.lit(" \t\r\n\f\v")), number_sql("v"))


def digits_sql(d: str) -> str:
    """SQL text of the double ``d`` without exponent: whole numbers without a point, others with the fewest digits."""
    cut = rf"regexp_replace(regexp_replace(cast(try_cast({d} AS decimal(38,18)) AS string), '0+$', ''), r'\.$', '')"
    return f"CASE WHEN isnan({d}) THEN 'NaN' WHEN {d} = rint({d}) AND abs({d}) < 1e38D THEN cast(try_cast({d} AS decimal(38,0)) AS string) WHEN abs({d}) < 1e19D THEN {cut} ELSE cast({d} AS string) END"


def variant_kind(v: Column) -> Column:
    """STRING, BOOLEAN, BIGINT, DOUBLE, DECIMAL(..), OBJECT<..>, ARRAY<..>, VOID, or null."""
    return F.schema_of_variant(v)


def variant_sql(v: str, depth: int) -> str:
    """SQL text of the VARIANT ``v``."""
    kind, string = f"schema_of_variant({v})", f"try_variant_get({v}, '$', 'string')"
    plain = rf"if(contains({string}, '.'), regexp_replace(regexp_replace({string}, '0+$', ''), r'\.$', ''), {string})"
    parts = [f"WHEN {kind} IN ('DOUBLE', 'FLOAT') THEN {digits_sql(f"try_variant_get({v}, '$', 'double')")}", f"WHEN startswith({kind}, 'DECIMAL') THEN {plain}"]
    if depth:
        w, e, m = f"w{depth}", f"e{depth}", f"try_variant_get({v}, '$', 'map<string,variant>')"
        inner = lambda x: f"if({x} IS NULL OR is_variant_null({x}), '<nil>', {variant_sql(x, depth - 1)})"
        parts.append(f"WHEN startswith({kind}, 'ARRAY') THEN concat('[', array_join(transform(try_variant_get({v}, '$', 'array<variant>'), {w} -> {inner(w)}), ' '), ']')")
        entries = f"transform(sort_array(map_keys({m})), k{depth} -> named_struct('k', k{depth}, 'x', element_at({m}, k{depth})))"
        parts.append(f"WHEN startswith({kind}, 'OBJECT') THEN concat('map[', array_join(transform({entries}, {e} -> concat({e}.k, ':', {inner(f'{e}.x')})), ' '), ']')")
    else:
        parts.append(f"WHEN startswith({kind}, 'ARRAY') OR startswith({kind}, 'OBJECT') THEN to_json({v})")
    return f"coalesce(CASE {' '.join(parts)} ELSE {string} END, '')"


def variant_text(value: Column, depth: int = TEXT_DEPTH) -> Column:
    """Text of a VARIANT; a missing or null one is empty. Lists read ``[a b]`` and objects ``map[k:v]``."""
    return bind(value, variant_sql("v", depth))


def variant_number(value: Column) -> Column:
    """Number of a VARIANT: numbers and texts that spell one; null for all else."""
    kind = "schema_of_variant(v)"
    spelled = number_sql("trim(try_variant_get(v, '$', 'string'))")
    return bind(value, f"CASE WHEN {kind} = 'STRING' THEN {spelled} WHEN {kind} IN ('BIGINT', 'DOUBLE', 'FLOAT') OR startswith({kind}, 'DECIMAL') THEN try_variant_get(v, '$', 'double') END")


def text_variant(text: Column) -> Column:
    return text.cast("variant")


def literal_variant(value: object) -> Column:
    """A configured constant as VARIANT."""
    return F.parse_json(F.lit(json.dumps(value)))


def _step(name: str) -> str:
    return "['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"


def attr_at(parts: list[str], attrs: Column | None = None) -> Column:
    """VARIANT below attrs; a whole number also means a place in a list."""
    attrs = F.col("attrs") if attrs is None else attrs
    v = F.try_element_at(attrs, F.lit(parts[0]))
    for p in parts[1:]:
        v = F.coalesce(F.try_variant_get(v, f"${_step(p)}", "variant"), F.try_variant_get(v, f"$[{p}]", "variant")) if p.isdigit() else F.try_variant_get(v, f"${_step(p)}", "variant")
    return v


@dataclass
class Ref:
    """A path of an event: whether it is there, its text and its number."""

    path: str

    @property
    def parts(self) -> list[str]:
        return self.path.split(".")

    @property
    def column(self) -> str | None:
        head = self.parts[0]
        if head == "attrs":
            return "attrs"
        return PATH_NAMES.get(self.path)

    def value(self) -> Column:
        return attr_at(self.parts[1:])

    def found(self) -> Column:
        c = self.column
        if c is None:
            return F.lit(False)
        if c == "attrs" and len(self.parts) > 1:
            v = self.value()
            return v.isNotNull() & ~F.coalesce(F.is_variant_null(v), F.lit(True))
        if c in ("severity", "attrs"):
            return F.lit(True)
        if c == "tags":
            return F.coalesce(F.size("tags") > 0, F.lit(False))
        if c == "timestamp":
            return F.col(c).isNotNull()
        return F.coalesce(F.col(c) != "", F.lit(False))

    def text(self) -> Column:
        c = self.column
        if c is None:
            return F.lit("")
        if c == "attrs":
            if len(self.parts) > 1:
                return variant_text(self.value())
            keys = F.array_sort(F.map_keys("attrs"))
            return F.concat(F.lit("map["), F.array_join(F.transform(keys, lambda k: F.concat(k, F.lit(":"), variant_text(F.element_at(F.col("attrs"), k)))), " "), F.lit("]"))
        if c == "severity":
            return severity_name(F.col("severity"))
        if c == "tags":
            return F.concat(F.lit("["), F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " "), F.lit("]"))
        if c == "timestamp":
            return time_text(F.col(c))
        return F.coalesce(F.col(c), F.lit(""))

    def number(self) -> Column:
        c = self.column
        if c == "attrs" and len(self.parts) > 1:
            return variant_number(self.value())
        if c in (None, "attrs", "severity", "tags", "timestamp"):
            return F.lit(None).cast("double")
        return parse_number(F.col(c))


def time_text(t: Column) -> Column:
    """RFC 3339 in UTC with as many digits as needed."""
    fraction = F.regexp_replace(F.date_format(t, ".SSSSSS"), r"\.?0*$", "")
    return F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("Z"))


def equal_values(ref: Ref, want: object) -> Column:
    """Equal as numbers (to 1e-9) if both are numbers or spell them, else as texts."""
    as_text = ref.text() == want_text(want)
    number = want_number(want)
    if number is None:
        return as_text
    own = ref.number()
    return F.when(own.isNotNull(), F.abs(own - number) < 1e-9).otherwise(as_text)


def want_number(want: object) -> float | None:
    if isinstance(want, bool) or want is None:
        return None
    if isinstance(want, (int, float)):
        return float(want)
    import re

    t = str(want).strip()
    return float(t) if re.match(NUMBER.replace("(?i:", "(?:"), t, re.IGNORECASE) and isinstance(want, str) else None


def want_text(want: object) -> str:
    if want is None:
        return ""
    if isinstance(want, bool):
        return "true" if want else "false"
    if isinstance(want, float):
        if want.is_integer() and abs(want) < 1e18:
            return str(int(want))
        from decimal import Decimal

        return format(Decimal(repr(want)), "f")
    if isinstance(want, list):
        return "[" + " ".join(map(want_text, want)) + "]"
    if isinstance(want, dict):
        return "map[" + " ".join(f"{k}:{want_text(want[k])}" for k in sorted(want)) + "]"
    return str(want)


def set_variant(value: Column, parts: list[str], new: Column) -> Column:
    """``value`` with ``new`` at the path; what is no object on the way becomes one."""
    if not parts:
        return new
    have = F.coalesce(bind(value, "if(startswith(schema_of_variant(v), 'OBJECT'), try_variant_get(v, '$', 'map<string,variant>'), NULL)"), F.create_map().cast("map<string,variant>"))
    inner = set_variant(F.try_element_at(have, F.lit(parts[0])), parts[1:], new)
    return F.to_variant_object(F.map_concat(F.map_filter(have, lambda k, _: k != parts[0]), F.create_map(F.lit(parts[0]), inner)))


def set_attr(attrs: Column, parts: list[str], value: Column) -> Column:
    """The attrs map with ``value`` (VARIANT) at the path."""
    inner = set_variant(F.try_element_at(attrs, F.lit(parts[0])), parts[1:], value)
    return F.map_concat(F.map_filter(attrs, lambda k, _: k != parts[0]), F.create_map(F.lit(parts[0]), inner))
