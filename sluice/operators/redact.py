"""Redaction rule sets: patterns, whole fields, pseudonyms."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions import regexes
from sluice.functions.binding import bind, text
from sluice.functions.hashing import token
from sluice.functions.values import Ref, set_attr
from sluice.schema import PATH_NAMES

DEPTH = 3
PATTERN_COLUMNS = ("host", "actor", "resource", "category")
WRITABLE = ("id", "host", "category", "actor", "resource", "trace_id", "source_id", "severity")


@dataclass
class Pattern:
    name: str
    regex: str
    replace: str = "[redacted]"


@dataclass
class RuleSet:
    name: str
    patterns: list[Pattern] = field(default_factory=list)
    fields: list[tuple[str, str]] = field(default_factory=list)
    hash_fields: list[str] = field(default_factory=list)
    salt: str = ""

    def problems(self) -> list[str]:
        found = []
        for p in self.patterns:
            if not p.regex:
                found.append(f"{self.name}: pattern {p.name!r} has no regex")
                continue
            try:
                regexes.to_java(p.regex)
            except ValueError as e:
                found.append(f"{self.name}: {e}")
        found += [f"{self.name}: field {path!r} has no replacement" for path, new in self.fields if not new]
        return found

    @staticmethod
    def of(spec: dict, number: int = 0) -> RuleSet:
        patterns = [Pattern(p.get("name", ""), p.get("regex", ""), p.get("replace") or "[redacted]") for p in spec.get("patterns") or []]
        fields_ = [(f.get("path", ""), f.get("replace", "")) for f in spec.get("fields") or []]
        return RuleSet(spec.get("name") or f"set-{number}", patterns, fields_, list(spec.get("hash_fields") or []), spec.get("salt", ""))


# The built-in rule set.
DEFAULT = RuleSet(
    "default",
    [
        Pattern("email", r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", "[redacted:email]"),
        Pattern("card", r"\b(?:\d[ \-]?){13,19}\b", "[redacted:card]"),
        Pattern("bearer", r"(?i)\bbearer\s+[A-Za-z0-9._\-]{8,}", "[redacted:token]"),
        Pattern("aws_key", r"\bAKIA[0-9A-Z]{16}\b", "[redacted:aws-key]"),
        Pattern("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----", "[redacted:private-key]"),
        Pattern("jwt", r"\beyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{5,}\b", "[redacted:jwt]"),
    ],
    [
        ("attrs.password", "[redacted:password]"),
        ("attrs.secret", "[redacted:secret]"),
        ("attrs.token", "[redacted:token]"),
        ("attrs.authorization", "[redacted:auth]"),
        ("attrs.api_key", "[redacted:api-key]"),
    ],
)


def redact_text(value: Column, patterns: list[Pattern]) -> tuple[Column, Column]:
    """The text after all patterns in order, and whether any matched what it saw."""
    both = bind(value, _pair_sql("v", "v", patterns, lambda t: t))
    return both["v"], F.coalesce(both["n"] > 0, F.lit(False))


def _text_sql(t: str, patterns: list[Pattern]) -> tuple[str, str]:
    """SQL of the text after all patterns for the SQL text ``t``, and of whether any matched."""
    hits = []
    for p in patterns:
        java = text(regexes.to_java(p.regex))
        hits.append(f"coalesce({t} RLIKE {java}, false)")
        t = f"regexp_replace({t}, {java}, {text(regexes.replacement(p.replace, p.regex))})"
    return t, "(" + " OR ".join(hits or ["false"]) + ")"


def _any_sql(t: str, patterns: list[Pattern]) -> str:
    """SQL test that holds wherever any pattern matches ``t`` as it is; what no pattern matches, none changes."""
    java = [regexes.to_java(p.regex) for p in patterns]
    if any("(?<" in j.replace("(?<=", "").replace("(?<!", "") for j in java):  # names could clash in one expression
        return "(" + " OR ".join(f"coalesce({t} RLIKE {text(j)}, false)" for j in java) + ")"
    return f"coalesce({t} RLIKE {text('|'.join(f'(?:{j})' for j in java))}, false)" if java else "false"


def _pair_sql(t: str, same: str, patterns: list[Pattern], wrap) -> str:
    """SQL struct (v, n) for the lambda variable ``t``: ``wrap`` of the redacted text and 1 if a pattern matches, else ``same`` and 0."""
    shown, hit = _text_sql(t, patterns)
    return f"if({_any_sql(t, patterns)}, named_struct('v', {wrap(shown)}, 'n', cast({hit} AS int)), named_struct('v', {same}, 'n', 0))"


def variant_sql(v: str, patterns: list[Pattern], depth: int) -> str:
    """SQL struct (v: the VARIANT with every text leaf redacted, n: leaves changed).

    Below ``depth`` levels of lists and objects the patterns run over the JSON
    text of what is left, so nothing escapes them. Texts are tested once, all
    patterns together; only those that match are rewritten.
    """
    once = lambda value, body: f"get(transform(array({value}), t{depth} -> {body}), 0)"
    t, kind = f"t{depth}", f"schema_of_variant({v})"
    own = once(f"try_variant_get({v}, '$', 'string')", _pair_sql(t, v, patterns, lambda x: f"cast({x} AS variant)"))
    parts = [f"WHEN {kind} = 'STRING' THEN {own}"]
    if depth == 0:
        flat = once(f"to_json({v})", _pair_sql(t, v, patterns, lambda x: f"coalesce(try_parse_json({x}), cast({x} AS variant))"))
        parts.append(f"WHEN startswith({kind}, 'ARRAY') OR startswith({kind}, 'OBJECT') THEN {flat}")
    else:
        inner = lambda name: variant_sql(name, patterns, depth - 1)
        items = f"transform(try_variant_get({v}, '$', 'array<variant>'), a{depth} -> {inner(f'a{depth}')})"
        entries = f"transform_values(try_variant_get({v}, '$', 'map<string,variant>'), (k{depth}, b{depth}) -> {inner(f'b{depth}')})"
        pair = lambda value, n: f"named_struct('v', {value}, 'n', cast({n} AS int))"
        listed = pair("to_variant_object(transform(p, q -> q.v))", "aggregate(p, 0, (n, q) -> n + q.n)")
        keyed = pair("to_variant_object(transform_values(p, (k, q) -> q.v))", "aggregate(map_values(p), 0, (n, q) -> n + q.n)")
        parts.append(f"WHEN startswith({kind}, 'ARRAY') THEN get(transform(array({items}), p -> {listed}), 0)")
        parts.append(f"WHEN startswith({kind}, 'OBJECT') THEN get(transform(array({entries}), p -> {keyed}), 0)")
    return f"CASE {' '.join(parts)} ELSE named_struct('v', {v}, 'n', 0) END"


def set_path(path: str, value: Column, variant: Column) -> dict[str, Column]:
    """Columns that change when ``value`` (text) or ``variant`` is written to a path; none if it can't be written."""
    from sluice.operators.normalize import parse_severity

    head, *rest = path.split(".")
    if head == "attrs":
        return {"attrs": set_attr(F.col("attrs"), rest, variant)} if rest else {}
    column = PATH_NAMES.get(path)
    if column == "severity":
        return {"severity": F.coalesce(parse_severity(value), F.col("severity"))}
    return {column: value} if column in WRITABLE else {}


def apply(df: DataFrame, rules: RuleSet, when: Column | None = None, counter: str | None = "redacted") -> DataFrame:
    """Redact where ``when`` holds, counting changed values in ``counter``.

    Patterns first (every text in attrs, then host, actor, resource and
    category), then whole fields, then pseudonyms.
    """
    when = F.lit(True) if when is None else when
    df = df.withColumns({"_go": when, "_n": F.lit(0)})
    go = F.col("_go")
    if rules.patterns:
        # spark_partition_id makes the column one that no filter behind it is pushed through: that would copy the whole expression into the filter
        done = F.when(go & (F.spark_partition_id() >= 0), F.expr(f"transform_values(attrs, (key, v) -> {variant_sql('v', rules.patterns, DEPTH)})"))
        df = df.withColumn("_attrs", done)
        counted = F.aggregate(F.map_values("_attrs"), F.lit(0), lambda n, p: n + p["n"])
        new, hits = {"attrs": F.when(go, F.transform_values("_attrs", lambda _, p: p["v"])).otherwise(F.col("attrs"))}, [F.coalesce(counted, F.lit(0))]
        for c in PATTERN_COLUMNS:
            shown, hit = redact_text(F.col(c), rules.patterns)
            new[c] = F.when(go, shown).otherwise(F.col(c))
            hits.append(hit.cast("int"))
        df = df.withColumns(new | {"_n": F.when(go, reduce(lambda a, b: a + b, hits)).otherwise(0)}).drop("_attrs")
    for path, new_text in rules.fields:
        df = _write(df, path, F.lit(new_text), Ref(path).found())
    for path in rules.hash_fields:
        raw = Ref(path).text()
        df = _write(df, path, token(raw, rules.salt), Ref(path).found() & (raw != ""))
    if counter:
        df = df.withColumn(counter, F.coalesce(F.col(counter), F.lit(0)) + F.col("_n") if counter in df.columns else F.col("_n"))
    return df.drop("_go", "_n")


def _write(df: DataFrame, path: str, value: Column, found: Column) -> DataFrame:
    changes = set_path(path, value, value.cast("variant"))
    if not changes:
        return df
    hit = F.col("_go") & found
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in changes.items()} | {"_n": F.col("_n") + hit.cast("int")})


def library(specs: list[dict]) -> dict[str, RuleSet]:
    """Rule sets by name; ``default`` is the built-in one unless given."""
    sets = {"default": DEFAULT}
    for n, spec in enumerate(specs or []):
        rules = RuleSet.of(spec, n)
        sets[rules.name] = rules
    return sets
