"""Ordered rules over events.

Rules run one after the other and see what earlier ones changed. The actions
of a matched rule run in the order drop, sample, redact, tag, set, route,
enrich; a drop or a failed sample ends the event's way. The outcome travels in
columns beside the event (``STATE``).
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.hashing import unsigned_mod, with_roll
from sluice.functions.values import Ref, literal_variant, want_text
from sluice.operators import matchers, redact
from sluice.operators.enrich import Enricher, EnrichSpec, enriched

STATE = {"alive": "boolean", "drop_reason": "string", "drop_rule": "string", "sinks": "array<string>", "redacted": "int", "enriched": "int", "enrich_failed": "int", "matched": "array<string>"}


@dataclass
class Sample:
    every: int = 0
    percent: float = 0.0

    def kept(self, roll: Column) -> Column:
        """The same decision for the same id always. Every first of one keeps all; percentages work in tenths."""
        if self.every >= 1:
            return unsigned_mod(roll, self.every) == 0
        if self.percent >= 100:
            return F.lit(True)
        return unsigned_mod(roll, 1000) < int(self.percent / 100 * 1000)


@dataclass
class SetField:
    path: str
    value: Any = None
    source: str = ""


@dataclass
class Action:
    drop: bool = False
    sample: Sample | None = None
    redact: str = ""
    tag: list[str] = field(default_factory=list)
    set: list[SetField] = field(default_factory=list)
    route: list[str] = field(default_factory=list)
    enrich: EnrichSpec | None = None


@dataclass
class Rule:
    name: str
    match: matchers.Matcher | None
    actions: list[Action]

    @staticmethod
    def of(spec: dict, number: int) -> Rule:
        if unknown := set(spec) - {"name", "match", "actions"}:
            raise ValueError(f"rule {number}: unknown keys {sorted(unknown)}")
        return Rule(spec.get("name") or f"rule-{number}", matchers.Matcher.of(spec.get("match")), [_action(a) for a in spec.get("actions") or []])


def _action(spec: dict) -> Action:
    if unknown := set(spec) - {f.name for f in fields(Action)}:
        raise ValueError(f"unknown actions {sorted(unknown)}")
    listed = lambda x: [x] if isinstance(x, str) else list(x or [])
    sets = spec.get("set") or []
    return Action(
        drop=bool(spec.get("drop")),
        sample=Sample(**spec["sample"]) if spec.get("sample") is not None else None,
        redact=spec.get("redact") or "",
        tag=listed(spec.get("tag")),
        set=[SetField(s["path"], s.get("value"), s.get("from", "")) for s in ([sets] if isinstance(sets, dict) else sets)],
        route=listed(spec.get("route")),
        enrich=EnrichSpec(**spec["enrich"]) if spec.get("enrich") else None,
    )


class InvalidRules(ValueError):
    """Holds every problem of a rule set."""

    def __init__(self, problems: list[str]):
        super().__init__("; ".join(problems))
        self.problems = problems


@dataclass
class Engine:
    """A compiled rule set: a function from events to events with their state."""

    rules: list[Rule]
    sets: dict[str, redact.RuleSet]
    enricher: Enricher | None = None

    @staticmethod
    def of(specs: list[dict], sets: list[dict] | None = None, enricher: Enricher | None = None, sinks: set[str] | None = None) -> Engine:
        """Compile; InvalidRules with all problems if anything is wrong. Route targets are checked if ``sinks`` is given."""
        problems, rules = [], []
        for n, spec in enumerate(specs):
            try:
                rules.append(Rule.of(spec, n))
            except (ValueError, TypeError, KeyError) as e:
                problems.append(f"rule {n}: {e}")
        library = redact.library(sets or [])
        problems += [p for s in library.values() for p in s.problems()]
        names: set[str] = set()
        for r in rules:
            if r.name in names:
                problems.append(f"duplicate rule name {r.name!r}")
            names.add(r.name)
            problems += [f"{r.name}: {p}" for p in (r.match.problems() if r.match else [])]
            for a in r.actions:
                if a.sample and not (a.sample.every > 0 or a.sample.percent > 0):
                    problems.append(f"{r.name}: sample needs every or percent")
                if a.sample and a.sample.percent > 100:
                    problems.append(f"{r.name}: sample percent is over 100")
                if a.redact and a.redact not in library:
                    problems.append(f"{r.name}: unknown redaction set {a.redact!r}")
                if a.enrich and enricher is None:
                    problems.append(f"{r.name}: enrich without an enricher")
                if sinks is not None:
                    problems += [f"{r.name}: unknown sink {s!r}" for s in a.route if s not in sinks]
        if problems:
            raise InvalidRules(problems)
        return Engine(rules, library, enricher)

    def evaluate(self, events: DataFrame) -> DataFrame:
        """``events`` with STATE. Leading rules that only drop become one condition, found before anything is rewritten."""
        df = events.withColumns({"alive": F.lit(True), "redacted": F.lit(0), "enriched": F.lit(0), "enrich_failed": F.lit(0)} | {c: F.lit(None).cast(STATE[c]) for c in ("drop_reason", "drop_rule")} | {c: F.array().cast("array<string>") for c in ("sinks", "matched")})
        if any(a.sample for r in self.rules for a in r.actions):
            df = with_roll(df, "_roll", F.col("id"))
        for rule in self.rules:
            df = self._apply(df, rule)
        return df.drop("_roll")

    def _apply(self, df: DataFrame, rule: Rule) -> DataFrame:
        df = df.withColumn("_m", F.col("alive") & matchers.compile(rule.match))
        df = df.withColumn("matched", F.when(F.col("_m"), F.array_append("matched", F.lit(rule.name))).otherwise(F.col("matched")))
        for a in rule.actions:
            hit = F.col("_m") & F.col("alive")
            if a.drop:
                df = _ended(df, hit, "rule", rule.name)
                hit = F.lit(False)
                continue
            if a.sample:
                df = _ended(df, hit & ~a.sample.kept(F.col("_roll")), "sampled", rule.name)
            hit = F.col("_m") & F.col("alive")
            if a.redact:
                df = redact.apply(df, self.sets[a.redact], hit)
            if a.tag:
                df = df.withColumn("tags", F.when(hit, _union("tags", a.tag)).otherwise(F.col("tags")))
            for s in a.set:
                df = _set(df, s, hit)
            if a.route:
                df = df.withColumn("sinks", F.when(hit, _union("sinks", a.route)).otherwise(F.col("sinks")))
            if a.enrich:
                df = enriched(df, a.enrich, self.enricher, hit)
        return df.drop("_m")


def _union(column: str, new: list[str]) -> Column:
    """Appended if absent; what is there stays as it is, repeats included."""
    extra = F.array_except(F.array_distinct(F.array(*map(F.lit, new))), F.col(column))
    return F.concat(column, extra)


def _ended(df: DataFrame, hit: Column, reason: str, rule: str) -> DataFrame:
    return df.withColumn("_end", hit).withColumns({"drop_reason": F.when(F.col("_end"), reason).otherwise(F.col("drop_reason")), "drop_rule": F.when(F.col("_end"), rule).otherwise(F.col("drop_rule")), "alive": F.col("alive") & ~F.col("_end")}).drop("_end")


def _set(df: DataFrame, s: SetField, hit: Column) -> DataFrame:
    text, variant = F.lit(want_text(s.value)), literal_variant(s.value)
    if s.source:
        ref = Ref(s.source)
        raw = ref.value() if ref.column == "attrs" and len(ref.parts) > 1 else ref.text().cast("variant")
        text, variant = F.when(ref.found(), ref.text()).otherwise(text), F.when(ref.found(), raw).otherwise(variant)
    changes = redact.set_path(s.path, text, variant)
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in changes.items()}) if changes else df


def deliveries(evaluated: DataFrame, default_sinks: list[str], known: list[str]) -> DataFrame:
    """One row for each event and sink it goes to: column sink; ``delivered`` false for a sink that doesn't exist or none at all."""
    targets = F.when(F.size("sinks") > 0, F.col("sinks")).otherwise(F.array(*map(F.lit, default_sinks)).cast("array<string>"))
    out = evaluated.where("alive").withColumn("sink", F.explode_outer(targets))
    known_sink = F.col("sink").isin(known) if known else F.lit(False)
    return out.withColumn("delivered", F.coalesce(known_sink, F.lit(False)))
