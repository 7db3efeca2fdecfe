"""Findings: what a rule says about one row.

A ``Case`` couples a rule with its condition. The same list of cases yields the
full findings (with wording) and the bare rule ids a roll-up needs, so a roll-up
never builds a sentence."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import wording

FINDING_DDL = "struct<rule:string,severity:string,message:string,evidence:map<string,string>>"


@dataclass
class Case:
    rule: str
    severity: str
    when: Column
    message: Column | str
    evidence: dict[str, Column] = field(default_factory=dict)


def say(key: str, *values: Column) -> Column:
    return F.format_string(wording.SAY[key], *values) if values else F.lit(wording.SAY[key])


def evidence_map(values: dict[str, Column]) -> Column:
    """Texts by name, absent ones left out."""
    if not values:
        return F.create_map().cast("map<string,string>")
    entries = [F.lit(name) for name in values]
    texts = [value.cast("string") for value in values.values()]
    return F.map_filter(F.map_from_arrays(F.array(*entries), F.array(*texts)), lambda _, v: v.isNotNull())


def _message(case: Case) -> Column:
    return case.message if isinstance(case.message, Column) else say(case.message)


def rule_ids(cases: list[Case], severity: str) -> Column:
    """Sorted distinct rule ids of one severity."""
    hits = [F.when(c.when, F.lit(c.rule)) for c in cases if c.severity == severity]
    if not hits:
        return F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*hits))))


def any_case(cases: list[Case], severity: str) -> Column:
    """Does any case of one severity hold? Plain booleans, for verdicts over many rows."""
    held = F.lit(False)
    for c in cases:
        if c.severity == severity:
            held = held | F.coalesce(c.when, F.lit(False))
    return held


def explode_findings(df: DataFrame, cases: list[Case], keep: list[str]) -> DataFrame:
    """One row per finding: ``keep``, position, rule, severity, rule_text, message, evidence.
    Only the numbers of the cases are exploded; a message or evidence that is not read
    later is never built."""
    held = F.array_compact(F.array(*[F.when(c.when, F.lit(i)) for i, c in enumerate(cases)]))
    long = df.select("*", F.posexplode(held).alias("_pos", "_case"))

    def of_case(value):
        out = F
        for i, case in enumerate(cases):
            out = out.when(F.col("_case") == i, value(case))
        return out

    texts = F.create_map(*[F.lit(x) for kv in wording.RULE_TEXT.items() for x in kv])
    rule = of_case(lambda c: F.lit(c.rule))
    return long.select(
        *keep,
        F.col("_pos").alias("pos"),
        rule.alias("rule"),
        of_case(lambda c: F.lit(c.severity)).alias("severity"),
        F.try_element_at(texts, rule).alias("rule_text"),
        of_case(_message).alias("message"),
        of_case(lambda c: evidence_map(c.evidence)).alias("evidence"),
    )


def union_findings(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def distinct_findings(findings: DataFrame, keys=("bill_id", "drain_id"), order=("trip_id", "pos")) -> DataFrame:
    """The first finding per (rule, message); drain findings (no trip) come first."""
    first = F.min_by(
        F.struct(*[c for c in findings.columns if c not in (*keys, "rule", "message")]),
        F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")) if c != "pos" else F.col(c) for c in order]),
    )
    picked = findings.groupBy(*keys, "rule", "message").agg(first.alias("_f"))
    return picked.select(*keys, "rule", "message", "_f.*")


def first_per_rule(findings: DataFrame, keys=("bill_id", "drain_id"), order=("trip_id", "pos")) -> DataFrame:
    spot = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")) if c != "pos" else F.col(c) for c in order])
    picked = findings.groupBy(*keys, "rule").agg(F.min_by(F.struct("severity", "message"), spot).alias("_f"))
    return picked.select(*keys, "rule", "_f.*")


def reason_for(findings: DataFrame, keys=("bill_id", "drain_id"), order=("trip_id", "pos")) -> DataFrame:
    """The message of the weightiest rule, the earliest finding of it."""
    rank = F.array_position(F.array(*[F.lit(r) for r in wording.REASON_ORDER]), F.col("rule"))
    rank = F.when(rank == 0, F.lit(len(wording.REASON_ORDER) + 1)).otherwise(rank)
    spot = F.struct(
        rank.alias("rank"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")) if c != "pos" else F.col(c) for c in order],
    )
    return findings.groupBy(*keys).agg(F.min_by("message", spot).alias("reason"))
