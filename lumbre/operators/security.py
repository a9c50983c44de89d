"""Detection rules: all of them in one scan, findings, severities and proposal checks."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from lumbre.functions.text import contains_phrase
from lumbre.operators import joins

# Severity of each level (1 is the highest).
SEVERITY = {"critical": 1, "high": 2, "medium": 3, "low": 4}
MAX_COVERAGE = 0.2
TAG = r"^attack\.[a-z0-9_.]+$"


@dataclass(frozen=True)
class Rule:
    """All fields of the selection must hold; a list means any of its values; ``field|contains`` is a phrase in free text."""
    title: str
    level: str
    selection: dict
    tags: tuple[str, ...] = field(default=())


def condition(rule: Rule) -> Column:
    def one(name: str, wanted) -> Column:
        values = list(wanted) if isinstance(wanted, (list, tuple)) else [wanted]
        base, _, modifier = name.partition("|")
        if modifier == "contains":
            return reduce(lambda a, b: a | b, [contains_phrase(F.col(base), v) for v in values])
        return F.col(base).isin(*values)
    return F.coalesce(reduce(and_, [one(n, v) for n, v in rule.selection.items()]), F.lit(False))


def matched_rules(rules: list[Rule]) -> Column:
    """Array of the titles a row matches: every rule looks at the row once."""
    return F.array_compact(F.array(*[F.when(condition(r), F.lit(r.title)) for r in rules]))


@dataclass(frozen=True)
class Correlation:
    """Events of one source followed by events of another within ``minutes``, both of one campaign."""
    title: str
    campaign: str
    left: str
    right: str
    minutes: int


def campaign_correlations(df: DataFrame, correlations: list[Correlation], campaign: str, source: str, ts: str) -> DataFrame:
    """For each correlation that was found: its left events with a right one in the window, pairs, first and last left event.

    Correlations of one window are found in one pass; a row goes in once for each side that it is on.
    """
    def side(these: list[Correlation], which: str) -> DataFrame:
        titles = F.array_compact(F.array(*[F.when((F.col(campaign) == c.campaign) & (F.col(source) == getattr(c, which)), F.lit(c.title)) for c in these]))
        return df.select(F.explode(titles).alias("correlation"), F.col(ts).alias("_at"))

    def found(minutes: int) -> DataFrame:
        these = [c for c in correlations if c.minutes == minutes]
        near = joins.window_matches(side(these, "left"), side(these, "right"), "correlation", "_at", minutes * 60, before=False)
        return near.groupBy("correlation").agg(F.sum("n_left").alias("findings"), F.sum(F.col("n_left") * F.col("n_right")).alias("matches"), F.min("_at").alias("first_at"), F.max("_at").alias("last_at"))
    return reduce(DataFrame.unionByName, [found(m) for m in sorted({c.minutes for c in correlations})])


# The tactics of an attack in the order of its course.
TACTICS = ("Reconnaissance", "Resource Development", "Initial Access", "Execution", "Persistence", "Privilege Escalation", "Defense Evasion", "Credential Access", "Discovery",
           "Lateral Movement", "Collection", "Command and Control", "Exfiltration", "Impact")


def with_techniques(df: DataFrame, column: str, techniques: DataFrame) -> DataFrame:
    """Rows with ``technique``, ``tactic`` and ``stage`` (place of the tactic in the course of an attack, from 1) out of a user's table.

    ``techniques``: value, technique, tactic, one row a value.  Rows without an entry get NULLs.
    """
    stage = F.array_position(F.array(*[F.lit(t) for t in TACTICS]), F.col("tactic"))
    table = techniques.select(F.col("value").alias(column), "technique", "tactic", F.when(stage > 0, stage.cast("int")).alias("stage"))
    return joins.lookup(df, table, column, ["technique", "tactic", "stage"])


def scan(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rows that match something, with ``rules``."""
    hit = reduce(lambda a, b: a | b, [condition(r) for r in rules])
    return df.where(hit).withColumn("rules", matched_rules(rules))


def findings(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per event and rule, with its level and severity."""
    levels = F.create_map(*[F.lit(x) for r in rules for x in (r.title, r.level)])
    severity = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    exploded = scan(df, rules).withColumn("rule", F.explode("rules")).drop("rules")
    return exploded.withColumn("level", levels[F.col("rule")]).withColumn("severity", severity[F.col("level")])


def rule_coverage(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Share of all rows each rule matches, and whether it is rare enough, from one aggregate."""
    one = df.agg(*[F.avg(condition(r).cast("int")).alias(f"r{i}") for i, r in enumerate(rules)])
    rows = F.array(*[F.struct(F.lit(r.title).alias("rule"), F.col(f"r{i}").alias("coverage")) for i, r in enumerate(rules)])
    return one.select(F.explode(rows).alias("x")).select("x.*").withColumn("accepted", F.col("coverage") <= MAX_COVERAGE)


def ungrounded(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Literals of the rules never seen in their field: expected minus found."""
    wanted = [(r.title, n.partition("|")[0], str(v)) for r in rules for n, vs in r.selection.items() if "|" not in n
              for v in (vs if isinstance(vs, (list, tuple)) else [vs])]
    expected = df.sparkSession.createDataFrame(wanted, "rule string, field string, value string")
    by_field: dict[str, set[str]] = {}
    for _, f, v in wanted:
        by_field.setdefault(f, set()).add(v)
    # Only the wanted values leave the scan, already distinct per task.
    cells = F.array(*[F.when(F.col(f).cast("string").isin(*vs), F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")))
                      for f, vs in by_field.items()])
    seen = df.select(F.explode(F.array_compact(cells)).alias("c")).select("c.*").distinct()
    return expected.join(seen, ["field", "value"], "left_anti")


def validate(df: DataFrame, rules: list[Rule], columns: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Rules worth keeping, all of them or the first ``limit``: known level and fields, good tags, grounded values, rare enough."""
    known = set(columns or df.columns)
    well_formed = []
    for r in rules:
        fields = {n.partition("|")[0] for n in r.selection}
        if r.title and r.level in SEVERITY and r.selection and fields <= known and r.title not in {w.title for w in well_formed}:
            well_formed.append(r)
    if not well_formed:
        return df.sparkSession.createDataFrame([], "rule string, level string, tags array<string>, coverage double")
    facts = df.sparkSession.createDataFrame(
        [(i, r.title, r.level, [t for t in r.tags if re.match(TAG, t)]) for i, r in enumerate(well_formed)],
        "position int, rule string, level string, tags array<string>")
    good = rule_coverage(df, well_formed).where("accepted")
    kept = facts.join(good, "rule").join(ungrounded(df, well_formed).select("rule").distinct(), "rule", "left_anti").orderBy("position")
    return (kept.limit(limit) if limit else kept).select("rule", "level", "tags", "coverage")


def month_range(df: DataFrame, ts: str) -> DataFrame:
    """One row: first month with events and the month after the last one."""
    return df.agg(F.date_format(F.min(ts), "yyyy-MM").alias("first_month"),
                  F.date_format(F.add_months(F.max(ts), 1), "yyyy-MM").alias("last_month"))


# Rules over the standard names the parsers give their columns: one per tactic that these sources can show.
SIEM_RULES = [
    Rule("Critical intrusion signature from a known bad source", "critical",
         {"event.category": "intrusion_detection", "event.severity_name": "critical", "threat.matched": True}, ("attack.initial_access", "attack.t1190")),
    Rule("Failed shell login as superuser", "high", {"event.action": "ssh_login", "event.outcome": "failure", "user.name": "root"},
         ("attack.credential_access", "attack.t1110")),
    Rule("Privileged command that reads stored credentials", "critical", {"event.action": "sudo", "threat.technique.id": "T1003"},
         ("attack.credential_access", "attack.t1003")),
    Rule("Outside account made an access key", "high", {"event.action": "createAccessKey", "user.roles": "external"}, ("attack.persistence", "attack.t1098")),
    Rule("Audit trail removed", "critical", {"event.action": ["deleteTracker", "stopTracker"]}, ("attack.defense_evasion", "attack.t1562")),
    Rule("Injection into a web form from a known bad source", "high", {"rule.name": ["sqli", "cmdi"], "threat.matched": True},
         ("attack.initial_access", "attack.t1190")),
    Rule("Web shell upload", "critical", {"rule.name": "webshell"}, ("attack.persistence", "attack.t1505.003")),
]
FIREWALL_RULES = [
    Rule("Critical signature stopped by intrusion prevention", "critical", {"event.module": "ips", "event.severity_name": "critical"},
         ("attack.initial_access", "attack.t1190")),
    Rule("Malware stopped", "high", {"event.module": "virus", "event.outcome": "denied"}, ("attack.execution", "attack.t1204")),
    Rule("Denied connection to a remote administration port", "high", {"event.outcome": "denied", "destination.port": [22, 3389, 5900]},
         ("attack.lateral_movement", "attack.t1021")),
    Rule("Forbidden site requested", "medium", {"event.module": "webfilter", "event.outcome": "denied"}, ("attack.command_and_control", "attack.t1071")),
    Rule("Administrator session opened", "low", {"event.module": "system", "event.action": "login"}, ("attack.initial_access", "attack.t1078")),
]
