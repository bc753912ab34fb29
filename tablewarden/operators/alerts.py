"""Alert gating as table operations: suppression, dedup, routing, formatting, lineage."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.times import before, instant, shift
from tablewarden.operators.lineage import closure
from tablewarden.operators.noise import MAX_WINDOW, MIN_WINDOW, PAIR, window_minutes
from tablewarden.plans.lookups import measured_join
from tablewarden.plans.recent import since

# Severities the paging and webhook channels understand.
PAGER_SEVERITY = {"fail": "critical", "warn": "warning", "info": "info", "ok": "info"}
WEBHOOK_SEVERITY = {"quality": "critical", "volume": "critical", "contract": "critical", "freshness": "warning",
                    "schema": "warning", "distribution": "warning", "finops": "info"}


def active(suppressions: DataFrame, as_of: datetime | str) -> DataFrame:
    return suppressions.filter(F.col("suppressed_until") >= instant(as_of))


def drop_suppressed(alerts: DataFrame, suppressions: DataFrame, as_of: datetime | str) -> DataFrame:
    """Alerts whose table has no suppression running at ``as_of``; alerts without a table pass."""
    muted = active(suppressions, as_of).select("table_name").distinct()
    return measured_join(alerts, muted, ["table_name"], "left_anti")


def list_suppressions(suppressions: DataFrame, as_of: datetime | str, active_only: bool = True) -> DataFrame:
    rows = active(suppressions, as_of) if active_only else suppressions
    return rows.orderBy(F.desc("suppressed_until"), F.desc("id"))


def new_suppressions(requests: DataFrame, as_of: datetime | str) -> DataFrame:
    """Rows to append for requests (id, table_name, minutes, reason)."""
    return requests.select("id", "table_name", shift(instant(as_of), F.col("minutes") * 60).alias("suppressed_until"),
                           "reason", instant(as_of).alias("created_at"))


def without_suppression(suppressions: DataFrame, suppression_id: int) -> DataFrame:
    return suppressions.filter(F.col("id") != suppression_id)


def last_sent(log: DataFrame, as_of: datetime | str, noise: DataFrame | None = None, base_minutes: int = MIN_WINDOW,
              smallest: int = MIN_WINDOW, largest: int = MAX_WINDOW) -> DataFrame:
    """Pairs that are inside their dedup window at ``as_of``, one row per pair.

    No window is longer than the largest one, so only that part of the log is read. Failed sends
    count as well. A pair with a noise record has the window its score gives.
    """
    span = max(base_minutes, largest) if noise is not None else base_minutes
    newest = since(log, "sent_at", before(as_of, span * 60)).groupBy(*PAIR).agg(F.max("sent_at").alias("last_sent_at"))
    if noise is None:
        return newest
    window = noise.select(*PAIR, window_minutes(F.col("noise_score"), smallest, largest).alias("minutes"))
    minutes = F.coalesce("minutes", F.lit(base_minutes))
    return (newest.join(window, PAIR, "left")
            .filter(F.col("last_sent_at") >= shift(instant(as_of), -(minutes * 60))).select(*PAIR, "last_sent_at"))


def drop_repeated(alerts: DataFrame, log: DataFrame, as_of: datetime | str, noise: DataFrame | None = None,
                  **limits: int) -> DataFrame:
    """Alerts whose (table, type) was not logged inside its dedup window."""
    recent = last_sent(log, as_of, noise, **limits).select(*PAIR)
    return measured_join(alerts, recent, PAIR, "left_anti")


@dataclass(frozen=True)
class Route:
    """A routing rule; an absent field matches anything."""

    channel: str
    alert_type: str | None = None
    severity: str | None = None
    table_pattern: str | None = None

    def matches(self) -> Column:
        tests = [F.lit(True)]
        if self.alert_type is not None:
            tests.append(F.col("alert_type") == self.alert_type)
        if self.severity is not None:
            tests.append(F.col("severity") == self.severity)
        if self.table_pattern is not None:
            anchored = "^(?:" + self.table_pattern.replace("*", ".*") + ")$"
            tests.append(F.col("table_name").isNull() | F.col("table_name").rlike(anchored))
        return reduce(lambda a, b: a & b, tests)


def route(alerts: DataFrame, routes: Sequence[Route], default_channel: str = "slack") -> DataFrame:
    """One row per alert and matching rule, in rule order; the default channel if none matches.

    Rules are configuration, so they become predicates of one projection instead of a join.
    """
    hits = F.array_compact(F.array(*[
        F.when(r.matches(), F.struct(F.lit(i).alias("rule"), F.lit(r.channel).alias("channel")))
        for i, r in enumerate(routes, start=1)])) if routes else F.array().cast("array<struct<rule:int,channel:string>>")
    fallback = F.array(F.struct(F.lit(0).alias("rule"), F.lit(default_channel).alias("channel")))
    chosen = F.when(F.size(hits) > 0, hits).otherwise(fallback)
    return alerts.select(*alerts.columns, F.inline(chosen))


def mapped(key: Column, values: dict[str, str], otherwise: str) -> Column:
    out = F.lit(otherwise)
    for k, v in values.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def text(severity: Column, message: Column) -> Column:
    icon = F.when(severity == "fail", "🔴").otherwise("🟠")
    return F.concat(icon, F.lit(" ["), F.upper(severity), F.lit("] "), message)


def format_alerts(alerts: DataFrame) -> DataFrame:
    """Message text, stable incident key and the severities the channels use."""
    key = F.concat_ws(":", F.coalesce("table_name", F.lit("global")), F.coalesce("alert_type", F.lit("unknown")))
    return alerts.withColumns({
        "text": text(F.col("severity"), F.col("message")), "dedup_key": key,
        "pager_severity": mapped(F.col("severity"), PAGER_SEVERITY, "error"),
        "webhook_severity": mapped(F.col("alert_type"), WEBHOOK_SEVERITY, "info")})


def gate(alerts: DataFrame, suppressions: DataFrame, log: DataFrame, as_of: datetime | str,
         routes: Sequence[Route] = (), default_channel: str = "slack", noise: DataFrame | None = None) -> DataFrame:
    """The alerts that go out at ``as_of``, one row per alert and channel.

    Candidates of one pair are judged at the same instant, so only the first of them can pass.
    Keeping that one is a plain aggregate and comes first; the gates then see one row per pair.
    Alerts without a table are not gated.
    """
    rest = [c for c in alerts.columns if c not in PAIR]
    firsts = alerts.filter(F.col("table_name").isNotNull()).groupBy(*PAIR).agg(
        F.min_by(F.struct(*rest), F.struct("raised_at", "id")).alias("r")).select(*PAIR, "r.*").select(*alerts.columns)
    passed = drop_repeated(drop_suppressed(firsts, suppressions, as_of), log, as_of, noise)
    free = alerts.filter(F.col("table_name").isNull())
    return format_alerts(route(passed.unionByName(free), routes, default_channel))


def log_rows(sent: DataFrame, as_of: datetime | str) -> DataFrame:
    """Log rows of the alerts that went out: one per alert, with the last channel used."""
    return sent.groupBy("id").agg(
        F.max_by(F.struct("table_name", "alert_type", "severity", F.col("text").alias("message"), "channel"), "rule").alias("r")
    ).select("id", "r.*", F.lit(True).alias("success"), instant(as_of).alias("sent_at"))


def lineage_impact(tables: DataFrame, edges: DataFrame, depth: int | None = 1) -> DataFrame:
    """Downstream tables of each table, sorted; an empty list for a leaf. Direct ones, those up to ``depth`` edges
    away, or with None all. A table on a cycle is not its own downstream table beyond depth 1."""
    if depth != 1:
        edges = closure(edges, depth).where("table_name <> downstream")
    below = edges.groupBy("table_name").agg(F.array_sort(F.collect_set("downstream")).alias("downstream"))
    joined = tables.select("table_name").distinct().join(below, "table_name", "left")
    return joined.select("table_name", F.coalesce("downstream", F.array().cast("array<string>")).alias("downstream"))
