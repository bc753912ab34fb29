"""Contracts and late-arriving data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.operators import arrival as A
from tablewarden.operators import contracts as C
from tablewarden.operators.contracts import ColumnRule, Contract, SqlRule
from tablewarden.queryset.fixtures import EVENTS_AS_OF, LINEITEM_AS_OF, fixture, table, with_
from tablewarden.queryset.registry import query

BROKEN = Contract("shape", "orders", "1.0", (
    ColumnRule("o_orderkey", "integer", nullable=False), ColumnRule("o_channel", "varchar", nullable=False),
    ColumnRule("o_totalprice", "varchar"), ColumnRule("o_orderdate", "timestamp with time zone"),
    ColumnRule("o_orderstatus", "numeric"), ColumnRule("o_custkey", "bigint")))
FULL = Contract("events_v1", "dirty", "1.2.0", (
    ColumnRule("event_id", "integer", nullable=False, unique=True),
    ColumnRule("user_id", "integer", nullable=False, unique=True, allowed_values=tuple(range(0, 140)) + ("x",)),
    ColumnRule("event_type", "varchar", nullable=False, allowed_values=("click", "view", "error", "purchase", "signup")),
    ColumnRule("value", "numeric", min=0, max=300), ColumnRule("ts", "timestamp", nullable=False),
    ColumnRule("currency", "varchar", nullable=False)), 1000, (
    SqlRule("no_future_rows", "SELECT count(*) AS n FROM {dirty} WHERE ts > TIMESTAMP_NTZ '2024-01-31 00:00:00'"),
    SqlRule("null_counts_as_zero", "SELECT min(value) AS m FROM {dirty} WHERE event_type = 'nothing'", "result >= 0"),
    SqlRule("share_with_value", "SELECT count(value) * 100.0 / count(*) AS p FROM {dirty}", "result is None or result >= 90"),
    SqlRule("enough_with_value", "SELECT count(value) * 100.0 / count(*) AS p FROM {dirty}", "result >= 90"),
    SqlRule("not_a_select", "DELETE FROM dirty")))


def rows(spark, sf, contracts, *keep):
    tables = {"orders": table(spark, sf, "orders"), "dirty": fixture(spark, sf, "dirty")}
    out = C.validate(spark, contracts, tables).select("contract_id", "rule", "metric_value", "passed")
    return out.filter(reduce(lambda a, b: a | b, [F.col("rule").startswith(k) for k in keep])) if keep else out


def one(rule, metric, passed, t="dirty", cid="events_v1", tail=""):
    return f"SELECT '{cid}' AS contract_id, '{rule}' AS rule, CAST({metric} AS DOUBLE) AS metric_value, {passed} AS passed FROM {t} {tail}"


def zero(rule, cond, **kw):
    return one(rule, f"count(*) FILTER (WHERE {cond})", f"count(*) FILTER (WHERE {cond}) = 0", **kw)


def dup(rule, c):
    return one(rule, "count(*) FILTER (WHERE n > 1)", "count(*) FILTER (WHERE n > 1) = 0", f"(SELECT count(*) AS n FROM dirty GROUP BY {c})")


def fixed(rule, cid="events_v1"):
    return f"SELECT '{cid}' AS contract_id, '{rule}' AS rule, CAST(NULL AS DOUBLE) AS metric_value, false AS passed"


TYPES = "('click', 'view', 'error', 'purchase', 'signup')"
SQL = {
    "not_null": [zero(f"not_null:{c}", f"{c} IS NULL") for c in ("event_id", "user_id", "event_type", "ts")],
    "unique": [dup(f"unique:{c}", c) for c in ("event_id", "user_id")],
    "allowed": [zero("allowed_values:event_type", f"event_type IS NOT NULL AND event_type NOT IN {TYPES}"),
                zero("allowed_values:user_id", "user_id NOT BETWEEN 0 AND 139")],
    "min": [zero("min_value:value", "value < 0")], "max": [zero("max_value:value", "value > 300")],
    "min_rows": [one("min_rows", "count(*)", "count(*) >= 1000")],
    "sql": [one("no_future_rows", "count(*)", "count(*) = 0", tail="WHERE ts > TIMESTAMP '2024-01-31 00:00:00'"),
            "SELECT 'events_v1', 'null_counts_as_zero', 0.0, true", fixed("share_with_value"),
            one("enough_with_value", "round(count(value) * 100.0 / count(*), 6)", "count(value) * 100.0 / count(*) >= 90"), fixed("not_a_select")],
    "exists": [fixed("column_exists:currency")],
}


def oracle(*kinds):
    return with_("dirty") + " UNION ALL ".join(q for k in kinds for q in SQL[k])


@query("contract_column_exists", " UNION ALL ".join([fixed("column_exists:o_channel", "shape"), zero("not_null:o_orderkey", "o_orderkey IS NULL", t="orders", cid="shape")]))
def contract_column_exists(spark, sf):
    return rows(spark, sf, [BROKEN], "column_exists", "not_null")


@query("contract_column_type", " UNION ALL ".join([fixed("column_type:o_totalprice", "shape"), fixed("column_type:o_orderstatus", "shape"), zero("not_null:o_orderkey", "o_orderkey IS NULL", t="orders", cid="shape")]))
def contract_column_type(spark, sf):
    return rows(spark, sf, [BROKEN], "column_type", "not_null")


@query("contract_not_null", oracle("not_null"))
def contract_not_null(spark, sf):
    return rows(spark, sf, [FULL], "not_null")


@query("contract_unique", oracle("unique"))
def contract_unique(spark, sf):
    return rows(spark, sf, [FULL], "unique")


@query("contract_allowed_values", oracle("allowed"))
def contract_allowed_values(spark, sf):
    return rows(spark, sf, [FULL], "allowed_values")


@query("contract_min", oracle("min"))
def contract_min(spark, sf):
    return rows(spark, sf, [FULL], "min_value")


@query("contract_max", oracle("max"))
def contract_max(spark, sf):
    return rows(spark, sf, [FULL], "max_value")


@query("contract_min_rows", oracle("min_rows"))
def contract_min_rows(spark, sf):
    return rows(spark, sf, [FULL], "min_rows")


@query("contract_sql_rule", oracle("sql"))
def contract_sql_rule(spark, sf):
    out = rows(spark, sf, [FULL], *[r.name for r in FULL.rules])
    return out.withColumn("metric_value", F.round("metric_value", 6))


ABSENT = Contract("ghost", "no_such_table", "0.1")
ALL = " UNION ALL ".join(q for k in SQL.values() for q in k)
SHAPE = " UNION ALL ".join([fixed("column_exists:o_channel", "shape"), fixed("column_type:o_totalprice", "shape"), fixed("column_type:o_orderstatus", "shape"),
                            zero("not_null:o_orderkey", "o_orderkey IS NULL", t="orders", cid="shape"), fixed("schema_fetch", "ghost")])


@query("contract_validate", with_("dirty", r=ALL + " UNION ALL " + SHAPE) + """
    SELECT contract_id, CASE contract_id WHEN 'events_v1' THEN '1.2.0' WHEN 'shape' THEN '1.0' ELSE '0.1' END AS version,
           CASE contract_id WHEN 'events_v1' THEN 'dirty' WHEN 'shape' THEN 'orders' ELSE 'no_such_table' END AS table_name,
           bool_and(passed) AS passed, count(*) AS total_rules, count(*) FILTER (WHERE passed) AS passed_rules,
           string_agg(rule, ',' ORDER BY rule) FILTER (WHERE NOT passed) AS failed_rules FROM r GROUP BY contract_id""")
def contract_validate(spark, sf):
    tables = {"orders": table(spark, sf, "orders"), "dirty": fixture(spark, sf, "dirty")}
    out = C.summarise(C.validate(spark, [FULL, BROKEN, ABSENT], tables))
    return out.withColumn("failed_rules", F.array_join(F.transform("violations", lambda v: v["rule"]), ",")).drop("violations")


@query("contract_results", with_("contract_history") + "SELECT * FROM contract_history WHERE contract_id = 'contract_3' AND table_name = 'view' ORDER BY validated_at DESC, id DESC LIMIT 50")
def contract_results(spark, sf):
    return C.results(fixture(spark, sf, "contract_history"), "contract_3", "view")


@query("contract_freshness", f"""SELECT 'orders' AS table_name, 'o_orderdate' AS timestamp_column, m AS last_updated_at, l AS lag_seconds,
    CASE WHEN l > 7776000 THEN 'fail' WHEN l > 2592000 THEN 'warn' ELSE 'ok' END AS status, TIMESTAMP '{LINEITEM_AS_OF}' AS checked_at
    FROM (SELECT max(o_orderdate) AS m, (epoch_us(TIMESTAMP '{LINEITEM_AS_OF}') - epoch_us(max(o_orderdate))) / 1e6 AS l FROM orders)""")
def contract_freshness(spark, sf):
    promised = Contract("orders_v1", "orders", freshness_column="o_orderdate", freshness_warn="30d", freshness_fail="90d")
    return C.freshness([promised], {"orders": table(spark, sf, "orders")}, LINEITEM_AS_OF)


# ---- late-arriving data ----

SLOTS = f"""SELECT s AS expected_at, lag(s) OVER (ORDER BY s) AS prev_expected_at, lead(s) OVER (ORDER BY s) AS next_at FROM
    (SELECT unnest(generate_series((SELECT date_trunc('day', min(ts)) FROM events) - INTERVAL 40 DAY, TIMESTAMP '{EVENTS_AS_OF}' + INTERVAL 40 DAY, INTERVAL 1 MINUTE)) AS s)
    WHERE {{cond}}"""
ODD_CRON, ODD_COND = "30 6,18 1,15 * 1", "minute(s) = 30 AND hour(s) IN (6, 18) AND (day(s) IN (1, 15) OR dayofweek(s) = 1)"
DAILY_COND = "minute(s) = 0 AND hour(s) = 2"
INSIDE = f"expected_at >= (SELECT min(ts) FROM {{t}}) AND expected_at < TIMESTAMP '{EVENTS_AS_OF}'"


@query("arrival_slots", "WITH s AS (" + SLOTS.format(cond=ODD_COND) + ") SELECT expected_at, prev_expected_at FROM s WHERE " + INSIDE.format(t="events"))
def arrival_slots(spark, sf):
    first = table(spark, sf, "events").agg(F.min("ts")).first()[0]
    return A.slots(spark, ODD_CRON, first, EVENTS_AS_OF)


def arrival_sql(t, name, min_rows, src=None):
    return f"""SELECT '{name}' AS table_name, expected_at, deadline, n AS rows_arrived,
        CASE WHEN n >= {min_rows} THEN NULL WHEN as_of >= deadline THEN (epoch_us(as_of) - epoch_us(deadline)) / 1e6 END AS delay_seconds,
        CASE WHEN n >= {min_rows} THEN 'ok' WHEN as_of >= deadline THEN 'missing' ELSE 'ok' END AS status, as_of AS checked_at
        FROM (SELECT expected_at, expected_at + INTERVAL 60 MINUTE AS deadline, TIMESTAMP '{EVENTS_AS_OF}' AS as_of, count(ts) AS n
              FROM s LEFT JOIN {src or t} ON ts > prev_expected_at AND ts <= expected_at WHERE {INSIDE.format(t=t)} GROUP BY expected_at)"""


@query("arrival_check", with_("arrivals", s=SLOTS.format(cond=DAILY_COND)) + arrival_sql("arrivals", "arrivals", 200))
def arrival_check(spark, sf):
    return A.check(fixture(spark, sf, "arrivals"), "arrivals", "ts", EVENTS_AS_OF, min_rows=200)


@query("arrival_check_grace", with_("arrivals", s=SLOTS.format(cond=DAILY_COND), c=f"""
    SELECT expected_at, expected_at + INTERVAL 60 MINUTE AS deadline, TIMESTAMP '{EVENTS_AS_OF}' AS as_of,
           count(*) FILTER (WHERE ts <= expected_at + INTERVAL 60 MINUTE) AS on_time, count(ts) AS total, max(ts) AS last_ts
    FROM s LEFT JOIN arrivals ON ts > prev_expected_at AND ts <= greatest(next_at, expected_at + INTERVAL 60 MINUTE) AND ts <= TIMESTAMP '{EVENTS_AS_OF}'
    WHERE {INSIDE.format(t='arrivals')} GROUP BY expected_at""") + """
    SELECT 'arrivals' AS table_name, expected_at, deadline, CASE WHEN on_time >= 200 OR total < 200 THEN on_time ELSE total END AS rows_arrived,
           CASE WHEN on_time >= 200 THEN NULL WHEN total >= 200 THEN (epoch_us(last_ts) - epoch_us(deadline)) / 1e6 WHEN as_of >= deadline THEN (epoch_us(as_of) - epoch_us(deadline)) / 1e6 END AS delay_seconds,
           CASE WHEN on_time >= 200 THEN 'ok' WHEN total >= 200 THEN 'late' WHEN as_of >= deadline THEN 'missing' ELSE 'ok' END AS status, as_of AS checked_at FROM c""")
def arrival_check_grace(spark, sf):
    return A.check_grace(fixture(spark, sf, "arrivals"), "arrivals", "ts", EVENTS_AS_OF, min_rows=200)


TYPED = ("click", "view", "error", "purchase", "signup")


def typed_checks(spark, sf):
    e = table(spark, sf, "events")
    return reduce(DataFrame.unionByName, [A.check(e.filter(F.col("event_type") == t), t, "ts", EVENTS_AS_OF, min_rows=65) for t in TYPED])


TYPED_SQL = with_(s=SLOTS.format(cond=DAILY_COND), **{f"t_{t}": f"SELECT ts FROM events WHERE event_type = '{t}'" for t in TYPED},
                  r=" UNION ALL ".join(arrival_sql(f"t_{t}", t, 65) for t in TYPED))


@query("arrival_latest", TYPED_SQL + "SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY table_name ORDER BY checked_at DESC, expected_at DESC) = 1")
def arrival_latest(spark, sf):
    return A.latest(typed_checks(spark, sf))


@query("arrival_list", TYPED_SQL + "SELECT * FROM r WHERE status = 'missing' AND table_name = 'view' ORDER BY checked_at DESC, expected_at DESC LIMIT 50")
def arrival_list(spark, sf):
    return A.listing(typed_checks(spark, sf).filter(F.col("table_name") == "view"), "missing")
