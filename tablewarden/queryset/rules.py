"""Rules across columns, failing rows, weekly digest."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewarden.operators import digest as G
from tablewarden.operators import row_rules as R
from tablewarden.queryset.fixtures import fixture, with_
from tablewarden.queryset.registry import query

RULES = (R.RowRule("value_is_not_negative", "value >= 0"), R.RowRule("errors_have_a_value", "event_type <> 'error' OR value IS NOT NULL"),
         R.RowRule("mail_has_the_user", "email LIKE concat('u', user_id, '@%')", most_failed=1_000_000_000), R.RowRule("not_boolean", "value + 1"),
         R.RowRule("no_such_column", "gone > value"), R.RowRule("aggregate", "value > avg(value)"))
SQL = {"value_is_not_negative": "value >= 0", "errors_have_a_value": "event_type <> 'error' OR value IS NOT NULL", "mail_has_the_user": "email LIKE concat('u', user_id, '@%')"}


@query("check_cross_column", with_("dirty") + " UNION ALL ".join(
    f"SELECT '{n}' AS rule, 'dirty' AS table_name, count(*) FILTER (WHERE NOT ({e})) AS failed, count(*) FILTER (WHERE ({e}) IS NULL) AS unknown, "
    + ("true" if n.startswith("mail") else f"count(*) FILTER (WHERE NOT ({e})) = 0") + " AS passed, false AS is_error FROM dirty" for n, e in SQL.items())
    + "".join(f" UNION ALL SELECT '{n}', 'dirty', NULL, NULL, false, true" for n in ("not_boolean", "no_such_column", "aggregate")))
def check_cross_column(spark, sf):
    return R.check(fixture(spark, sf, "dirty"), "dirty", RULES).withColumn("is_error", F.col("details").isNotNull()).drop("details")


@query("check_failing_rows", with_("dirty", x=" UNION ALL ".join(f"SELECT '{n}' AS rule, event_id, ts, value FROM dirty WHERE NOT ({e})" for n, e in SQL.items())) + """
    SELECT rule, row_number() OVER (PARTITION BY rule ORDER BY ts DESC, event_id)::INTEGER AS place, event_id, ts, value FROM x
    QUALIFY row_number() OVER (PARTITION BY rule ORDER BY ts DESC, event_id) <= 10""")
def check_failing_rows(spark, sf):
    found = R.failing_rows(fixture(spark, sf, "dirty"), RULES, k=10, order=[-F.unix_micros(F.col("ts").cast("timestamp")), "event_id"])
    return found.select("rule", "place", "row.event_id", "row.ts", "row.value")


DIGEST = """SELECT 'freshness' AS pillar, coalesce(table_name, '') AS table_name, date_trunc('week', checked_at) AS week, checked_at AS at, status <> 'ok' AS bad FROM freshness_history
    UNION ALL SELECT 'quality', coalesce(table_name, ''), date_trunc('week', executed_at), executed_at, NOT passed FROM check_history
    UNION ALL SELECT 'contracts', coalesce(table_name, ''), date_trunc('week', validated_at), validated_at, NOT passed FROM contract_history"""


@query("weekly_digest", with_("freshness_history", "check_history", "contract_history", d=DIGEST) + """
    SELECT pillar, table_name, week::TIMESTAMP AS week, count(*) AS records, count(*) FILTER (WHERE bad) AS bad, max(d.at) FILTER (WHERE bad) AS last_bad_at,
           CASE grouping_id(pillar, table_name, week) WHEN 0 THEN 'table' WHEN 2 THEN 'pillar' ELSE 'week' END AS level
    FROM d GROUP BY GROUPING SETS ((pillar, table_name, week), (pillar, week), (week))""")
def weekly_digest(spark, sf):
    return G.weekly({"freshness": fixture(spark, sf, "freshness_history"), "quality": fixture(spark, sf, "check_history"), "contracts": fixture(spark, sf, "contract_history")})
