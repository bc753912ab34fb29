"""Quality checks, expectations, consistency."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewarden.functions.assertions import assertion_holds
from tablewarden.operators import checks as O
from tablewarden.operators import consistency as X
from tablewarden.operators.checks import Check
from tablewarden.queryset.fixtures import EVENTS_AS_OF, LINEITEM_AS_OF, fixture, table, with_
from tablewarden.queryset.registry import query
from tablewarden.session import small_frame
from tablewarden.sources.tables import schema_rows


def suite(tables, *checks, as_of=EVENTS_AS_OF):
    return O.run_suite(tables, checks, as_of)


def row(rule, table_name, metric, passed, kind="declared", source=None):
    return (f"SELECT '{rule}' AS rule, '{table_name}' AS table_name, '{kind}' AS check_type, "
            f"CAST({metric} AS DOUBLE) AS metric_value, {passed} AS passed FROM {source or table_name}")


DUP = "(SELECT {c} AS v, count(*) AS n FROM {t} GROUP BY {c})"

CUSTOM = [
    ("no_orphan_lines", "SELECT count(*) AS n FROM {lineitem} LEFT JOIN {orders} ON l_orderkey = o_orderkey WHERE o_orderkey IS NULL", "result == 0", "lineitem"),
    ("enough_revenue", "SELECT sum(CAST(o_totalprice AS DECIMAL(18,2))) AS s FROM {orders}", "result >= 1000000", "orders"),
    ("no_rows_is_zero", "SELECT o_orderkey FROM {orders} WHERE o_totalprice < 0", "result == 0", "orders"),
    ("null_result", "SELECT max(o_totalprice) AS m FROM {orders} WHERE o_totalprice < 0", "result >= 0", "orders"),
    ("text_result", "SELECT max(o_orderpriority) AS m FROM {orders}", "result == 0", "orders"),
    ("negative_literal", "SELECT min(o_totalprice) AS m FROM {orders}", "result > -1", "orders"),
    ("none_clause", "SELECT max(o_totalprice) AS m FROM {orders}", "result is None or result >= 90", "orders"),
]


@query("check_custom_sql", """
    SELECT * FROM (
    SELECT 'no_orphan_lines' AS check_name, 'lineitem' AS table_name, 'custom_sql' AS check_type, count(*) = 0 AS passed, CAST(count(*) AS DOUBLE) AS metric_value
      FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey IS NULL
    UNION ALL SELECT 'enough_revenue', 'orders', 'custom_sql', sum(CAST(o_totalprice AS DECIMAL(18,2))) >= 1000000, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) FROM orders
    UNION ALL SELECT 'no_rows_is_zero', 'orders', 'custom_sql', count(*) = 0, CAST(count(*) AS DOUBLE) FROM orders WHERE o_totalprice < 0
    UNION ALL SELECT 'null_result', 'orders', 'custom_sql', false, max(o_totalprice) FROM orders WHERE o_totalprice < 0
    UNION ALL SELECT 'text_result', 'orders', 'custom_sql', false, NULL
    UNION ALL SELECT 'negative_literal', 'orders', 'custom_sql', false, min(o_totalprice) FROM orders
    UNION ALL SELECT 'none_clause', 'orders', 'custom_sql', false, max(o_totalprice) FROM orders)""")
def check_custom_sql(spark, sf):
    tables = {t: table(spark, sf, t) for t in ("orders", "lineitem")}
    return O.run_sql_checks(spark, [O.SqlCheck(n, q, a, t) for n, q, a, t in CUSTOM], {
        "orders": tables["orders"], "lineitem": tables["lineitem"]}).drop("details")


@query("assert_eval", """
    SELECT event_id, CASE event_id % 9 WHEN 0 THEN value == user_id WHEN 1 THEN value != user_id WHEN 2 THEN value < user_id
        WHEN 3 THEN value <= user_id WHEN 4 THEN value > user_id WHEN 5 THEN value >= user_id END AS passed,
        event_id % 9 > 5 AS is_error FROM events""")
def assert_eval(spark, sf):
    e = table(spark, sf, "events")
    op = F.element_at(F.array(*[F.lit(x) for x in ("==", "!=", "<", "<=", ">", ">=", "is", "> -", "==x")]),
                      (F.col("event_id") % 9 + 1).cast("int"))
    text = F.concat(F.lit("result "), op, F.lit(" "), F.col("user_id"))
    outcome = assertion_holds(text, F.col("value"))
    return e.select("event_id", outcome.alias("passed"), outcome.isNull().alias("is_error"))


DIRTY = with_("dirty")


@query("check_missing_count", DIRTY + row("missing_count(event_type) = 0", "dirty", "count(*) - count(event_type)", "count(*) = count(event_type)"))
def check_missing_count(spark, sf):
    return suite({"dirty": fixture(spark, sf, "dirty")}, O.declare("dirty", "missing_count(event_type) = 0"))


@query("check_missing_percent", DIRTY + row("missing_percent(value) < 5", "dirty", "round((count(*) - count(value)) * 100.0 / count(*), 6)", "(count(*) - count(value)) * 100.0 / count(*) < 5"))
def check_missing_percent(spark, sf):
    out = suite({"dirty": fixture(spark, sf, "dirty")}, O.declare("dirty", "missing_percent(value) < 5"))
    return out.withColumn("metric_value", F.round("metric_value", 6))


@query("check_duplicate_count",
       row("duplicate_count(l_orderkey) = 0", "lineitem", "count(*) FILTER (WHERE n > 1 AND v IS NOT NULL)", "count(*) FILTER (WHERE n > 1 AND v IS NOT NULL) = 0", source=DUP.format(c="l_orderkey", t="lineitem"))
       + " UNION ALL " + row("duplicate_count(o_orderkey) = 0", "orders", "count(*) FILTER (WHERE n > 1 AND v IS NOT NULL)", "count(*) FILTER (WHERE n > 1 AND v IS NOT NULL) = 0", source=DUP.format(c="o_orderkey", t="orders")))
def check_duplicate_count(spark, sf):
    return suite({t: table(spark, sf, t) for t in ("lineitem", "orders")},
                 O.declare("lineitem", "duplicate_count(l_orderkey) = 0"), O.declare("orders", "duplicate_count(o_orderkey) = 0"))


@query("check_duplicate_percent",
       row("duplicate_percent(l_partkey) < 1", "lineitem", "round(count(*) FILTER (WHERE n > 1 AND v IS NOT NULL) * 100.0 / sum(n), 6)",
           "count(*) FILTER (WHERE n > 1 AND v IS NOT NULL) * 100.0 / sum(n) < 1", source=DUP.format(c="l_partkey", t="lineitem")))
def check_duplicate_percent(spark, sf):
    out = suite({"lineitem": table(spark, sf, "lineitem")}, O.declare("lineitem", "duplicate_percent(l_partkey) < 1"))
    return out.withColumn("metric_value", F.round("metric_value", 6))


@query("check_row_count", row("row_count > 100", "orders", "count(*)", "count(*) > 100") + " UNION ALL "
       + row("row_count between 1000 and 50000", "lineitem", "count(*)", "count(*) BETWEEN 1000 AND 50000"))
def check_row_count(spark, sf):
    return suite({t: table(spark, sf, t) for t in ("lineitem", "orders")}, O.declare("orders", "row_count > 100"),
                 O.declare("lineitem", "row_count between 1000 and 50000"))


@query("check_min_max_avg", " UNION ALL ".join([
    row("min(o_totalprice) >= 0", "orders", "min(o_totalprice)", "min(o_totalprice) >= 0"),
    row("max(o_totalprice) < 400000", "orders", "max(o_totalprice)", "max(o_totalprice) < 400000"),
    row("avg(o_totalprice) between 10 and 500000", "orders", "round(avg(o_totalprice), 6)", "avg(o_totalprice) BETWEEN 10 AND 500000")]))
def check_min_max_avg(spark, sf):
    out = suite({"orders": table(spark, sf, "orders")}, *[O.declare("orders", t) for t in (
        "min(o_totalprice) >= 0", "max(o_totalprice) < 400000", "avg(o_totalprice) between 10 and 500000")])
    return out.withColumn("metric_value", F.round("metric_value", 6))


AGE = f"(epoch_us(TIMESTAMP '{EVENTS_AS_OF}') - epoch_us(max(ts))) / 1e6"


@query("check_freshness", row("freshness(ts) < 2h", "events", AGE, f"{AGE} < 7200") + " UNION ALL " + row("freshness(ts) < 1s", "events", AGE, f"{AGE} < 1"))
def check_freshness(spark, sf):
    return suite({"events": table(spark, sf, "events")}, O.declare("events", "freshness(ts) < 2h"), O.declare("events", "freshness(ts) < 1s"))


REQUIRED = [("orders", "o_orderkey"), ("orders", "o_channel"), ("events", "ts"), ("events", "session_id"), ("lineitem", "l_shipdate")]


@query("check_required_columns", "SELECT * FROM (VALUES " + ", ".join(str(r) for r in REQUIRED) + """) r(table_name, column_name)
    ANTI JOIN (SELECT 'orders' AS table_name, column_name FROM (DESCRIBE SELECT * FROM orders) UNION ALL SELECT 'events', column_name FROM (DESCRIBE SELECT * FROM events)
               UNION ALL SELECT 'lineitem', column_name FROM (DESCRIBE SELECT * FROM lineitem)) s USING (table_name, column_name)""")
def check_required_columns(spark, sf):
    rows = schema_rows(spark, {t: table(spark, sf, t) for t in ("orders", "events", "lineitem")})
    return O.missing_columns(rows, small_frame(spark, REQUIRED, "table_name string, column_name string"))


@query("check_invalid_count", DIRTY + row("valid email", "dirty",
       r"count(*) FILTER (WHERE email IS NOT NULL AND NOT regexp_matches(email, '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$'))",
       r"count(*) FILTER (WHERE email IS NOT NULL AND NOT regexp_matches(email, '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$')) = 0"))
def check_invalid_count(spark, sf):
    return suite({"dirty": fixture(spark, sf, "dirty")}, Check("dirty", "invalid_count", "email", name="valid email"))


@query("check_referential", with_("child_orphans") + row("values in (o_custkey) must exist in customer (c_custkey)", "child_orphans", "count(*)", "count(*) = 0",
       source="child_orphans WHERE o_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)"))
def check_referential(spark, sf):
    return suite({"child_orphans": fixture(spark, sf, "child_orphans"), "customer": table(spark, sf, "customer")},
                 O.declare("child_orphans", "values in (o_custkey) must exist in customer (c_custkey)"))


def expectation(label, column, bad, of, source):
    col = f"'{column}'" if column else "CAST(NULL AS VARCHAR)"
    return (f"SELECT '{label}' AS expectation, {col} AS column_name, {bad} = 0 AS success, CAST({bad} AS BIGINT) AS unexpected_count, "
            f"round({bad} * 100.0 / nullif({of}, 0), 6) AS unexpected_percent FROM {source}")


@query("expect_not_null", DIRTY + expectation("expect_column_values_to_not_be_null", "value", "(count(*) - count(value))", "count(*)", "dirty")
       + " UNION ALL " + expectation("expect_column_values_to_not_be_null", "event_type", "(count(*) - count(event_type))", "count(*)", "dirty"))
def expect_not_null(spark, sf):
    return O.expectation_results(fixture(spark, sf, "dirty"), "dirty", not_null=["value", "event_type"])


@query("expect_unique", " UNION ALL ".join(
    expectation("expect_column_values_to_be_unique", c, "coalesce(sum(n) FILTER (WHERE n > 1), 0)", "sum(n)", f"(SELECT count(*) AS n FROM orders GROUP BY {c})")
    for c in ("o_orderkey", "o_custkey")))
def expect_unique(spark, sf):
    return O.expectation_results(table(spark, sf, "orders"), "orders", unique=["o_orderkey", "o_custkey"])


@query("expect_between", DIRTY + expectation("expect_column_values_to_be_between", "value", "count(*) FILTER (WHERE value < 0 OR value > 200)", "count(value)", "dirty"))
def expect_between(spark, sf):
    return O.expectation_results(fixture(spark, sf, "dirty"), "dirty", between={"value": (0, 200)})


@query("expect_row_count_between", """SELECT 'expect_table_row_count_to_be_between' AS expectation, CAST(NULL AS VARCHAR) AS column_name,
    count(*) >= 1 AS success, CASE WHEN count(*) >= 1 THEN 0::BIGINT ELSE count(*) END AS unexpected_count,
    CASE WHEN count(*) >= 1 THEN 0.0::DOUBLE ELSE 100.0::DOUBLE END AS unexpected_percent FROM lineitem""")
def expect_row_count_between(spark, sf):
    return O.expectation_results(table(spark, sf, "lineitem"), "lineitem", row_count=(1, None))


SUITE = ["row_count > 0", "missing_count(o_orderkey) = 0", "missing_percent(o_custkey) < 5", "duplicate_count(o_orderkey) = 0",
         "duplicate_percent(o_custkey) < 1", "min(o_totalprice) >= 0", "max(o_totalprice) < 1000000", "avg(o_totalprice) between 10 and 500000",
         "freshness(o_orderdate) < 1d"]
ODUP = "(SELECT o_custkey AS v, count(*) AS n FROM orders GROUP BY o_custkey)"
OAGE = f"(epoch_us(TIMESTAMP '{LINEITEM_AS_OF}') - epoch_us(max(o_orderdate))) / 1e6"


@query("check_suite", " UNION ALL ".join([
    row(SUITE[0], "orders", "count(*)", "count(*) > 0"),
    row(SUITE[1], "orders", "count(*) - count(o_orderkey)", "count(*) = count(o_orderkey)"),
    row(SUITE[2], "orders", "(count(*) - count(o_custkey)) * 100.0 / count(*)", "(count(*) - count(o_custkey)) * 100.0 / count(*) < 5"),
    row(SUITE[3], "orders", "count(*) FILTER (WHERE n > 1)", "count(*) FILTER (WHERE n > 1) = 0", source="(SELECT o_orderkey, count(*) AS n FROM orders GROUP BY o_orderkey)"),
    row(SUITE[4], "orders", "round(count(*) FILTER (WHERE n > 1) * 100.0 / sum(n), 6)", "count(*) FILTER (WHERE n > 1) * 100.0 / sum(n) < 1", source=ODUP),
    row(SUITE[5], "orders", "min(o_totalprice)", "min(o_totalprice) >= 0"),
    row(SUITE[6], "orders", "max(o_totalprice)", "max(o_totalprice) < 1000000"),
    row(SUITE[7], "orders", "round(avg(o_totalprice), 6)", "avg(o_totalprice) BETWEEN 10 AND 500000"),
    row(SUITE[8], "orders", OAGE, f"{OAGE} < 86400"),
    row("values in (l_orderkey) must exist in orders (o_orderkey)", "lineitem", "count(*)", "count(*) = 0",
        source="lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)"),
    row("row_count > 100000000", "lineitem", "count(*)", "count(*) > 100000000")]))
def check_suite(spark, sf):
    tables = {t: table(spark, sf, t) for t in ("orders", "lineitem")}
    checks = [O.declare("orders", t) for t in SUITE]
    checks += [O.declare("lineitem", "values in (l_orderkey) must exist in orders (o_orderkey)"), O.declare("lineitem", "row_count > 100000000")]
    return suite(tables, *checks, as_of=LINEITEM_AS_OF).withColumn("metric_value", F.round("metric_value", 6))


@query("check_results_query", with_("check_history") + "SELECT * FROM check_history WHERE table_name = 'click' AND NOT passed ORDER BY executed_at DESC, id DESC LIMIT 50")
def check_results_query(spark, sf):
    return O.results(fixture(spark, sf, "check_history"), "click", False)


# The newest hours of one type are made to fail, so that a streak exists.
STREAKS = "SELECT id, table_name, executed_at, passed AND NOT (table_name IN ('view', 'error') AND executed_at >= TIMESTAMP '2024-01-30 18:00:00') AS passed FROM check_history"


@query("check_trend", with_("check_history", h=STREAKS + f" WHERE executed_at >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 30 DAY",
       l="SELECT table_name, max(executed_at) FILTER (WHERE passed) AS last_ok, count(*) AS n, count(*) FILTER (WHERE passed) AS ok FROM h GROUP BY table_name",
       s="SELECT h.table_name, count(*) FILTER (WHERE last_ok IS NULL OR executed_at > last_ok) AS streak FROM h JOIN l USING (table_name) GROUP BY h.table_name") + """
    SELECT h.table_name, date_trunc('day', executed_at) AS day, round(count(*) FILTER (WHERE passed) * 100.0 / count(*), 6) AS pass_rate,
           round(any_value(l.ok) * 100.0 / any_value(l.n), 2) AS overall_pass_rate, any_value(streak) AS current_failure_streak
    FROM h JOIN l USING (table_name) JOIN s USING (table_name) GROUP BY h.table_name, date_trunc('day', executed_at)""")
def check_trend(spark, sf):
    h = fixture(spark, sf, "check_history")
    forced = F.col("table_name").isin("view", "error") & (F.col("executed_at") >= F.lit("2024-01-30 18:00:00").cast("timestamp_ntz"))
    return O.trend(h.withColumn("passed", F.col("passed") & ~forced), EVENTS_AS_OF).withColumn("pass_rate", F.round("pass_rate", 6))


@query("check_pass_rate_by_table", with_("check_history") + """SELECT table_name, count(*) AS total, count(*) FILTER (WHERE passed) AS passed,
    round(count(*) FILTER (WHERE passed) * 100.0 / count(*), 6) AS pass_rate FROM check_history GROUP BY table_name""")
def check_pass_rate_by_table(spark, sf):
    return O.pass_rate_by_table(fixture(spark, sf, "check_history"))


@query("check_volume_24h", with_("check_history") + f"""SELECT table_name, count(*) AS checks_run, count(*) FILTER (WHERE passed) AS passed,
    count(*) FILTER (WHERE NOT passed) AS failed FROM check_history WHERE executed_at >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 1 DAY
    AND executed_at <= TIMESTAMP '{EVENTS_AS_OF}' GROUP BY table_name""")
def check_volume_24h(spark, sf):
    return O.checks_in_last_day(fixture(spark, sf, "check_history"), EVENTS_AS_OF)


@query("consistency_orphans", with_("child_orphans") + """SELECT 'orders_customers' AS check_name, count(*) AS unmatched, count(*) <= 10 AS passed
    FROM child_orphans WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)
    UNION ALL SELECT 'orders_without_lines', count(*), count(*) <= 300 FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def consistency_orphans(spark, sf):
    child = fixture(spark, sf, "child_orphans")
    a = X.orphans(child, table(spark, sf, "customer"), "o_custkey", "c_custkey", "orders_customers", 10)
    b = X.orphans(table(spark, sf, "orders"), table(spark, sf, "lineitem"), "o_orderkey", "l_orderkey", "orders_without_lines", 300)
    return a.unionByName(b)


@query("consistency_row_count", """SELECT 'orders_vs_lines' AS check_name, a AS count_a, b AS count_b, abs(a - b) AS diff, abs(a - b) <= 100 AS passed
    FROM (SELECT (SELECT count(*) FROM orders) AS a, (SELECT count(*) FROM lineitem) AS b)""")
def consistency_row_count(spark, sf):
    return X.row_count_match(table(spark, sf, "orders"), table(spark, sf, "lineitem"), "orders_vs_lines", 100)


@query("consistency_sum", """SELECT 'price_sums' AS check_name, a AS sum_a, b AS sum_b, abs(a - b) / greatest(abs(a), abs(b), 1.0) AS drift,
    abs(a - b) / greatest(abs(a), abs(b), 1.0) <= 0.01 AS passed FROM (SELECT
    (SELECT CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))), 0) AS DOUBLE) FROM orders) AS a,
    (SELECT CAST(coalesce(sum(CAST(l_extendedprice AS DECIMAL(18,2))), 0) AS DOUBLE) FROM lineitem) AS b)""")
def consistency_sum(spark, sf):
    return X.sum_match(table(spark, sf, "orders"), table(spark, sf, "lineitem"), "o_totalprice", "l_extendedprice", "price_sums", 0.01)


@query("migration_parity", with_("child_orphans") + """
    SELECT 'customer' AS table_name, count(*) AS source_rows, count(*) AS target_rows, 0::BIGINT AS row_difference, 0::BIGINT AS schema_differences, 'equal' AS status FROM customer
    UNION ALL SELECT 'orders', a, b, b - a, 4, 'different' FROM (SELECT (SELECT count(*) FROM orders) AS a, (SELECT count(*) FROM child_orphans WHERE o_custkey IS NOT NULL) AS b)
    UNION ALL SELECT 'part', count(*), NULL, NULL, NULL, 'missing_in_target' FROM part
    UNION ALL SELECT 'supplier', NULL, count(*), NULL, NULL, 'missing_in_source' FROM supplier""")
def migration_parity(spark, sf):
    orders = table(spark, sf, "orders")
    moved = fixture(spark, sf, "child_orphans").filter("o_custkey IS NOT NULL").withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)"))
    return X.migration_parity({"customer": table(spark, sf, "customer"), "orders": orders, "part": table(spark, sf, "part")},
                              {"customer": table(spark, sf, "customer"), "orders": moved, "supplier": table(spark, sf, "supplier")})
