"""Rules across columns, samples of failing rows, weekly digest."""

from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tablewarden.operators import digest as G
from tablewarden.operators import row_rules as R
from tablewarden.operators import runs as U
from tablewarden.session import small_frame
from tests.conftest import values

RULES = [R.RowRule("order", "a <= b"), R.RowRule("either", "a IS NOT NULL OR b > 5"), R.RowRule("lenient", "b < 100", most_failed=50), R.RowRule("number", "a + b"),
         R.RowRule("absent", "gone > a"), R.RowRule("syntax", "a <"), R.RowRule("aggregate", "a > max(b)"), R.RowRule("window", "row_number() over (order by a) > 1")]


@pytest.fixture(scope="module")
def rows(spark):
    return [(None if i % 11 == 0 else i % 40, None if i % 7 == 0 else (i * 13) % 120, f"r{i % 150}") for i in range(400)]


def test_rules_are_three_valued_and_bad_ones_fail_with_a_reason(spark, rows):
    df = spark.createDataFrame(rows, "a int, b int, s string")
    got = {r.rule: r for r in R.check(df, "t", RULES).collect()}
    known = [(a, b) for a, b, _ in rows]
    assert (got["order"].failed, got["order"].unknown) == (sum(a is not None and b is not None and a > b for a, b in known), sum(a is None or b is None for a, b in known))
    assert got["either"].failed == sum(a is None and b is not None and b <= 5 for a, b in known)
    assert got["lenient"].passed == (got["lenient"].failed <= 50) and got["lenient"].failed == sum(b is not None and b >= 100 for _, b in known)
    for name in ("number", "absent", "syntax", "aggregate", "window"):
        assert not got[name].passed and got[name].details.startswith("error: ") and got[name].failed is None
    assert R.check(df, "t", [RULES[5]]).count() == 1
    assert {r.rule: (r.failed, r.passed) for r in R.check(df.limit(0), "t", RULES[:3]).collect()} == {"order": (0, True), "either": (0, True), "lenient": (0, True)}


def test_the_same_rows_are_sampled_however_the_table_is_cut(spark, rows):
    df = spark.createDataFrame(rows, "a int, b int, s string")
    columns = ("rule", "place", "row.a", "row.b", "row.s")
    one = values(R.failing_rows(df.coalesce(1), RULES, k=7), *columns)
    assert one == values(R.failing_rows(df.repartition(13, "s"), RULES, k=7), *columns)
    by_rule = defaultdict(list)
    for rule, place, *row in one:
        by_rule[rule].append(place)
    assert by_rule["order"] == list(range(1, 8)) and {"order", "lenient"} <= set(by_rule) <= {"order", "either", "lenient"}
    assert all(a > b for rule, _, a, b, _ in one if rule == "order")
    plan = R.failing_rows(df, RULES, k=7)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan[plan.index("Exchange"):]            # below the exchange: each task keeps its first k
    assert R.failing_rows(df, [RULES[5]]).count() == 0


def test_weekly_digest_levels_add_up(spark):
    monday = datetime(2024, 1, 1)
    data = [(t, monday + timedelta(hours=31 * i), [True, False, None][i % 3]) for i in range(40) for t in ("a", "b", None)] + [("a", None, False)]
    checks = spark.createDataFrame(data, "table_name string, executed_at timestamp_ntz, passed boolean")
    volume = checks.where("table_name = 'a'").select("table_name", F.col("executed_at").alias("recorded_at"), (~F.col("passed")).alias("is_anomaly"))
    got = G.weekly({"quality": checks, "volume": volume})
    totals = {r.level: (r.n, r.bad) for r in got.groupBy("level").agg(F.sum("records").alias("n"), F.sum("bad").alias("bad")).collect()}
    assert totals == {level: (160, 52) for level in ("table", "pillar", "week")}
    assert got.where("week <> date_trunc('week', week)").isEmpty()
    assert got.where("level = 'week' and (pillar is not null or table_name is not null)").isEmpty()


def test_unreadable_callbacks_give_no_run(spark):
    bodies = ['{"dag_id": "d", "run_id": "r", "state": "success", "duration": 3.5}', "{}", " {\"dag_id\": \"x\"}", "", None, "not json", '{"dag_id": "cut', "[1]", '"text"', "null", '{"dag_id": "e", "duration": "long"}']
    df = small_frame(spark, list(enumerate(bodies)), "k int, body string")
    assert values(U.from_airflow(df), "k", "dag_id", "duration_seconds") == [(0, "d", 3.5), (1, "unknown", None), (10, "e", None), (2, "x", None)]
    assert {r.k for r in U.unreadable(df).collect()} == {3, 4, 5, 6, 7, 8, 9}
    assert values(U.from_prefect(df), "k") == [(0,), (1,), (10,), (2,)]
