"""Single rules on literal rows."""

import pytest
from pyspark.sql import functions as F

from tablewarden.functions import times as T
from tablewarden.functions.assertions import assertion_holds, parse_assertion
from tablewarden.operators import alerts as A
from tablewarden.operators import checks as C
from tablewarden.operators import contracts as K
from tablewarden.operators import distribution as D
from tablewarden.operators import freshness as FR
from tablewarden.operators import noise as N
from tablewarden.operators import schema_drift as S
from tablewarden.operators import volume as V
from tablewarden.operators.maintenance import retention
from tablewarden.session import small_frame
from tests.conftest import values

AS_OF = "2024-01-10 00:00:00"


@pytest.mark.parametrize("text,seconds", [("1h", 3600), ("0.5h", 1800), ("30m", 1800), ("60s", 60), ("1d", 86400), ("3600", 3600), (" 2H ", 7200)])
def test_durations(spark, text, seconds):
    assert T.duration_seconds(text) == seconds
    assert small_frame(spark, [(text,)], "t string").select(T.duration_seconds_col(F.col("t"))).first()[0] == seconds


@pytest.mark.parametrize("text", ["", "abc", "1w", "h", "-1h"])
def test_bad_durations(spark, text):
    with pytest.raises(ValueError):
        T.duration_seconds(text)
    assert small_frame(spark, [(text,)], "t string").select(T.duration_seconds_col(F.col("t"))).first()[0] is None


@pytest.mark.parametrize("text,value,expected", [
    ("result == 0", 0, True), ("result == 0", 5, False), ("result != 0", 5, True), ("result >= 100", 100, True),
    ("result > 100", 100, False), ("result <= 0.5", 0.5, True), ("result < 10", 9, True), ("result>1e3", 1001, True), ("result == True", 1, True),
    ("result != False", 0, False)])
def test_assertions(spark, text, value, expected):
    df = small_frame(spark, [(text, float(value))], "t string, v double")
    assert df.select(parse_assertion(text).holds(F.col("v")), assertion_holds(F.col("t"), F.col("v"))).first() == (expected, expected)


@pytest.mark.parametrize("text", ["result == 0 and True", "result is None", "result > -1", "1 == 1", "x == 0", "result == 'a'",
                                  "0 < result < 5", "__import__('os')", "result", ""])
def test_assertions_outside_the_grammar(spark, text):
    with pytest.raises(ValueError):
        parse_assertion(text)
    assert small_frame(spark, [(text,)], "t string").select(assertion_holds(F.col("t"), F.lit(1.0))).first()[0] is None


def test_freshness_thresholds_are_strict(spark):
    rows = [(None,), (3600.0,), (3600.5,), (7200.0,), (7200.5,), (0.0,)]
    df = small_frame(spark, rows, "lag double")
    got = df.select(FR.classify(F.col("lag"), F.lit(3600.0), F.lit(7200.0))).collect()
    assert [r[0] for r in got] == ["fail", "ok", "warn", "warn", "fail", "ok"]


def test_freshness_of_an_empty_table_fails(spark):
    empty = small_frame(spark, [], "ts timestamp_ntz")
    row = FR.poll([FR.Watch("t", empty, "ts")], AS_OF).first()
    assert (row["status"], row["lag_seconds"]) == ("fail", None)


def test_disabled_tables_are_not_polled(spark):
    t = small_frame(spark, [("2024-01-01 00:00:00",)], "ts string").select(F.col("ts").cast("timestamp_ntz").alias("ts"))
    watches = [FR.Watch("a", t, "ts"), FR.Watch("b", t, "ts", enabled=False)]
    assert values(FR.poll(watches, AS_OF), "table_name") == [("a",)]


@pytest.mark.parametrize("secs,text", [(None, "—"), (45, "45s"), (59.4, "59s"), (720, "12m"), (12240, "3.4h"), (181440, "2.1d")])
def test_humanize(spark, secs, text):
    assert small_frame(spark, [(secs,)], "s double").select(T.humanize_lag(F.col("s"))).first()[0] == text


@pytest.mark.parametrize("text,expected", [("2024-01-01T10:00:00Z", "2024-01-01 10:00:00"), ("2024-01-01T10:00:00+02:00", "2024-01-01 08:00:00"),
                                           ("2024-01-01T10:00:00.5", "2024-01-01 10:00:00.5"), ("soon", None), (None, None)])
def test_iso_instants(spark, text, expected):
    got = small_frame(spark, [(text,)], "t string").select(T.parse_iso(F.col("t")).cast("string")).first()[0]
    assert got == expected


@pytest.mark.parametrize("current,average,expected", [(70, 100.0, 0.3), (0, 0.0, 0.0), (5, 0.0, 1.0), (200, 100.0, 1.0)])
def test_volume_deviation(spark, current, average, expected):
    df = small_frame(spark, [(current, average)], "c bigint, a double")
    assert df.select(V.deviation(F.col("c"), F.col("a"))).first()[0] == pytest.approx(expected)


def test_volume_needs_three_points(spark):
    history = small_frame(spark, [("a", 100, "2024-01-08"), ("a", 100, "2024-01-09"), ("b", 100, "2024-01-07"), ("b", 100, "2024-01-08"), ("b", 100, "2024-01-09"), ("b", 9000, "2023-12-01")],
                          "table_name string, row_count bigint, d string").withColumn("recorded_at", F.col("d").cast("timestamp_ntz"))
    current = small_frame(spark, [("a", 500), ("b", 500), ("c", 500)], "table_name string, row_count bigint")
    got = values(V.check(current, history, AS_OF), "table_name", "history_points", "is_anomaly", "deviation_pct")
    assert got == [("a", 2, False, 4.0), ("b", 3, True, 4.0), ("c", 0, False, 0.0)]


def test_volume_threshold_is_strict(spark):
    history = small_frame(spark, [("a", 100, f"2024-01-0{d}") for d in (6, 7, 8)], "table_name string, row_count bigint, d string").withColumn(
        "recorded_at", F.col("d").cast("timestamp_ntz"))
    at = lambda n: V.check(small_frame(spark, [("a", n)], "table_name string, row_count bigint"), history, AS_OF).first()["is_anomaly"]
    assert (at(130), at(131), at(69)) == (False, True, True)


@pytest.mark.parametrize("counts,score", [((0, 0, 0), 0.0), ((1, 1, 1), 22.5), ((3, 3, 4), 68.0), ((5, 10, 20), 100.0), ((0, 0, 20), 10.0)])
def test_noise_score(spark, counts, score):
    df = small_frame(spark, [counts], "a bigint, b bigint, c bigint")
    assert df.select(N.score(F.col("a"), F.col("b"), F.col("c"))).first()[0] == score


@pytest.mark.parametrize("score,minutes", [(0.0, 60), (-1.0, 60), (25.0, 120), (50.0, 240), (75.0, 480), (100.0, 480), (10.0, 79)])
def test_window(spark, score, minutes):
    assert small_frame(spark, [(score,)], "s double").select(N.window_minutes(F.col("s"))).first()[0] == minutes


@pytest.mark.parametrize("recent,older,trend", [
    (["fail", "fail"], ["warn", "info"], "worsening"), (["info"], ["fail"], "improving"), (["warn"], ["warn"], "stable"),
    ([], ["fail"], "stable"), (["fail"], [], "stable"), (["odd"], ["info"], "stable")])
def test_trend(spark, recent, older, trend):
    df = small_frame(spark, [(recent, older)], "r array<string>, o array<string>")
    assert df.select(N.trend_of(F.col("r"), F.col("o"))).first()[0] == trend


def log(spark, rows):
    return small_frame(spark, rows, "id bigint, table_name string, alert_type string, severity string, success boolean, t string").withColumn(
        "sent_at", F.col("t").cast("timestamp_ntz")).drop("t")


def test_noise_record_counts_and_throttle(spark):
    rows = [(i, "orders", "quality", "fail", True, f"2024-01-09 {23 - i:02d}:30:00") for i in range(12)]
    rows += [(50, "orders", "quality", "warn", False, "2024-01-09 23:59:00"), (51, "orders", "quality", None, True, "2024-01-05 00:00:00")]
    r = N.records(log(spark, rows), AS_OF).first()
    assert (r["count_1h"], r["count_24h"], r["count_7d"], r["is_throttled"], r["severity_trend"]) == (1, 12, 13, True, "stable")


def test_suppression_boundary(spark):
    alerts = small_frame(spark, [(1, "a"), (2, "b"), (3, "c"), (4, None)], "id bigint, table_name string")
    muted = small_frame(spark, [(1, "a", AS_OF), (2, "b", "2024-01-09 23:59:59")], "id bigint, table_name string, t string").withColumn(
        "suppressed_until", F.col("t").cast("timestamp_ntz"))
    assert values(A.drop_suppressed(alerts, muted, AS_OF), "id") == [(2,), (3,), (4,)]


def test_dedup_window_grows_with_noise(spark):
    sent = log(spark, [(1, "a", "quality", "fail", True, "2024-01-09 22:30:00"), (2, "b", "quality", "fail", False, "2024-01-09 23:00:00"), (3, "c", "quality", "fail", True, "2024-01-09 22:59:59")])
    alerts = small_frame(spark, [(i, t, "quality") for i, t in enumerate("abcd")], "id bigint, table_name string, alert_type string")
    assert values(A.drop_repeated(alerts, sent, AS_OF), "table_name") == [("a",), ("c",), ("d",)]
    noise = small_frame(spark, [("a", "quality", 25.0)], "table_name string, alert_type string, noise_score double")
    assert values(A.drop_repeated(alerts, sent, AS_OF, noise), "table_name") == [("c",), ("d",)]


def test_routing(spark):
    alerts = small_frame(spark, [(1, "payments.x", "schema", "fail"), (2, "sales.x", "schema", "warn"), (3, None, "schema", "info")],
                         "id bigint, table_name string, alert_type string, severity string")
    routes = [A.Route("finance", "schema", table_pattern="payments.*"), A.Route("pager", severity="fail")]
    assert values(A.route(alerts, routes), "id", "channel") == [(1, "finance"), (1, "pager"), (2, "slack"), (3, "finance")]
    assert values(A.route(alerts, []), "id", "channel") == [(1, "slack"), (2, "slack"), (3, "slack")]


def test_gate_sends_first_of_pair_and_all_without_table(spark):
    rows = [(1, "a", "quality", "fail", "m1"), (2, "a", "quality", "warn", "m2"), (3, None, "finops", "info", "m3"), (4, None, "finops", "info", "m4"), (5, "b", "volume", "warn", "m5")]
    alerts = small_frame(spark, rows, "id bigint, table_name string, alert_type string, severity string, message string").withColumn(
        "raised_at", F.lit(AS_OF).cast("timestamp_ntz"))
    muted = small_frame(spark, [(1, "b", "2024-02-01")], "id bigint, table_name string, t string").withColumn("suppressed_until", F.col("t").cast("timestamp_ntz"))
    sent = A.gate(alerts, muted, log(spark, []), AS_OF, [A.Route("x", "quality"), A.Route("y", severity="fail")])
    assert values(sent, "id", "channel") == [(1, "x"), (1, "y"), (3, "slack"), (4, "slack")]
    logged = A.log_rows(sent, AS_OF)
    assert values(logged, "id", "channel", "message") == [(1, "y", "🔴 [FAIL] m1"), (3, "slack", "🟠 [INFO] m3"), (4, "slack", "🟠 [INFO] m4")]


def snaps(spark, prev, curr, kind="categorical"):
    ddl = ("table_name string, column_name string, column_type string, null_pct double, mean double, max double, "
           "top_values array<struct<value_rank:int,value:string,value_count:bigint,pct:double>>, t string")
    rows = []
    for i, (nulls, mean, top, shares) in enumerate((prev, curr)):
        listed = None if shares is None else [{"value_rank": n, "value": v, "value_count": 1, "pct": p} for n, (v, p) in enumerate(shares.items(), 1)]
        rows.append(("t", "c", kind, nulls, mean, top, listed, f"2024-01-0{i + 1}"))
    return small_frame(spark, rows, ddl).withColumn("snapshotted_at", F.col("t").cast("timestamp_ntz")).drop("t")


@pytest.mark.parametrize("prev,curr,kind,drift,size", [
    ((0.0, None, None, {"a": 1.0}), (0.05, None, None, {"a": 0.95}), "categorical", "null_pct_change", 0.05),
    ((0.0, None, None, {"a": 0.5, "b": 0.5}), (0.01, None, None, {"a": 0.52, "b": 0.48}), "categorical", None, 0.0),
    ((0.0, None, None, {"a": 0.95, "x": 0.05}), (0.0, None, None, {"a": 0.2, "x": 0.8}), "categorical", "value_share_shift", 0.75),
    ((0.0, None, None, {"a": 1.0}), (0.0, None, None, {"a": 0.7, "new": 0.3}), "categorical", "value_share_shift", 0.3),
    ((0.0, None, None, {"a": 0.8, "gone": 0.2}), (0.0, None, None, {"a": 1.0}), "categorical", "value_share_shift", 0.2),
    ((0.0, 100.0, 1000.0, None), (0.0, 300.0, 1000.0, None), "numeric", "mean_shift", 0.2),
    ((0.0, 100.0, 1000.0, None), (0.0, 150.0, 1000.0, None), "numeric", None, 0.0),
    ((0.0, 100.0, 1000.0, None), (0.5, 900.0, 1000.0, None), "numeric", "null_pct_change", 0.5),
    ((0.0, 0.0, 0.0, None), (0.0, 0.5, 3.0, None), "numeric", "mean_shift", 0.5)])
def test_drift(spark, prev, curr, kind, drift, size):
    r = D.detect(snaps(spark, prev, curr, kind)).first()
    assert (r["drift_type"], r["drifted"]) == (drift, drift is not None)
    assert r["magnitude"] == pytest.approx(size)


def cols(*pairs):
    return [{"name": n, "type": t, "nullable": True, "ordinal_position": i} for i, (n, t) in enumerate(pairs, 1)]


@pytest.mark.parametrize("old,new,expected", [
    ([("id", "int"), ("n", "text")], [("n", "text"), ("id", "int")], []),
    ([("id", "int")], [("id", "int"), ("e", "text")], [("added", "e", None, "text")]),
    ([("id", "int"), ("e", "text")], [("id", "int")], [("removed", "e", "text", None)]),
    ([("a", "int")], [("a", "numeric")], [("type_changed", "a", "int", "numeric")]),
    ([("a", "int"), ("b", "text")], [("a", "bigint"), ("B", "text")], [("added", "B", None, "text"), ("removed", "b", "text", None), ("type_changed", "a", "int", "bigint")])])
def test_schema_changes(spark, old, new, expected):
    ddl = "table_name string, columns array<struct<name:string,type:string,nullable:boolean,ordinal_position:int>>"
    d = S.diff(small_frame(spark, [("t", cols(*old))], ddl), small_frame(spark, [("t", cols(*new))], ddl))
    assert values(d, "change_type", "column_name", "old_value", "new_value") == expected


def test_contract_quotes_and_types(spark):
    df = small_frame(spark, [(1, "O'Malley"), (2, "x"), (3, None)], "n int, s string")
    c = K.Contract("c", "t", columns=(K.ColumnRule("s", "varchar", allowed_values=("O'Malley",)), K.ColumnRule("n", "integer", allowed_values=("1", "two", 2.5))))
    got = values(K.validate(spark, [c], {"t": df}), "rule", "metric_value", "passed")
    assert got == [("allowed_values:n", 2.0, False), ("allowed_values:s", 1.0, False)]


def test_contract_of_one_id_and_unique_null_group(spark):
    df = small_frame(spark, [(None,), (None,), (1,)], "n int")
    a, b = K.Contract("a", "t", columns=(K.ColumnRule("n", unique=True),)), K.Contract("b", "t", min_rows=3)
    rows = K.validate(spark, [a, b], {"t": df}, "a")
    assert values(rows, "contract_id", "rule", "metric_value") == [("a", "unique:n", 1.0)]
    assert values(K.summarise(K.validate(spark, [a, b], {"t": df})), "contract_id", "passed") == [("a", False), ("b", True)]


def test_check_lines():
    assert C.declare("t", "row_count between 1 and 9").high == 9
    assert C.declare("t", "freshness(ts) < 2h").value == 7200
    assert C.declare("t", "values in (a) must exist in p (b)").parent == "p"
    for bad in ("drop table x", "max(a)", "sum(a) > 1", "missing_count(a) = "):
        with pytest.raises(ValueError):
            C.declare("t", bad)


def test_required_columns_in_a_suite(spark):
    df = small_frame(spark, [(1,)], "a int")
    got = C.run_suite({"t": df}, [C.Check("t", "required_columns", required=("a", "b", "c"))])
    assert values(got, "metric_value", "passed") == [(2.0, False)]


def test_checks_on_an_empty_table(spark):
    df = small_frame(spark, [], "a int")
    lines = ["row_count > 0", "missing_percent(a) < 5", "duplicate_percent(a) < 1", "min(a) >= 0", "missing_count(a) = 0"]
    got = dict((r["rule"], r["passed"]) for r in C.run_suite({"t": df}, [C.declare("t", x) for x in lines]).collect())
    assert got == {lines[0]: False, lines[1]: False, lines[2]: False, lines[3]: False, lines[4]: True}


def test_retention_order():
    assert retention("alert_logs") == 30
    assert retention("alert_logs", None, {}, 90) == 90
    assert retention("alert_logs", None, {"alert_logs": 10}, 90) == 10
    assert retention("alert_logs", 5, {"alert_logs": 10}, 90) == 5


def test_sql_check_results_that_are_no_numbers(spark):
    t = small_frame(spark, [("x", True, None)], "s string, b boolean, n int")
    cases = [("s", "result != 0", True, None), ("s", "result == 0", False, None), ("b", "result == 1", True, 1.0),
             ("n", "result != 0", True, None), ("n", "result >= 0", False, None), ("nowhere", "result != 0", False, None)]
    checks = [C.SqlCheck(str(i), f"SELECT {c} FROM {{t}}", a) for i, (c, a, _, _) in enumerate(cases)]
    got = values(C.run_sql_checks(spark, checks, {"t": t}), "check_name", "passed", "metric_value")
    assert got == [(str(i), p, m) for i, (_, _, p, m) in enumerate(cases)]


def test_each_sql_check_fails_alone_and_says_why(spark):
    t = small_frame(spark, [(1, "a"), (2, "b")], "n int, s string")
    cases = {"fine": ("SELECT count(*) FROM orders", "result == 2", True), "qualified": ("SELECT max(orders.n) AS m FROM public.orders WHERE orders.n > 0", "result == 2", True),
             "alias": ("SELECT max(o.n) FROM `public`.orders AS o JOIN orders p ON o.n = p.n", "result == 2", True),
             "cte": ("WITH orders AS (SELECT 7 AS n) SELECT n FROM orders", "result == 7", True), "subquery": ("SELECT (SELECT max(n) FROM public.orders) AS m", "result == 2", True),
             "text": ("SELECT 'FROM public.orders' AS x", "result == 0", False), "no_rows": ("SELECT n FROM orders WHERE n > 9", "result == 0", True),
             "run_time": ("SELECT raise_error('boom')", "result == 0", False), "overflow": ("SELECT cast(s AS int) FROM orders", "result == 0", False),
             "renamed": ("SELECT max(gone) FROM orders", "result == 0", False), "unknown": ("SELECT 1 FROM nowhere.at_all", "result == 1", False),
             "syntax": ("SELEC 1", "result == 1", False), "judge": ("SELECT 1", "result is None", False)}
    got = {r.check_name: r for r in C.run_sql_checks(spark, [C.SqlCheck(k, q, a) for k, (q, a, _) in cases.items()], {"public.orders": t}).collect()}
    assert {k: r.passed for k, r in got.items()} == {k: p for k, (_, _, p) in cases.items()}
    wrong = {k for k, r in got.items() if r.details is not None}
    assert wrong == {"run_time", "overflow", "renamed", "unknown", "syntax", "judge"} and "boom" in got["run_time"].details
    assert C.run_sql_checks(spark, [], {}).count() == 0


def test_bare_name_finds_the_qualified_rule_table_and_errors_are_told_from_failures(spark):
    t = small_frame(spark, [(1,), (None,)], "n int")
    rules = (K.SqlRule("shop", "SELECT count(*) AS c FROM shop.public.orders WHERE n IS NULL"), K.SqlRule("broken", "SELECT count(*) AS c FROM public.gone"), K.SqlRule("good", "SELECT count(n) AS c FROM public.orders", "result == 1"))
    got = {r.rule: (r.passed, r.detail.startswith("error:")) for r in K.validate(spark, [K.Contract("c", "orders", rules=rules)], {"orders": t}).collect()}
    assert got == {"shop": (False, False), "broken": (False, True), "good": (True, False)}


def test_checks_of_absent_tables_and_columns_fail_alone(spark):
    t = small_frame(spark, [(1,)], "n int")
    lines = [C.declare("t", "row_count = 1"), C.declare("t", "max(gone) < 5"), C.declare("gone", "row_count > 0"), C.declare("t", "duplicate_count(gone) = 0"), C.declare("t", "values in (n) must exist in gone (n)")]
    got = C.run_suite({"t": t}, lines, AS_OF)
    assert {r.rule: r.passed for r in got.where("table_name = 't'").collect()} == {c.title: c is lines[0] for c in lines if c.table == "t"} and got.count() == 5
    assert C.run_suite({"t": t}, [], AS_OF).count() == 0 and FR.poll([], AS_OF).count() == 0
    lag = FR.poll([FR.Watch("t", t, "gone"), FR.Watch("u", small_frame(spark, [(AS_OF,)], "x string").select(F.col("x").cast("timestamp_ntz").alias("ts")), "ts")], AS_OF)
    assert values(lag, "table_name", "status") == [("t", "fail"), ("u", "ok")]
    with pytest.raises(ValueError):
        C.run_suite({"t": t}, [C.Check("t", "invalid_count", "n")], AS_OF)


def test_contract_sql_rule_counts_null_as_zero(spark):
    t = small_frame(spark, [("x", None)], "s string, n int")
    rules = tuple(K.SqlRule(f"r{i}", f"SELECT {c} FROM {{t}}", a) for i, (c, a) in enumerate([("n", "result == 0"), ("s", "result == 0"), ("s", "result != 0"), ("nowhere", "result != 0")]))
    assert values(K.validate(spark, [K.Contract("c", "t", rules=rules)], {"t": t}), "rule", "passed") == [("r0", True), ("r1", False), ("r2", True), ("r3", False)]


def test_profile_report(spark):
    t = small_frame(spark, [(1,), (None,), (3,)], "n int")
    from tablewarden.operators import profiling as P
    assert values(P.report(P.profile(t, "t", AS_OF)), "column_name", "null_percent", "distinct_count") == [("n", 33.33, 2)]
    assert P.profile(small_frame(spark, [], "n int"), "t", AS_OF).count() == 0


def test_suppressions_are_created_listed_and_removed(spark):
    asked = small_frame(spark, [(1, "a", 60, "reload"), (2, "b", 1, "x")], "id bigint, table_name string, minutes int, reason string")
    made = A.new_suppressions(asked, AS_OF)
    assert values(A.list_suppressions(made, "2024-01-10 00:30:00"), "id") == [(1,)]
    assert values(A.list_suppressions(made, "2024-01-10 00:30:00", active_only=False), "id") == [(1,), (2,)]
    assert values(A.without_suppression(made, 1), "table_name") == [("b",)]


def test_backfill_gate(spark):
    old = small_frame(spark, [(i,) for i in range(400)], "h int").select((F.lit(AS_OF).cast("timestamp_ntz") - F.col("h") * F.expr("INTERVAL 1 HOUR")).alias("ts"))
    new = old.filter("ts >= '2024-01-09'")
    checked = small_frame(spark, [("old", 9, 3, 3.0, 2.0, True), ("new", 9, 3, 3.0, 2.0, True), ("calm", 3, 3, 3.0, 0.0, False), ("unwatched", 9, 3, 3.0, 2.0, True)],
                          "table_name string, row_count bigint, history_points bigint, rolling_avg double, deviation_pct double, is_anomaly boolean")
    gated = V.gate_backfills(checked, [V.BackfillWatch(n, t, "ts") for n, t in (("old", old), ("new", new), ("calm", old))], AS_OF, sample_rows=10_000)
    assert values(gated, "table_name", "is_anomaly", "is_backfill", "severity") == [
        ("calm", False, False, None), ("new", True, False, "warn"), ("old", False, True, "info"), ("unwatched", True, False, "warn")]
    assert values(V.backfill_events(gated, AS_OF), "table_name", "row_count", "historical_row_fraction") == [("old", 9, round((400 - 169) / 400, 4))]


def test_backfill_larger_than_the_least_sample(spark):
    # 12,000 rows of today, a second apart, on 28,000 of two months ago that arrived with them
    day = F.lit(AS_OF).cast("timestamp_ntz")
    at = F.when(F.col("id") < 12_000, day - F.make_dt_interval(secs=F.col("id").cast("decimal(18,6)"))).otherwise(
        day - F.make_dt_interval(F.lit(60), secs=F.col("id").cast("decimal(18,6)")))
    rows = spark.range(40_000).select(at.alias("ts"))
    checked = small_frame(spark, [("t", 40_000, 7, 1_000.0, 39.0, True)],
                          "table_name string, row_count bigint, history_points bigint, rolling_avg double, deviation_pct double, is_anomaly boolean")
    watch = [V.BackfillWatch("t", rows, "ts")]
    assert values(V.gate_backfills(checked, watch, AS_OF), "is_backfill", "sample_size", "severity") == [(True, 39_000, "info")]
    assert values(V.gate_backfills(checked, watch, AS_OF, sample_rows=10_000), "is_backfill", "sample_size", "severity") == [(False, 10_000, "warn")]


def test_backfill_of_an_empty_table(spark):
    empty = small_frame(spark, [], "ts timestamp_ntz")
    assert V.detect_backfill(V.BackfillWatch("t", empty, "ts"), AS_OF).first()["is_backfill"] is False
