"""Schema drift, profiling, distribution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewarden.functions.times import instant
from tablewarden.operators import distribution as D
from tablewarden.operators import profiling as P
from tablewarden.operators import schema_drift as S
from tablewarden.queryset.fixtures import EVENTS_AS_OF, fixture, table, with_
from tablewarden.queryset.registry import query

# ---- schema drift: snapshots are the "columns" sighted per event type and day ----


def snapshots(spark, sf):
    seen = fixture(spark, sf, "column_sightings")
    column = F.struct("name", "type", F.lit(True).alias("nullable"), F.lit(0).alias("ordinal_position"))
    return seen.groupBy("table_name", "snapshot_at").agg(F.array_sort(F.collect_list(column)).alias("columns"))


PAIRS = dict(
    snaps="SELECT table_name, snapshot_at, lag(snapshot_at) OVER (PARTITION BY table_name ORDER BY snapshot_at) AS prev_at, row_number() OVER (PARTITION BY table_name ORDER BY snapshot_at DESC) AS rn FROM (SELECT DISTINCT table_name, snapshot_at FROM column_sightings)",
    news="SELECT s.table_name, s.snapshot_at, c.name, c.type FROM snaps s JOIN column_sightings c ON c.table_name = s.table_name AND c.snapshot_at = s.snapshot_at WHERE prev_at IS NOT NULL",
    olds="SELECT s.table_name, s.snapshot_at, c.name, c.type FROM snaps s JOIN column_sightings c ON c.table_name = s.table_name AND c.snapshot_at = s.prev_at",
    diffs="""SELECT coalesce(n.table_name, o.table_name) AS table_name, coalesce(n.snapshot_at, o.snapshot_at) AS detected_at,
        CASE WHEN n.name IS NULL THEN 'removed' WHEN o.name IS NULL THEN 'added' ELSE 'type_changed' END AS change_type,
        coalesce(n.name, o.name) AS column_name, o.type AS old_value, n.type AS new_value
        FROM news n FULL OUTER JOIN olds o ON n.table_name = o.table_name AND n.snapshot_at = o.snapshot_at AND n.name = o.name
        WHERE n.name IS NULL OR o.name IS NULL OR n.type <> o.type""")
SCHEMA = with_("column_sightings", **PAIRS)


@query("schema_snapshot", " UNION ALL ".join(f"""SELECT '{t}' AS table_name, string_agg(column_name, ',') AS names, count(*) AS n_columns
    FROM (DESCRIBE SELECT * FROM {t})""" for t in ("orders", "lineitem", "events", "documents")))
def schema_snapshot(spark, sf):
    out = S.snapshot(spark, {t: table(spark, sf, t) for t in ("orders", "lineitem", "events", "documents")}, EVENTS_AS_OF)
    return out.select("table_name", F.array_join(F.transform("columns", lambda c: c["name"]), ",").alias("names"),
                      F.size("columns").cast("bigint").alias("n_columns"))


@query("schema_diff", SCHEMA + """SELECT d.table_name, change_type, column_name, old_value, new_value FROM diffs d JOIN snaps s
    ON s.table_name = d.table_name AND s.snapshot_at = d.detected_at WHERE s.rn = 1""")
def schema_diff(spark, sf):
    order = Window.partitionBy("table_name").orderBy(F.desc("snapshot_at"))
    ranked = snapshots(spark, sf).withColumn("rn", F.row_number().over(order)).filter("rn <= 2")
    return S.diff(ranked.filter("rn = 2").drop("rn"), ranked.filter("rn = 1").drop("rn"))


@query("schema_diff_history", SCHEMA + "SELECT * FROM diffs")
def schema_diff_history(spark, sf):
    return S.diff_history(snapshots(spark, sf))


@query("schema_diff_list", SCHEMA + "SELECT * FROM diffs QUALIFY row_number() OVER (PARTITION BY table_name ORDER BY detected_at DESC, column_name DESC) <= 20")
def schema_diff_list(spark, sf):
    return S.latest_diffs(S.diff_history(snapshots(spark, sf)))


@query("schema_snapshots_list", with_("column_sightings") + """SELECT table_name, snapshot_at, string_agg(name || ':' || type, ',' ORDER BY name, type) AS columns_text
    FROM column_sightings GROUP BY table_name, snapshot_at QUALIFY row_number() OVER (PARTITION BY table_name ORDER BY snapshot_at DESC) <= 10""")
def schema_snapshots_list(spark, sf):
    out = S.latest_snapshots(snapshots(spark, sf))
    text = F.array_join(F.transform("columns", lambda c: F.concat(c["name"], F.lit(":"), c["type"])), ",")
    return out.select("table_name", "snapshot_at", text.alias("columns_text"))


@query("schema_diff_summary", SCHEMA + """SELECT table_name, detected_at, count(*) AS changes, string_agg('  - Column `' || column_name || '` ' || change_type ||
    CASE WHEN change_type = 'type_changed' THEN ': ' || old_value || ' → ' || new_value ELSE '' END, chr(10) ORDER BY column_name) AS summary
    FROM diffs GROUP BY table_name, detected_at""")
def schema_diff_summary(spark, sf):
    return S.summary(S.diff_history(snapshots(spark, sf)))


# ---- profiling ----

PROFILED = {
    "orders": {"o_orderkey": 1, "o_custkey": 1, "o_orderstatus": 0, "o_totalprice": 1, "o_orderdate": 0, "o_orderpriority": 0},
    "lineitem": {"l_orderkey": 1, "l_partkey": 1, "l_suppkey": 1, "l_linenumber": 1, "l_quantity": 1, "l_extendedprice": 1,
                 "l_discount": 1, "l_tax": 1, "l_returnflag": 0, "l_linestatus": 0, "l_shipdate": 0},
    "dirty": {"event_id": 1, "ts": 0, "user_id": 1, "event_type": 0, "value": 1, "email": 0},
}


def profile_sql(t, distinct=True):
    return " UNION ALL ".join(f"""SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) - count({c}) AS null_count,
        (count(*) - count({c})) / count(*) AS null_pct, {'count(DISTINCT ' + c + ') AS distinct_count,' if distinct else ''}
        CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value,
        {f'round(avg({c}), 7)' if numeric else 'CAST(NULL AS DOUBLE)'} AS mean_value,
        TIMESTAMP '{EVENTS_AS_OF}' AS profiled_at FROM {t}""" for c, numeric in PROFILED[t].items())


def profiled(spark, sf, fn):
    tables = {"orders": table(spark, sf, "orders"), "lineitem": table(spark, sf, "lineitem"), "dirty": fixture(spark, sf, "dirty")}
    out = reduce(DataFrame.unionByName, [fn(df, t, EVENTS_AS_OF) for t, df in tables.items()])
    return out.withColumn("mean_value", F.round("mean_value", 7))


@query("profile_columns", with_("dirty") + " UNION ALL ".join(profile_sql(t) for t in PROFILED))
def profile_columns(spark, sf):
    return profiled(spark, sf, P.profile)


@query("profile_columns_approx")
def profile_columns_approx(spark, sf):
    return profiled(spark, sf, P.profile_approx)


RUNS = """SELECT 'svc_' || CAST(user_id % 9 AS VARCHAR) AS table_name, event_type AS column_name, date_trunc('day', ts) AS profiled_at,
    count(*) - count(value) AS null_count, round(avg(value), 6) AS mean_value FROM dirty WHERE event_type IS NOT NULL GROUP BY ALL"""


@query("profile_latest", with_("dirty", runs=RUNS, newest="SELECT table_name, max(profiled_at) AS profiled_at FROM runs GROUP BY table_name")
       + "SELECT r.* FROM runs r JOIN newest n ON r.table_name = n.table_name AND r.profiled_at = n.profiled_at")
def profile_latest(spark, sf):
    d = fixture(spark, sf, "dirty").filter("event_type IS NOT NULL")
    runs = d.groupBy(F.concat(F.lit("svc_"), F.col("user_id") % 9).alias("table_name"), F.col("event_type").alias("column_name"),
                     F.to_date("ts").cast("timestamp_ntz").alias("profiled_at")).agg(
        (F.count(F.lit(1)) - F.count("value")).alias("null_count"), F.round(F.avg("value"), 6).alias("mean_value"))
    return P.latest(runs)


# ---- distribution ----


def top_sql(t, c, by="", n=20):
    g = f"{by}, " if by else ""
    tot = f"SELECT {g}count(*) AS total_rows, count(*) - count({c}) AS null_count FROM {t} {'GROUP BY ' + by if by else ''}"
    return f"""SELECT {'x.' + by + ',' if by else ''} '{c}' AS column_name, total_rows, null_count, null_count / total_rows AS null_pct, value_rank, value, value_count, value_count / total_rows AS pct
        FROM (SELECT {g}{c} AS value, count(*) AS value_count, CAST(row_number() OVER ({'PARTITION BY ' + by if by else ''} ORDER BY count(*) DESC, {c}) AS INTEGER) AS value_rank
              FROM {t} WHERE {c} IS NOT NULL GROUP BY {g}{c}) x JOIN ({tot}) y ON {f'x.{by} = y.{by}' if by else 'true'} WHERE value_rank <= {n}"""


@query("dist_categorical", with_("dirty") + top_sql("dirty", "event_type") + " UNION ALL " + top_sql("dirty", "email"))
def dist_categorical(spark, sf):
    return D.categorical(fixture(spark, sf, "dirty"), ["event_type", "email"])


def stats_sql(t, c, by=""):
    return f"""SELECT {by + ',' if by else ''} '{c}' AS column_name, count(*) AS total_rows, count(*) - count({c}) AS null_count, (count(*) - count({c})) / count(*) AS null_pct,
        coalesce(min({c}), 0) AS min, coalesce(max({c}), 0) AS max, round(coalesce(avg({c}), 0), 7) AS mean FROM {t} {'GROUP BY ' + by if by else ''}"""


NUMERIC = {"lineitem": ["l_quantity", "l_extendedprice", "l_discount"], "dirty": ["value"]}


def per_table(spark, sf, fn):
    return reduce(DataFrame.unionByName, [
        fn(fixture(spark, sf, t) if t == "dirty" else table(spark, sf, t), cs) for t, cs in NUMERIC.items()])


@query("dist_numeric_stats", with_("dirty") + " UNION ALL ".join(stats_sql(t, c) for t, cs in NUMERIC.items() for c in cs))
def dist_numeric_stats(spark, sf):
    return per_table(spark, sf, D.numeric_stats).withColumn("mean", F.round("mean", 7))


def rank_sql(t, c):
    marks = ", ".join(f"max(v) FILTER (WHERE rn = greatest(1, CAST(floor(n * {p}) AS BIGINT))) AS {k}" for k, p in D.PERCENTILES.items())
    return f"""SELECT '{c}' AS column_name, {marks} FROM (SELECT {c} AS v, row_number() OVER (ORDER BY {c}) AS rn, count(*) OVER () AS n FROM {t} WHERE {c} IS NOT NULL)"""


@query("dist_percentiles", with_("dirty") + " UNION ALL ".join(rank_sql(t, c) for t, cs in NUMERIC.items() for c in cs))
def dist_percentiles(spark, sf):
    return per_table(spark, sf, D.percentiles)


def hist_sql(t, c):
    return f"""SELECT '{c}' AS column_name, CAST(i + 1 AS INTEGER) AS bucket, round(any_value(s), 4) AS range_low, round(any_value(e), 4) AS range_high,
        count(*) FILTER (WHERE {c} >= s AND ({c} < e OR i = 9)) AS count
        FROM {t}, (SELECT i, lo + i * ((hi - lo) / 10) AS s, CASE i WHEN 9 THEN hi ELSE lo + (i + 1) * ((hi - lo) / 10) END AS e FROM (SELECT min({c}) AS lo, max({c}) AS hi FROM {t}), range(10) r(i)) b GROUP BY i"""


@query("dist_histogram", with_("dirty") + " UNION ALL ".join(hist_sql(t, c) for t, cs in NUMERIC.items() for c in cs))
def dist_histogram(spark, sf):
    return per_table(spark, sf, D.histogram)


def two_snapshots(spark, sf):
    make = lambda name, at: D.drift_snapshots(fixture(spark, sf, name), "events", ["event_type"], ["value"], instant(at))
    return make("dist_prev", "2024-01-16 00:00:00"), make("dist_curr", EVENTS_AS_OF)


NULLS = " UNION ALL ".join(f"""SELECT 'events' AS table_name, '{c}' AS column_name, round(p, 6) AS previous_null_pct, round(q, 6) AS current_null_pct, round(abs(q - p), 6) AS magnitude, abs(q - p) >= 0.05 AS drifted
    FROM (SELECT (SELECT (count(*) - count({c})) / count(*) FROM dist_prev) AS p, (SELECT (count(*) - count({c})) / count(*) FROM dist_curr) AS q)""" for c in ("event_type", "value"))


@query("drift_null_pct", with_("dist_prev", "dist_curr") + NULLS)
def drift_null_pct(spark, sf):
    return D.null_drift(*two_snapshots(spark, sf)).withColumns(
        {c: F.round(c, 6) for c in ("previous_null_pct", "current_null_pct", "magnitude")})


def share_sql(t):
    return f"SELECT event_type AS value, count(*) / (SELECT count(*) FROM {t}) AS pct FROM {t} WHERE event_type IS NOT NULL GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 20"


@query("drift_value_share", with_("dist_prev", "dist_curr", p=share_sql("dist_prev"), c=share_sql("dist_curr"),
       s="SELECT coalesce(c.value, p.value) AS value, coalesce(p.pct, 0) AS was, coalesce(c.pct, 0) AS now, abs(coalesce(c.pct, 0) - coalesce(p.pct, 0)) AS shift FROM p FULL OUTER JOIN c ON p.value = c.value")
       + """SELECT 'events' AS table_name, 'event_type' AS column_name, value, round(was, 6) AS previous_pct, round(now, 6) AS current_pct, round(shift, 6) AS magnitude, shift >= 0.1 AS drifted
            FROM s ORDER BY shift DESC, value LIMIT 1""")
def drift_value_share(spark, sf):
    return D.share_drift(*two_snapshots(spark, sf)).withColumns({c: F.round(c, 6) for c in ("previous_pct", "current_pct", "magnitude")})


@query("drift_mean_shift", with_("dist_prev", "dist_curr") + """SELECT 'events' AS table_name, 'value' AS column_name, round(p, 6) AS previous_mean, round(q, 6) AS current_mean,
    round(abs(q - p) / m, 6) AS magnitude, abs(q - p) / m >= 0.1 AS drifted FROM (SELECT (SELECT avg(value) FROM dist_prev) AS p, (SELECT avg(value) FROM dist_curr) AS q, (SELECT max(value) FROM dist_prev) AS m)""")
def drift_mean_shift(spark, sf):
    return D.mean_drift(*two_snapshots(spark, sf)).withColumns({c: F.round(c, 6) for c in ("previous_mean", "current_mean", "magnitude")})


def daily(spark, sf):
    return D.drift_snapshots(fixture(spark, sf, "daily_values"), "events", ["event_type"], ["value"], period="period")


DETECT = dict(
    tot="SELECT period, count(*) AS n, 1 - count(event_type) / count(*) AS cn, 1 - count(value) / count(*) AS vn, avg(value) AS mean, max(value) AS mx, lag(period) OVER (ORDER BY period) AS prev FROM daily_values GROUP BY period",
    sh="SELECT d.period, event_type AS value, count(*) / any_value(t.n) AS pct FROM daily_values d JOIN tot t ON t.period = d.period WHERE event_type IS NOT NULL GROUP BY d.period, event_type",
    pair="SELECT t.period, t.prev, v.value FROM tot t JOIN (SELECT DISTINCT value FROM sh) v ON true WHERE t.prev IS NOT NULL",
    mv="SELECT pair.*, coalesce(o.pct, 0) AS was, coalesce(n.pct, 0) AS now, abs(coalesce(n.pct, 0) - coalesce(o.pct, 0)) AS shift FROM pair LEFT JOIN sh o ON o.period = prev AND o.value = pair.value LEFT JOIN sh n ON n.period = pair.period AND n.value = pair.value",
    best="SELECT * FROM mv QUALIFY row_number() OVER (PARTITION BY period ORDER BY shift DESC, value) = 1",
    det="""SELECT 'events' AS table_name, 'event_type' AS column_name, t.period AS detected_at,
             CASE WHEN abs(t.cn - p.cn) >= 0.05 THEN 'null_pct_change' WHEN shift >= 0.1 THEN 'value_share_shift' END AS drift_type,
             CASE WHEN abs(t.cn - p.cn) >= 0.05 THEN abs(t.cn - p.cn) WHEN shift >= 0.1 THEN shift ELSE 0 END AS magnitude,
             CASE WHEN abs(t.cn - p.cn) >= 0.05 THEN printf('%.1f%% nulls', p.cn * 100) WHEN shift >= 0.1 THEN printf('''%s'' = %.1f%%', value, was * 100) END AS previous_value,
             CASE WHEN abs(t.cn - p.cn) >= 0.05 THEN printf('%.1f%% nulls', t.cn * 100) WHEN shift >= 0.1 THEN printf('''%s'' = %.1f%%', value, now * 100) END AS current_value
           FROM tot t JOIN tot p ON p.period = t.prev JOIN best b ON b.period = t.period
           UNION ALL SELECT 'events', 'value', t.period, CASE WHEN abs(t.vn - p.vn) >= 0.05 THEN 'null_pct_change' WHEN abs(t.mean - p.mean) / p.mx >= 0.1 THEN 'mean_shift' END,
             CASE WHEN abs(t.vn - p.vn) >= 0.05 THEN abs(t.vn - p.vn) WHEN abs(t.mean - p.mean) / p.mx >= 0.1 THEN abs(t.mean - p.mean) / p.mx ELSE 0 END,
             CASE WHEN abs(t.mean - p.mean) / p.mx >= 0.1 THEN printf('mean=%.2f', p.mean) END, CASE WHEN abs(t.mean - p.mean) / p.mx >= 0.1 THEN printf('mean=%.2f', t.mean) END
           FROM tot t JOIN tot p ON p.period = t.prev""")


@query("drift_detect", with_("daily_values", **DETECT) + "SELECT table_name, column_name, detected_at, drift_type IS NOT NULL AS drifted, drift_type, round(magnitude, 6) AS magnitude, previous_value, current_value FROM det")
def drift_detect(spark, sf):
    return D.detect(daily(spark, sf)).withColumn("magnitude", F.round("magnitude", 6))


@query("drift_list", with_("daily_values", **DETECT) + f"""SELECT table_name, column_name, drift_type, previous_value, current_value, round(magnitude * 100, 2) AS change_magnitude_pct, detected_at
    FROM det WHERE drift_type IS NOT NULL AND detected_at >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 20 DAY""")
def drift_list(spark, sf):
    return D.drifts(D.detect(daily(spark, sf)), "events", EVENTS_AS_OF, 20)


@query("dist_history", with_("daily_values", x=top_sql("daily_values", "event_type", "period")) + """
    SELECT 'events' AS table_name, column_name, period AS snapshotted_at, round(any_value(null_pct), 6) AS null_pct,
           string_agg(value || '=' || CAST(value_count AS VARCHAR), ',' ORDER BY value_rank) AS top_text
    FROM x GROUP BY column_name, period ORDER BY period DESC LIMIT 10""")
def dist_history(spark, sf):
    text = F.array_join(F.transform("top_values", lambda v: F.concat(v["value"], F.lit("="), v["value_count"].cast("string"))), ",")
    return D.history(daily(spark, sf), "events", "event_type").select(
        "table_name", "column_name", "snapshotted_at", F.round("null_pct", 6).alias("null_pct"), text.alias("top_text"))
