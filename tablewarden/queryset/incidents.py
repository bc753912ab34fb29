"""Incident groups, lineage at any depth, failures and recoveries of checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewarden.operators import alerts as A
from tablewarden.operators import incidents as I
from tablewarden.operators import lineage as L
from tablewarden.operators import recoveries as R
from tablewarden.queryset.fixtures import fixture, table, with_
from tablewarden.queryset.registry import query


def recursive(text: str) -> str:
    return text.replace("WITH", "WITH RECURSIVE", 1)


GAP = "INTERVAL 30 MINUTE"
INCIDENTS = dict(
    marked=f"SELECT *, CASE WHEN raised_at - lag(raised_at) OVER (PARTITION BY table_name ORDER BY raised_at, id) <= {GAP} THEN 0 ELSE 1 END AS b FROM table_alerts",
    numbered="SELECT *, sum(b) OVER (PARTITION BY table_name ORDER BY raised_at, id) AS n FROM marked",
    sess="SELECT table_name, n, min(raised_at) AS f, max(raised_at) AS l, min(id) AS s FROM numbered GROUP BY table_name, n",
    link=f"""SELECT a.s AS a, b.s AS b FROM sess a JOIN table_edges e ON e.table_name = a.table_name JOIN sess b ON b.table_name = e.downstream
             WHERE a.table_name <> b.table_name AND a.f <= b.l + {GAP} AND b.f <= a.l + {GAP}""",
    ways="SELECT a, b FROM link UNION SELECT b, a FROM link",
    reach="SELECT a, b FROM ways UNION SELECT r.a, w.b FROM reach r JOIN ways w ON r.b = w.a",
    least="SELECT a AS s, min(b) AS m FROM reach GROUP BY a",
    grouped="""SELECT t.* EXCLUDE (b, n), least(x.s, coalesce(m, x.s)) AS incident_id FROM numbered t
               JOIN sess x ON x.table_name IS NOT DISTINCT FROM t.table_name AND x.n = t.n LEFT JOIN least USING (s)""")
WITH_INCIDENTS = recursive(with_("table_alerts", "table_edges", **INCIDENTS))


@query("incident_groups", WITH_INCIDENTS + "SELECT id, table_name, raised_at, incident_id FROM grouped")
def incident_groups(spark, sf):
    return I.group_alerts(fixture(spark, sf, "table_alerts"), fixture(spark, sf, "table_edges")).select("id", "table_name", "raised_at", "incident_id")


@query("incident_summary", WITH_INCIDENTS + """SELECT g.incident_id, min(raised_at) AS started_at, max(raised_at) AS ended_at, count(*) AS alerts, count(DISTINCT table_name) AS tables,
    CASE max(CASE severity WHEN 'fail' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END) WHEN 2 THEN 'fail' WHEN 1 THEN 'warn' ELSE 'info' END AS severity,
    coalesce(string_agg(DISTINCT table_name, ',' ORDER BY table_name) FILTER (WHERE NOT EXISTS (SELECT 1 FROM grouped o JOIN table_edges e ON e.table_name = o.table_name
        WHERE o.incident_id = g.incident_id AND e.downstream = g.table_name AND e.table_name <> e.downstream)), '') AS roots
    FROM grouped g GROUP BY g.incident_id""")
def incident_summary(spark, sf):
    edges = fixture(spark, sf, "table_edges")
    out = I.summarise(I.group_alerts(fixture(spark, sf, "table_alerts"), edges), edges)
    return out.withColumn("roots", F.array_join("roots", ","))


def manifests(spark, sf):
    """One manifest a day, with the parents of the models that had events."""
    day = F.date_trunc("day", "ts").alias("day")
    number = F.col("user_id") % 120
    parent = F.concat(F.lit("model.shop.m"), (number * 7 + 3 + F.col("event_id") % 2 * 11) % 120)
    models = table(spark, sf, "events").groupBy(day, F.concat(F.lit("model.shop.m"), number).alias("model")).agg(F.collect_set(parent).alias("parents"))
    body = F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("model", "parents"))).alias("parent_map")))
    return models.groupBy("day").agg(body.alias("manifest"))


WALK = "SELECT table_name, downstream, 1 AS depth FROM {edges} UNION SELECT w.table_name, e.downstream, depth + 1 FROM walk w JOIN {edges} e ON w.downstream = e.table_name WHERE depth < {most}"


@query("lineage_closure", recursive(with_("model_edges", walk=WALK.format(edges="model_edges", most=30))) + "SELECT table_name, downstream, min(depth)::INTEGER AS depth FROM walk GROUP BY table_name, downstream")
def lineage_closure(spark, sf):
    return L.closure(L.manifest_edges(manifests(spark, sf)))


@query("lineage_impact_deep", recursive(with_("table_alerts", "table_edges", walk=WALK.format(edges="table_edges", most=3))) + """
    SELECT t.table_name, coalesce(string_agg(DISTINCT downstream, ',' ORDER BY downstream), '') AS downstream FROM (SELECT DISTINCT table_name FROM table_alerts) t
    LEFT JOIN (SELECT * FROM walk WHERE table_name <> downstream) w ON w.table_name = t.table_name GROUP BY t.table_name""")
def lineage_impact_deep(spark, sf):
    out = A.lineage_impact(fixture(spark, sf, "table_alerts"), fixture(spark, sf, "table_edges"), depth=3)
    return out.withColumn("downstream", F.array_join("downstream", ","))


ISLANDS = dict(
    turns="SELECT *, CASE WHEN passed IS DISTINCT FROM lag(passed) OVER w THEN 1 ELSE 0 END AS turn FROM check_history WINDOW w AS (PARTITION BY table_name, check_name ORDER BY executed_at, id)",
    numbered="SELECT *, sum(turn) OVER (PARTITION BY table_name, check_name ORDER BY executed_at, id) AS n FROM turns",
    islands="""SELECT table_name, check_name, n, passed, min(executed_at) AS at, arg_min(id, (executed_at, id)) AS id, max(executed_at) AS last_at, count(*) AS results
               FROM numbered GROUP BY table_name, check_name, n, passed""")


@query("alert_recoveries", with_("check_history", **ISLANDS) + """SELECT i.table_name, i.check_name, CASE WHEN i.passed THEN 'recovered' ELSE 'failed' END AS event, i.at, i.id,
    CASE WHEN i.passed THEN b.at END AS failing_since, CASE WHEN i.passed THEN (epoch_us(i.at) - epoch_us(b.at)) / 1e6 END AS down_seconds, CASE WHEN i.passed THEN b.results END AS failed_results
    FROM islands i LEFT JOIN islands b ON b.table_name = i.table_name AND b.check_name = i.check_name AND b.n = i.n - 1 WHERE NOT i.passed OR b.n IS NOT NULL""")
def alert_recoveries(spark, sf):
    return R.events(fixture(spark, sf, "check_history"))


@query("checks_still_failing", with_("check_history", **ISLANDS) + """SELECT table_name, check_name, islands.at AS failing_since, last_at, results AS failed_results FROM islands
    QUALIFY n = max(n) OVER (PARTITION BY table_name, check_name) AND NOT passed""")
def checks_still_failing(spark, sf):
    return R.still_failing(fixture(spark, sf, "check_history"))
