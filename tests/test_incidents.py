"""Incidents, components, lineage closure and recoveries against brute force, with hubs, cycles, ties and nulls."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tablewarden.operators import alerts as A
from tablewarden.operators import incidents as I
from tablewarden.operators import lineage as L
from tablewarden.operators import recoveries as R
from tablewarden.plans.chunked import with_last_marked, with_previous
from tablewarden.plans.components import components

DAY = datetime(2024, 1, 1)


class Groups(dict):
    def find(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def as_links(spark, pairs):
    return spark.createDataFrame(pairs, "a long, b long")


def test_components_of_random_graphs(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(7, 7), (900, 900), (None, 3), (5, None)]
    want = Groups()
    for a, b in pairs:
        if a is not None and b is not None:
            want.join(a, b)
    got = {r.node: r.component for r in components(as_links(spark, pairs)).collect()}
    assert got == {n: want.find(n) for n in want}


def test_components_of_a_long_path_and_a_hub(spark):
    path = spark.range(3000).select(((F.col("id") * 7919) % 3001).alias("a"), (((F.col("id") + 1) * 7919) % 3001).alias("b"))
    hub = spark.range(100_000).select((F.col("id") + 10_000).alias("a"), F.lit(5_000_000).alias("b"))
    found = components(path.unionByName(hub))
    assert {(r.component, r.n) for r in found.groupBy("component").agg(F.count("*").alias("n")).collect()} == {(0, 3001), (10_000, 100_001)}


def test_components_without_links(spark):
    assert components(as_links(spark, [])).count() == 0


def brute_incidents(rows, edges, gap):
    groups, timed = Groups(), [r for r in rows if r[2] is not None]
    for i, _, _ in timed:
        groups.find(i)
    by_table = defaultdict(list)
    for i, t, at in sorted(timed, key=lambda r: r[2]):
        if by_table[t] and at - by_table[t][-1][-1][1] <= gap:
            by_table[t][-1].append((i, at))
        else:
            by_table[t].append([(i, at)])
    for sessions in by_table.values():
        for s in sessions:
            for i, _ in s:
                groups.join(s[0][0], i)
    for a, b in edges:
        if a is None or b is None or a == b:
            continue
        for s in by_table.get(a, ()):
            for t in by_table.get(b, ()):
                if s[0][1] <= t[-1][1] + gap and t[0][1] <= s[-1][1] + gap:
                    groups.join(s[0][0], t[0][0])
    return {(i, groups.find(i)) for i, _, _ in timed}


@pytest.mark.parametrize("minutes", [1, 17, 240])
def test_incidents_are_those_of_the_definition(spark, minutes):
    rng = random.Random(minutes)
    tables = [f"t{i}" for i in range(12)] + [None]
    rows = [(i, rng.choice(tables), DAY + timedelta(minutes=rng.randrange(3000))) for i in range(350)]
    rows += [(1000 + i, "t0", DAY + timedelta(minutes=10 * i)) for i in range(40)] + [(2000, "t1", None)]
    rows += [(3000, "t5", DAY - timedelta(days=40000)), (3001, "t5", DAY - timedelta(days=40000) + timedelta(minutes=minutes))]    # before 1970, exactly a gap apart
    edges = [(f"t{rng.randrange(12)}", f"t{rng.randrange(12)}") for _ in range(14)] + [("t1", "t1"), ("t0", None), (None, "t3"), ("t0", "t1"), ("t1", "t0")]
    alerts = spark.createDataFrame([(*r, "fail") for r in rows], "id long, table_name string, raised_at timestamp_ntz, severity string").repartition(5)
    lineage = spark.createDataFrame(edges, "table_name string, downstream string")
    got = I.group_alerts(alerts, lineage, gap=f"{minutes}m")
    assert {(r.id, r.incident_id) for r in got.collect()} == brute_incidents(rows, edges, timedelta(minutes=minutes))
    summary = I.summarise(got, lineage).collect()
    assert sum(r.alerts for r in summary) == len(rows) - 1 and all(r.started_at <= r.ended_at for r in summary)


def test_incidents_without_alerts_or_edges(spark):
    alerts = spark.createDataFrame([(1, "a", DAY)], "id long, table_name string, raised_at timestamp_ntz")
    edges = spark.createDataFrame([], "table_name string, downstream string")
    assert I.group_alerts(alerts.limit(0), edges).count() == 0
    assert [r.incident_id for r in I.group_alerts(alerts, edges).collect()] == [1]


def test_a_hub_of_a_million_alerts_is_few_rows(spark):
    """One table raises nearly all alerts and has 300 tables below it, which raise a few each."""
    at = F.timestamp_micros(F.col("id") * 2_000_000).cast("timestamp_ntz")
    hub = spark.range(1_000_000).select("id", F.lit("hub").alias("table_name"), at.alias("raised_at"))
    rest = spark.range(3000).select((F.col("id") + 2_000_000).alias("id"), F.concat(F.lit("leaf"), F.col("id") % 300).alias("table_name"),
                                    F.timestamp_micros(F.col("id") * 600_000_000).cast("timestamp_ntz").alias("raised_at"))
    edges = spark.range(300).select(F.lit("hub").alias("table_name"), F.concat(F.lit("leaf"), "id").alias("downstream"))
    alerts = hub.unionByName(rest)
    found = I.sessions(alerts, 1_800_000_000)
    # what is grouped, joined and linked: buckets of half an hour, not alerts
    assert found.where("table_name = 'hub'").count() == 1112
    assert I.links(found, edges, 1_800_000_000).count() <= 3000
    got = I.group_alerts(alerts, edges)
    assert got.count() == 1_003_000 and got.select("incident_id").distinct().count() == 1


def brute_closure(edges, depth=None):
    below = defaultdict(set)
    for a, b in edges:
        if a is not None and b is not None:
            below[a].add(b)
    out = set()
    for a in below:
        seen, now, d = {}, {a}, 0
        while now and (depth is None or d < depth):
            d += 1
            now = {c for b in now for c in below.get(b, ())} - set(seen)
            seen |= dict.fromkeys(now, d)
        out |= {(a, b, d) for b, d in seen.items()}
    return out


@pytest.mark.parametrize("depth", [None, 1, 2, 5])
def test_closure_has_least_depths_and_ends_on_cycles(spark, depth):
    rng = random.Random(9)
    edges = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(55)]
    edges += [("a", "a"), ("x", "y"), ("y", "z"), ("z", "x"), ("x", "z"), (None, "a"), ("a", None)] + [(f"p{i}", f"p{i + 1}") for i in range(12)]
    frame = spark.createDataFrame(edges, "table_name string, downstream string")
    assert {tuple(r) for r in L.closure(frame, depth).select("table_name", "downstream", "depth").collect()} == brute_closure(edges, depth)
    tables = frame.select("table_name").where("table_name is not null")
    impact = {r.table_name: r.downstream for r in A.lineage_impact(tables, frame.dropna(), depth).collect()}
    for t, below in impact.items():
        want = {b for a, b, _ in brute_closure(edges, depth) if a == t and (depth == 1 or b != t)}
        assert below == sorted(want)


def test_manifest_edges(spark):
    docs = ['{"parent_map": {"m.b": ["m.a", "s.x"], "m.c": ["m.b"], "m.a": []}}', '{"parent_map": {"m.c": ["m.b", null], "m.d": null}}', '{"nodes": {}}', "not json", None, ""]
    got = L.manifest_edges(spark.createDataFrame([(d,) for d in docs], "manifest string"))
    assert {tuple(r) for r in got.collect()} == {("m.a", "m.b"), ("s.x", "m.b"), ("m.b", "m.c")} and got.count() == 3
    assert L.closure(got.limit(0)).count() == 0


def check_rows(seed=6):
    rng = random.Random(seed)
    rows, state = [], True
    for i in range(600):
        state = state if rng.random() < 0.8 else not state
        key = rng.choice([("a", "c1"), ("a", "c1"), ("b", "c1"), (None, "c2"), ("a", None)])
        rows.append((i, *key, DAY + timedelta(hours=rng.randrange(2000) // 3 * 3), state))
    return rows + [(700, "a", "c1", None, True), (701, "a", "c1", DAY, None)]


def machine(rows):
    by_key = defaultdict(list)
    for i, t, c, at, ok in rows:
        if at is not None and ok is not None:
            by_key[t, c].append((at, i, ok))
    events, open_ = set(), set()
    for key, own in by_key.items():
        since = None
        for at, i, ok in sorted(own):
            if not ok:
                if since is None:
                    since, n = at, 0
                    events.add((*key, "failed", at, i, None, None, None))
                n, last = n + 1, at
            elif since is not None:
                events.add((*key, "recovered", at, i, since, (at - since).total_seconds(), n))
                since = None
        if since is not None:
            open_.add((*key, since, last, n))
    return events, open_


@pytest.mark.parametrize("chunk", ["hour", "day", "year"])
def test_recoveries_are_those_of_the_state_machine(spark, chunk):
    rows = check_rows()
    frame = spark.createDataFrame(rows, "id long, table_name string, check_name string, executed_at timestamp_ntz, passed boolean").repartition(6)
    events, open_ = machine(rows)
    assert {tuple(r) for r in R.events(frame, chunk=chunk).collect()} == events
    assert {tuple(r) for r in R.still_failing(frame, chunk=chunk).collect()} == open_
    assert R.events(frame.limit(0)).count() == 0


def test_rows_before_across_chunks(spark):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), rng.randrange(100), i, rng.choice([None, 1, 2])) for i in range(300)]
    frame = spark.createDataFrame(rows, "k string, at int, id int, m int").repartition(4)
    part = F.floor(F.col("at") / 10)
    before = {r.id: r.previous for r in with_previous(frame, ["k"], part, ["at", "id"], F.col("id")).collect()}
    marked = {r.id: r.mark for r in with_last_marked(frame, ["k"], part, ["at", "id"], F.col("m"), "mark").collect()}
    for k in "ab":
        last = mark = None
        for _, at, i, m in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])):
            mark = m if m is not None else mark
            assert before[i] == last and marked[i] == mark
            last = i
