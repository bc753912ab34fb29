"""Shared plan shapes against brute force, with hot keys, ties and tiny limits that force every path."""

import bisect
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewarden.functions.cron import parse_cron
from tablewarden.operators import arrival as A
from tablewarden.operators import dedup as R
from tablewarden.operators import distribution as D
from tablewarden.plans.lookups import measured_join, salted_join
from tablewarden.plans.quantiles import grouped_quantiles
from tablewarden.plans.ranks import Wanted, values_at_ranks
from tablewarden.plans.rules import unmatched_rows
from tablewarden.plans.running import trailing_totals
from tablewarden.session import small_frame
from tests.conftest import values

START = datetime(2024, 1, 1)


def column(kind, n, seed=7):
    rng = random.Random(seed)
    if kind == "uniform":
        return [rng.random() * 1000 for _ in range(n)]
    if kind == "hot":      # one value holds a third of the rows
        return [5.0 if rng.random() < 1 / 3 else rng.choice([rng.random() * 5, rng.random() * 1e9]) for _ in range(n)]
    if kind == "two":
        return [rng.choice([1.0, 2.0]) for _ in range(n)]
    return [3.0] * n


@pytest.mark.parametrize("kind", ["uniform", "hot", "two", "constant"])
@pytest.mark.parametrize("final_rows", [0, 50, 10**6])
def test_values_at_ranks(spark, kind, final_rows):
    data = column(kind, 3000)
    df = small_frame(spark, [(v,) for v in data] + [(None,)] * 10, "v double")
    ranks = [1, 2, 750, 1500, 2250, 2999, 3000]
    got = values_at_ranks(df, [Wanted(str(r), "v", r, len(data)) for r in ranks], final_rows)
    assert got == {str(r): sorted(data)[r - 1] for r in ranks}


@pytest.mark.parametrize("n", [0, 1, 2, 7, 100])
def test_percentile_ranks(spark, n):
    data = column("uniform", n)
    row = D.percentiles(small_frame(spark, [(v,) for v in data], "v double"), ["v"]).first()
    for p, share in D.PERCENTILES.items():
        assert row[p] == (sorted(data)[max(1, int(n * share)) - 1] if n else None)


def test_histogram_loses_no_value_at_any_edge(spark):
    rng = random.Random(12)
    for _ in range(2000):
        low = rng.uniform(-1, 1) * 10 ** rng.randint(-6, 6)
        high = low + rng.random() * 10 ** rng.randint(-6, 6)
        if high > low:
            edges = D.bucket_bounds(low, high)
            assert edges[0][0] == low and edges[-1][1] == high and all(a[1] == b[0] for a, b in zip(edges, edges[1:]))
    data = [0.1, 0.7, 0.1 + 0.6 / 10 * 3, float("nan"), None, 0.64]
    assert sum(r["count"] for r in D.histogram(small_frame(spark, [(v,) for v in data], "v double"), ["v"]).collect()) == 4


def test_histogram_counts_every_row_once(spark):
    data = [0.0, 10.0, 10.0] + [i / 10 for i in range(100)]
    bars = D.histogram(small_frame(spark, [(v,) for v in data], "v double"), ["v"])
    assert bars.agg(F.sum("count")).first()[0] == len(data)
    assert D.histogram(small_frame(spark, [(1.0,), (1.0,)], "v double"), ["v"]).count() == 0


def test_numeric_snapshot_agrees_with_its_parts(spark):
    rows = [(v, None if i % 7 == 0 else i % 13) for i, v in enumerate(column("hot", 500))]
    df = small_frame(spark, rows, "a double, b int").withColumn("c", F.lit(4)).withColumn("d", F.lit(None).cast("int"))
    names = ["a", "b", "c", "d"]
    snap = {r["column_name"]: r for r in D.numeric_snapshot(df, "t", names, F.lit("2024-01-01").cast("timestamp_ntz")).collect()}
    marks = {r["column_name"]: r for r in D.percentiles(df, names).collect()}
    bars = D.histogram(df, names).collect()
    assert sorted(snap) == names and snap["c"]["histogram"] is None and snap["d"]["max"] == 0.0
    for c in names:
        assert snap[c]["percentiles"].asDict() == {p: marks[c][p] for p in D.PERCENTILES}
        assert [tuple(b) for b in snap[c]["histogram"] or []] == sorted((b["bucket"], b["range_low"], b["range_high"], b["count"]) for b in bars if b["column_name"] == c)


def test_grouped_quantiles(spark):
    rng = random.Random(3)
    rows = [("hot", rng.random() * 50) for _ in range(800)] + [("hot", 7.0)] * 400 + [("one", 4.5)] + [("neg", -rng.random() * 9) for _ in range(31)]
    got = grouped_quantiles(small_frame(spark, rows, "k string, v double"), ["k"], F.col("v"), {"p50": 0.5, "p95": 0.95}, 0.5)
    for k, p50, p95 in got.select("k", "p50", "p95").collect():
        mine = [v for g, v in rows if g == k]
        assert (p50, p95) == pytest.approx((np.quantile(mine, 0.5), np.quantile(mine, 0.95)))
    assert got.count() == 3


@pytest.mark.parametrize("chunk", [3600, 6 * 3600, 40 * 86400])
def test_trailing_totals(spark, chunk):
    rng = random.Random(5)
    rows = [(i, "hot" if i % 3 else f"t{i % 4}", START + timedelta(hours=rng.randrange(24 * 30)), rng.randrange(1000)) for i in range(400)]
    df = small_frame(spark, rows, "id bigint, k string, at timestamp_ntz, v bigint")
    got = trailing_totals(df, ["k"], "at", {"n": F.lit(1).cast("bigint"), "total": F.col("v")}, 7 * 86400, chunk)
    expected = []
    for i, k, at, v in rows:
        window = [w for _, kk, t, w in rows if kk == k and at - timedelta(days=7) <= t < at]
        expected.append((i, len(window), sum(window)))
    assert sorted(values(got, "id", "n", "total")) == expected


def brute_replay(moments, minutes):
    sent, last = [], None
    for at in sorted(moments):
        if last is None or at > last + timedelta(minutes=minutes):
            sent.append(at)
            last = at
    return sent


@pytest.mark.parametrize("minutes,windows", [(60, 1), (60, 2), (60, 32), (7, 3), (60, None), (30, None)])
def test_dedup_replay(spark, minutes, windows):
    rng = random.Random(11)
    moments = {("hot", "q"): [START + timedelta(minutes=i) for i in range(2000)],                      # steady, no gap
               ("burst", "q"): [START + timedelta(seconds=rng.randrange(5 * 86400)) for _ in range(700)],
               ("same", "q"): [START] * 50 + [START + timedelta(minutes=minutes)] * 3 + [START + timedelta(minutes=minutes, seconds=1)],
               ("rare", "v"): [START + timedelta(days=d) for d in (0, 40, 41)]}
    rows, i = [], 0
    for (t, k), times in moments.items():
        for at in times:
            rows.append((i, t, k, at))
            i += 1
    df = small_frame(spark, rows, "id bigint, table_name string, alert_type string, sent_at timestamp_ntz")
    got = {}
    for t, k, at, first in R.replay(df, minutes, chunk_windows=windows, chunk_rows=100).select("table_name", "alert_type", "sent_at", "id").collect():
        got.setdefault((t, k), []).append(at)
        assert first == min(j for j, tt, kk, aa in rows if (tt, kk, aa) == (t, k, at))
    assert {k: sorted(v) for k, v in got.items()} == {k: brute_replay(v, minutes) for k, v in moments.items()}


def test_chunk_steps_are_few_for_a_full_chunk():
    at = np.sort(np.random.default_rng(1).integers(0, 32 * 3_600_000_000, 200_000))
    steps = R.chunk_steps(at, 0, 3_600_000_000)
    assert len(steps) < len(at) / 100
    for blocked in (-1, 5, 1_000_000_000, 3_599_999_999):
        i = bisect.bisect_right([u for u, _ in steps], blocked)
        assert steps[i][1] == at[R.sent_in_chunk(at, blocked, 3_600_000_000)[-1]]


def test_joins_agree_whatever_the_size(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 50}" if i % 7 else None) for i in range(600)]
    facts = small_frame(spark, rows, "id bigint, k string")
    dim = small_frame(spark, [("hot", 1), ("k1", 2), ("k2", 3)], "k string, v int")
    for how in ("left", "inner", "left_anti", "left_semi"):
        side = dim if how in ("left", "inner") else dim.select("k")
        plain = facts.join(side, ["k"], how)
        keep = plain.columns
        assert values(salted_join(facts, side, ["k"], how, 8), *keep) == values(plain, *keep)
        assert values(measured_join(facts, side, ["k"], how, row_limit=1), *keep) == values(plain, *keep)
        assert values(measured_join(facts, side, ["k"], how), *keep) == values(plain, *keep)


def test_unmatched_rows_and_null_keys(spark):
    child = small_frame(spark, [(1,), (1,), (9,), (None,), (None,), (9,), (9,)], "a int")
    parent = small_frame(spark, [(1,), (1,), (None,)], "b int")
    assert unmatched_rows(child, ["a"], parent, ["b"]).first()[0] == 5
    assert unmatched_rows(child, ["a"], parent, ["b"], skip_null_keys=True).first()[0] == 3


def brute_slots(text, first, last):
    cron, out, at = parse_cron(text), [], first
    while at < last:
        dom, dow = at.day in cron.days, (at.weekday() + 1) % 7 in cron.weekdays
        if at.month in cron.months and at.hour * 60 + at.minute in cron.times and ((dom or dow) if cron.either_day else (dom and dow)):
            out.append(at)
        at += timedelta(minutes=1)
    return out


@pytest.mark.parametrize("cron", ["0 2 * * *", "*/20 * * * *", "15 6,18 * * 1-5", "30 0 1,15 * mon", "0 0 31 * *", "5 4 * feb sun", "59 23 * * 7"])
def test_cron_slots(spark, cron):
    first, as_of = datetime(2024, 1, 3, 1, 30), datetime(2024, 4, 2, 2, 0)
    got = values(A.slots(spark, cron, first, as_of), "expected_at", "prev_expected_at")
    times = brute_slots(cron, datetime(2023, 1, 1), as_of)
    expected = [(t, times[i - 1]) for i, t in enumerate(times) if t >= first]
    assert sorted(got) == expected


def test_rare_cron_day(spark):
    got = values(A.slots(spark, "0 0 29 2 *", "2020-01-01", "2025-01-01"), "expected_at", "prev_expected_at")
    assert got == [(datetime(2020, 2, 29), datetime(2016, 2, 29)), (datetime(2024, 2, 29), datetime(2020, 2, 29))]


@pytest.mark.parametrize("bad", ["* * * *", "60 * * * *", "* 24 * * *", "* * 0 * *", "a b c d e"])
def test_bad_cron(bad):
    with pytest.raises(ValueError):
        parse_cron(bad)


@pytest.mark.parametrize("cron,grace", [("0 2 * * *", 60), ("0 */6 * * *", 600), ("*/30 * * * *", 5), ("0 3 * * 1", 90)])
def test_arrival_windows(spark, cron, grace):
    rng = random.Random(2)
    times = [START + timedelta(seconds=rng.randrange(20 * 86400)) for _ in range(300)] + [START + timedelta(days=3, hours=2)] * 40
    as_of = START + timedelta(days=20)
    df = small_frame(spark, [(t,) for t in times], "ts timestamp_ntz")
    slots = brute_slots(cron, START - timedelta(days=30), as_of + timedelta(days=30))
    first = min(times)
    plain = {r["expected_at"]: r for r in A.check(df, "t", "ts", as_of, cron, grace, 3).collect()}
    graced = {r["expected_at"]: r for r in A.check_grace(df, "t", "ts", as_of, cron, grace, 3).collect()}
    wanted = [i for i, s in enumerate(slots) if first <= s < as_of]
    assert sorted(plain) == sorted(graced) == [slots[i] for i in wanted]
    for i in wanted:
        slot, prev, after = slots[i], slots[i - 1], slots[i + 1]
        deadline = slot + timedelta(minutes=grace)
        n = sum(prev < t <= slot for t in times)
        assert plain[slot]["rows_arrived"] == n
        assert plain[slot]["status"] == ("missing" if n < 3 and as_of >= deadline else "ok")
        end = max(after, deadline)
        on_time, total = sum(prev < t <= deadline for t in times), sum(prev < t <= end for t in times)
        status = "ok" if on_time >= 3 else "late" if total >= 3 else "missing" if as_of >= deadline else "ok"
        assert graced[slot]["status"] == status


def test_last_arrival_only(spark):
    df = small_frame(spark, [(START + timedelta(hours=h),) for h in range(60)], "ts timestamp_ntz")
    rows = A.check(df, "t", "ts", "2024-01-03 02:00:00", last_only=True).collect()
    assert [(r["expected_at"], r["rows_arrived"]) for r in rows] == [(datetime(2024, 1, 2, 2), 24)]
