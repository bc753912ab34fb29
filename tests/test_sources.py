"""Sources, history tables, retention, documents, streams."""

import json
import re
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewarden.operators import alerts as A
from tablewarden.operators import checks as C
from tablewarden.operators import dbt as B
from tablewarden.operators import dedup as R
from tablewarden.operators import distribution as D2
from tablewarden.operators import maintenance as M
from tablewarden.operators import noise as N
from tablewarden.operators import recoveries as RC
from tablewarden.operators import runs as RU
from tablewarden.operators import status as ST2
from tablewarden.operators import volume as V
from tablewarden.queryset.fixtures import fixture, kept_checks
from tablewarden.queryset.kept import run_all
from tablewarden.queryset.streams import in_batches
from tablewarden.queryset.upkeep import artifacts
from tablewarden.session import cut_lineage, shared_folder, small_frame
from tablewarden.sources import documents as D
from tablewarden.sources import history as H
from tablewarden.sources import tables as S
from tablewarden.streaming import monitors as ST
from tests.conftest import values

SF = "/root/testdata/sf0.001"


def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


@pytest.mark.parametrize("kind,options", [("parquet", {}), ("orc", {}), ("json", {}), ("csv", {"header": "true"})])
def test_file_formats(spark, kind, options):
    df = small_frame(spark, [(1, "a"), (2, None)], "id int, s string")
    path = f"{folder()}/t"
    df.write.format(kind).options(**options).save(path)
    back = S.load(spark, S.TableSpec("t", kind, path, options, "id int, s string"))
    assert values(back, "id", "s") == [(1, "a"), (2, None)]


def test_catalog_table_and_unknown_source(spark):
    small_frame(spark, [(1,)], "id int").createOrReplaceTempView("some_view")
    assert S.load(spark, S.TableSpec("some_view", "table")).count() == 1
    with pytest.raises(Exception):
        S.load(spark, S.TableSpec("x", "nosuchformat", "/tmp/x")).count()


def test_max_timestamp_of_an_empty_table(spark):
    t = small_frame(spark, [], "ts timestamp_ntz")
    assert S.max_timestamps({"t": (t, "ts")}).first()["max_ts"] is None


def test_metadata_count_reads_no_data_and_restores_settings(spark):
    before = spark.conf.get("spark.sql.parquet.aggregatePushdown")
    counts = S.row_counts_from_statistics(spark, {"lineitem": f"{SF}/lineitem.parquet"})
    assert "PushedAggregation: [COUNT(*)]" in plan(counts)
    assert counts.first()["row_count"] == spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == before


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_file_stats(spark):
    path = f"{folder()}/t"
    spark.range(1000).repartition(4).write.parquet(path)
    row = S.file_stats(spark.read.parquet(path)).first()
    assert (row["num_files"], row["row_count"]) == (4, 1000) and row["total_bytes"] > 0
    empty = S.file_stats(spark.read.parquet(path).filter("id < 0")).first()
    assert (empty["num_files"], empty["total_bytes"], empty["row_count"]) == (0, 0, 0)


def test_scan_documents_from_files(spark):
    root = folder()
    docs = {"a.json": json.dumps({"checks": [{"name": "c1", "outcome": "pass", "table": "t", "measured_value": 3}, {}]}, indent=2),
            "b.json": json.dumps([{"outcome": "FAIL"}]), "c.json": "not json", "d.json": json.dumps({"other": 1})}
    for name, text in docs.items():
        with open(f"{root}/{name}", "w") as f:
            f.write(text)
    rows = D.scan_results(D.read_documents(spark, root)).withColumn("f", F.element_at(F.split("path", "/"), -1))
    assert values(rows, "f", "check_name", "table_name", "passed") == [
        ("a.json", "c1", "t", True), ("a.json", "unnamed", "unknown", False), ("b.json", "unnamed", "unknown", False), ("c.json", "scan", "unknown", False)]
    newest = D.read_documents(spark, root).agg(F.max("modified_at")).first()[0]
    assert D.newer_than(D.read_documents(spark, root), F.lit(newest)).count() == 0


def test_history_round_trip_and_pruning(spark):
    root = folder()
    H.append(kept_checks(spark, SF), "check_results", root)
    H.append(kept_checks(spark, SF), "check_results", root)
    back = H.read(spark, "check_results", root)
    assert back.count() == 2000 and back.schema["metric_value"].dataType.simpleString() == "decimal(20,6)"
    day = back.filter(F.col(H.PARTITION) == F.lit("2024-01-05").cast("date"))
    assert "PartitionFilters: [isnotnull(on_date" in plan(day)


def filled(df, table):
    """Rows of a history table of which only some columns matter."""
    return df.select([F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in H.schema(table).fields])


@pytest.mark.parametrize("table", sorted(H.HISTORY))
def test_history_takes_exactly_its_columns(spark, table):
    assert H.time_column(table) in H.schema(table).names
    whole = filled(small_frame(spark, [(1,)], "id bigint"), table)
    assert H.conform(whole, table).columns == H.schema(table).names
    with pytest.raises(ValueError, match="absent .*" + H.time_column(table)):
        H.conform(whole.drop(H.time_column(table)), table)
    with pytest.raises(ValueError, match="unknown .*more"):
        H.conform(whole.withColumn("more", F.lit(1)), table)


def test_results_of_monitors_come_back_whole(spark):
    root = folder()
    run_all(spark, SF, root)
    negative = spark.read.parquet(f"{SF}/events.parquet").where("value < 0").count()
    checks = H.read(spark, "check_results", root)
    assert values(checks, "check_name", "passed") == [("max(value) < 0", False), ("missing_count(value) = 0", True), ("negative", negative == 0), ("row_count > 0", True)]
    assert checks.where("executed_at is null or id is null or check_type is null").isEmpty()
    contract = H.read(spark, "contract_validation_results", root).first()
    assert (contract["contract_version"], contract["passed"], contract["total_rules"], contract["passed_rules"]) == ("2.0", False, 3, 1 + (negative == 0))
    assert "min_rows" in contract["violations"]
    drifts = H.read(spark, "distribution_drifts", root)
    assert drifts.where("change_magnitude is null or drift_type is null").isEmpty() and not drifts.isEmpty()
    snapshots = H.read(spark, "distribution_snapshots", root)
    assert D2.from_history(snapshots).where("column_type = 'numeric' and mean is null").isEmpty()
    again = folder()
    run_all(spark, SF, again)
    for name in ("check_results", "freshness_records", "volume_records", "late_arriving_records", "distribution_drifts"):
        assert values(H.read(spark, name, root), "id") == values(H.read(spark, name, again), "id")      # ids follow from the content


def test_readers_of_history_open_only_the_dates_they_ask_for(spark):
    root = folder()
    run_all(spark, SF, root)
    H.append(kept_checks(spark, SF), "check_results", root)
    H.append(H.fit(fixture(spark, SF, "alert_log"), "alert_logs"), "alert_logs", root)
    H.append(H.fit(fixture(spark, SF, "run_history").withColumn("end_time", F.col("start_time")), "pipeline_runs"), "pipeline_runs", root)
    H.append(filled(small_frame(spark, [(1,)], "id bigint"), "schema_diffs"), "schema_diffs", root)
    at, t = "2024-01-31 00:00:00", {n: H.read(spark, n, root) for n in ("check_results", "alert_logs", "volume_records", "freshness_records", "schema_diffs", "pipeline_runs", "distribution_drifts")}
    counts = small_frame(spark, [("a", 1)], "table_name string, row_count bigint")
    readers = {"trend": C.trend(t["check_results"], at), "daily": C.daily_pass_rate(t["check_results"], at), "day": C.checks_in_last_day(t["check_results"], at),
               "noise": N.counts(t["alert_logs"], at), "sent": A.last_sent(t["alert_logs"], at), "volume": V.check(counts, t["volume_records"], at),
               "runs": RU.success_rate(t["pipeline_runs"], at), "grid": ST2.grid(t["freshness_records"], t["volume_records"], t["check_results"], t["schema_diffs"], at),
               "drifts": D2.drifts(t["distribution_drifts"].selectExpr("*", "true AS drifted", "change_magnitude AS magnitude"), "events", at), "purge": M.preview({"alert_logs": t["alert_logs"]}, at)}
    for name, df in readers.items():
        found = re.findall(r"PartitionFilters: \[([^\]]*)\]", plan(df))
        assert found and all("on_date" in f for f in found if f is not None), name


def test_purge_keeps_null_times_and_is_repeatable(spark):
    root = folder()
    rows = [(1, "2024-01-01 10:00:00"), (2, "2024-01-05 08:00:00"), (3, "2024-01-05 12:00:00"), (4, "2024-01-06 00:00:00"), (5, None)]
    df = small_frame(spark, rows, "id bigint, t string").withColumn("sent_at", F.col("t").cast("timestamp_ntz"))
    H.append(filled(df, "alert_logs"), "alert_logs", root)
    for expected in (2, 0):
        log = M.apply(spark, root, ["alert_logs"], "2024-02-04 12:00:00")
        assert log.first()["deleted_counts"] == {"alert_logs": expected}
    assert values(H.read(spark, "alert_logs", root), "id") == [(3,), (4,), (5,)]
    assert H.read(spark, "maintenance_logs", root).count() == 2


def test_purge_of_a_whole_boundary_date(spark):
    root = folder()
    df = small_frame(spark, [(1, "2024-01-05 08:00:00")], "id bigint, t string").withColumn("sent_at", F.col("t").cast("timestamp_ntz"))
    H.append(filled(df, "alert_logs"), "alert_logs", root)
    M.apply(spark, root, ["alert_logs"], "2024-02-04 12:00:00")
    assert H.read(spark, "alert_logs", root).count() == 0


def test_shared_folder_follows_the_session(spark, monkeypatch):
    unset = shared_folder(spark)
    assert unset == shared_folder(spark)
    named, read = folder(), type(spark.conf).get
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *default: named if key == "spark.checkpoint.dir" else read(self, key, *default))
    assert shared_folder(spark) == named
    assert named in cut_lineage(spark.range(3)).inputFiles()[0]


def run(spark, stream):
    path = folder()
    ST.append_to(stream, path).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


@pytest.fixture(scope="module")
def event_files(spark):
    """Events in six files of ascending time, to be read one file per batch."""
    root = folder()
    events = spark.read.parquet(f"{SF}/events.parquet")
    for i in range(6):
        events.filter(F.dayofmonth("ts").between(i * 5 + 1, i * 5 + 5)).coalesce(1).write.mode("append").parquet(f"{root}")
    return root, events


def test_streaming_gate_keeps_its_state_between_batches(spark, event_files):
    root, events = event_files
    as_alerts = lambda df: df.select(F.col("event_id").alias("id"), F.lit("t").alias("table_name"), "event_type", F.col("ts").alias("sent_at")).withColumnRenamed("event_type", "alert_type")
    stream = ST.open_files(spark, root, events.schema, pattern="*.parquet", files_per_batch=1)
    sent = run(spark, ST.gate_alerts(as_alerts(stream), 600))
    batch = R.replay(as_alerts(events), 600)
    assert values(sent, "alert_type", "id") == values(batch, "alert_type", "id")


def test_streaming_volume_has_open_windows_and_late_rows(spark):
    root = folder()
    times = [["2024-01-05 10:00:00"], ["2024-01-01 09:00:00", "2024-01-05 11:00:00"], ["2024-01-01 08:00:00", "2024-01-06 01:00:00"]]
    for at in times:
        small_frame(spark, [("t", x) for x in at], "k string, x string").select("k", F.col("x").cast("timestamp_ntz").alias("ts")).coalesce(1).write.mode("append").parquet(root)
    stream = ST.open_files(spark, root, "k string, ts timestamp_ntz", pattern="*.parquet", files_per_batch=1)
    path = folder()
    ST.volume_per_batch(stream, "k", "ts", path).awaitTermination()
    parts = spark.read.parquet(f"{path}/rows")
    assert parts.select("batch").distinct().count() == 3
    got = values(ST.volume_so_far(parts).withColumn("day", F.dayofmonth("recorded_at")), "day", "row_count")
    assert got == [(1, 2), (5, 2), (6, 1)]


def test_streaming_freshness_over_batches(spark, event_files):
    root, events = event_files
    path = folder()
    stream = ST.open_files(spark, root, events.schema, pattern="*.parquet", files_per_batch=1)
    ST.newest_per_batch(stream, "event_type", "ts", path).awaitTermination()
    seen = spark.read.parquet(f"{path}/rows")
    assert seen.select("batch").distinct().count() == 6
    top = seen.groupBy("table_name").agg(F.max("last_updated_at").alias("m"), F.sum("rows").alias("n"))
    direct = events.groupBy(F.col("event_type").alias("table_name")).agg(F.max("ts").alias("m"), F.count(F.lit(1)).alias("n"))
    assert values(top, "table_name", "m", "n") == values(direct, "table_name", "m", "n")


def in_turn(spark, frames):
    """Each frame a file of its own, to be read one a batch."""
    root = folder()
    for f in frames:
        f.coalesce(1).write.mode("append").parquet(root)
    return ST.open_files(spark, root, frames[0].schema, pattern="*.parquet", files_per_batch=1)


def test_late_rows_are_late_against_what_the_stream_has_seen(spark):
    batches = [["2024-01-05 10:00:00", None], ["2024-01-05 09:00:00", "2024-01-05 09:30:00", "2024-01-06 08:00:00", "2024-01-01 00:00:00"], [None], ["2024-01-06 07:29:59", "2024-01-06 07:30:00", "2024-01-09 00:00:00"]]
    frames = [small_frame(spark, [(x,) for x in b], "x string").select(F.col("x").cast("timestamp_ntz").alias("ts"), "x") for b in batches]
    path = folder()
    ST.late_per_batch(in_turn(spark, frames), "ts", path, delay_seconds=1800).awaitTermination()
    rows = spark.read.parquet(f"{path}/rows")
    assert rows.count() == 10
    assert values(rows.where("late = 'true'"), "batch", "x") == [(1, "2024-01-01 00:00:00"), (1, "2024-01-05 09:00:00"), (3, "2024-01-06 07:29:59")]
    assert values(spark.read.parquet(f"{path}/progress"), "batch", "rows", "late_rows") == [(0, 2, 0), (1, 4, 2), (2, 1, 0), (3, 3, 1)]


def test_forgotten_times_change_no_decision():
    rng = np.random.default_rng(5)
    for round_ in range(300):
        window, blocked = int(rng.integers(1, 60)), int(rng.integers(-50, 50)) if round_ % 3 else R.NEVER
        at = rng.integers(-60, 600, int(rng.integers(1, 200)))
        held = np.empty(0, np.int64)
        for part in np.array_split(at, 6):
            held = np.unique(np.append(held, part[part > blocked]))
            held = held[R.still_needed(held, blocked, window)]
        whole = np.unique(at)
        assert held[R.sent_in_chunk(held, blocked, window)].tolist() == whole[R.sent_in_chunk(whole, blocked, window)].tolist()


def test_gate_holds_few_of_a_busy_pair(spark, monkeypatch):
    """Two million alerts of one pair inside three windows, after a first batch: what is held stays small."""
    most = []

    class Handle:
        def getValueState(self, *a, **k):
            return State()

    class State:
        def exists(self):
            return True

        def get(self):
            return (0,)

        def update(self, value):
            most.append(value)

    gate = ST.Gate(3_600_000_000, 24, 50_000)
    gate.init(Handle())
    seen, inner = [], ST.still_needed
    monkeypatch.setattr(ST, "still_needed", lambda at, *a: (seen.append(len(at)), inner(at, *a))[1])
    rng = np.random.default_rng(1)
    frames = (pd.DataFrame({"at": rng.integers(1, 3 * 3_600_000_000, 10_000), "id": np.arange(10_000) + 10_000 * i}) for i in range(200))
    sent = pd.concat(list(gate.handleInputRows(("t", "volume"), frames, None)))
    assert max(seen) <= 120_000 and len(sent) in (3, 4) and (np.diff(sent["at"]) > 3_600_000_000).all()


def test_streamed_recoveries_equal_the_batch_over_three_batches(spark):
    history = fixture(spark, SF, "check_history")
    parts = [history.where(F.dayofmonth("executed_at").between(a, b)) for a, b in ((1, 9), (10, 20), (21, 31))]
    streamed = run(spark, ST.recoveries(in_turn(spark, parts)))
    columns = ("table_name", "check_name", "event", "at", "id", "failing_since", "down_seconds", "failed_results")
    assert values(streamed, *columns) == values(RC.events(history), *columns)


def test_lasting_failures_are_recalled_once(spark):
    rows = [[("a", "c", 0, 1, False), ("b", "c", 0, 2, True)], [("a", "c", 50, 3, False), ("b", "c", 60, 4, False)], [("b", "c", 120, 5, True)], [("b", "c", 400, 6, True)], [("b", "c", 900, 7, True)]]
    frames = [small_frame(spark, [(t, c, f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00", i, ok) for t, c, m, i, ok in part], "table_name string, check_name string, x string, id bigint, passed boolean")
              .select("table_name", "check_name", F.col("x").cast("timestamp_ntz").alias("executed_at"), "id", "passed") for part in rows]
    got = run(spark, ST.recoveries(in_turn(spark, frames), remind_seconds=100 * 60))
    assert values(got, "table_name", "event", "id") == [("a", "failed", 1), ("a", "reminder", 3), ("b", "failed", 4), ("b", "recovered", 5)]


def test_results_that_come_before_their_manifest_still_join(spark):
    pairs = artifacts(spark, SF).withColumn("made_at", F.col("ts")).where("event_id < 60")
    results = [pairs.select("event_id", "made_at", "run_results").where(f"event_id % 2 = {k}") for k in (0, 1)]
    manifests = [pairs.select("event_id", "made_at", "manifest").where(f"event_id % 2 = {k}") for k in (1, 0)]
    joined = run(spark, ST.joined_artifacts(in_turn(spark, results), in_turn(spark, manifests), "event_id", "2024-01-31 00:00:00", "made_at", wait="40 days"))
    want = B.joined_results(pairs, "event_id", "2024-01-31 00:00:00").where("node is not null")
    assert values(joined, "event_id", "unique_id", "status", "at") == values(want, "event_id", "unique_id", "status", "at")


def test_results_are_matched_with_nodes_within_a_pair(spark):
    results = json.dumps({"metadata": {"invocation_id": "i", "generated_at": "2024-01-02T03:04:05Z"}, "results": [
        {"unique_id": "model.a", "status": "success", "execution_time": 1.5}, {"unique_id": "test.b", "status": "fail", "message": "m"}, {"unique_id": "source.c", "status": "pass"},
        {"unique_id": "model.unknown", "status": "success"}, {"status": "pass"}, None]})
    twice = json.dumps({"results": [{"unique_id": "model.a", "status": "error"}, {"unique_id": "model.a", "status": "success"}, {"unique_id": "test.b", "status": "pass"}]})
    manifest = json.dumps({"nodes": {"model.a": {"resource_type": "model"}, "test.b": {"resource_type": "test", "attached_node": "model.a"}},
                           "sources": {"source.c": {"resource_type": "snapshot"}, "model.a": {"resource_type": "seed"}}})
    rows = [(1, results, manifest), (2, twice, manifest), (3, results, "{}"), (4, "no json", manifest), (5, results, None), (6, None, manifest), (7, '{"results": []}', manifest)]
    pairs = small_frame(spark, rows, "id bigint, run_results string, manifest string")
    want = B.joined_results(pairs, "id", "2024-01-31 00:00:00").where("node is not null")
    columns = ("id", "invocation_id", "at", "unique_id", "status", "execution_time", "message", "node")
    got = values(B.matched_results(pairs, "id", "2024-01-31 00:00:00"), *columns)
    assert got == values(want, *columns) and len(got) == 6


def test_paired_artifacts_are_done_with_and_the_rest_waits(spark):
    pairs = artifacts(spark, SF).withColumn("made_at", F.col("ts")).where("event_id < 60")
    results = [pairs.select("event_id", "made_at", "run_results").where(f"event_id % 3 = {k}") for k in (0, 1, 2)]
    manifests = [pairs.select("event_id", "made_at", "manifest").where(f"event_id % 3 = {k} AND event_id <> 4") for k in (2, 0, 1)]
    path = folder()
    ST.artifacts_per_batch(in_turn(spark, results), in_turn(spark, manifests), "event_id", "2024-01-31 00:00:00", "made_at", path, wait="40 days").awaitTermination()
    want = B.joined_results(pairs.where("event_id <> 4"), "event_id", "2024-01-31 00:00:00").where("node is not null")
    assert values(spark.read.parquet(f"{path}/rows"), "event_id", "unique_id", "status", "at") == values(want, "event_id", "unique_id", "status", "at")
    kept = spark.read.parquet(f"{path}/met").groupBy("batch", F.col("paired").cast("string").alias("paired")).count()
    assert values(kept, "batch", "paired", "count") == [(0, "false", 40), (1, "false", 40), (1, "true", 20), (2, "false", 1), (2, "true", 39)]


def test_artifacts_without_their_other_half_are_given_up(spark):
    def documents(column, parts):
        return in_turn(spark, [small_frame(spark, [(i, f"2024-01-{day:02d} 00:00:00", "{}") for i, day in part], f"id bigint, x string, {column} string")
                               .select("id", F.col("x").cast("timestamp_ntz").alias("made_at"), column) for part in parts])

    path = folder()
    results = documents("run_results", [[(1, 1), (2, 1), (9, 1)], [(3, 6), (4, 20)], [(5, 20)]])
    manifests = documents("manifest", [[(7, 2), (9, 4)], [(2, 2), (8, 6)], [(1, 2)]])
    ST.artifacts_per_batch(results, manifests, "id", "2024-01-31 00:00:00", "made_at", path, wait="2 days").awaitTermination()
    met = spark.read.parquet(f"{path}/met")
    # 9 is made too far apart; after the second batch both streams have come to the 6th, so what is older than the 2nd goes
    assert values(met.where("batch = 1 AND paired"), "id") == [(2,)] and not met.where("batch = 2 AND paired").count()
    assert values(met.where("batch = 2"), "id") == [(1,), (3,), (4,), (5,), (7,), (8,), (9,)]


def test_a_micro_batch_is_a_number_of_files(spark):
    rows = spark.range(40).repartition(3).withColumn("batch", F.when(F.col("id") < 1, 0).when(F.col("id") < 30, 2).otherwise(3))
    path = folder()
    stream = in_batches(rows, spark, "numbers", 4, files=3)
    ST.newest_per_batch(stream.withColumn("k", F.lit("k")), "k", "id", path).awaitTermination()
    assert values(spark.read.parquet(f"{path}/rows"), "batch", "rows") == [(0, 1), (2, 29), (3, 10)]
