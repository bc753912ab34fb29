"""Distribution snapshots of columns and the drift between snapshots."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewarden.functions.times import before
from tablewarden.plans.newest import newest
from tablewarden.plans.ranks import FINAL_ROWS, Wanted, values_at_ranks
from tablewarden.plans.recent import since
from tablewarden.session import small_frame

# Fixed values.
TOP_VALUES = 20
BUCKETS = 10
PERCENTILES = {"p25": 0.25, "p50": 0.50, "p75": 0.75, "p95": 0.95}
DRIFT_THRESHOLD = 0.1
NULL_THRESHOLD = 0.05


ENTRY = "struct<value_rank:int,value:string,value_count:bigint>"


def top_lists(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), top: int = TOP_VALUES) -> DataFrame:
    """(*by, column_name, total_rows, null_count, entries): the most frequent values of each column.

    Values are counted on the map side first, and the list is cut per task before the final
    ranking, so no task sees all the values of a column. Totals and lists are stacked and merged
    by one aggregate over at most ``top`` + 1 rows per group.
    """
    totals = df.groupBy(*by).agg(F.count(F.lit(1)).alias("total_rows"),
                                 *[F.count(c).alias(f"have{i}") for i, c in enumerate(columns)])
    totals = totals.select(*by, "total_rows", F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), (F.col("total_rows") - F.col(f"have{i}")).alias("null_count"))
        for i, c in enumerate(columns)])))
    order = Window.partitionBy(*by, "column_name").orderBy(F.desc("value_count"), "value")
    parts = [totals]
    for c in columns:
        counts = df.filter(F.col(c).isNotNull()).groupBy(*by, F.col(c).cast("string").alias("value")).agg(
            F.count(F.lit(1)).alias("value_count"))
        ranked = (counts.select(*by, F.lit(c).alias("column_name"), "value", "value_count")
                  .withColumn("value_rank", F.row_number().over(order)).filter(F.col("value_rank") <= top))
        parts.append(ranked.select(*by, "column_name", F.struct("value_rank", "value", "value_count").cast(ENTRY).alias("entry")))
    stacked = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    return stacked.groupBy(*by, "column_name").agg(
        F.max("total_rows").alias("total_rows"), F.max("null_count").alias("null_count"),
        F.array_sort(F.collect_list("entry")).alias("entries"))


def _null_pct() -> Column:
    return F.coalesce(F.try_divide("null_count", "total_rows"), F.lit(0.0))


def categorical(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), top: int = TOP_VALUES) -> DataFrame:
    """Most frequent values of each column (ties by value), with shares of all rows, nulls included.

    Rows: (*by, column_name, total_rows, null_count, null_pct, value_rank, value, value_count, pct).
    """
    lists = top_lists(df, columns, by, top)
    rows = lists.select(*by, "column_name", "total_rows", "null_count", _null_pct().alias("null_pct"), F.inline_outer("entries"))
    return rows.withColumn("pct", F.col("value_count") / F.col("total_rows"))


def numeric_stats(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Row and null counts, min, max and mean of every column from one scan; NULL becomes 0."""
    asked = [F.count(F.lit(1)).alias("total_rows")]
    for i, c in enumerate(columns):
        v = F.col(c).cast("double")
        asked += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"), F.avg(v).alias(f"mean{i}")]
    zero = F.lit(0.0)
    rows = [F.struct(F.lit(c).alias("column_name"), (F.col("total_rows") - F.col(f"n{i}")).alias("null_count"),
                     F.coalesce(F.try_divide(F.col("total_rows") - F.col(f"n{i}"), F.col("total_rows")), zero).alias("null_pct"),
                     F.coalesce(f"lo{i}", zero).alias("min"), F.coalesce(f"hi{i}", zero).alias("max"),
                     F.coalesce(f"mean{i}", zero).alias("mean"))
            for i, c in enumerate(columns)]
    measured = df.groupBy(*by).agg(*asked) if by else df.agg(*asked)
    return measured.select(*by, "total_rows", F.inline(F.array(*rows)))


def wanted_rank(rows: int, share: float) -> int:
    return max(1, int(rows * share))


def percentiles(df: DataFrame, columns: Sequence[str], final_rows: int = FINAL_ROWS,
                counts: Sequence[int] | None = None) -> DataFrame:
    """Exact values at rank max(1, floor(n * p)) of the non-null values, one row per column.

    ``counts`` are the non-null rows of the columns if they are known already.
    """
    if counts is None:
        counts = df.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    wanted = [Wanted(f"{c}.{p}", c, wanted_rank(counts[i], share), counts[i])
              for i, c in enumerate(columns) for p, share in PERCENTILES.items()]
    found = values_at_ranks(df, wanted, final_rows)
    rows = [(c, *[found[f"{c}.{p}"] for p in PERCENTILES]) for c in columns]
    return small_frame(df.sparkSession, rows, "column_name string, " + ", ".join(f"{p} double" for p in PERCENTILES))


def bucket_bounds(low: float, high: float, buckets: int = BUCKETS) -> list[tuple[float, float]]:
    """Between neighbours of one list of edges, of which the last is the maximum itself: no value is between or beyond them."""
    width = (high - low) / buckets
    edges = [low + i * width for i in range(buckets)] + [high]
    return list(zip(edges, edges[1:]))


def histogram(df: DataFrame, columns: Sequence[str],
              bounds: Sequence[tuple[float | None, float | None]] | None = None) -> DataFrame:
    """Ten equal-width buckets per column, the last one closed; none for a constant column. NaN is in no bucket.

    One scan for the bounds unless they are given, one for the conditional counts of all columns.
    """
    if bounds is None:
        number = lambda c: F.nullif(F.col(c).cast("double"), F.lit(float("nan")))
        flat = df.agg(*[f(number(c)).alias(f"{n}{i}") for i, c in enumerate(columns)
                        for n, f in (("lo", F.min), ("hi", F.max))]).first()
        bounds = list(zip(flat[0::2], flat[1::2]))
    asked, rows = [], []
    for i, c in enumerate(columns):
        low, high = bounds[i]
        if low is None or not high > low:
            continue
        v = F.col(c).cast("double")
        for b, (start, end) in enumerate(bucket_bounds(low, high), start=1):
            inside = (v >= start) & ((v <= end) if b == BUCKETS else (v < end))
            asked.append(F.count_if(inside).alias(f"b{i}_{b}"))
            rows.append(F.struct(F.lit(c).alias("column_name"), F.lit(b).alias("bucket"),
                                 F.round(F.lit(start), 4).alias("range_low"), F.round(F.lit(end), 4).alias("range_high"),
                                 F.col(f"b{i}_{b}").alias("count")))
    if not rows:
        return small_frame(df.sparkSession, [], "column_name string, bucket int, range_low double, range_high double, count bigint")
    return df.agg(*asked).select(F.inline(F.array(*rows)))


def numeric_snapshot(df: DataFrame, table: str, columns: Sequence[str], at: Column) -> DataFrame:
    """Full numeric snapshot rows, one per column.

    The statistics of the columns (a row each) are fetched first; they give the ranks and the
    bucket bounds, so the table is read once for them, once for the buckets and, as long as the
    columns are not too long for it, once for the ranks.
    """
    stats = numeric_stats(df, columns)
    found = {r["column_name"]: r for r in stats.collect()}
    known = small_frame(df.sparkSession, [tuple(found[c][n] for n in stats.columns) for c in columns],
                        ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stats.schema.fields))
    bars = histogram(df, columns, [(found[c]["min"], found[c]["max"]) for c in columns]).groupBy("column_name").agg(
        F.array_sort(F.collect_list(F.struct("bucket", "range_low", "range_high", "count"))).alias("histogram"))
    filled = [found[c]["total_rows"] - found[c]["null_count"] for c in columns]
    marks = percentiles(df, columns, counts=filled).select("column_name", F.struct(*PERCENTILES).alias("percentiles"))
    return (known.join(marks, "column_name").join(bars, "column_name", "left")
            .select(F.lit(table).alias("table_name"), "column_name", F.lit("numeric").alias("column_type"),
                    "total_rows", "null_count", "null_pct", "min", "max", "mean", "percentiles", "histogram",
                    at.alias("snapshotted_at")))


SNAPSHOT = ("table_name", "column_name", "column_type", "null_pct", "mean", "max", "top_values", "snapshotted_at")


def drift_snapshots(df: DataFrame, table: str, categorical_columns: Sequence[str],
                    numeric_columns: Sequence[str], at: Column | None = None,
                    period: str | None = None) -> DataFrame:
    """What drift detection needs of a snapshot: one row per column, or per period and column.

    With ``period`` the snapshots of all periods in the table come from the same scans.
    """
    by = [period] if period else []
    when = F.col(period) if period else at
    parts = []
    if categorical_columns:
        shares = F.transform("entries", lambda e: F.struct(
            e["value_rank"].alias("value_rank"), e["value"].alias("value"), e["value_count"].alias("value_count"),
            (e["value_count"] / F.col("total_rows")).alias("pct")))
        lists = top_lists(df, categorical_columns, by).select(
            *by, "column_name", _null_pct().alias("null_pct"), shares.alias("top_values"))
        parts.append(lists.select(F.lit(table).alias("table_name"), "column_name", F.lit("categorical").alias("column_type"),
                                  "null_pct", F.lit(None).cast("double").alias("mean"), F.lit(None).cast("double").alias("max"),
                                  "top_values", when.alias("snapshotted_at")))
    if numeric_columns:
        stats = numeric_stats(df, numeric_columns, by)
        none = F.lit(None).cast("array<struct<value_rank:int,value:string,value_count:bigint,pct:double>>")
        parts.append(stats.select(F.lit(table).alias("table_name"), "column_name", F.lit("numeric").alias("column_type"),
                                  "null_pct", "mean", "max", none.alias("top_values"), when.alias("snapshotted_at")))
    return reduce(DataFrame.unionByName, parts)


def from_history(records: DataFrame) -> DataFrame:
    """Snapshots as `detect` takes them, from rows of the history table."""
    kind = "struct<null_pct:double,mean:double,max:double,top_values:array<struct<value_rank:int,value:string,value_count:bigint,pct:double>>>"
    parsed = records.withColumn("d", F.from_json("distribution", kind))
    return parsed.select("table_name", "column_name", "column_type", "d.*", "snapshotted_at")


def null_change(prev: str, curr: str) -> Column:
    return F.abs(F.col(f"{curr}.null_pct") - F.col(f"{prev}.null_pct"))


def largest_share_shift(prev: str, curr: str) -> Column:
    """Struct(value, shift, was, now) of the value whose share moved most (ties: smallest value).

    Works inside the row on the two top lists, which hold at most 20 entries each.
    """
    def shares(side: str) -> Column:
        entries = F.coalesce(F.col(f"{side}.top_values"), F.array().cast("array<struct<value_rank:int,value:string,value_count:bigint,pct:double>>"))
        return F.map_from_entries(F.transform(entries, lambda v: F.struct(v["value"], v["pct"])))

    was, now = shares(prev), shares(curr)
    zero = F.lit(0.0)
    moved = F.transform(F.array_union(F.map_keys(was), F.map_keys(now)), lambda v: F.struct(
        (-F.abs(F.coalesce(F.element_at(now, v), zero) - F.coalesce(F.element_at(was, v), zero))).alias("neg"),
        v.alias("value"), F.coalesce(F.element_at(was, v), zero).alias("was"), F.coalesce(F.element_at(now, v), zero).alias("now")))
    best = F.array_min(moved)
    return F.struct(best["value"].alias("value"), F.coalesce(-best["neg"], zero).alias("shift"),
                    best["was"].alias("was"), best["now"].alias("now"))


def mean_shift(prev: str, curr: str) -> Column:
    scale = F.abs(F.coalesce(F.nullif(F.col(f"{prev}.max"), F.lit(0.0)), F.lit(1.0)))
    return F.abs(F.coalesce(f"{curr}.mean", F.lit(0.0)) - F.coalesce(f"{prev}.mean", F.lit(0.0))) / scale


def _pair(prev: DataFrame, curr: DataFrame) -> DataFrame:
    return curr.alias("c").join(prev.alias("p"), ["table_name", "column_name"])


def null_drift(prev: DataFrame, curr: DataFrame, threshold: float = NULL_THRESHOLD) -> DataFrame:
    change = null_change("p", "c")
    return _pair(prev, curr).select("table_name", "column_name", F.col("p.null_pct").alias("previous_null_pct"),
                                    F.col("c.null_pct").alias("current_null_pct"), change.alias("magnitude"),
                                    (change >= threshold).alias("drifted"))


def share_drift(prev: DataFrame, curr: DataFrame, threshold: float = DRIFT_THRESHOLD) -> DataFrame:
    pairs = _pair(prev, curr).filter(F.col("c.column_type") == "categorical")
    rows = pairs.select("table_name", "column_name", largest_share_shift("p", "c").alias("s"))
    return rows.select("table_name", "column_name", "s.value", F.col("s.was").alias("previous_pct"),
                       F.col("s.now").alias("current_pct"), F.col("s.shift").alias("magnitude"),
                       (F.col("s.shift") >= threshold).alias("drifted"))


def mean_drift(prev: DataFrame, curr: DataFrame, threshold: float = DRIFT_THRESHOLD) -> DataFrame:
    pairs = _pair(prev, curr).filter(F.col("c.column_type") == "numeric")
    rows = pairs.select("table_name", "column_name", F.col("p.mean").alias("previous_mean"),
                        F.col("c.mean").alias("current_mean"), mean_shift("p", "c").alias("magnitude"))
    return rows.withColumn("drifted", F.col("magnitude") >= threshold)


def _judge(pairs: DataFrame, threshold: float, null_threshold: float) -> DataFrame:
    """``pairs`` has structs p (previous) and c (current). Null change is looked at first."""
    kind = F.col("c.column_type")
    marked = (pairs.withColumn("nulls", null_change("p", "c"))
              .withColumn("s", F.when(kind == "categorical", largest_share_shift("p", "c")))
              .withColumn("m", F.when(kind == "numeric", mean_shift("p", "c"))))
    by_null, by_share, by_mean = (F.col("nulls") >= null_threshold, F.col("s.shift") >= threshold, F.col("m") >= threshold)

    def text(side: str, share: str) -> Column:
        return (F.when(by_null, F.format_string("%.1f%% nulls", F.col(f"{side}.null_pct") * 100))
                .when(by_share, F.format_string("'%s' = %.1f%%", F.col("s.value"), F.col(f"s.{share}") * 100))
                .when(by_mean, F.format_string("mean=%.2f", F.col(f"{side}.mean"))))

    drift_type = F.when(by_null, "null_pct_change").when(by_share, "value_share_shift").when(by_mean, "mean_shift")
    size = F.when(by_null, F.col("nulls")).when(by_share, F.col("s.shift")).when(by_mean, F.col("m")).otherwise(0.0)
    return marked.select(
        F.col("c.table_name").alias("table_name"), F.col("c.column_name").alias("column_name"),
        F.col("c.snapshotted_at").alias("detected_at"), drift_type.isNotNull().alias("drifted"),
        drift_type.alias("drift_type"), size.alias("magnitude"),
        text("p", "was").alias("previous_value"), text("c", "now").alias("current_value"))


def detect(snapshots: DataFrame, threshold: float = DRIFT_THRESHOLD,
           null_threshold: float = NULL_THRESHOLD) -> DataFrame:
    """One row per snapshot that has a predecessor of the same table and column."""
    row = F.struct(*SNAPSHOT)
    order = Window.partitionBy("table_name", "column_name").orderBy("snapshotted_at")
    pairs = snapshots.select("table_name", "column_name", row.alias("c"), F.lag(row).over(order).alias("p"))
    return _judge(pairs.filter(F.col("p").isNotNull()).select("c", "p"), threshold, null_threshold)


def drifts(detected: DataFrame, table: str, as_of: datetime | str, days: int = 7) -> DataFrame:
    """Drifts of a table in the last days, newest first."""
    return (since(detected, "detected_at", before(as_of, days * 86_400)).filter(F.col("drifted") & (F.col("table_name") == table))
            .select("table_name", "column_name", "drift_type", "previous_value", "current_value",
                    F.round(F.col("magnitude") * 100, 2).alias("change_magnitude_pct"), "detected_at")
            .orderBy(F.desc("detected_at"), "column_name"))


def history(snapshots: DataFrame, table: str, column: str, limit: int = 10) -> DataFrame:
    """The newest snapshots of one column."""
    return newest(snapshots, "snapshotted_at", limit,
                  (F.col("table_name") == table) & (F.col("column_name") == column), "column_name")
