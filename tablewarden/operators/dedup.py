"""Replay of the dedup rule over a history: an alert goes out only if the last one *sent* for its
pair is more than the window before it.

Each decision depends on the one before, yet a pair's history need not pass through one task. The
history is cut into time chunks. What a chunk does to the state is a step function: the time until
which alerts are blocked when entering it decides which alert is sent first, and that decides the
last one sent. The functions of all chunks are computed in parallel, strung together per pair, and
then every chunk is replayed in parallel from its known entry state. Only entries within one
window of the chunk start can occur, and neighbouring ones mostly lead to the same end, so a
function is a few steps however many alerts the chunk holds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.times import micros
from tablewarden.operators.noise import MIN_WINDOW, PAIR

# A chunk spans at most this many windows, fewer where alerts are dense.
CHUNK_WINDOWS = 32
CHUNK_ROWS = 1_000_000
NEVER = np.iinfo(np.int64).min
STEP = "table_name string, alert_type string, chunk bigint, until bigint, last bigint"
ENTRY = "table_name string, alert_type string, chunk bigint, blocked bigint"
SENT = "table_name string, alert_type string, at bigint, id bigint"


def next_allowed(at: np.ndarray, window: int) -> np.ndarray:
    """Index of the first time more than ``window`` after each time; own index if there is none."""
    after = np.searchsorted(at, at + window, side="right")
    own = np.arange(len(at))
    return np.where(after < len(at), after, own)


def chunk_steps(at: np.ndarray, chunk_start: int, window: int) -> list[tuple[int, int]]:
    """(until, last): entering blocked up to a time before ``until`` ends with ``last`` sent."""
    end = next_allowed(at, window)
    while True:
        further = end[end]
        if np.array_equal(further, end):
            break
        end = further
    reachable = min(len(at), int(np.searchsorted(at, chunk_start + window, side="left")) + 1)
    last = at[end[:reachable]]
    closes = np.append(last[1:] != last[:-1], True)
    return list(zip(at[:reachable][closes].tolist(), last[closes].tolist()))


def sent_in_chunk(at: np.ndarray, blocked: int, window: int) -> list[int]:
    """Indexes sent when everything up to ``blocked`` is held back."""
    follow = next_allowed(at, window)
    i = int(np.searchsorted(at, blocked, side="right"))
    out = []
    while i < len(at):
        out.append(i)
        if follow[i] == i:
            break
        i = int(follow[i])
    return out


def still_needed(at: np.ndarray, blocked: int, window: int) -> np.ndarray:
    """Which of some sorted times may still be sent when more times, earlier or later, turn up.

    The k-th time sent lies in a range: not before ``blocked`` plus k - 1 windows, and not after the time that would be
    the k-th if nothing else turned up. Times outside all ranges can be forgotten without changing any decision.
    """
    keep = np.zeros(len(at), bool)
    low, i = blocked, int(np.searchsorted(at, blocked, side="right"))
    while i < len(at):
        keep[int(np.searchsorted(at, low, side="right")):i + 1] = True
        low = low + window if low > NEVER else NEVER
        i = int(np.searchsorted(at, at[i] + window, side="right"))
    keep[int(np.searchsorted(at, low, side="right")):] = True
    return keep


def fitting_windows(alerts: DataFrame, at: Column, window: int, chunk_rows: int) -> int:
    """Windows per chunk so that the densest stretch of any pair stays within ``chunk_rows``."""
    cells = alerts.groupBy(*PAIR, (at - F.pmod(at, F.lit(window))).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    densest = cells.agg(F.max("n")).first()[0] or 1
    return max(1, min(CHUNK_WINDOWS, chunk_rows // densest))


def replay(alerts: DataFrame, window_minutes: int = MIN_WINDOW, time_col: str = "sent_at",
           id_col: str = "id", chunk_windows: int | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Alerts that are sent: (table_name, alert_type, sent_at, id)."""
    window = window_minutes * 60_000_000
    at = micros(F.col(time_col))
    width = window * (chunk_windows or fitting_windows(alerts, at, window, chunk_rows))
    # Alerts of a pair at the same instant: the first can be sent, the others never are.
    moments = alerts.groupBy(*PAIR, at.alias("at")).agg(F.min(id_col).alias("id")).withColumn(
        "chunk", F.col("at") - F.pmod("at", F.lit(width)))

    def steps(pdf: pd.DataFrame) -> pd.DataFrame:
        table, kind, chunk = pdf["table_name"].iat[0], pdf["alert_type"].iat[0], int(pdf["chunk"].iat[0])
        found = chunk_steps(np.sort(pdf["at"].to_numpy()), chunk, window)
        return pd.DataFrame([(table, kind, chunk, u, e) for u, e in found],
                            columns=["table_name", "alert_type", "chunk", "until", "last"])

    def string_together(pdf: pd.DataFrame) -> pd.DataFrame:
        blocked, out = NEVER, []
        for chunk, part in pdf.sort_values(["chunk", "until"]).groupby("chunk", sort=True):
            out.append((pdf["table_name"].iat[0], pdf["alert_type"].iat[0], chunk, blocked))
            i = int(np.searchsorted(part["until"].to_numpy(), blocked, side="right"))
            if i < len(part):
                blocked = int(part["last"].iat[i]) + window
        return pd.DataFrame(out, columns=["table_name", "alert_type", "chunk", "blocked"])

    def decide(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = left.sort_values("at")
        keep = sent_in_chunk(rows["at"].to_numpy(), int(right["blocked"].iat[0]), window)
        return rows.iloc[keep][["table_name", "alert_type", "at", "id"]]

    keys = [*PAIR, "chunk"]
    entries = (moments.groupBy(*keys).applyInPandas(steps, STEP)
               .groupBy(*PAIR).applyInPandas(string_together, ENTRY))
    sent = moments.groupBy(*keys).cogroup(entries.groupBy(*keys)).applyInPandas(decide, SENT)
    return sent.select(*PAIR, F.timestamp_micros("at").cast("timestamp_ntz").alias(time_col), "id")
