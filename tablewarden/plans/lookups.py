"""Joining a large table with a smaller keyed one without trusting guesses about size or skew."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.session import cut_lineage

BROADCAST_ROW_LIMIT = 100_000
SALT = "__salt"


def salted_join(facts: DataFrame, dim: DataFrame, on: Sequence[str], how: str = "left",
                salts: int = 32) -> DataFrame:
    """Equi-join where one key may hold a large share of ``facts``.

    ``dim`` has at most one row per key. The salt comes from the row's own content, so a
    recomputed task assigns the same rows to the same salt.
    """
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in facts.columns]), F.lit(salts)).cast("int")
    left = facts.withColumn(SALT, spread)
    right = dim.withColumn(SALT, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, SALT], how).drop(SALT)


def measured_join(facts: DataFrame, dim: DataFrame, on: Sequence[str], how: str = "left",
                  row_limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Broadcast ``dim`` if its counted size is below the limit, else fall back to a salted join.

    ``dim`` is written to the shared folder once; counting it and joining it do not repeat the
    aggregation that made it.
    """
    dim = cut_lineage(dim)
    if dim.limit(row_limit + 1).count() <= row_limit:
        return facts.join(F.broadcast(dim), list(on), how)
    return salted_join(facts, dim, on, how)
