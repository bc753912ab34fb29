"""Exact largest inner products: vectors in order of length, rotated partial sums, Cauchy-Schwarz bounds.

Rows are written in order of falling norm, a range of norms a file. Queries come in blocks of bounded size; each block
is broadcast and meets the rows where they lie. A first pass over a hash sample gives every query a score that its k-th
best reaches at least. In the second pass a task goes through its rows in order of length and stops asking a query whose
norm times the next row's norm is below what the query has. Of the others it adds up products of rotated coordinates, a
quarter at a time: the sum so far plus the product of the residual norms bounds the score, and only pairs whose bound
holds to the end are multiplied out, in 64-bit integers. The rotation is that of a bounded sample's singular vectors, so
most of a score is in its first coordinates; it changes the work, never the result.

Defined results. Rows with a null id, a null vector or a null or non-finite component take no part; without queries or
rows the result is empty. Shorter vectors count as ended by zeros. A row is not its own candidate, others of its id are;
queries that repeat an id are ranked apart. Ties go to the smaller id, then to equal ids in any order. Other columns are
not read, whatever they are called. Scores whose bound reaches 2**56 raise a ValueError.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewarden.llm.hard_negatives import LARGEST, Best, matrix
from tablewarden.session import cut_lineage, fresh_path, small_frame

STAGES = (0.25, 0.5, 0.75, 1.0)
CELLS = 1 << 20


def sift(queries: np.ndarray, rotated: np.ndarray, q_row: np.ndarray, best: Best, x: np.ndarray, row: np.ndarray, ident: np.ndarray, basis: np.ndarray) -> None:
    """Add to ``best`` what rows in order of falling norm have for the queries."""
    ends = [max(1, round(s * x.shape[1])) for s in STAGES]
    xr = x.astype(float) @ basis
    norm, q_norm = np.sqrt((xr * xr).sum(1)), np.sqrt((rotated * rotated).sum(1))
    rest, q_rest = (np.sqrt(np.maximum(np.cumsum((v * v)[:, ::-1], 1)[:, ::-1], 0)) for v in (xr, rotated))
    step = max(1, CELLS // max(1, len(queries)))
    for a in range(0, len(x), step):
        floor = np.where(best.floor > -LARGEST, best.floor, -np.inf)
        slack = 1e-6 * (1 + q_norm * norm[a])
        q, r = np.flatnonzero(q_norm * norm[a] + slack >= floor), np.arange(a, min(a + step, len(x)))
        if not len(q):
            return
        total, begin = np.zeros((len(q), len(r))), 0
        for end in ends:
            total += rotated[q, begin:end] @ xr[r, begin:end].T
            left = np.outer(q_rest[q, end], rest[r, end]) if end < x.shape[1] else 0.0
            fits = total + left + slack[q, None] >= floor[q, None]
            q_in, r_in = fits.any(1), fits.any(0)
            q, r, total, fits, begin = q[q_in], r[r_in], total[q_in][:, r_in], fits[q_in][:, r_in], end
            if not len(q):
                break
        else:
            at, col = np.nonzero(fits)
            at, col = q[at], r[col]
            for b in range(0, len(at), CELLS // 16):
                i, j = at[b:b + CELLS // 16], col[b:b + CELLS // 16]
                score = np.einsum("ij,ij->i", queries[i], x[j])
                ok = (q_row[i] != row[j]) & (score >= best.floor[i])
                best.add(i[ok], score[ok], ident[j[ok]])


def top_products(vectors: DataFrame, is_query: Column, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding",
                 scale: float = 256.0, file_rows: int = 1 << 16, block_cells: int = 1 << 20, sample_rows: int = 5000, sample_one_of: int = 16) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: integer products of floor(scale * component)."""
    spark = vectors.sparkSession
    raw = vectors.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{vector_column}`").alias("e"), F.coalesce(is_query, F.lit(False)).alias("q"))
    fine = raw.where("id is not null and e is not null").where(~F.exists("e", lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf"))))
    ints = fine.select("id", "q", F.transform("e", lambda v: F.floor(v.cast("double") * scale)).alias("x"), F.monotonically_increasing_id().alias("row"))
    ints = cut_lineage(ints.withColumn("square", F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))))
    count, dim, most = ints.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0)), F.coalesce(F.max("square"), F.lit(0.0))).first()
    if most * (1 + 1e-6) + 1 >= LARGEST:
        raise ValueError(f"scores of up to {most:.3g} are too large; lower the scale")
    dim = max(1, dim)
    # the row number parts rows of equal norm
    rows = ints.repartitionByRange(1 + count // file_rows, F.desc("square"), "row").sortWithinPartitions(F.desc("square"), "row")
    rows = cut_lineage(rows.select("id", "row", "x", "q"))
    few = rows.orderBy(F.xxhash64("row")).limit(sample_rows).select("x").collect()
    sample = np.array([list(r["x"]) + [0] * (dim - len(r["x"])) for r in few], float).reshape(-1, dim)
    basis = np.linalg.svd(sample.T @ sample)[0] if len(sample) else np.eye(dim)
    schema = "query long, query_id long, vec_id long, score long"
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    path = fresh_path(spark, "products")

    def meet(source: DataFrame, block: list, floor: dict[int, int], use: Callable[[DataFrame], object]) -> object:
        asked = np.array([list(r["x"]) + [0] * (dim - len(r["x"])) for r in block], np.int64)
        least = np.array([floor.get(r["row"], -LARGEST) for r in block], np.int64)
        sent = spark.sparkContext.broadcast((asked, np.array([r["row"] for r in block]), np.array([r["id"] for r in block]), least, basis))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, q_row, q_id, least, basis = sent.value
            best, rotated = Best(len(asked), k, least), asked.astype(float) @ basis
            for batch in batches:
                c = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
                sift(asked, rotated, q_row, best, matrix(c["x"], dim), c["row"].to_numpy(), c["id"].to_numpy(), basis)
            got = (q_row[best.slot], q_id[best.slot], best.ident, best.score)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in got], names=["query", "query_id", "vec_id", "score"])

        found = source.mapInArrow(run, schema).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        out = use(found)
        sent.destroy()
        return out

    def lowest(found: DataFrame) -> dict[int, int]:
        low = found.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("low")).where(F.col("n") == k)
        return {r["query"]: r["low"] for r in low.collect()}

    def keep(found: DataFrame) -> None:
        found.select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)

    keep(small_frame(spark, [], f"{schema}, rank int"))
    some = rows.where(F.pmod(F.xxhash64("row"), F.lit(sample_one_of)) == 0).drop("q")
    size, block = max(1, block_cells // dim), []
    for r in rows.where("q").select("row", "id", "x").toLocalIterator():
        block.append(r)
        if len(block) == size:
            meet(rows.drop("q"), block, meet(some, block, {}, lowest), keep)
            block = []
    if block:
        meet(rows.drop("q"), block, meet(some, block, {}, lowest), keep)
    return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(path)
