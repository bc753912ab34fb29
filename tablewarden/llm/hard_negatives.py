"""Hard negatives by exact inner products in a residue number system.

Integer matrices are multiplied modulo several primes below 256 in float32: centred residues are at most 127, so a
sum of 1,024 products stays below 2**24 and is exact. The Chinese remainder theorem (Garner's mixed radix digits)
gives back the signed score; as many primes are taken as the largest possible score, bounded by the norms, needs.
A first pass finds each anchor's positives, a second one the best rows of other labels within a window below each
positive's score.

Anchors are a query set: they are taken in blocks of bounded size, each block is broadcast and meets all rows where
they lie, so rows are never shuffled. Tasks keep the best few of every anchor and send only those.

Defined results. Rows with a null id or label, a null vector or a null or non-finite component take no part; without
anchors or rows the result is empty. Vectors of different lengths count as ended by zeros. Every row is a row of its
own: of rows that repeat an anchor's id each is an anchor and may be the other's positive. Ties go to the smaller id,
then to equal ids in any order. Other columns are not read, whatever they are called. Scores whose bound reaches
2**56 raise a ValueError.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewarden.session import cut_lineage, fresh_path, small_frame

INNER = 1024
LARGEST = 1 << 56
CELLS = 1 << 20
NONE = np.iinfo(np.int64).min


def primes_for(bound: int) -> list[int]:
    """The largest primes below 256 whose product exceeds 2 * bound, two at least."""
    found, product, p = [], 1, 255
    while product <= 2 * bound + 1 or len(found) < 2:
        if all(p % q for q in range(3, 16, 2)):
            found.append(p)
            product *= p
        p -= 2
    return found


def residues(x: np.ndarray, p: int) -> np.ndarray:
    r = x % p
    return (r - p * (r > p // 2)).astype(np.float32)


def product_mod(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """a @ b.T modulo p, from centred residues in float32."""
    total = np.zeros((len(a), len(b)), np.int64)
    for k in range(0, a.shape[1], INNER):
        total += (a[:, k:k + INNER] @ b[:, k:k + INNER].T).astype(np.int64)
    return total % p


def combined(parts: list[np.ndarray], primes: list[int], bound: int) -> np.ndarray:
    """Signed integers of absolute value up to ``bound`` from their residues."""
    rest = [(r + bound) % p for r, p in zip(parts, primes)]
    digits: list[np.ndarray] = []
    for i, p in enumerate(primes):
        v = rest[i]
        for j in range(i):
            v = (v - digits[j]) * pow(primes[j], -1, p) % p
        digits.append(v)
    x = digits[-1]
    for p, v in zip(primes[-2::-1], digits[-2::-1]):
        x = x * p + v
    return x - bound


def scores(a: list[np.ndarray], x: np.ndarray, primes: list[int], bound: int) -> np.ndarray:
    """Exact inner products of rows given as residues with integer rows."""
    return combined([product_mod(r, residues(x, p), p) for r, p in zip(a, primes)], primes, bound)


def first_of(group: np.ndarray, score: np.ndarray, ident: np.ndarray, k: int) -> np.ndarray:
    """Positions of each group's k first rows, by score downwards, then id."""
    order = np.lexsort((ident, -score, group))
    g = group[order]
    begin = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.empty(0, np.int64)
    place = np.arange(len(g)) - np.repeat(begin, np.diff(np.r_[begin, len(g)]))
    return order[place < k]


class Best:
    """The k best (score, id) found so far for each slot, and the score that a further one must reach."""

    def __init__(self, slots: int, k: int, least: np.ndarray | None = None):
        self.k, self.least = k, np.full(slots, NONE) if least is None else least
        self.floor, self.count = self.least, np.zeros(slots, np.int64)
        self.slot = self.score = self.ident = np.empty(0, np.int64)

    def add(self, slot: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score, ident = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.ident, ident)))
        kept = first_of(slot, score, ident, self.k)
        self.slot, self.score, self.ident = slot[kept], score[kept], ident[kept]
        self.count = np.bincount(self.slot, minlength=len(self.floor))
        low = np.full(len(self.floor), np.iinfo(np.int64).max)
        np.minimum.at(low, self.slot, self.score)
        self.floor = np.where(self.count >= self.k, np.maximum(low, self.least), self.least)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column, ended by zeros up to ``dim``."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(flat) == n * dim:
        return flat.reshape(n, dim)
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((n, dim), np.int64)
    row = np.repeat(np.arange(n), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def integer_vectors(vectors: DataFrame, id_column: str, vector_column: str, label: Column, scale: float) -> DataFrame:
    """``id``, ``label``, ``x`` (array of long) of the rows that take part."""
    raw = vectors.select(F.col(f"`{id_column}`").cast("long").alias("id"), label.cast("long").alias("label"), F.col(f"`{vector_column}`").alias("e"))
    fine = raw.where("id is not null and label is not null and e is not null")
    fine = fine.where(~F.exists("e", lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf"))))
    return fine.select("id", "label", F.transform("e", lambda v: F.floor(v.cast("double") * scale)).alias("x"))


def mine(vectors: DataFrame, is_anchor: Column, label: Column, id_column: str = "vec_id", vector_column: str = "embedding",
         positives: int = 5, negatives: int = 5, low_percent: int = 80, high_percent: int = 100, scale: float = 256.0,
         block_cells: int = 1 << 20) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    ``is_anchor`` may refer to ``id``. A negative's score lies between ``low_percent`` and ``high_percent`` of the
    positive's. Blocks of anchors hold up to ``block_cells`` components (8 bytes each), one anchor at least.
    """
    spark = vectors.sparkSession
    rows = integer_vectors(vectors, id_column, vector_column, label, scale)
    rows = cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()))
    square = F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    dim, most = rows.agg(F.coalesce(F.max(F.size("x")), F.lit(0)), F.coalesce(F.max(square), F.lit(0.0))).first()
    if most * (1 + 1e-6) + 1 >= LARGEST:
        raise ValueError(f"scores of up to {most:.3g} are too large; lower the scale")
    dim, bound = max(1, dim), int(most * (1 + 1e-6)) + 1
    primes = primes_for(bound)
    anchors = cut_lineage(rows.where(is_anchor))
    first_schema = "anchor long, anchor_id long, other_id long, score long"
    second_schema = "anchor long, anchor_id long, positive_id long, positive_score long, other_id long, score long, place long"

    def blocks(source: DataFrame, size: int) -> Iterator[list]:
        held = []
        for row in source.toLocalIterator():
            held.append(row)
            if len(held) == size:
                yield held
                held = []
        if held:
            yield held

    def positive_pass(block: list) -> tuple[DataFrame, Broadcast]:
        sent = spark.sparkContext.broadcast((np.array([r["row"] for r in block]), np.array([r["id"] for r in block]), np.array([r["label"] for r in block]),
                                             [residues(np.array([list(r["x"]) + [0] * (dim - len(r["x"])) for r in block], np.int64), p) for p in primes]))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a_row, a_id, a_label, a = sent.value
            best = Best(len(a_row), positives)
            for part, row, ident, lab, x in pieces(batches, dim, len(a_row)):
                s = scores(a, x, primes, bound)
                at, col = np.nonzero((a_label[:, None] == lab) & (a_row[:, None] != row) & (s >= best.floor[:, None]))
                best.add(at, s[at, col], ident[col])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (a_row[best.slot], a_id[best.slot], best.ident, best.score)],
                                             names=["anchor", "anchor_id", "other_id", "score"])

        return rows.mapInArrow(run, first_schema), sent

    def negative_pass(block: list) -> tuple[DataFrame, Broadcast]:
        """Here a row of the block is an anchor with its positives."""
        found = [(i, p) for i, r in enumerate(block) for p in r["found"]]
        sent = spark.sparkContext.broadcast((np.array([r["row"] for r in block]), np.array([r["id"] for r in block]), np.array([r["label"] for r in block]),
                                             [residues(np.array([list(r["x"]) + [0] * (dim - len(r["x"])) for r in block], np.int64), p) for p in primes],
                                             np.array([i for i, _ in found], np.int64), *(np.array([p[c] for _, p in found], np.int64) for c in ("other_id", "score", "place"))))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a_row, a_id, a_label, a, owner, p_id, p_score, p_place = sent.value
            best = Best(len(owner), negatives)
            least, top = np.full(len(a_row), np.iinfo(np.int64).max), np.full(len(a_row), NONE)
            np.minimum.at(least, owner, -(-low_percent * p_score // 100))
            np.maximum.at(top, owner, high_percent * p_score // 100)
            firsts = np.searchsorted(owner, np.arange(len(a_row) + 1))
            for part, row, ident, lab, x in pieces(batches, dim, len(a_row)):
                s = scores(a, x, primes, bound)
                at, col = np.nonzero((a_label[:, None] != lab) & (s >= least[:, None]) & (s <= top[:, None]))
                got = s[at, col]
                for place in range(int(np.diff(firsts).max(initial=0))):
                    slot = np.minimum(firsts[at] + place, max(0, len(owner) - 1))
                    ok = (firsts[at] + place < firsts[at + 1]) & (low_percent * p_score[slot] <= 100 * got) & (100 * got <= high_percent * p_score[slot]) & (got >= best.floor[slot])
                    best.add(slot[ok], got[ok], ident[col[ok]])
            slot = best.slot
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (a_row[owner[slot]], a_id[owner[slot]], p_id[slot], p_score[slot], best.ident, best.score, p_place[slot])],
                                             names=["anchor", "anchor_id", "positive_id", "positive_score", "other_id", "score", "place"])

        return rows.mapInArrow(run, second_schema), sent

    def first_rows(df: DataFrame, keys: list[str], k: int) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), "other_id")
        return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def keep(ranked: DataFrame) -> None:
        columns = ["anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")]
        ranked.select(columns).write.mode("append").parquet(path)

    path = fresh_path(spark, "negatives")
    keep(small_frame(spark, [], f"{second_schema}, rank int"))
    for block in blocks(anchors, max(1, block_cells // dim)):
        raw, sent = positive_pass(block)
        found = first_rows(raw, ["anchor"], positives)
        listed = found.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct(F.col("rank").cast("long").alias("place"), "other_id", "score"))).alias("found"))
        by_row = {r["anchor"]: r["found"] for r in listed.collect()}
        sent.destroy()
        with_found = [r.asDict() | {"found": by_row[r["row"]]} for r in block if r["row"] in by_row]
        if with_found:
            raw, sent = negative_pass(with_found)
            keep(first_rows(raw, ["anchor", "place"], negatives))
            sent.destroy()
    return spark.read.schema("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long").parquet(path)


def pieces(batches: Iterable[pa.RecordBatch], dim: int, anchors: int) -> Iterator[tuple]:
    """Slices of rows that make a bounded number of scores."""
    step = max(1, CELLS // max(anchors, dim))
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            part = batch.slice(start, step)
            row, ident, lab = (part.column(part.schema.get_field_index(c)).to_numpy() for c in ("row", "id", "label"))
            yield part, row, ident, lab, matrix(part.column(part.schema.get_field_index("x")), dim)
