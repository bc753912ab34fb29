"""Exact ranked lexical search: sparse documents in ball trees, integer scores, best-first visits.

Terms are runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z lower-cased. A score is the
integer inner product of an item's weights and a document's saturated term counts (`saturation`, `term_weight`).

Each task cuts its documents into shards of bounded size and builds a ball tree over each: a node knows the centroid
and radius of its documents. For an item, q.centroid + |q| * radius, rounded upwards by more than the error of the
doubles, is no less than any score below the node. Nodes are visited best first until the bound of the best one left
is below the item's k-th score; documents in leaves are scored in 64-bit integers. A first pass over a hash sample of
the documents gives each item a score it will reach at least, so most shards are left at their upper nodes.

Items are a query set: they come in blocks of bounded size, each is broadcast and meets all documents where they lie.
Documents are read once for their terms; a bitmap of fixed size (1 MiB) keeps the terms that no item has out of what
is written. Corpus counts cover all documents.

Defined results. Null texts have no term, so they never score. A row is a document or an item of its own, also if its
id repeats; then ranks are given to each row. Equal scores go to the smaller id, null ids last, equal ids in any
order. Empty tables give an empty result. Other columns are not read, whatever they are called. Terms are compared by
64-bit hashes: two different ones are equal with a chance of 2**-57 a pair.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewarden.llm.words import Texts, chunks
from tablewarden.session import cut_lineage, fresh_path, small_frame

# ASCII bytes other than letters and digits part terms.
BREAKS = np.zeros(256, bool)
BREAKS[:128] = [not chr(b).isalnum() for b in range(128)]
MAP_BITS = 23
LEAF = 32
SHARD_ROWS, SHARD_ENTRIES = 8192, 1 << 20
BLOCK_CELLS, BLOCK_ITEMS = 1 << 22, 512


def term_weight(n_docs: Column, df: Column) -> Column:
    return F.floor(F.lit(1000.0) * F.ln((2 * n_docs + 2).cast("double") / (2 * df + 1).cast("double")))


def saturation(tf: np.ndarray, length: np.ndarray, n_docs: int, all_terms: int) -> np.ndarray:
    m = 25 + 75 * length * n_docs // max(1, all_terms)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def counted(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of the terms of a chunk of texts, by row and term."""
    term = texts.hashes().view(np.int64)
    order = np.lexsort((term, texts.doc))
    row, term = texts.doc[order], term[order]
    new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (term[1:] != term[:-1])]) if len(row) else np.empty(0, np.int64)
    return row[new], term[new], np.diff(np.r_[new, len(row)])


def term_rows(df: DataFrame, id_column: str, text_column: str, wanted: np.ndarray | None = None) -> DataFrame:
    """``id``, ``n`` (terms with repeats), ``terms``, ``counts``: distinct terms that the bitmap may hold."""
    sent = None if wanted is None else df.sparkSession.sparkContext.broadcast(wanted)
    source = df.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            texts = Texts(part.column(1), lower=True, separators=BREAKS)
            row, term, count = counted(texts)
            if sent is not None:
                at = term.view(np.uint64) >> np.uint64(64 - MAP_BITS)
                hit = (sent.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0
                row, term, count = row[hit], term[hit], count[hit]
            ends = np.searchsorted(row, np.arange(texts.docs + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v.astype(np.int64))) for v in (term, count)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(texts.bounds).astype(np.int64)), *lists], names=["id", "n", "terms", "counts"])

    return source.mapInArrow(run, "id long, n long, terms array<long>, counts array<long>")


def bitmap(items: DataFrame) -> np.ndarray:
    """One bit per value of the leading hash bits of any item's term: 2**MAP_BITS bits whatever the number of items."""
    at = items.select(F.explode("terms").alias("term")).select(F.shiftrightunsigned("term", 64 - MAP_BITS).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    out = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    for r in words.collect():
        out[r["word"]] = np.uint64(r["bits"] & 0xFFFFFFFFFFFFFFFF)
    return out


class Tree:
    """Ball tree over sparse rows in CSR form (``ends``, ``index``, ``value``); all rows have entries."""

    def __init__(self, ends: np.ndarray, index: np.ndarray, value: np.ndarray, width: int):
        self.ends, self.index, self.value, self.width = ends, index, value, width
        self.square = np.add.reduceat(value.astype(float) ** 2, ends[:-1]) if len(ends) > 1 else np.empty(0)
        self.children: list[tuple[int, int] | None] = []
        self.rows: list[np.ndarray] = []
        self.radius: list[float] = []
        self.centroids: list[tuple[np.ndarray, np.ndarray]] = []
        if len(ends) > 1:
            self._build(np.arange(len(ends) - 1))

    def entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the rows' entries, and where each row begins among them."""
        size = self.ends[rows + 1] - self.ends[rows]
        begin = np.cumsum(size) - size
        return np.arange(size.sum()) + np.repeat(self.ends[rows] - begin, size), begin

    def _build(self, all_rows: np.ndarray) -> None:
        # scratch is as long as the vocabulary and is cleared entry by entry
        scratch = np.zeros(self.width)
        waiting = [(all_rows, -1, 0)]
        while waiting:
            rows, parent, side = waiting.pop()
            node = len(self.children)
            if parent >= 0:
                self.children[parent] = (node, self.children[parent][1]) if side == 0 else (self.children[parent][0], node)
            at, begin = self.entries(rows)
            index, value = self.index[at], self.value[at].astype(float)
            np.add.at(scratch, index, value / len(rows))
            place = np.unique(index)
            centre = scratch[place]

            def distances(square: float) -> np.ndarray:
                return np.sqrt(np.maximum(self.square[rows] + square - 2 * np.add.reduceat(scratch[index] * value, begin), 0.0))

            d = distances(float(centre @ centre))
            scratch[index] = 0.0
            # the error of a squared distance is a small part of the squares it is made of
            far = float(np.sqrt((d.max() ** 2) + 1e-9 * (self.square[rows].max() + centre @ centre)))
            self.children.append(None)
            self.rows.append(rows)
            self.radius.append(far)
            self.centroids.append((place, centre))
            if len(rows) <= LEAF or far * far <= 1e-6 * self.square[rows].max():
                continue

            def from_row(r: int) -> np.ndarray:
                own = slice(self.ends[r], self.ends[r + 1])
                scratch[self.index[own]] = self.value[own]
                out = distances(float(self.square[r]))
                scratch[self.index[own]] = 0.0
                return out

            to_a = from_row(rows[int(d.argmax())])
            to_b = from_row(rows[int(to_a.argmax())])
            order = np.argsort(to_a ** 2 - to_b ** 2, kind="stable")
            half = len(rows) // 2
            self.children[node] = (-1, -1)
            waiting += [(rows[order[:half]], node, 0), (rows[order[half:]], node, 1)]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """(node, query) upper bounds of the scores below each node."""
        n, norm = len(self.children), np.sqrt((queries ** 2).sum(1))
        out = np.empty((n, len(queries)))
        step = max(1, (1 << 21) // self.width)
        for a in range(0, n, step):
            some = self.centroids[a:a + step]
            dense = np.zeros((len(some), self.width))
            for i, (place, centre) in enumerate(some):
                dense[i, place] = centre
            out[a:a + step] = dense @ queries.T
        # every rounding error here is far below a 1e-9th of |q| times the largest |d|
        return out + norm * (np.array(self.radius)[:, None] + 1e-9 * np.sqrt(self.square.max())) + 1.0

    def best(self, query: np.ndarray, bound: np.ndarray, ids: np.ndarray, found: list, floor: int, k: int) -> tuple[list, int]:
        """Merge the rows that may be among the k best into ``found``: [(-score, id), ...]."""
        heap = [(-bound[0], 0)]
        while heap:
            b, node = heapq.heappop(heap)
            if -b < floor:
                break
            if self.children[node] is not None:
                for child in self.children[node]:
                    heapq.heappush(heap, (max(b, -bound[child]), child))
                continue
            rows = self.rows[node]
            at, begin = self.entries(rows)
            score = np.add.reduceat(query[self.index[at]] * self.value[at], begin)
            hit = np.flatnonzero((score >= floor) & (score > 0))
            if len(hit) > k:
                hit = hit[np.lexsort((ids[rows[hit]], -score[hit]))[:k]]
            if len(hit):
                found = sorted([*found, *zip((-score[hit]).tolist(), ids[rows[hit]].tolist())])[:k]
                if len(found) == k:
                    floor = max(floor, -found[-1][0])
        return found, floor


def shards(batches: Iterable[pa.RecordBatch], vocabulary: np.ndarray, n_docs: int, all_terms: int) -> Iterator[tuple]:
    """(ids, null ids, tree) of a bounded number of documents with terms of the vocabulary each."""
    held: list[tuple] = []
    rows = entries = 0

    def made() -> tuple:
        ids, nulls, sizes, index, value = (np.concatenate(x) for x in zip(*held))
        return ids, nulls, Tree(np.r_[0, np.cumsum(sizes)], index, value, len(vocabulary))

    for batch in batches:
        c = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        nulls = c["id"].is_null().to_numpy(zero_copy_only=False)
        ids = c["id"].fill_null(0).to_numpy()
        sizes = np.diff(c["terms"].offsets.to_numpy())
        term, tf = c["terms"].flatten().to_numpy(), c["counts"].flatten().to_numpy()
        row = np.repeat(np.arange(len(ids)), sizes)
        at = np.minimum(np.searchsorted(vocabulary, term), len(vocabulary) - 1)
        hit = vocabulary[at] == term
        row, at, tf = row[hit], at[hit], tf[hit]
        d = saturation(tf, c["n"].to_numpy()[row], n_docs, all_terms)
        for start in range(0, len(ids), SHARD_ROWS // 4):
            a, b = np.searchsorted(row, [start, start + SHARD_ROWS // 4])
            if a == b:
                continue
            own, size = np.unique(row[a:b], return_counts=True)
            held.append((ids[own], nulls[own], size, at[a:b], d[a:b]))
            rows, entries = rows + len(own), entries + b - a
            if rows > SHARD_ROWS * 3 // 4 or entries > SHARD_ENTRIES:
                yield made()
                held, rows, entries = [], 0, 0
    if held:
        yield made()


def item_blocks(items: DataFrame) -> Iterator[list]:
    """Items one block at a time: items times distinct terms of a block stay bounded, a single item aside."""
    held, entries = [], 0
    for r in items.toLocalIterator():
        entries += len(r["terms"])
        if held and ((len(held) + 1) * entries > BLOCK_CELLS or len(held) == BLOCK_ITEMS):
            yield held
            held, entries = [], len(r["terms"])
        held.append(r)
    if held:
        yield held


def rank_documents(documents: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", doc_text: str = "text",
                   item_id: str = "item_id", item_text: str = "text", sample_one_of: int = 16) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: the k best documents of each item with a score above 0."""
    spark = documents.sparkSession
    asked = cut_lineage(term_rows(items, item_id, item_text).withColumn("item", F.monotonically_increasing_id()))
    docs = cut_lineage(term_rows(documents, doc_id, doc_text, bitmap(asked)))
    n_docs, all_terms = docs.agg(F.coalesce(F.count_if(F.col("n") > 0), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    docs = docs.where(F.size("terms") > 0)
    used = docs.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    entries = asked.select("item", F.col("id").alias("item_id"), F.explode(F.arrays_zip("terms", "counts")).alias("e")).select("item", "item_id", F.col("e.terms").alias("term"), F.col("e.counts").alias("count"))
    weighed = entries.join(used, "term").select("item", "item_id", "term", (term_weight(F.lit(n_docs), F.col("df")) * F.col("count")).alias("weight")).where("weight > 0")
    listed = weighed.groupBy("item", "item_id").agg(F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights"))
    listed = cut_lineage(listed)
    sample = docs.where(F.pmod(F.xxhash64("id", "n", "terms"), F.lit(sample_one_of)) == 0)
    schema = "item long, item_id long, doc_id long, score long"
    path = fresh_path(spark, "ranked")

    def best_in(source: DataFrame, block: list, floors: np.ndarray, use: Callable[[DataFrame], object]) -> object:
        vocabulary = np.unique(np.concatenate([np.array(r["terms"], np.int64) for r in block]))
        vectors = np.zeros((len(block), len(vocabulary)), np.int64)
        for i, r in enumerate(block):
            vectors[i, np.searchsorted(vocabulary, np.array(r["terms"], np.int64))] = r["weights"]
        sent = spark.sparkContext.broadcast((vocabulary, vectors, floors, [(r["item"], r["item_id"]) for r in block]))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocabulary, vectors, floors, names = sent.value
            dense, floor, found = vectors.astype(float), floors.tolist(), [[] for _ in names]
            for ids, nulls, tree in shards(batches, vocabulary, n_docs, all_terms):
                # ids as ranked: nulls after all others
                shown = np.array(list(zip(nulls.tolist(), ids.tolist())), dtype=[("null", bool), ("id", np.int64)])
                order = np.argsort(shown, order=("null", "id"))
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                bound = tree.bounds(dense)
                for q in range(len(names)):
                    if bound[0, q] < floor[q]:
                        continue
                    own, floor[q] = tree.best(vectors[q], bound[:, q], place, [], floor[q], k)
                    if own:
                        found[q] = sorted([*found[q], *((s, *shown[order[p]].tolist()) for s, p in own)])[:k]
                        if len(found[q]) == k:
                            floor[q] = max(floor[q], -found[q][-1][0])
            got = [(*names[q], None if null else ident, -s) for q, f in enumerate(found) for s, null, ident in f]
            yield pa.RecordBatch.from_arrays([pa.array([g[c] for g in got], pa.int64()) for c in range(4)], names=["item", "item_id", "doc_id", "score"])

        got = use(first_rows(source.mapInArrow(run, schema)))
        sent.destroy()
        return got

    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))

    def first_rows(df: DataFrame) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def lowest(ranked: DataFrame) -> dict:
        low = ranked.groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("low")).where(F.col("n") == k)
        return {r["item"]: r["low"] for r in low.collect()}

    def keep(ranked: DataFrame) -> None:
        ranked.select("item_id", "rank", "doc_id", "score").write.mode("append").parquet(path)

    keep(small_frame(spark, [], f"{schema}, rank int"))
    for block in item_blocks(listed):
        low = best_in(sample, block, np.zeros(len(block), np.int64), lowest)
        best_in(docs, block, np.array([low.get(r["item"], 0) for r in block], np.int64), keep)
    return spark.read.schema("item_id long, rank int, doc_id long, score long").parquet(path)
