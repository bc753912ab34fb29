"""Toxicity by a factorization machine over hashed terms.

Terms are a text's distinct lower-case words and their first 4, 5 and 6 bytes, hashed. The model adds to
each term's own weight a product of factor vectors for every pair of terms, so that an insult beside a
group's name counts more than both alone. It is fitted on a bounded sample of labelled rows.

Null and empty texts score what the bias says. Labels: rows with a null id or label are left out; of
several labels of an id the highest counts. Without labels of both kinds the score is the share of label 1
(0 without any). Other columns are not read; repeated rows get the same score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewarden.llm.words import Texts, chunks, mix

SPACE_BITS = 18
PREFIXES = (4, 5, 6)
# ASCII bytes other than letters and digits part words; bytes of other scripts do not.
BREAKS = np.zeros(256, bool)
BREAKS[:128] = [not chr(b).isalnum() for b in range(128)]


def terms(texts: Texts, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, bucket) pairs; only buckets marked in ``wanted`` if given."""
    pairs = []
    size = texts.ends - texts.starts
    for n in (0, *PREFIXES):
        long = np.flatnonzero(size > n)
        ends = texts.ends[long] if n == 0 else texts.starts[long] + n
        bucket = (mix(texts.hashes(texts.starts[long], ends) + np.uint64(n)) >> np.uint64(64 - SPACE_BITS)).astype(np.int64)
        doc = texts.doc[long]
        if wanted is not None:
            hit = wanted[bucket]
            bucket, doc = bucket[hit], doc[hit]
        pairs.append((doc << SPACE_BITS) + bucket)
    both = np.unique(np.concatenate(pairs))
    return both >> SPACE_BITS, both & ((1 << SPACE_BITS) - 1)


def fit(rows: list[np.ndarray], labels: np.ndarray, factors: int = 8, most_features: int = 2048, rounds: int = 60,
        decay: float = 1e-4, seed: int = 3) -> dict:
    """Weights by bucket. Buckets in four rows or more whose label rate stands out are kept."""
    n, positive = len(labels), int(labels.sum())
    model = {"buckets": np.empty(0, np.int64), "w": np.empty(0, np.float32), "v": np.empty((0, factors), np.float32), "bias": 0.0, "prior": positive / n if n else 0.0}
    if not 0 < positive < n:
        return model
    size = 1 << SPACE_BITS
    flat, doc = np.concatenate(rows), np.repeat(np.arange(n), [len(r) for r in rows])
    seen = np.bincount(flat, minlength=size)
    hits = np.bincount(flat, labels[doc], size)
    rate = seen / n
    with np.errstate(divide="ignore", invalid="ignore"):
        z = (hits / positive - (seen - hits) / (n - positive)) / np.sqrt(rate * (1 - rate) * (1 / positive + 1 / (n - positive)))
    z = np.where(seen >= 4, np.abs(np.nan_to_num(z)), 0)
    buckets = np.sort(np.argsort(-z, kind="stable")[:most_features])
    buckets = buckets[z[buckets] >= 4]
    place = np.full(size, -1)
    place[buckets] = np.arange(len(buckets))
    x = np.zeros((n, len(buckets)), np.float32)
    held = place[flat] >= 0
    x[doc[held], place[flat[held]]] = 1
    rng = np.random.default_rng(seed)
    p = [np.full(1, np.log(positive / (n - positive)), np.float32), np.zeros(len(buckets), np.float32),
         rng.normal(0, 0.01, (len(buckets), factors)).astype(np.float32)]
    m, s, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(rounds):
        order = rng.permutation(n)
        for at in range(0, n, 512):
            b = order[at:at + 512]
            xb, yb = x[b], labels[b]
            q = xb @ p[2]
            score = p[0] + xb @ p[1] + 0.5 * ((q * q).sum(1) - (xb @ (p[2] * p[2])).sum(1))
            g = ((1 / (1 + np.exp(-np.clip(score, -30, 30)))) - yb).astype(np.float32) / len(b)
            grads = [g.sum(keepdims=True), xb.T @ g + decay * p[1], xb.T @ (g[:, None] * q) - p[2] * (xb.T @ g)[:, None] + decay * p[2]]
            step += 1
            for k in range(3):
                m[k] = 0.9 * m[k] + 0.1 * grads[k]
                s[k] = 0.999 * s[k] + 0.001 * grads[k] ** 2
                p[k] = p[k] - np.float32(0.02) * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(s[k] / (1 - 0.999 ** step)) + 1e-8)
    return model | {"buckets": buckets, "w": p[1], "v": p[2], "bias": float(p[0][0]), "prior": None}


def predict(model: dict, doc: np.ndarray, bucket: np.ndarray, docs: int) -> np.ndarray:
    if model["prior"] is not None:
        return np.full(docs, model["prior"])
    at = np.searchsorted(model["buckets"], bucket)
    score = model["bias"] + np.bincount(doc, model["w"][at], docs)
    for k in range(model["v"].shape[1]):
        v = model["v"][at, k]
        score += 0.5 * (np.bincount(doc, v, docs) ** 2 - np.bincount(doc, v * v, docs))
    return 1 / (1 + np.exp(-np.clip(score, -500, 500)))


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic",
          most_rows: int = 8000) -> dict:
    """Fit on up to ``most_rows`` labelled ids, those of the smallest hash. The bound is the driver's memory."""
    chosen = labels.select(F.col(f"`{id_column}`").alias("k"), F.col(f"`{label_column}`").alias("y")).dropna().groupBy("k").agg(F.max("y").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("k"), "k").limit(most_rows)
    rows = docs.select(F.col(f"`{id_column}`").alias("k"), F.col(f"`{text_column}`").alias("t")).join(F.broadcast(chosen), "k")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "t"):
            doc, bucket = terms(Texts(batch.column("t"), True, BREAKS))
            cut = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("y"), pa.array([bucket[a:b].astype("<i4").tobytes() for a, b in zip(cut, cut[1:])], pa.binary())], names=["k", "y", "b"])

    kinds = {f.name: f.dataType for f in rows.schema.fields}
    found = rows.mapInArrow(features, T.StructType([T.StructField("k", kinds["k"]), T.StructField("y", kinds["y"]), T.StructField("b", T.BinaryType())]))
    # ids may repeat: the bound holds for rows too
    got = sorted(found.limit(2 * most_rows).collect(), key=lambda r: (r["k"], r["b"]))
    return fit([np.frombuffer(r["b"], "<i4").astype(np.int64) for r in got], np.array([float(r["y"] > 0) for r in got]))


def score(docs: DataFrame, model: dict, text_column: str = "text") -> DataFrame:
    """``docs`` with columns ``score`` and ``predicted`` added (columns of these names are replaced)."""
    docs = docs.drop("score", "predicted")
    held = docs.sparkSession.sparkContext.broadcast(model)  # at most 2048 buckets
    inner = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    text = f"c{docs.columns.index(text_column)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(1 << SPACE_BITS, bool)
        wanted[held.value["buckets"]] = True
        for batch in chunks(batches, text):
            s = predict(held.value, *terms(Texts(batch.column(text), True, BREAKS), wanted), batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], names=[*batch.schema.names, "score"])

    out = inner.mapInArrow(run, T.StructType([*inner.schema.fields, T.StructField("score", T.DoubleType())]))
    return out.toDF(*docs.columns, "score").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
