"""Bigram language model as a weighted backoff automaton, trained and applied without a copy of it anywhere.

States are the root and one state per word (and the text's start). A state has an arc for each word seen after
it and a failure arc to the root. The seen arcs weigh (c(v,w) + mu * p(w)) / (c(v) + mu), the failure arc
mu / (c(v) + mu), the root's arcs (c(w) - d) / N for known and d * V / N for the one unknown word.

Documents are dealt into blocks. A block sends its distinct words and pairs once, to the bucket of their
hash; the bucket adds up the counts of the training documents and answers each block with the totals it
asked for. The block then has the part of the automaton that its texts can reach, and walks all its texts
from left to right at once, each carrying its state. All counts cover the whole corpus.

Null and empty texts are one end token. A null id is not in training. Repeated rows count once each. Other
columns are not read. Without training documents every token has probability 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.llm.words import Texts, chunks, mix
from tablewarden.session import cut_lineage

END, START = np.uint64(1), np.uint64(2)
BLOCK_CHARS, BUCKET_CHARS = 6_000_000, 4_000_000


def tokens(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token and pair hash at each position, and the first position of each text (and the end of all)."""
    words, counts = [], []
    batches = table.to_batches() if isinstance(table, pa.Table) else [table]
    for chunk in chunks(batches, "t"):
        t = Texts(chunk.column("t"), lower=True)
        words.append(np.insert(t.hashes(), t.bounds[1:], END))
        counts.append(np.diff(t.bounds) + 1)
    word = np.concatenate(words) if words else np.empty(0, np.uint64)
    first = np.append(0, np.cumsum(np.concatenate(counts))) if counts else np.zeros(1, np.int64)
    before = np.append(START, word[:-1])[:len(word)]
    before[first[:-1]] = START
    return word, mix(mix(before) + word), first


def score(docs: DataFrame, held_out: Column, id_column: str = "doc_id", text_column: str = "text", mu: float = 50.0,
          discount: float = 0.5) -> DataFrame:
    """Per row: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` (log10)."""
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    base = docs.select(F.col(f"`{id_column}`").alias("id"), F.coalesce(held_out, F.lit(True)).alias("held"), text.alias("t"))
    chars = base.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    blocks, buckets = 1 + chars // BLOCK_CHARS, 1 + chars // BUCKET_CHARS
    base = base.withColumn("block", F.pmod(F.xxhash64("id", "t"), F.lit(blocks)))
    kind = base.schema["id"].dataType.simpleString()

    def ask(table: pa.Table) -> Iterator[pa.RecordBatch]:
        word, pair, first = tokens(table)
        learn = np.repeat(~np.concatenate([c.to_numpy(zero_copy_only=False) for c in table["held"].chunks]).astype(bool), np.diff(first))
        out = []
        for order, key in ((1, word), (2, pair)):
            keys, inverse = np.unique(key, return_inverse=True)
            counts = np.bincount(inverse, learn, len(keys)).astype(np.uint32)
            where = keys % np.uint64(buckets)
            for b in np.unique(where):
                own = where == b
                out.append((table["block"][0].as_py(), order, int(b), keys[own].tobytes(), counts[own].tobytes()))
        return pa.table([pa.array(c) for c in zip(*out)], names=["block", "n", "bucket", "keys", "counts"]).cast(asked)

    asked = pa.schema([("block", pa.int64()), ("n", pa.int32()), ("bucket", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
    questions = base.groupBy("block").applyInArrow(ask, "block long, n int, bucket long, keys binary, counts binary")

    def answer(group: pa.Table) -> pa.Table:
        keys = [np.frombuffer(k, np.uint64) for k in group["keys"].to_pylist()]
        counts = np.concatenate([np.frombuffer(c, np.uint32) for c in group["counts"].to_pylist()])
        distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(inverse, counts, len(distinct)).astype(np.int64)
        parts = np.split(total[inverse], np.cumsum([len(k) for k in keys])[:-1])
        one = group["n"][0].as_py() == 1
        v = [int((total > 0).sum()) if one else 0] + [0] * (len(parts) - 1)
        n = [int(total.sum()) if one else 0] + [0] * (len(parts) - 1)
        return group.drop_columns(["keys", "counts"]).append_column("totals", pa.array([p.tobytes() for p in parts], pa.binary())).append_column(
            "v", pa.array(v, pa.int64())).append_column("tokens", pa.array(n, pa.int64()))

    answers = cut_lineage(questions.groupBy("n", "bucket").applyInArrow(answer, "block long, n int, bucket long, totals binary, v long, tokens long"))
    stats = answers.agg(F.coalesce(F.sum("v"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    vocabulary, total = int(stats[0]), int(stats[1])

    def walk(texts: pa.Table, got: pa.Table) -> pa.Table:
        word, pair, first = tokens(texts)
        counts = {}
        for order, key in ((1, word), (2, pair)):
            keys, inverse = np.unique(key, return_inverse=True)
            where, known = keys % np.uint64(buckets), np.zeros(len(keys), np.int64)
            for n, b, packed in zip(got["n"].to_pylist(), got["bucket"].to_pylist(), got["totals"]):
                if n == order:
                    known[where == np.uint64(b)] = np.frombuffer(packed.as_py(), np.int64)
            counts[order] = known[inverse]
        c1, c2 = counts[1].astype(float), counts[2].astype(float)
        size = np.diff(first)
        simple = np.log10((c1 + 0.1) / (total + 0.1 * (vocabulary + 1)))
        root = np.where(c1 > 0, c1 - discount, discount * vocabulary) / total if total else np.ones(len(word))
        # the texts that still run come first
        order = np.argsort(-size, kind="stable")
        start, left = first[:-1][order], size[order]
        sums, state = np.zeros(len(order)), np.full(len(order), float(c1[first[1:] - 1].max(initial=0)))
        running = len(order)
        for t in range(int(left.max(initial=0))):
            while left[running - 1] <= t:
                running -= 1
            at = start[:running] + t
            s, arc = state[:running], c2[at]
            failure = mu / (s + mu)
            sums[:running] += np.log10(np.where(arc > 0, arc / (s + mu) + failure * root[at], failure * root[at]))
            state[:running] = c1[at]
        out = np.zeros(len(order))
        out[order] = sums
        n = len(order)
        return pa.table([texts["id"], texts["held"], pa.array(size), pa.array(np.add.reduceat(c1 > 0, first[:-1], dtype=np.int64)),
                         pa.array(np.full(n, total)), pa.array(np.add.reduceat(simple, first[:-1])), pa.array(out)],
                        names=["id", "held", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    scored = base.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        walk, f"id {kind}, held boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.withColumnRenamed("id", id_column).withColumnRenamed("held", "held_out")
