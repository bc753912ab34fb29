"""Language by multinomial naive Bayes over hashed character n-grams.

Runs of letters, lower-cased and set in spaces, give 1- to 3-grams of code points, hashed into buckets. The
counts by language and bucket are summed by Spark; the log-probability matrix is broadcast. Its size is
bounded: the buckets shrink as languages grow, languages times buckets stay within 2**20 cells.

Null texts and texts without a letter are ``und`` with score 0. Rows with a null language teach nothing;
with nothing learned, all rows are ``und``. Ties go to the first language in order. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.llm.words import C1, C2, chunks, mix

CELLS = 1 << 20
LETTERS: list[np.ndarray] = []


def grams(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document and bucket of each n-gram, and the letters of each document."""
    if not LETTERS:
        LETTERS.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    texts = [t.lower() for t in pc.fill_null(column, "").to_pylist()]
    # a space before and after each document keeps n-grams inside it
    code = np.frombuffer((" " + "  ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.cumsum([len(t) + 2 for t in texts])
    letter = LETTERS[0][code]
    doc = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    n_letters = np.bincount(doc[letter], minlength=len(texts))
    use = letter.copy()
    use[1:] |= letter[:-1]
    use[:-1] |= letter[1:]
    code, doc = np.where(letter, code, 32)[use].astype(np.uint64), doc[use]
    word = code != 32
    docs, found = [doc[word]], [code[word] * C1]
    for n in (2, 3):
        h = code[:len(code) - n + 1] * C1
        for k in range(1, n):
            h = (h ^ (h >> np.uint64(29))) * C2 + code[k:len(code) - n + 1 + k]
        # n-grams with a letter, and no space inside
        inner = word[1:1 + len(h)] if n == 3 else (word[:len(h)] | word[1:1 + len(h)])
        ok = inner & (doc[:len(h)] == doc[n - 1:])
        docs.append(doc[:len(h)][ok])
        found.append(h[ok] + np.uint64(n))
    bucket = (mix(np.concatenate(found)) % np.uint64(buckets)).astype(np.int64)
    return np.concatenate(docs), bucket, n_letters


def train(docs: DataFrame, text_column: str = "text", lang_column: str = "lang") -> dict:
    rows = docs.select(F.col(f"`{lang_column}`").alias("l"), F.col(f"`{text_column}`").alias("t")).where("l is not null")
    priors = rows.groupBy("l").count().orderBy("l").collect()
    langs = [r["l"] for r in priors]
    if not langs:
        return {"langs": [], "buckets": 1, "logp": None, "prior": None}
    buckets = 1 << int(np.log2(max(2, min(1 << 16, CELLS // len(langs)))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(langs) * buckets, np.int64)
        place = {lang: k for k, lang in enumerate(langs)}
        for batch in chunks(batches, "t"):
            own = np.array([place[x] for x in batch.column("l").to_pylist()])
            doc, bucket, _ = grams(batch.column("t"), buckets)
            total += np.bincount(own[doc] * buckets + bucket, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    cells = rows.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(len(langs) * buckets)
    table[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    table = table.reshape(len(langs), buckets) + 0.5
    seen = np.array([r["count"] for r in priors], float)
    return {"langs": langs, "buckets": buckets, "logp": np.log(table / table.sum(1, keepdims=True)), "prior": np.log(seen / seen.sum())}


def identify(docs: DataFrame, model: dict, keys: list[Column], names: list[str], text_column: str = "text") -> DataFrame:
    """``keys`` of each row, ``lang_pred`` and ``score``, the probability of that language given the text."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.select(*(k.alias(f"k{i}") for i, k in enumerate(keys)), F.col(f"`{text_column}`").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in chunks(batches, "t"):
            doc, bucket, letters = grams(batch.column("t"), m["buckets"])
            pred, score = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows)
            if m["langs"]:
                logs = np.stack([np.bincount(doc, row[bucket], batch.num_rows) for row in m["logp"]], 1) + m["prior"]
                best = logs.argmax(1)
                p = 1 / np.exp(logs - logs.max(1, keepdims=True)).sum(1)
                pred = np.where(letters > 0, np.array(m["langs"], object)[best], "und")
                score = np.where(letters > 0, p, 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(pred, pa.string()), pa.array(score)], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    kinds = ", ".join(f"k{i} {base.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keys)))
    return base.mapInArrow(run, f"{kinds}, lang_pred string, score double").toDF(*names, "lang_pred", "score")
