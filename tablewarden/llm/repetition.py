"""Repetition inside a document, from its suffix array.

The words of a chunk of documents get one suffix array by prefix doubling, where words of different
documents never compare equal and only suffixes not yet told apart are sorted again. Longest common
prefixes of neighbours come from the ranks of the doubling rounds. Their intervals are the maximal
repeated word sequences; a document may have only so much of it inside such sequences, and none
longer than a limit.

Null and empty texts have no words: all counts 0. Repeated rows are judged one by one, each alone,
so ties and copies of whole documents do not matter. Columns other than id and text are not read; of
an empty table the result is empty. A document of any length is one array of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewarden.llm.words import SPACE, Texts, chunks, covered, mix

WINDOW = 8
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "n_repeats", "covered_words", "longest_repeat"]


def suffix_array(tokens: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array over all documents' tokens and the LCP with the suffix before, in tokens.

    No common prefix crosses documents. ``lcp[0]`` is 0.
    """
    n = len(tokens)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    last = np.append(np.flatnonzero(np.diff(doc)), n - 1)
    end = (last + 1)[np.searchsorted(last, np.arange(n))]
    _, inverse, counts = np.unique(mix(tokens ^ mix(doc.astype(np.uint64))), return_inverse=True, return_counts=True)
    firsts = np.cumsum(counts) - counts
    rank = firsts[inverse]
    active = np.flatnonzero(counts[inverse] > 1)
    levels = [rank]
    step = 1
    while len(active):
        follow = active + step
        second = np.where(follow < end[active], rank[np.minimum(follow, n - 1)] + 1, 0)
        key = rank[active] * (n + 1) + second
        order = np.argsort(key, kind="stable")
        key, active = key[order], active[order]
        old = rank[active]
        at = np.arange(len(key))
        new_old = np.append(True, old[1:] != old[:-1])
        new_key = np.append(True, key[1:] != key[:-1])
        start_old = np.maximum.accumulate(np.where(new_old, at, 0))
        start_key = np.maximum.accumulate(np.where(new_key, at, 0))
        rank = rank.copy()
        rank[active] = old + start_key - start_old
        levels.append(rank)
        alone = new_key & np.append(new_key[1:], True)
        active = active[~alone]
        step *= 2
    sa = np.empty(n, np.int64)
    sa[rank] = np.arange(n)
    lcp = np.zeros(n, np.int64)
    r = np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]]) + 1
    i, j = sa[r - 1].copy(), sa[r].copy()
    start = j.copy()
    for k in range(len(levels) - 1, -1, -1):
        level = np.append(levels[k], -1)
        same = np.flatnonzero((i < n) & (j < n) & (level[i] == level[j]))
        i[same] += 1 << k
        j[same] += 1 << k
    lcp[r] = j - start
    return sa, lcp


def maximal_repeats(sa: np.ndarray, lcp: np.ndarray, before: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(length, first, last row of the suffix array) of the LCP intervals of ``least`` tokens or more
    whose occurrences are not all preceded by one and the same token (``before``, by position)."""
    found = []
    rows = np.flatnonzero(lcp >= least)
    if not len(rows):
        return found
    breaks = np.flatnonzero(np.diff(rows) > 1)
    for a, b in zip(np.append(0, breaks + 1), np.append(breaks, len(rows) - 1)):
        left = int(rows[a]) - 1
        run, pre = lcp[left + 1:rows[b] + 1].tolist(), before[sa[left:rows[b] + 1]].tolist()
        # open intervals: length, first row, the one token before all occurrences or None
        stack: list[list] = []
        for k, depth in enumerate([*run, 0]):
            row, token = left + k, pre[k]
            first = row
            while stack and stack[-1][0] > depth:
                length, first, one = stack.pop()
                token = token if one == token else None
                if token is None:
                    found.append((length, first, row))
            if depth < least:
                break
            if stack and stack[-1][0] == depth:
                if stack[-1][2] != token:
                    stack[-1][2] = None
            else:
                stack.append([depth, first, token])
    return found


def measure(texts: Texts, min_repeat: int) -> dict[str, np.ndarray]:
    """The counts of ``MEASURES`` for each document of a chunk."""
    n = len(texts.starts)
    tokens = texts.hashes()
    sa, lcp = suffix_array(tokens, texts.doc)
    longest = np.zeros(n, np.int64)
    if n:
        longest[sa] = np.maximum(lcp, np.append(lcp[1:], 0))
    # a token before a document's first word is like no other
    before = np.append(np.uint64(0), tokens[:-1])
    firsts = texts.bounds[:-1][np.diff(texts.bounds) > 0]
    before[firsts] = np.arange(len(firsts), dtype=np.uint64)
    repeats = maximal_repeats(sa, lcp, before, min_repeat)
    owner = texts.doc[sa[[first for _, first, _ in repeats]]] if repeats else np.empty(0, np.int64)

    # The longest repeat that starts at a word lies inside the spans of a maximal repeat, and each
    # maximal repeat's spans are such starts: the union is the same.
    spans = np.flatnonzero(longest >= min_repeat)
    inside = covered(spans, longest[spans], n)
    windows = np.flatnonzero(longest >= WINDOW)
    in_windows = covered(windows, np.full(len(windows), WINDOW), n)

    body = texts.bytes
    points = np.flatnonzero(~SPACE[body] & ((body & 0xC0) != 0x80))
    symbols = np.flatnonzero(SYMBOLS[body])
    cuts = np.flatnonzero(body == 10)
    line_starts = np.unique(np.concatenate([texts.offsets[:-1], cuts + 1]))
    line_starts = line_starts[line_starts < len(body)]
    line_ends = np.append(line_starts[1:], len(body))
    line_ends = line_ends - (body[line_ends - 1] == 10) if len(body) else line_ends
    has_word = np.searchsorted(texts.starts, line_ends) > np.searchsorted(texts.starts, line_starts)
    line_starts, line_ends = line_starts[has_word], line_ends[has_word]
    line_doc = np.searchsorted(texts.offsets, line_starts, "right") - 1
    lines = mix(texts.hashes(line_starts, line_ends) ^ mix(line_doc.astype(np.uint64)))
    _, kept_line = np.unique(lines, return_index=True)
    distinct = np.bincount(line_doc[kept_line], minlength=texts.docs)

    top = np.zeros(texts.docs, np.int64)
    np.maximum.at(top, texts.doc, longest)
    return {
        "n_words": np.diff(texts.bounds).astype(np.int64),
        "word_chars": texts.per_doc(np.ones(len(points)), points),
        "n_symbols": texts.per_doc(np.ones(len(symbols)), symbols),
        "n_dup_lines": np.bincount(line_doc, minlength=texts.docs) - distinct,
        "n_repeat_words": texts.per_doc(in_windows),
        "n_repeats": np.bincount(owner, minlength=texts.docs),
        "covered_words": texts.per_doc(inside),
        "longest_repeat": top,
    }


def repetition(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_repeat: int = 5,
               max_covered: float = 0.30, max_longest: int = 100, keep: list[str] | None = None) -> DataFrame:
    """Counts and verdict per row: ``id_column``, the ``MEASURES``, ``covered_fraction``, ``base_failed``, ``kept``.

    ``kept`` is false if the base rules fail, if more than ``max_covered`` of the words lie in repeats of
    ``min_repeat`` words or more, or if a repeat has more than ``max_longest`` words. ``keep`` names further
    columns to carry along.
    """
    carried = [id_column, *(keep or [])]
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    inner = [f"c{k}" for k in range(len(carried))]
    schema = T.StructType([T.StructField(c, kinds[o]) for c, o in zip(inner, carried)]
                          + [T.StructField(m, T.LongType()) for m in MEASURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "t"):
            m = measure(Texts(batch.column("t")), min_repeat)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in inner), *(pa.array(m[k], pa.int64()) for k in MEASURES)],
                                             names=[*inner, *MEASURES])

    counted = docs.select(*(F.col(f"`{o}`").alias(c) for c, o in zip(inner, carried)), F.col(f"`{text_column}`").alias("t")).mapInArrow(run, schema)
    n = F.col("n_words")
    failed = (n < 20) | (F.lit(100) * F.col("n_repeat_words") > F.lit(30) * n)
    counted = counted.withColumn("covered_fraction", F.when(n > 0, F.col("covered_words") / n).otherwise(F.lit(0.0)))
    counted = counted.withColumn("base_failed", failed).withColumn(
        "kept", ~failed & (F.col("covered_fraction") <= max_covered) & (F.col("longest_repeat") <= max_longest))
    measured = [c for c in counted.columns if c not in inner]
    return counted.select(*(F.col(c).alias(o) for c, o in zip(inner, carried)), *measured)
