"""First-fit decreasing packing of documents into token sequences.

Documents are cut at the capacity; the pieces are dealt at random into groups of bounded size, and
each group is packed alone: longest piece first, into the leftmost bin with room, found by descending
a tournament tree over the bins' free space.

Null and empty texts are one piece of the closing id. Repeated rows are packed once each. Other
columns are not read; of an empty table the result is empty.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewarden.llm.words import chunks
from tablewarden.session import cut_lineage

CACHED_WORDS = 500_000
RUN = re.compile(r"[^\t-\r ]+")
# Fixed value: the pattern by which the tokenizer file parts words.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# The same on printable ASCII and accented Latin letters in lower case, whose lower and composed forms are certain.
PLAIN_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^\t-\r a-z0-9ß-öø-ſ]+")
NOT_PLAIN = re.compile(r"[^\t-\r -~À-ÖØ-öø-įı-ſ]")
# How byte-level vocabularies write bytes: printable ones as themselves, the others from code point 256 on.
BYTE_CHARS = [chr(b) if 33 <= b < 127 or 161 <= b < 173 or b > 173 else "" for b in range(256)]
BYTE_CHARS = [c or chr(256 + BYTE_CHARS[:b].count("")) for b, c in enumerate(BYTE_CHARS)]
_STATE: dict = {}


def _load(path: str) -> None:
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = False
    said = json.loads(tokenizer.to_str())
    steps = (said["pre_tokenizer"] or {}).get("pretokenizers", [])
    plain = ([n["type"] for n in (said["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
             and [n["type"] for n in steps] == ["Split", "ByteLevel"] and steps[0]["pattern"] == {"Regex": SPLIT}
             and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"])
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    _STATE.update(path=path, tokenizer=tokenizer, model=tokenizer.model, plain=plain, cache={}, special=special)


def _parts(text: str, plain: bool) -> list[str]:
    """Parts of a text that are encoded each alone: words as the tokenizer parts them, in plain text; else
    runs without white space, which the tokenizer drops."""
    if not plain:
        return RUN.findall(text)
    if not NOT_PLAIN.search(text):
        return PLAIN_SPLIT.findall(text.lower())
    parts = []
    for run in RUN.findall(text):
        if NOT_PLAIN.search(run):
            parts.append(run)
        else:
            parts.extend(PLAIN_SPLIT.findall(run.lower()))
    return parts


def encode(texts: list[str], path: str, end_id: int) -> list[bytes]:
    """Little-endian 32-bit ids and the closing id. Each distinct part of the texts is encoded once."""
    if _STATE.get("path") != path:
        _load(path)
    cache, tokenizer, model, plain = (_STATE[k] for k in ("cache", "tokenizer", "model", "plain"))
    if len(cache) > CACHED_WORDS:
        cache.clear()
    closing = np.array([end_id], "<u4").tobytes()
    # A special token's string in a text is one id wherever it stands; such texts are encoded whole.
    parts = [None if any(s in text for s in _STATE["special"]) else _parts(text, plain) for text in texts]
    for part in set(chain.from_iterable(p for p in parts if p)).difference(cache):
        if plain and not NOT_PLAIN.search(part):
            ids = [t.id for t in model.tokenize(part if part.isascii() else "".join(map(BYTE_CHARS.__getitem__, part.encode())))]
        else:
            ids = tokenizer.encode(part, add_special_tokens=False).ids
        cache[part] = struct.pack(f"<{len(ids)}I", *ids)
    return [(np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes() if own is None
             else b"".join(map(cache.__getitem__, own))) + closing for text, own in zip(texts, parts)]


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; pieces are no longer than the capacity."""
    n = len(lengths)
    size = 1 << max(0, (n - 1).bit_length())
    free = [capacity] * (2 * size)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need, node = int(lengths[i]), 1
        while node < size:
            node *= 2
            if free[node] < need:
                node += 1
        bins[i], offsets[i] = node - size, capacity - free[node]
        free[node] -= need
        while node > 1:
            node //= 2
            free[node] = max(free[2 * node], free[2 * node + 1])
    return bins, offsets


def pack(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text", capacity: int = 4096,
         end_id: int = 2, group_pieces: int = 20_000, seed: int = 7, keep_ids: bool = False) -> DataFrame:
    """One row per piece: id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``
    (and ``ids``, little-endian 32-bit, if ``keep_ids``)."""
    kind = docs.schema[id_column].dataType
    schema = T.StructType([T.StructField("k", kind)] + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens")]
                          + [T.StructField("ids", T.BinaryType())] * keep_ids)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "t"):
            coded = encode(pc.fill_null(batch.column("t"), "").to_pylist(), tokenizer_path, end_id)
            rows = [(d, s, ids[4 * s:4 * (s + capacity)], len(ids) // 4) for d, ids in enumerate(coded)
                    for s in range(0, len(ids) // 4, capacity)]
            columns = [batch.column("k").take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.int64()),
                       pa.array([len(r[2]) // 4 for r in rows], pa.int64()), pa.array([zlib.crc32(r[2]) for r in rows], pa.int64()),
                       pa.array([r[3] for r in rows], pa.int64())]
            if keep_ids:
                columns.append(pa.array([r[2] for r in rows], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    # written once: tokens are not counted twice, and a row keeps its group if a task is repeated
    pieces = cut_lineage(docs.select(F.col(f"`{id_column}`").alias("k"), F.col(f"`{text_column}`").alias("t")).mapInArrow(cut, schema))
    groups = max(1, -(-pieces.count() // group_pieces))
    packed = T.StructType([*schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def fill(group: pa.Table) -> pa.Table:
        bins, offsets = first_fit_decreasing(group["length"].to_numpy(), capacity)
        g = group["g"][0].as_py()
        return group.drop_columns(["g"]).append_column("sequence_id", pa.array((g << 32) + bins, pa.int64())).append_column(
            "offset", pa.array(offsets, pa.int64()))

    dealt = pieces.withColumn("g", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)), F.lit(groups)))
    return dealt.groupBy("g").applyInArrow(fill, packed).withColumnRenamed("k", id_column)
