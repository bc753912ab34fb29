"""Sampled segmentations by forward filtering and backward sampling over the piece lattice.

A piece holds the space mark only at its start, so the lattice of a text falls apart before each word. The
lattices of a block's distinct words are built and filtered together, one end position after the other; each
occurrence is then sampled backward on its own random numbers, all occurrences at a time. A piece's weight is
alpha * -log(2 + its rank in the vocabulary). Random numbers come from the seed, the row key, the word's place
in the text and the step.

Characters that no piece holds, and the space mark itself, are spelled in byte pieces, so decoding gives the
text back exactly. Null and empty texts have no pieces. Equal rows get equal segmentations. Other columns
are not read; of an empty table the result is empty.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.llm.words import C1, chunks, mix

MARK = "▁"
# A run of spaces belongs to the word after it; each text is given one space in front.
WORD = re.compile(r" +[^ ]*|[^ ]+")
BLOCK_WORDS = 1 << 18
STEP = np.uint64(0x9E3779B97F4A7C15)
SLOT_SHIFT = np.uint64(44)
_MODEL: dict = {}


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)


class Lattice:
    """Lattices of many words: the edges that end at each node, and their filtered probabilities.

    Node ``i`` is the place after character ``i`` of all words in a row. ``rank`` numbers the nodes in the order
    of the filter; edges of the node of rank r have cumulative probabilities in (r, r + 1].
    """

    def __init__(self, words: list[str], model: Pieces):
        code = codes("".join(words))
        size = np.fromiter(map(len, words), np.int64, len(words))
        self.last = np.cumsum(size) - 1
        begins = self.last + 1 - size
        n = len(code)
        stop = np.repeat((self.last + 1).astype(np.int32), size)
        level = np.arange(n) - np.repeat(begins, size)

        at, h = np.arange(n, dtype=np.int32), np.zeros(n, np.uint64)
        starts, ends, symbols = [], [], []
        single = np.zeros(n, bool)
        for length in range(1, model.longest + 1):
            room = at + length <= stop[at]
            at, h = at[room], h[room]
            h = mix(h + code[at + (length - 1)] * C1)
            place = model.slot[h >> SLOT_SHIFT]
            for _ in range(model.fullest):
                place += model.prefix[place] < h
            known = model.prefix[place] == h
            at, h, piece = at[known], h[known], model.piece[place[known]]
            whole = piece >= 0
            if length == 1:
                single[at[whole]] = True
            starts.append(at[whole])
            ends.append(at[whole] + (length - 1))
            symbols.append(piece[whole])
            if not len(at):
                break
        # a symbol past the vocabulary is a character spelled in bytes
        spelled = np.flatnonzero(~single)
        start, end = np.concatenate([*starts, spelled]), np.concatenate([*ends, spelled])
        symbol = np.concatenate([*symbols, code[spelled].astype(np.int64) + len(model.weight)])
        weight = np.concatenate([model.weight[np.concatenate(symbols)], model.spelling_weight(code[spelled])])

        # levels of 16 bits are sorted by radix, and the ends come as a few ascending runs
        depth = level.astype(np.uint16) if level.max(initial=0) < 1 << 16 else level
        order = np.argsort(depth, kind="stable")
        self.rank = np.empty(n, np.int64)
        self.rank[order] = np.arange(n)
        by = np.argsort(end, kind="stable")
        by = by[np.argsort(depth[end[by]], kind="stable")]
        start, end, weight, self.symbol = start[by], end[by], weight[by], symbol[by]
        self.back = np.where(level[start] > 0, start - 1, -1)
        row = self.rank[end]
        first = np.searchsorted(row, np.arange(n + 1))
        forward, p = np.zeros(n + 1), np.empty(len(row))  # forward[-1]: the start of every word
        cuts = np.searchsorted(level[order], np.arange(level.max(initial=-1) + 2))
        for a, b in zip(cuts, cuts[1:]):
            e, f = first[a], first[b]
            seg, count = first[a:b] - e, np.diff(first[a:b + 1])
            logs = forward[self.back[e:f]] + weight[e:f]
            top = np.maximum.reduceat(logs, seg)
            q = np.exp(logs - np.repeat(top, count))
            total = np.add.reduceat(q, seg)
            forward[order[a:b]] = top + np.log(total)
            p[e:f] = q / np.repeat(total, count)
        running = np.cumsum(p)
        before = np.append(0.0, running)[first[:-1]]
        self.cumulative = row + np.clip(running - before[row], 0.0, 1.0)
        self.cumulative[first[1:] - 1] = np.arange(1, n + 1)

    def sample(self, word: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all occurrences in a row, and how many each has; ``state`` seeds each occurrence."""
        alive, node = np.arange(len(word)), self.last[word]
        taken, steps = np.zeros(len(word), np.int64), []
        while len(alive):
            u = (mix(state[alive] + np.array([len(steps)], np.uint64) * STEP) >> np.uint64(32)) * 2.0 ** -32
            edge = np.searchsorted(self.cumulative, self.rank[node] + u, "right")
            steps.append((alive, edge))
            taken[alive] += 1
            node = self.back[edge]
            alive, node = alive[node >= 0], node[node >= 0]
        last = np.cumsum(taken) - 1
        out = np.empty(int(taken.sum()), np.int64)
        for t, (who, edge) in enumerate(steps):
            out[last[who] - t] = self.symbol[edge]
        return out, taken


class Pieces:
    def __init__(self, path: str, alpha: float):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids, self.surface = {}, [b""] * model.get_piece_size()
        self.byte = np.full(256, -1, np.int64)
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:-1], 16)] = i
                self.surface[i] = bytes([int(piece[3:-1], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                piece = piece.replace(MARK, " ")
                if " " not in piece.lstrip(" "):
                    self.ids[piece] = i
                    self.surface[i] = piece.encode()
        if (self.byte < 0).any():
            raise ValueError("the vocabulary lacks byte pieces")
        self.longest = max(map(len, self.ids))
        self.weight = -alpha * np.log(2.0 + np.arange(len(self.surface)))
        # hash of each beginning of a piece, and the piece that it is itself, or -1
        found: dict[str, int] = {p[:k]: -1 for p in self.ids for k in range(1, len(p) + 1)} | self.ids
        texts = list(found)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        code, first = codes("".join(texts)), np.cumsum(size) - size
        h = np.zeros(len(texts), np.uint64)
        for k in range(self.longest):
            own = size > k
            h[own] = mix(h[own] + code[first[own] + k] * C1)
        order = np.argsort(h)
        self.prefix = np.append(h[order], np.uint64(2**64 - 1))
        self.piece = np.append(np.fromiter(found.values(), np.int64, len(found))[order], -1)
        # where the hashes of equal leading bits begin, and the most of them
        self.slot = np.searchsorted(self.prefix[:-1], np.arange(1 << 20, dtype=np.uint64) << SLOT_SHIFT)
        self.fullest = int(np.diff(np.append(self.slot, len(texts))).max())

    def spelling(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte pieces of each code point, points x 4, and how many there are."""
        coded = [chr(c).encode() for c in points.tolist()]
        table = np.zeros((len(coded), 4), np.int64)
        for k, b in enumerate(coded):
            table[k, :len(b)] = self.byte[list(b)]
        return table, np.fromiter(map(len, coded), np.int64, len(coded))

    def spelling_weight(self, points: np.ndarray) -> np.ndarray:
        distinct, inverse = np.unique(points, return_inverse=True)
        table, size = self.spelling(distinct)
        return np.where(np.arange(4) < size[:, None], self.weight[table], 0.0).sum(1)[inverse]

    def spell(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids for symbols, with the characters past the vocabulary spelled; and the new counts a word."""
        odd = np.flatnonzero(symbols >= len(self.weight))
        if not len(odd):
            return symbols, counts
        distinct, inverse = np.unique(symbols[odd] - len(self.weight), return_inverse=True)
        table, size = self.spelling(distinct)
        each = np.ones(len(symbols), np.int64)
        each[odd] = size[inverse]
        first = np.cumsum(each) - each
        ids = np.repeat(symbols, each)
        for k in range(4):
            own = size[inverse] > k
            ids[first[odd[own]] + k] = table[inverse[own], k]
        return ids, np.bincount(np.repeat(np.arange(len(counts)), counts), each, len(counts)).astype(np.int64)

    def sample_texts(self, texts: list[str], keys: list[int], seed: int) -> list[np.ndarray]:
        """Ids of each text. Words are taken in blocks, whatever texts they come from."""
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        base = mix(mix(np.array([k & (2**64 - 1) for k in keys], np.uint64) + np.uint64(seed)))
        block: list[tuple[int, int, list[str]]] = []
        held = 0

        def flush() -> None:
            number: dict[str, int] = {}
            word = np.array([number.setdefault(w, len(number)) for _, _, ws in block for w in ws], np.int64)
            state = np.concatenate([mix(base[t] + np.arange(a, a + len(ws), dtype=np.uint64) * C1) for t, a, ws in block])
            ids, counts = self.spell(*Lattice(list(number), self).sample(word, state))
            ends = np.append(0, np.cumsum(counts))[np.append(0, np.cumsum([len(ws) for _, _, ws in block]))]
            for (t, _, _), a, b in zip(block, ends, ends[1:]):
                parts[t].append(ids[a:b].astype("<u4"))
            block.clear()

        for t, text in enumerate(texts):
            if not text:
                continue
            words, at = (m[0] for m in WORD.finditer(" " + text)), 0
            while some := list(islice(words, BLOCK_WORDS - held)):
                block.append((t, at, some))
                at += len(some)
                held += len(some)
                if held == BLOCK_WORDS:
                    flush()
                    held = 0
        if block:
            flush()
        return [p[0] if len(p) == 1 else np.concatenate(p) if p else np.empty(0, "<u4") for p in parts]

    def sample(self, text: str, key: int, seed: int) -> list[int]:
        return self.sample_texts([text], [key], seed)[0].tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.surface.__getitem__, ids)).decode()[1:]


def pieces(path: str, alpha: float) -> Pieces:
    if _MODEL.get("is") != (path, alpha):
        _MODEL.update({"is": (path, alpha), "model": Pieces(path, alpha)})
    return _MODEL["model"]


def sample_pieces(docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text", alpha: float = 1.0,
                  seed: int = 11, keep_ids: bool = False) -> DataFrame:
    """Per row: id, ``n_pieces``, ``ids_crc32`` (little-endian 32-bit ids), ``lossless`` (and ``ids``)."""
    base = docs.select(F.col(f"`{id_column}`").alias("id"), F.xxhash64(F.col(f"`{id_column}`")).alias("key"), F.col(f"`{text_column}`").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(model_path, alpha)
        for batch in chunks(batches, "t"):
            texts = pc.fill_null(batch.column("t"), "").to_pylist()
            ids = model.sample_texts(texts, batch.column("key").to_pylist(), seed)
            columns = [batch.column("id"), pa.array([len(i) for i in ids], pa.int64()), pa.array([zlib.crc32(i.tobytes()) for i in ids], pa.int64()),
                       pa.array([model.decode(i.tolist()) == t for i, t in zip(ids, texts)])]
            names = ["id", "n_pieces", "ids_crc32", "lossless"]
            yield pa.RecordBatch.from_arrays(columns + [pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32()))] * keep_ids, names=names + ["ids"] * keep_ids)

    kind = base.schema["id"].dataType.simpleString()
    return base.mapInArrow(run, f"id {kind}, n_pieces long, ids_crc32 long, lossless boolean" + ", ids array<int>" * keep_ids).withColumnRenamed("id", id_column)
