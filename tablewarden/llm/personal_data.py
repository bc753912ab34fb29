"""Personal data: exact base rules, and spans added by a character-level bidirectional LSTM with CRF transitions.

Base rules find e-mail addresses, IPv4 addresses, payment cards and international telephone numbers, each kind by
leftmost non-overlapping matches (`base_spans`), in time linear in the text. The network is trained in numpy on
windows of text labelled by the base rules: a bounded, documented number of windows (`most_windows` for each kind and
as many without any), the least ones by hash of all in the corpus. Copies of labelled spans are rewritten (without
the plus, with other separators, with spelled-out signs), so the network also learns forms that no rule has.

Whole texts are cut into overlapping windows. A window in which no segment of any kind can gain over staying "outside"
is decoded to "outside" at once, which is exact; others by the Viterbi path. Neighbouring windows are joined
where they agree nearest to the middle of their overlap, so spans across borders are found once. An added span must
have a kind's shape (`plausible`: digits of telephones, the card checksum, parts of an address up to 255) and touch
no base span. The squashing function is x / (1 + |x|), which has the shape of tanh at a sixth of its cost.

Defined results. Null and empty texts have no span. Rows are independent, so repeated rows get equal results. A text
of any length is read to its end. Without labelled windows nothing is added. An empty table gives an empty result.
Other columns are not read, whatever they are called. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewarden.llm.words import chunks

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # kind's number, start, end

# The base patterns. Possessive repeats and the look-behind change no match: a run of digits either fits from its
# beginning or not at all. E-mail addresses are found from their sign, see emails().
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
ADDRESS = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")

# Shapes an added span must have.
DOT = r"\s?(?:\.|[\[({]\s?(?:\.|dot|DOT)\s?[\])}]|\bdot\b|\bDOT\b)\s?"
SHAPES = (re.compile(r"[A-Za-z0-9._%+-]+\s?(?:@|[\[({<]\s?(?:@|at|AT)\s?[\])}>]|\bat\b|\bAT\b)\s?[A-Za-z0-9-]+(?:" + DOT + r"[A-Za-z0-9-]+)+"),
          re.compile(r"([0-9]{1,3})" + DOT + r"([0-9]{1,3})" + DOT + r"([0-9]{1,3})" + DOT + r"([0-9]{1,3})"),
          re.compile(r"[0-9](?:[\x20./-]?[0-9])+"),
          re.compile(r"[+(]?[0-9](?:[\x20()./-]{0,3}[0-9])+"))


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(2 * int(d) - 9 * (d > "4") for d in digits[-2::-2])) % 10 == 0


def only_digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """An address holds one sign: its local part is the run before it, back to the end of the last match."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", m.end() if m else at + 1)


def base_spans(text: str) -> list[Span]:
    """By kind, then start."""
    found: list[Span] = [(0, *s) for s in emails(text)] if "@" in text else []
    found += [(1, *m.span()) for m in ADDRESS.finditer(text) if all(int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split("."))]
    found += [(2, *m.span()) for m in CARD.finditer(text) if m.end() - m.start() > 15 and 16 <= len(d := only_digits(m[0])) <= 19 and luhn(d)]
    found += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(only_digits(m[0])) <= 15] if "+" in text else []
    return found


def plausible(kind: int, s: str) -> bool:
    m = SHAPES[kind].fullmatch(s)
    if not m or kind == 0:
        return bool(m)
    digits = only_digits(s)
    if kind == 1:
        return all(int(p) <= 255 for p in m.groups())
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 8 <= len(digits) <= 15 and len(re.findall(r"[\x20()./-]+", s)) >= 2


# Input classes: 0 past the end, then ASCII with letters in lower case, all else as one.
_CHARS = [chr(c) for c in range(32, 127) if not chr(c).isupper() and not ("1" <= chr(c) <= "9")] + ["\n"]
CLASSES = len(_CHARS) + 3
CLASS = np.full(257, len(_CHARS) + 1, np.uint8)
CLASS[128:] = len(_CHARS) + 2
for _i, _c in enumerate(_CHARS):
    for _x in {_c, _c.upper(), *("123456789" if _c == "0" else "")}:
        CLASS[ord(_x)] = _i + 1
LABELS = 1 + 2 * len(KINDS)  # outside, then beginning and inside of each kind
WINDOW, STRIDE, GROUP = 256, 216, 2048
TRAIN = 96


def classes_of(text: str) -> np.ndarray:
    return CLASS[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), 256)]


def squash(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


class Tagger:
    """Both directions of the LSTM are stacked in the first axis; gates are input, forget, output, cell."""

    def __init__(self, hidden: int, rng: np.random.Generator):
        h, f = hidden, np.float32
        self.hidden = h
        allowed = np.zeros((LABELS, LABELS), f)
        for k in range(2, LABELS, 2):  # inside follows beginning or inside of its kind
            allowed[:, k] = -1e4
            allowed[[k - 1, k], k] = 0
        bias = np.zeros((2, 4 * h, 1), f)
        bias[:, h:2 * h] = 1
        self.p = {"in": rng.normal(0, .3, (2, 4 * h, CLASSES)).astype(f), "rec": rng.normal(0, h ** -.5, (2, 4 * h, h)).astype(f), "bias": bias,
                  "out": rng.normal(0, h ** -.5, (2, LABELS, h)).astype(f), "off": np.zeros((LABELS, 1), f),
                  "trans": allowed, "start": np.where(np.arange(LABELS) % 2 + (np.arange(LABELS) == 0), 0, -1e4).astype(f), "end": np.zeros(LABELS, f)}

    def emissions(self, x: np.ndarray, tape: list | None = None) -> np.ndarray:
        """(step, label, window) from classes (step, window)."""
        p, n, b = self.p, self.hidden, x.shape[1]
        steps = len(x)
        h = c = np.zeros((2, n, b), np.float32)
        out = np.empty((steps, LABELS, b), np.float32)
        out[:] = p["off"]
        table = p["in"] + p["bias"]
        a = np.empty((2, 4 * n, b), np.float32)
        part = np.empty((2, 4 * n, b), np.float32)
        for t in range(steps):
            np.matmul(p["rec"], h, out=a)
            for d, at in ((0, t), (1, steps - 1 - t)):
                np.take(table[d], x[at], axis=1, out=part[d], mode="clip")
            a += part
            np.abs(a, out=part)
            part += 1
            a /= part
            gates = a[:, :3 * n]
            gates *= 0.5
            gates += 0.5
            before = c
            c = a[:, n:2 * n] * before + a[:, :n] * a[:, 3 * n:]
            s = squash(c)
            if tape is not None:
                tape.append((a.copy(), before, s, h))
            h = a[:, 2 * n:3 * n] * s
            e = p["out"] @ h
            out[t] += e[0]
            out[steps - 1 - t] += e[1]
            if tape is not None:
                tape[-1] += (h,)
        return out

    def gradients(self, x: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean negative log-likelihood of label paths (step, window)."""
        p, n, (steps, b) = self.p, self.hidden, x.shape
        tape: list = []
        e = self.emissions(x, tape).transpose(0, 2, 1).astype(float)
        de, g = crf_gradients(e, labels, p["trans"], p["start"], p["end"])
        de = de.transpose(0, 2, 1).astype(np.float32) / b
        g = {k: v / b for k, v in g.items()} | {k: np.zeros_like(p[k]) for k in ("in", "rec", "out", "bias")}
        g["off"] = de.sum((0, 2))[:, None]
        hot = np.eye(CLASSES, dtype=np.float32)
        dh = dc = np.zeros((2, n, b), np.float32)
        for t in range(steps - 1, -1, -1):
            a, before, s, h_before, h = tape[t]
            both = np.stack([de[t], de[steps - 1 - t]])
            g["out"] += both @ h.transpose(0, 2, 1)
            dh = dh + p["out"].transpose(0, 2, 1) @ both
            i, f, o, z = (a[:, k * n:(k + 1) * n] for k in range(4))
            dc = dc + dh * o * (1 - np.abs(s)) ** 2
            # of a gate y = squash(v) / 2 + 1 / 2 the slope is (1 - |2y - 1|)**2 / 2
            da = np.concatenate([dc * z, dc * before, dh * s, dc * i], 1)
            da[:, :3 * n] *= (1 - np.abs(2 * a[:, :3 * n] - 1)) ** 2 / 2
            da[:, 3 * n:] *= (1 - np.abs(z)) ** 2
            dc = dc * f
            g["rec"] += da @ h_before.transpose(0, 2, 1)
            g["in"] += np.stack([da[0] @ hot[x[t]], da[1] @ hot[x[steps - 1 - t]]])
            g["bias"] += da.sum(2, keepdims=True)
            dh = p["rec"].transpose(0, 2, 1) @ da
        return g

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the windows whose best path is not all outside, and those paths (window, step)."""
        p, e = self.p, self.emissions(x)
        e[:, 1:][(x == 0)[:, None, :].repeat(LABELS - 1, 1)] = -1e4
        stay, first, inner = p["trans"][0, 0], slice(1, LABELS, 2), slice(2, LABELS, 2)
        # what the best segment of each kind that ends at a step gains over staying outside
        enter = np.maximum(p["trans"].max(0) - stay, p["start"] - p["start"][0])[first, None]
        go_on = np.maximum(p["trans"].diagonal()[inner], p["trans"][first, inner].diagonal())[:, None] - stay
        out = np.maximum(np.maximum(p["trans"][:, 0] - stay, p["end"] - p["end"][0]), 0)
        leave = np.maximum(out[first], out[inner])[:, None]
        begin, go_on = e[:, first] - e[:, :1] + enter, e[:, inner] - e[:, :1] + go_on
        gain = most = begin[0]
        for t in range(1, len(x)):
            gain = np.maximum(gain + go_on[t], begin[t])
            most = np.maximum(most, gain)
        some = np.flatnonzero((most + leave).max(0) >= -1e-3)
        if not len(some):
            return some, np.empty((0, len(x)), np.int8)
        paths = viterbi(np.ascontiguousarray(e[:, :, some].transpose(0, 2, 1)), p["trans"], p["start"], p["end"])
        hit = paths.any(1)
        return some[hit], paths[hit]

    def tag(self, texts: list[str]) -> list[list[Span]]:
        """Decoded spans of whole texts, windows joined where they agree."""
        size = np.array([len(t) for t in texts], np.int64)
        begin = np.cumsum(size) - size
        cls = np.concatenate([classes_of("".join(texts)), np.zeros(1, np.uint8)])
        n_windows = np.where(size > 0, 1 + np.maximum(0, -(-(size - WINDOW) // STRIDE)), 0)
        doc = np.repeat(np.arange(len(texts)), n_windows)
        place = np.arange(len(doc)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
        first, stop = begin[doc] + STRIDE * place, (begin + size)[doc]
        paths: dict[int, dict[int, np.ndarray]] = {}
        for g in range(0, len(doc), GROUP):
            at = first[g:g + GROUP] + np.arange(WINDOW)[:, None]
            inside = at < stop[g:g + GROUP]
            x = np.where(inside, cls[np.where(inside, at, 0)], 0)
            for w, path in zip(*self.decode(x)):
                paths.setdefault(int(doc[g + w]), {})[int(place[g + w])] = path
        return [joined(paths[i], int(size[i])) if i in paths else [] for i in range(len(texts))]


def joined(paths: dict[int, np.ndarray], size: int) -> list[Span]:
    """Spans of a text from the paths of its windows; windows without one are all outside."""
    outside, lap = np.zeros(WINDOW, np.int8), WINDOW - STRIDE
    labels = np.zeros(size + WINDOW, np.int8)

    def cut(w: int) -> int:
        """Where window w + 1 takes over, in the text."""
        a, b = paths.get(w, outside)[STRIDE:], paths.get(w + 1, outside)[:lap]
        same = np.flatnonzero(a == b)
        return (w + 1) * STRIDE + (int(same[np.abs(same - lap // 2).argmin()]) if len(same) else lap // 2)

    for w, path in paths.items():
        a, b = cut(w - 1) if w else 0, min(cut(w), w * STRIDE + WINDOW) if (w + 1) * STRIDE < size else size
        labels[a:b] = path[a - w * STRIDE:b - w * STRIDE]
    labels = labels[:size]
    kind = (labels.astype(np.int64) + 1) // 2
    begins = (kind > 0) & ((labels % 2 == 1) | (np.r_[0, kind[:-1]] != kind))
    out = []
    for s in np.flatnonzero(begins):
        rest = np.flatnonzero((kind[s + 1:] != kind[s]) | begins[s + 1:])
        out.append((int(kind[s]) - 1, int(s), int(s + 1 + rest[0]) if len(rest) else size))
    return out


def viterbi(e: np.ndarray, trans: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    steps, b, _ = e.shape
    back = np.empty((steps, b, LABELS), np.int8)
    score = start + e[0]
    for t in range(1, steps):
        every = score[:, :, None] + trans
        back[t] = every.argmax(1)
        score = every.max(1) + e[t]
    path = np.empty((b, steps), np.int8)
    path[:, -1] = (score + end).argmax(1)
    for t in range(steps - 1, 0, -1):
        path[:, t - 1] = back[t, np.arange(b), path[:, t]]
    return path


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def crf_gradients(e: np.ndarray, labels: np.ndarray, trans: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Expected minus observed: of emissions (step, window, label), transitions, starts and ends, summed over windows."""
    steps, b, _ = e.shape
    ahead, behind = np.empty_like(e), np.empty_like(e)
    ahead[0], behind[-1] = start + e[0], end
    for t in range(1, steps):
        ahead[t] = log_sum(ahead[t - 1][:, :, None] + trans, 1) + e[t]
        k = steps - 1 - t
        behind[k] = log_sum(trans + (e[k + 1] + behind[k + 1])[:, None, :], 2)
    total = log_sum(ahead[-1] + end, 1)
    d = np.exp(ahead + behind - total[:, None])
    g = {"start": d[0].sum(0), "end": d[-1].sum(0), "trans": np.zeros(trans.shape)}
    np.add.at(g["start"], labels[0], -1)
    np.add.at(g["end"], labels[-1], -1)
    for t in range(1, steps):
        g["trans"] += np.exp(ahead[t - 1][:, :, None] + trans + (e[t] + behind[t] - total[:, None])[:, None, :]).sum(0)
        np.add.at(g["trans"], (labels[t - 1], labels[t]), -1)
    d[np.arange(steps)[:, None], np.arange(b), labels] -= 1
    return d, g


def rewritten(kind: int, s: str, rng: np.random.Generator) -> str:
    """The same datum in a form that the base rules need not know."""
    pick = lambda *forms: forms[rng.integers(len(forms))]
    if kind == 0:
        at, dot = pick((" (at) ", " (dot) "), (" [at] ", " [dot] "), (" at ", " dot "), (" @ ", " . "), ("[@]", "[.]"), (" AT ", " DOT "))
        local, _, host = s.partition("@")
        return local + at + host.replace(".", dot)
    if kind == 1:
        return s.replace(".", pick("[.]", " . ", "(.)", "[dot]"))
    digits = only_digits(s)
    if kind == 2:
        sizes, sep = ([4, 4, 4, 4], pick(".", "/")) if len(digits) == 16 else ([len(digits)], "")
        if rng.random() < 0.4:  # fifteen digits in groups of 4, 6 and 5
            digits = digits[:14]
            digits += next(d for d in "0123456789" if luhn(digits + d))
            sizes, sep = [4, 6, 5], pick(" ", "-", ".")
        ends = np.cumsum(sizes)
        return sep.join(digits[b - a:b] for a, b in zip(sizes, ends))
    own = digits[-10:] if len(digits) > 10 else digits
    a, b, c = own[:3], own[3:6], own[6:]
    return pick(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"00 {digits[:-10] or '1'} {a} {b} {c}", f"({a}) {b} {c}", f"{a}/{b}-{c}")


def examples(windows: list[tuple[str, list[Span]]], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Classes and labels (step, window); every labelled window also with its spans rewritten."""
    x, y = [], []
    for text, spans in windows:
        for again in range(1 + bool(spans)):
            piece, label, last = "", [], 0
            for kind, a, b in sorted(spans, key=lambda s: s[1]):
                if a < last:
                    continue
                s = rewritten(kind, text[a:b], rng) if again else text[a:b]
                piece += text[last:a] + s
                label += [0] * (a - last) + [2 * kind + 1] + [2 * kind + 2] * (len(s) - 1)
                last = b
            piece, label = piece + text[last:], label + [0] * (len(text) - last)
            x.append(np.r_[classes_of(piece)[:TRAIN], np.zeros(max(0, TRAIN - len(piece)), np.uint8)])
            y.append(np.array((label + [0] * TRAIN)[:TRAIN]))
    return np.array(x).T.copy(), np.array(y).T.copy()


def fit(windows: list[tuple[str, list[Span]]], hidden: int = 8, steps: int = 240, batch: int = 128, rate: float = 0.02, seed: int = 13) -> Tagger | None:
    """Adam on batches of windows; None without labelled windows."""
    rng = np.random.default_rng(seed)
    if not any(spans for _, spans in windows):
        return None
    x, y = examples(windows, rng)
    tagger = Tagger(hidden, rng)
    mean, square = ({k: np.zeros_like(v, float) for k, v in tagger.p.items()} for _ in range(2))
    left = np.empty(0, np.int64)
    for step in range(1, steps + 1):
        if not len(left):
            left = rng.permutation(x.shape[1])
        own, left = left[:batch], left[batch:]
        g = tagger.gradients(x[:, own], y[:, own])
        norm = np.sqrt(sum(float((v ** 2).sum()) for v in g.values()))
        now = rate * (1 - step / (steps + 1))
        for k, v in g.items():
            v = v * min(1.0, 5.0 / (norm + 1e-9))
            mean[k] += 0.1 * (v - mean[k])
            square[k] += 0.01 * (v ** 2 - square[k])
            move = now * (mean[k] / (1 - 0.9 ** step)) / (np.sqrt(square[k] / (1 - 0.99 ** step)) + 1e-8)
            tagger.p[k] = (tagger.p[k] - np.where(tagger.p[k] < -5e3, 0, move)).astype(np.float32)
    return tagger


def training_windows(df: DataFrame, text_column: str, most_windows: int) -> list[tuple[str, list[Span]]]:
    """Up to ``most_windows`` windows for each kind and as many without a span, the least by hash of all there are."""
    source = df.select(F.col(f"`{text_column}`").cast("string").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            rows = []
            for text in part.column(0).to_pylist():
                if not text:
                    continue
                spans = base_spans(text)
                mark = int.from_bytes(hashlib.blake2b(text[:64].encode(errors="replace") + str(len(text)).encode(), digest_size=8).digest(), "big")
                # around each span, and around one number and one place of any kind without a span
                places = [(k, a) for k, a, b in spans if b - a <= TRAIN // 2]
                digit = re.compile("[0-9@]").search(text, mark % len(text))
                places += [(len(KINDS), p) for p in {mark // 7 % len(text), digit.start() if digit else 0}]
                for i, (kind, at) in enumerate(places):
                    first = max(0, at - (mark >> i % 16) % (TRAIN // 2))
                    end = first + TRAIN * 3 // 4 if kind < len(KINDS) else first + TRAIN
                    own = [s for s in spans if s[1] < end and s[2] > first]
                    if kind == len(KINDS) and own or any(s[2] > end + TRAIN // 4 for s in own):
                        continue
                    first, end = min([first, *(s[1] for s in own)]), max([end, *(s[2] for s in own)])
                    rows.append((kind, text[first:end], [v - first if j else v for s in own for j, v in enumerate(s)]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))],
                                             names=["kind", "piece", "spans"])

    found = source.mapInArrow(run, "kind int, piece string, spans array<long>")
    # first the least of each of 256 parts of a kind, so that no task gets what all others have kept
    hashed = found.withColumn("h", F.xxhash64("piece"))
    for keys in ((F.col("kind"), F.pmod("h", F.lit(256))), (F.col("kind"),)):
        order = Window.partitionBy(*keys).orderBy("h", "piece", "spans")
        hashed = hashed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most_windows)
    few = hashed.collect()
    few.sort(key=lambda r: (r["kind"], r["place"]))
    return [(r["piece"], [(s[i], s[i + 1], s[i + 2]) for i in range(0, len(s), 3)]) for r in few for s in [r["spans"]]]


def train(df: DataFrame, text_column: str = "text", most_windows: int = 384) -> Tagger | None:
    return fit(training_windows(df, text_column, most_windows))


def all_spans(text: str, base: list[Span], tagged: list[Span]) -> list[Span]:
    """Base spans and the tagged ones that have a kind's shape and touch none, by kind, then start."""
    added: list[Span] = []
    for kind, a, b in tagged:
        s = text[a:b]
        a, b = a + len(s) - len(s.lstrip(" \n,;:.")), b - len(s) + len(s.rstrip(" \n,;:."))
        if a < b and plausible(kind, text[a:b]) and not any(x < b and a < y for _, x, y in [*base, *added]):
            added.append((kind, a, b))
    return sorted([*base, *added])


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find(df: DataFrame, tagger: Tagger | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id``, counts of base spans by kind, ``base_sha256``, ``spans``, ``n_added``."""
    source = df.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    sent = df.sparkSession.sparkContext.broadcast(tagger)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            texts = [t or "" for t in part.column(1).to_pylist()]
            base = [base_spans(t) for t in texts]
            every = [all_spans(*x) for x in zip(texts, base, sent.value.tag(texts))] if sent.value else base
            counts = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in range(len(KINDS))]
            digests = pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b in base], pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), *counts, digests, pa.array([written(s) for s in every], pa.string()), pa.array([len(s) - len(b) for s, b in zip(every, base)], pa.int64())],
                                             names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    return source.mapInArrow(run, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long")
