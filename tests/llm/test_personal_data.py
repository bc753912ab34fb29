"""Personal data: base rules against their patterns, decoding against the plain Viterbi path, spans across windows."""

import hashlib
import random
import re

import numpy as np
import pytest

from tablewarden.llm import personal_data as P
from tablewarden.llm import queries

SF = "/root/testdata/sf0.001"
# the rules as they are stated
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def checksum(digits):
    return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(digits))) % 10 == 0


KEPT = {"email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m.split(".")),
        "card": lambda m: 16 <= len(re.sub(r"\D", "", m)) <= 19 and checksum(re.sub(r"\D", "", m)),
        "phone": lambda m: 8 <= len(re.sub(r"\D", "", m)) <= 15}


def plain(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if KEPT[k](m[0]))


CARD, CARD2 = "4266261444392889", "4539 5787 6362 1486"


def test_base_rules_are_the_stated_ones():
    rng = random.Random(1)
    for alphabet in ("a@.", "a.b@-%é", "0125.", "01 -", "+1 ()-9", "a1@.+ -(é\n", "0123456789 -"):
        for _ in range(1500):
            text = "".join(rng.choices(alphabet, k=rng.randint(0, 45)))
            if alphabet == "0123456789 -":
                text = text[:9] + rng.choice([CARD, CARD2, CARD2.replace(" ", "-"), CARD + "0"]) + text[9:]
            assert P.written(P.base_spans(text)) == plain(text), text


@pytest.mark.parametrize("text", ["a" * 300_000, "@" * 100_000, "1" * 200_000, "1." * 100_000, "+1" * 100_000, "+1" + "(" * 200_000, "a@" * 100_000, "1 " * 200_000 + "x@y.z"],
                         ids=range(8))
def test_long_texts_take_linear_time(text):
    P.base_spans(text)


@pytest.fixture(scope="module")
def tagger(spark):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    return P.train(docs, most_windows=96)


def test_windows_left_out_are_all_outside(tagger):
    rng = np.random.default_rng(2)
    texts = [r"an heon 212-555-0199 at +1 (212) 555-0199 e.34@mail7.example.com 10.2.3.4 " + CARD, "the of in er tion"]
    x = np.stack([np.r_[P.classes_of((texts[i % 2] * 30)[i:i + P.WINDOW - i % 50]), np.zeros(i % 50, np.uint8)] for i in range(80)] +
                 [rng.integers(1, P.CLASSES, P.WINDOW).astype(np.uint8) for _ in range(80)]).T.copy()
    e = tagger.emissions(x)
    e[:, 1:][(x == 0)[:, None, :].repeat(P.LABELS - 1, 1)] = -1e4
    want = P.viterbi(e.transpose(0, 2, 1), tagger.p["trans"], tagger.p["start"], tagger.p["end"])
    some, paths = tagger.decode(x)
    assert 0 < len(some) < x.shape[1]
    got = np.zeros_like(want)
    got[some] = paths
    assert (got == want).all()


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    e, trans, start, end = rng.normal(size=(4, 2, P.LABELS)), rng.normal(size=(P.LABELS, P.LABELS)), rng.normal(size=P.LABELS), rng.normal(size=P.LABELS)
    paths = np.stack(np.meshgrid(*[np.arange(P.LABELS)] * 4, indexing="ij"), -1).reshape(-1, 4)
    for w, got in enumerate(P.viterbi(e, trans, start, end)):
        s = start[paths[:, 0]] + end[paths[:, 3]] + sum(e[t, w, paths[:, t]] for t in range(4)) + sum(trans[paths[:, t], paths[:, t + 1]] for t in range(3))
        assert (paths[s.argmax()] == got).all()


def test_gradients_are_those_of_the_likelihood():
    rng = np.random.default_rng(0)
    t = P.Tagger(3, rng)
    t.p = {k: v.astype(float) for k, v in t.p.items()}
    x, y = rng.integers(1, P.CLASSES, (5, 2)).astype(np.uint8), np.array([[0, 1], [3, 2], [4, 2], [0, 0], [5, 7]])

    def loss():
        e = t.emissions(x).transpose(0, 2, 1).astype(float)
        a, s = t.p["start"] + e[0], t.p["start"][y[0]] + e[0][[0, 1], y[0]]
        for i in range(1, 5):
            a, s = P.log_sum(a[:, :, None] + t.p["trans"], 1) + e[i], s + t.p["trans"][y[i - 1], y[i]] + e[i][[0, 1], y[i]]
        return (P.log_sum(a + t.p["end"], 1) - s - t.p["end"][y[-1]]).mean()

    g = t.gradients(x, y)
    for k, at in {"in": (1, 4, x[2, 0]), "rec": (0, 5, 1), "bias": (1, 2, 0), "out": (0, 3, 1), "off": (3, 0), "trans": (1, 2), "start": (1,), "end": (7,)}.items():
        old = t.p[k][at]
        up, down = [(t.p[k].__setitem__(at, old + d), loss())[1] for d in (1e-2, -1e-2)]
        t.p[k][at] = old
        assert (up - down) / 2e-2 == pytest.approx(g[k][at], abs=2e-3)


def test_spans_across_windows_are_found_once():
    path = np.zeros(P.WINDOW, np.int8)
    for at in range(P.STRIDE - 30, P.WINDOW + 20):                       # a span of 12 everywhere around a border
        first, second = path.copy(), path.copy()
        for w, labels in ((0, first), (1, second)):
            a = at - w * P.STRIDE
            labels[max(0, a):max(0, a + 12)] = 2
            if 0 <= a < P.WINDOW:
                labels[a] = 1
        paths = {w: p for w, p in ((0, first), (1, second)) if p.any()}
        assert P.joined(paths, 2 * P.WINDOW) == [(0, at, at + 12)]


def test_rewritten_forms_are_found_in_unseen_texts(spark, tagger):
    """Held out: the documents of another table; words between the spans are new."""
    rng = np.random.default_rng(7)
    texts = [r.text for r in queries.table(spark, "/root/testdata/sf0.1", "documents").where("doc_id between 3000 and 4200").collect()]
    found = asked = clean = wrong = 0
    for text in texts:
        spans = P.base_spans(text)
        if not spans:
            clean, wrong = clean + 1, wrong + bool(P.all_spans(text, [], tagger.tag([text])[0]))
            continue
        kind, a, b = spans[0]
        new = P.rewritten(kind, text[a:b], rng)
        text = text[:a] + new + text[b:]
        base = P.base_spans(text)
        if not any(x < a + len(new) and a < y for _, x, y in base):
            asked += 1
            found += any(x < a + len(new) and a < y for _, x, y in P.all_spans(text, base, tagger.tag([text])[0]))
    assert asked > 40 and found > 0.7 * asked and wrong <= 0.01 * clean


def test_query_results_and_edges(spark, tagger):
    long = "word " * 50_000 + "a.b@c.de " + "word " * 50_000 + CARD
    rows = [(1, "a.b@c.de x +1 (212) 555-0199, 10.0.0.1 " + CARD), (2, None), (None, ""), (3, "é" * 300 + " a@b.co " + "漢" * 300), (3, "é" * 300 + " a@b.co " + "漢" * 300),
            (4, long), (5, "1.2.3.256 a@b +123 " + CARD[:-1]), (6, CARD2 + "\x00퟿" + "\U0001f600 1.2.3.4")]
    frame = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, spans string, n_email int").repartition(3)
    got = P.find(frame, tagger).collect()
    assert len(got) == len(rows)
    want = {(i, hashlib.sha256(plain(t).encode()).hexdigest(), *(sum(s.startswith(k) for s in plain(t).split(",")) for k in PATTERNS)) for i, t in rows}
    assert {(r.doc_id, r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got} == want
    for r in got:
        texts = [plain(t) for i, t in rows if i == r.doc_id]
        assert set(texts[0].split(",")) <= set(r.spans.split(",")) and r.n_added == len(r.spans.split(",")) - len(texts[0].split(","))
    assert P.find(frame.limit(0), tagger).count() == 0
    assert P.train(frame.where("doc_id = 2")) is None and P.train(frame.limit(0)) is None
    assert [r.spans for r in P.find(frame.where("doc_id = 1"), None).collect()] == [plain(rows[0][1])]
