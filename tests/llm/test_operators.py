"""Operators against brute force on small tables with nulls, empty texts, repeats and a clashing column."""

import base64
import hashlib
import re
import tempfile
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tablewarden.llm import backoff_lm, langid, near_dedup, queries, toxicity
from tablewarden.llm.license_scan import scan
from tablewarden.llm.packing import encode, first_fit_decreasing, pack
from tablewarden.llm.piece_sampling import Pieces, sample_pieces
from tablewarden.llm.repetition import repetition
from tablewarden.llm.top_products import top_products
from tablewarden.llm.warc_index import capture_index, merge

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, score string"
LONG = " ".join(f"w{i}" for i in range(3000))
ROWS = [(1, "one two three four five six seven", "en", "a"), (2, "one two three four five six seven", "en", "a"), (3, None, None, None),
        (None, "", "en", "x"), (4, "MIT License é é\nline\nline\n", "fr", ""), (5, LONG, "en", ""), (5, LONG, "en", ""), (6, "ab " * 60, "fr", "")]


@pytest.fixture
def docs(spark):
    queries.table(spark, SF, "region")
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.mark.parametrize("size", [len(ROWS), 0])
def test_edges(docs, size):
    table = docs.limit(0) if size == 0 else docs
    model = toxicity.train(table, table.select("doc_id", F.lit(1).alias("toxic")))
    lang = langid.train(table)
    assert repetition(table).count() == size
    assert scan(table).count() == size
    assert toxicity.score(table, model).count() == size
    assert langid.identify(table, lang, [F.col("doc_id")], ["doc_id"]).count() == size
    assert near_dedup.near_duplicates(table).count() == size
    assert backoff_lm.score(table, F.col("doc_id") == 1).count() == size
    assert pack(table, public_tokenizers.path("word_bpe_49k.json")).count() == pytest.approx(size, abs=20)
    got = sample_pieces(table, public_tokenizers.path("piece_bpe_32k.model"), keep_ids=True).collect()
    assert len(got) == size and all(r.lossless for r in got)


def test_repetition_counts(docs):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    got = {r.doc_id: r for r in repetition(docs).collect()}
    for key, text, *_ in ROWS:
        w = word.findall(text or "")
        seen = defaultdict(list)
        for i in range(len(w) - 7):
            seen[tuple(w[i:i + 8])].append(i)
        inside = {j for v in seen.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
        assert (got[key].n_words, got[key].n_repeat_words) == (len(w), len(inside))
    assert not got[6].kept and got[5].kept and got[4].n_dup_lines == 1


def test_near_duplicates_are_components(docs):
    got = sorted((str(r.doc_id), str(r.class_id)) for r in near_dedup.near_duplicates(docs).collect())
    assert got == [("1", "1"), ("2", "1"), ("3", "3"), ("4", "4"), ("5", "5"), ("5", "5"), ("6", "6"), ("None", "None")]


def test_borderline_copies_link_as_by_brute_force(spark):
    queries.table(spark, SF, "region")
    rng = np.random.default_rng(5)
    passage, rows = [f"p{i}" for i in range(80)], []
    for family in range(6):
        root = [f"f{family}w{i}" for i in range(100)]
        for _ in range(25):
            own = list(root)
            for at in rng.choice(100, rng.integers(0, 7), replace=False):
                own[at] = f"x{rng.integers(1 << 30)}"
            rows.append((len(rows), " ".join(own + passage)))
    grams = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (r[1].split() for r in rows)]
    want = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]) and want[a] != want[b]:
                old, new = max(want[a], want[b]), min(want[a], want[b])
                want = [new if w == old else w for w in want]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k] for k in range(len(rows))] == want and len(set(want)) > 6


def test_dart_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    element = rng.integers(0, 2**63, 400).astype(np.uint64)
    a, b = rng.uniform(0.2, 5, 400), rng.uniform(0.2, 5, 400)
    sig = near_dedup.signature(np.repeat([0, 1], 400), np.tile(element, 2), np.concatenate([a, b]), 2, 2000)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.05


def test_packing(docs):
    rows = pack(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=True, capacity=512).collect()
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        assert [o for o, _ in sorted(b)] == [sum(n for _, n in sorted(b)[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 512
    bins, offsets = first_fit_decreasing(np.array([6, 5, 5, 4]), 10)
    assert bins.tolist() == [0, 1, 1, 0] and offsets.tolist() == [0, 0, 5, 6]


def test_interactions_are_learned():
    rng = np.random.default_rng(1)
    a, b = rng.random(2000) < 0.5, rng.random(2000) < 0.5
    rows = [np.array([x for x, on in ((11, p), (29, q)) if on], np.int64) for p, q in zip(a, b)]
    model = toxicity.fit(rows, (a & b).astype(float))
    p = toxicity.predict(model, np.repeat(np.arange(2000), [len(r) for r in rows]), np.concatenate(rows), 2000)
    assert ((p >= 0.5) == (a & b)).mean() > 0.99


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    tox = queries.op7_toxicity(spark, sf).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in tox]) > 0.93
    lang = queries.op4_langid(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in lang]) > 0.99


def test_licences(docs):
    got = {r.doc_id: r for r in scan(docs).collect()}
    assert (got[4].n_base, got[4].first_word, got[4].base_labels) == (1, 0, "mit") and got[3].labels == ""


def test_licence_wordings(spark):
    texts = {
        "Code licensed under the MIT license.": "mit", "It is available under the terms of the GNU General Public License version 3.": "gpl",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software": "mit",
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies.": "isc",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, "
        "either version 3": "gpl,lgpl",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3": "agpl,gpl",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "cc-by-sa", "Text licensed under CC BY 4.0, as is": "cc-by",
        "Licensed under CC BY-NC-SA 4.0": "cc-by-nc-sa", "Licensed under CC BY-NC 4.0": "cc-by-nc", "Distributed under the ISC licence": "isc",
        "Redistribution and use in source and binary forms, with or without modification, are permitted": "bsd",
        "subject to the terms of the Mozilla Public License, v. 2.0": "mpl", "Licensed under the Apache License, Version 2.0": "apache",
        "Mozilla Public License is a name, a permission granted is a word, redistribution of wealth": ""}
    got = {r.doc_id: (r.labels, r.doubted) for r in scan(spark.createDataFrame([(t, t) for t in texts], "doc_id string, text string")).collect()}
    assert got == {t: (labels, "gpl" if labels in ("gpl,lgpl", "agpl,gpl") else "") for t, labels in texts.items()}


def test_licence_base_places_against_a_naive_scan(spark):
    word, rng = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), np.random.default_rng(4)
    parts = ["mit", "MIT license", "apache", "Apache-License", "general", "General Public License", "license", "lesser", "é", "x1", ",", "mitlicense", "public license\n"]
    texts = [" ".join(rng.choice(parts, rng.integers(0, 40))) for _ in range(200)] + [None, "", "mit license " * 60, "mit " * 5_000]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    got = {r.doc_id: r for r in scan(spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, labels string")).collect()}
    for i, t in enumerate(texts):
        w = word.findall((t or "").translate(lower))
        places = [(p, label) for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
                  for p in range(len(w)) if w[p:p + len(phrase.split())] == phrase.split()]
        at = [p for p, _ in places]
        assert (got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word) == (len(w), len(at), min(at, default=None), max(at, default=None))
        base = sorted({label for _, label in places})
        assert got[i].base_labels == ",".join(base) and set(base) <= set(got[i].labels.split(",")) and 0 <= got[i].score <= 1


def test_language_model_counts(docs):
    got = backoff_lm.score(docs, F.col("doc_id") == 1).collect()
    counts = Counter()
    for key, text, *_ in ROWS:
        if key not in (1, None):
            counts.update([*(text or "").lower().split(), 0])
    assert {r.train_tokens for r in got} == {sum(counts.values())}
    assert {r.doc_id: r.n_known for r in got}[1] == 8


@pytest.mark.parametrize("options", [{}, {"file_rows": 40, "block_cells": 8}, {"sample_rows": 3, "sample_one_of": 1}])
def test_products(spark, options):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8)).astype("float32") * rng.lognormal(0, 1, (300, 1)).astype("float32")
    x[40:80] = x[40]
    ids = [*range(300), 50, 50, 7, 400, 401]                       # repeated rows of a query and of another id
    x = np.concatenate([x, x[[50, 50, 9]], np.r_[x[3][:5], 0, 0, 0][None], np.zeros((1, 8))]).astype("float32")
    rows = [(i, v.tolist()) for i, v in zip(ids, x)]
    rows[-2] = (400, x[-2][:5].tolist())                           # a shorter vector
    table = spark.createDataFrame([(*r, 1, "a") for r in [*rows, (300, None), (301, [float("nan")] * 8), (302, [None] * 8), (None, [1.0] * 8)]],
                                  "vec_id long, embedding array<float>, row int, score string").repartition(3)
    got = sorted(tuple(r) for r in top_products(table, F.col("vec_id") % 50 == 0, **options).collect())
    w, want = np.floor(256 * x.astype(float)).astype(int), []
    for q in [q for q, i in enumerate(ids) if i % 50 == 0]:
        best = sorted((-int(w[q] @ w[i]), ids[i]) for i in range(len(ids)) if i != q)[:5]
        want += [(ids[q], k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert top_products(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert top_products(table.where("vec_id = 1"), F.col("vec_id") % 50 == 0).count() == 0


def test_archives(spark):
    pages = queries.table(spark, SF, "region").sparkSession.createDataFrame(
        [(1, "http://b.a/x", "p"), (2, "http://b.a/x", "p"), (3, None, None), (4, "z", ""), (None, "z", "q")], "page_id long, url string, html string")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in capture_index(pages, F.lit(5)).collect()}
    assert got == {1: (1, "revisit", 2), 2: (1, "response", None), 3: (0, "revisit", 4), 4: (0, "response", None), None: (1, "response", None)}
    rng = np.random.default_rng(3)
    sizes = {10**13 + i: int(n) for i, n in enumerate([0, 1, 65_535, 65_536, 3_000_000, *rng.integers(0, 90_000, 60)])}
    noisy = spark.createDataFrame([(k, f"http://h{k % 7}.a/{k}", "".join(map(chr, rng.integers(32, 300, n))), 1) for k, n in sizes.items()], "page_id long, url string, html string, capture int")
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    noisy.repartition(2).write.parquet(f"{folder}/pages.parquet")
    got = {r.page_id: r for r in queries.op1_warc_index(spark, folder).collect()}
    for r in noisy.collect():
        body = r.html.encode()
        assert (got[r.page_id].payload_bytes, got[r.page_id].payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
    assert queries.capture_index(noisy.limit(0), F.lit(5)).count() == 0
    runs = [sorted(np.random.default_rng(s).integers(0, 9, s).tolist()) for s in range(9)]
    assert list(merge(runs, lambda v: v)) == sorted(sum(runs, []))


def test_pieces_are_lossless():
    model = Pieces(public_tokenizers.path("piece_bpe_32k.model"), 0.5)
    for text in ["", " ", "a  b", "▁", "é\n\t😀 <0x0A> <s>"]:
        ids = model.sample(text, 7, 1)
        assert model.decode(ids) == text and ids == model.sample(text, 7, 1)
    assert len({tuple(model.sample("reproducible", k, 1)) for k in range(50)}) > 1


def test_parts_of_texts_encode_as_the_tokenizer_does():
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    plain = [chr(c) for c in [*range(32, 127), *range(0xC0, 0x180)]]
    for text in ["", " ", "it's I'LL 'S don''t 12ab3", "é É̀ x́", "\x00\x1c a b\x85c", "<|endoftext|> x<|startoftext|>y",
                 "İK ﬁ中文字 日本", "a\x7fb ~~--'t'\r\n\tx\x0by", *plain, *(f"a{c}B'{c} 1{c}" for c in plain)]:
        ids = np.frombuffer(encode([text], path, 2)[0], "<u4").tolist()
        assert ids == [*whole.encode(text, add_special_tokens=False).ids, 2], text


def test_pieces_are_sampled_by_weight():
    model = Pieces(public_tokenizers.path("piece_bpe_32k.model"), 0.5)

    def ways(rest):
        if not rest:
            yield ()
        for k in range(1, len(rest) + 1):
            if rest[:k] in model.ids:
                yield from ((model.ids[rest[:k]], *more) for more in ways(rest[k:]))

    odds = {w: np.exp(sum(model.weight[i] for i in w)) for w in ways(" thes")}
    got = Counter(tuple(x.tolist()) for x in model.sample_texts(["thes"] * 20_000, list(range(20_000)), 3))
    assert set(got) <= set(odds)
    assert all(abs(got[w] / 20_000 - v / sum(odds.values())) < 0.015 for w, v in odds.items())
