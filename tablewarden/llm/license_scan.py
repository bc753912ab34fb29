"""Licence notices by a positional index of rare words, with DataFrame functions only.

Each label has several templates: short notices, and openings and conditions of the licences themselves. A template's
rare words (once in it, outside its mandatory phrase, in two thirds of the templates at most) have positions; a word's weight is its inverse frequency over the
templates. Words of a text that are in the index are looked up, and each hit at text position p and template position q
votes for a notice that starts at p - q. The template's mandatory phrase fixes the start; votes up to an eighth of the
template (three words at least) off count too, so words may be put in or left out. The phrase scores a half, the votes'
share of the weight the other half. A label is given if one of its templates scores ``least``. "licence" is read as "license".

Null and empty texts: no words, no labels, score 0. Repeated rows each get their own result. Other columns are
not read; of an empty table the result is empty.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GNU = {"gpl": "gnu general public license", "lgpl": "gnu lesser general public license", "agpl": "gnu affero general public license"}
CC = {"cc-by": "", "cc-by-sa": "sharealike", "cc-by-nd": "noderivatives", "cc-by-nc": "noncommercial",
      "cc-by-nc-sa": "noncommercial sharealike", "cc-by-nc-nd": "noncommercial noderivatives"}
# Words that make another licence of a phrase they follow.
CC_MORE = {"nc", "sa", "nd", "noncommercial", "sharealike", "noderivatives", "noderivs", "non", "share", "no"}
NAMED = {"apache": ["apache license"], "mit": ["mit license"], "bsd": ["bsd license", "bsd 2 clause license", "bsd 3 clause license"],
         "isc": ["isc license"], "mpl": ["mozilla public license"], **{k: [v] for k, v in GNU.items()}}

# Label, mandatory phrase, notice.
TEMPLATES = [
    *((label, name, f"{start} {name}") for label, names in NAMED.items() for name in names
      for start in ("licensed under the", "released under the", "distributed under the", "available under the", "subject to the terms of the",
                    "licensed under the terms of the")),
    *((label, label.replace("-", " "), f"licensed under {label.replace('-', ' ')}") for label in CC),
    *((label, f"creative commons attribution {kind}".strip(), f"licensed under a creative commons attribution {kind} international license") for label, kind in CC.items()),
    ("apache", "apache license", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "apache license", "apache license version 2 0 january 2004 http www apache org licenses terms and conditions for use reproduction and distribution"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy",
     "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
     "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("isc", "software for any purpose with or without fee is hereby granted",
     "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", "redistribution and use in source and binary forms",
     "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl", "mozilla public license", "mozilla public license version 2 0 1 definitions 1 1 contributor means each individual or legal entity that creates"),
    *((label, name, f"you can redistribute it and or modify it under the terms of the {name} as published by the free software foundation either version") for label, name in GNU.items()),
    *((label, name, f"{name} version copyright c free software foundation inc everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed")
      for label, name in GNU.items()),
]
# Every mandatory phrase holds one of these; other texts need no look at their words.
GATE = "(?i)licen[sc]e|redistribution|cc|creative|granted"
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _anchor(notice: str, phrase: str) -> tuple[int, int]:
    """Place and length of the mandatory phrase in its template."""
    words, key = notice.split(), phrase.split()
    return next(i for i in range(len(words)) if words[i:i + len(key)] == key), len(key)


def _postings() -> tuple[dict[str, list[tuple[int, int]]], dict[str, float], list[float]]:
    notices = [text.split() for _, _, text in TEMPLATES]
    held = [set(range(at, at + n)) for at, n in (_anchor(text, phrase) for _, phrase, text in TEMPLATES)]
    common = {w: sum(w in words for words in notices) for words in notices for w in words}
    postings: dict[str, list[tuple[int, int]]] = {}
    for t, words in enumerate(notices):
        for q, w in enumerate(words):
            if q not in held[t] and words.count(w) == 1 and 3 * common[w] <= 2 * len(notices):
                postings.setdefault(w, []).append((t, q))
    weight = {w: math.log(1 + len(TEMPLATES) / len(p)) for w, p in postings.items()}
    return postings, weight, [sum(weight[w] for w, p in postings.items() for own, _ in p if own == t) for t in range(len(notices))]


def _stands(words: Column, at: Column, phrase: str) -> Column:
    return F.array_join(F.slice(words, at + 1, len(phrase.split())), " ") == phrase


def _places(phrase: str, words: Column) -> Column:
    """Positions at which the phrase stands."""
    head = phrase.split()[0]
    return F.transform(F.filter("hits", lambda x: (x.w == head) & _stands(words, x.p, phrase)), lambda x: x.p)


def _constant(value: list | dict, kind: str) -> Column:
    """A table as one literal; one expression over it keeps the plan short however many templates there are."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _anchors(phrase: Column) -> Column:
    """Positions at which a mandatory phrase stands and no further word makes it another licence's name."""
    def stands(x: Column) -> Column:
        more = phrase.cc & F.coalesce(F.try_element_at("u", x.p + phrase.n + 1).isin(sorted(CC_MORE)), F.lit(False))
        return (x.w == phrase.head) & (F.array_join(F.slice(F.col("u"), x.p + 1, phrase.n), " ") == phrase.text) & ~more

    return F.transform(F.filter("hits", stands), lambda x: x.p)


def _score(template: Column) -> Column:
    """Half for the phrase, half for the share of the weight among the votes near the start that its place fixes; the largest."""
    def share(start: Column) -> Column:
        own = F.filter("votes", lambda y: (y.t == template.t) & (F.abs(y.s - start) <= template.slack))
        once = F.array_distinct(F.transform(own, lambda y: F.struct(y.q.alias("q"), y.v.alias("v"))))
        return F.aggregate(once, F.lit(0.0), lambda acc, y: acc + y.v) / template.total

    places = F.element_at("anchors", template.phrase + 1)
    return F.least(F.lit(1.0), F.coalesce(F.array_max(F.transform(places, lambda p: (1 + share(p - template.back)) / 2)), F.lit(0.0)))


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: float = 0.8) -> DataFrame:
    """Per row: id, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score``,
    ``doubted`` (a base label all of whose places belong to another licence's name; it stays in ``labels``)."""
    postings, weight, totals = _postings()
    postings_of = {w: [{"t": t, "q": q, "v": weight[w]} for t, q in p] for w, p in sorted(postings.items())}
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), F.regexp_count(text, F.lit(RAW_WORD)).cast("long").alias("n_words"),
                       F.when(text.rlike(GATE), text).alias("t"))
    lower = F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = rows.withColumn("w", F.when(F.col("t").isNotNull(), F.regexp_extract_all(lower, F.lit(WORD), F.lit(0)))).drop("t")
    index = _constant(postings_of, "map<string,array<struct<t:int,q:int,v:double>>>")
    rows = rows.withColumn("u", F.transform("w", lambda w: F.when(w == "licence", "license").when(w == "licenced", "licensed").otherwise(w)))
    phrases = sorted({phrase for _, phrase, _ in TEMPLATES})
    heads = {p.split()[0] for p in [*phrases, *(p for p, _ in PHRASES)]}
    empty = F.array().cast("array<struct<p:int,w:string>>")
    hits = F.filter(F.transform("u", lambda w, p: F.struct(p.alias("p"), w.alias("w"))), lambda x: x.w.isin(sorted(heads | set(postings))))
    rows = rows.withColumn("hits", F.coalesce(hits, empty))
    # places of the base phrases and of the mandatory ones, from the positions of their first words
    kinds = "array<struct<text:string,head:string,n:int,cc:boolean>>"
    named = _constant([{"text": p, "head": p.split()[0], "n": len(p.split()), "cc": p.startswith(("cc by", "creative commons"))} for p in phrases], kinds)
    rows = rows.withColumns({f"b{k}": _places(phrase, F.col("w")) for k, (phrase, _) in enumerate(PHRASES)} | {"anchors": F.transform(named, _anchors)})
    none = F.array().cast("array<struct<t:int,q:int,s:int,v:double>>")
    votes = F.flatten(F.transform("hits", lambda x: F.coalesce(F.transform(index[x.w], lambda y: F.struct(
        y.t.alias("t"), y.q.alias("q"), (x.p - y.q).alias("s"), y.v.alias("v"))), none)))
    # texts without any mandatory phrase have no votes to count
    rows = rows.withColumn("votes", F.when(F.exists("anchors", lambda m: F.size(m) > 0), votes).otherwise(none))
    templates = _constant([{"t": t, "label": label, "phrase": phrases.index(phrase), "back": _anchor(notice, phrase)[0],
                            "slack": max(3, len(notice.split()) // 8), "total": totals[t]} for t, (label, phrase, notice) in enumerate(TEMPLATES)],
                          "array<struct<t:int,label:string,phrase:int,back:int,slack:int,total:double>>")
    rows = rows.withColumn("scores", F.transform(templates, lambda x: F.struct(x.label.alias("label"), _score(x).alias("score"))))
    places = F.concat(*(f"b{k}" for k in range(len(PHRASES))))
    base = F.array_compact(F.array(*(F.when(F.size(f"b{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(PHRASES))))
    # "general public license" after one of these words is another licence than the GPL
    plain = F.exists("b2", lambda p: (p == 0) | ~F.coalesce(F.try_element_at("w", p).isin("lesser", "affero", "library"), F.lit(False)))
    doubted = F.when(F.array_contains(base, "gpl") & ~plain, F.lit("gpl")).otherwise(F.lit(""))
    own = F.transform(F.filter("scores", lambda x: x.score >= least), lambda x: x.label)
    return rows.select(
        F.col("id").alias(id_column), "n_words", F.size(places).cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"), F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, own)), ",").alias("labels"),
        F.array_max(F.transform("scores", lambda x: x.score)).alias("score"), doubted.alias("doubted"))
