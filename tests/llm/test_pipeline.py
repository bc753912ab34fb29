"""The pipeline as a whole on a small corpus with null and repeated ids."""

import tempfile
import zlib

import public_tokenizers

import corpus_pipeline
from tablewarden.llm.packing import encode


def words(tag, changed=()):
    return " ".join(f"x{tag}{i}" if i in changed else f"{tag}{i}" for i in range(60))


def alike(a, b):
    a, b = ({tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(a & b) >= 0.8 * len(a | b)


def test_every_class_keeps_one_document_whatever_the_ids(spark):
    rows = [(None, words("a")), (None, words("b")), (None, words("c")),          # three texts without an id
            (7, words("d")), (7, words("e", {59})), (3, words("e")),              # one text of id 7 is a copy of another class
            (8, words("f")), (8, words("g")), (8, words("f")),                    # two classes of equal id, and a repeated row
            (None, words("h")), (9, words("h", {0})),                             # the copy with an id stays
            (None, words("i")), (None, words("i", {0})), (None, words("i", {59})),
            (5, words("j")), (5, words("j", {0})), (4, words("d", {0}))]
    sf = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(3, 0)], "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if alike(rows[a][1], rows[b][1]):
                group = [group[b] if g == group[a] else g for g in group]
    print_of = {zlib.crc32(encode([t], public_tokenizers.path("word_bpe_49k.json"), 2)[0]): t for _, t in rows}
    got = [(r.doc_id, print_of[r.ids_crc32]) for r in corpus_pipeline.run(spark, sf).collect()]
    assert set(got) <= set(rows)
    class_of = dict(zip((t for _, t in rows), group))
    assert sorted(class_of[t] for _, t in got) == sorted(set(group))
    least = {g: min((k for (k, _), h in zip(rows, group) if h == g and k is not None), default=None) for g in group}
    assert all(k == least[class_of[t]] for k, t in got)


def test_texts_without_words(spark):
    rows = [(None, None), (None, " "), (1, None), (1, ""), (2, "\n")]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(str(r.doc_id) for r in corpus_pipeline.distinct(spark, docs, "").collect()) == ["1", "2", "None", "None"]
