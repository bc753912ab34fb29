"""Near-duplicate classes by DartMinHash.

A document is its set of five-word shingles (its whole word sequence, if shorter). Each shingle throws
hashed darts into the cells of a weight-by-rank plane; the earliest dart of each coordinate is the
signature. Texts that share a band of the signature are candidates and are linked from a similarity of 0.8
on; classes are the connected components of the links. First each is compared with one leader of its bucket.
Buckets that still hold two classes are then split by the members' rarest shingles, of which two texts so similar
share one: texts that only share a frequent passage do not meet. In these groups the members outside the
largest class lead in turn, and meet all members of other classes, until each of them has led: no pair of two
classes that share a band is left out, and pairs within a class are not made. Before a pair is made, sizes and
512 parity bits of the sets give bounds of their difference, and the places of the shingle they share a bound of what
they have in common; a pair so similar meets these bounds in the first bucket it shares. Sets are compared by 32-bit
hashes, which lets a similarity be off by one shingle in about one pair of 10,000 (of 600 shingles each).

Texts of equal words (a 64-bit hash of them) are one node from the start. Null texts and texts without words stay alone. Repeated
rows and rows with a null id get a class like all others; ``class_id`` is the smallest id of the class,
null if it has none. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.llm.words import Texts, chunks, mix, ngrams
from tablewarden.session import cut_lineage

SHINGLE = 5
PARITIES = 512
POISSON = np.cumsum([np.exp(-1) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320, 362880)])


def shingles(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, shingle hash) sorted by both, and how often each occurs."""
    h = texts.hashes()
    at, grams = ngrams(h, texts.doc, SHINGLE)
    doc = texts.doc[at]
    sizes = np.diff(texts.bounds)
    for d in np.flatnonzero((sizes > 0) & (sizes < SHINGLE)):
        own = h[texts.bounds[d]:texts.bounds[d + 1]]
        grams, doc = np.append(grams, mix(np.array([hash(tuple(own.tolist())) & (2**64 - 1)], np.uint64))), np.append(doc, d)
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    new = np.append(True, (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1]))[:len(grams)]
    firsts = np.flatnonzero(new)
    return doc[firsts], grams[firsts], np.diff(np.append(firsts, len(grams)))


def signature(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, k: int) -> np.ndarray:
    """DartMinHash: docs x k, the dart of least rank for each coordinate (0 if none fell there)."""
    total = np.bincount(doc, weight, docs)
    limit = (k * np.log(k) + 2 * k) / np.maximum(total, 1e-300)
    theta = limit[doc]
    darts = []
    for nu in range(int(np.log2(1 + weight.max(initial=0))) + 1):
        for rho in range(int(np.log2(1 + theta.max(initial=0))) + 1):
            width, height = 2.0 ** (nu - rho), 2.0 ** (rho - nu)
            rows = np.flatnonzero((weight > 2 ** nu - 1) & (theta > 2 ** rho - 1))
            for a in range(1 << rho):
                held = rows[weight[rows] > 2 ** nu - 1 + a * width]
                for b in range(1 << nu):
                    own = held[theta[held] > 2 ** rho - 1 + b * height]
                    cell = mix(element[own] + np.uint64(((nu * 64 + rho) << 40) + (a << 20) + b))
                    u = (cell >> np.uint64(11)) * 2.0 ** -53
                    thrown = np.searchsorted(POISSON, u, "right")
                    for d in range(int(thrown.max(initial=0))):
                        hit = thrown > d
                        dart = mix(cell[hit] + np.uint64(d + 1))
                        rank = 2 ** rho - 1 + (b + (dart >> np.uint64(11)) * 2.0 ** -53) * height
                        place = 2 ** nu - 1 + (a + (mix(dart) >> np.uint64(11)) * 2.0 ** -53) * width
                        who = own[hit]
                        fits = (rank < theta[who]) & (place < weight[who])
                        darts.append((doc[who[fits]], dart[fits], rank[fits]))
    out = np.zeros((docs, k), np.uint64)
    if darts:
        d, dart, rank = (np.concatenate(x) for x in zip(*darts))
        # written from the latest to the earliest: the earliest stays
        order = np.argsort(-rank, kind="stable")
        d, dart = d[order], dart[order]
        out[d, (mix(dart + np.uint64(99)) % np.uint64(k)).astype(np.int64)] = dart
    return out


def bands(column: pa.Array, count: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes, documents x count, and the number of shingles of each document."""
    texts = Texts(column)
    doc, element, _ = shingles(texts)
    sig = signature(doc, element, np.ones(len(doc)), texts.docs, count * rows).reshape(texts.docs, count, rows)
    h = np.broadcast_to(np.arange(count, dtype=np.uint64), (texts.docs, count)).copy()
    for r in range(rows):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, r])
    return h, np.bincount(doc, minlength=texts.docs)


def components(links: DataFrame) -> DataFrame:
    """``key``, ``comp``: for each end of a link ``a``, ``b`` the least key reachable. Labels jump, so rounds are logarithmic in practice."""
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a")))
    label = cut_lineage(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("key"), F.least("a", "b").alias("comp")))
    while True:
        near = both.join(label, both.b == label.key).groupBy("a").agg(F.min("comp").alias("seen"))
        step = label.join(near, label.key == near.a, "left").select("key", "comp", F.least("comp", "seen").alias("low"))
        up = step.select(F.col("key").alias("k2"), F.col("low").alias("jump"))
        step = cut_lineage(step.join(up, step.low == up.k2, "left").select("key", "comp", F.least("low", "jump").alias("next")))
        label = step.select("key", F.col("next").alias("comp"))
        if step.where("next != comp").isEmpty():
            return label


def rare_shingles(content: DataFrame, similarity: float, bins: int = 1 << 18) -> DataFrame:
    """``bucket``, ``key``, ``place``: of each set the rarest shingles, as many as two sets so similar cannot both miss.

    ``place`` counts from the rarest, in an order that is the same for all sets. Rarity is counted over all sets given, by hash bin: the table of counts has a fixed size.
    """
    counted = content.select(F.explode("s").alias("e")).groupBy(F.pmod("e", F.lit(bins)).alias("bin")).count().collect()  # at most ``bins`` rows
    counts = np.zeros(bins, np.int64)
    counts[[r[0] for r in counted]] = [r[1] for r in counted]
    held = content.sparkSession.sparkContext.broadcast(counts)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("s")
            sizes = np.diff(column.offsets.to_numpy())
            element = column.flatten().to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((element, held.value[element % bins], doc))
            wanted = sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1
            rank = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            early = rank < wanted[doc]
            kept = order[early]
            yield pa.RecordBatch.from_arrays([pa.array(element[kept]), batch.column("key").take(pa.array(doc[kept])), pa.array(rank[early])], names=["bucket", "key", "place"])

    return content.mapInArrow(first, "bucket long, key long, place long")


def unsettled(member: DataFrame, label: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members with their classes, and the largest class of each bucket that has two or more."""
    held = member.join(label, "key")
    sizes = held.groupBy("bucket", "comp").count()
    main = sizes.groupBy("bucket").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"), F.count("*").alias("classes"))
    return held, main.where("classes > 1").drop("classes")


def linked(pairs: DataFrame, content: DataFrame, label: DataFrame, similarity: float) -> DataFrame:
    """``a``, ``b``: classes that a pair of sets so similar links."""
    checked = pairs.join(content.toDF("a", "sa"), "a").join(content.toDF("b", "sb"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    good = checked.where(common >= F.lit(similarity) * (F.size("sa") + F.size("sb") - common)).select("a", "b")
    of = label.select("key", "comp")
    good = good.join(of.toDF("a", "ca"), "a").join(of.toDF("b", "cb"), "b").where("ca != cb")
    return cut_lineage(good.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())


def joined(label: DataFrame, links: DataFrame) -> DataFrame:
    """``label`` with linked classes made one."""
    if links.isEmpty():
        return label
    whole = components(links).toDF("comp", "whole")
    return cut_lineage(label.join(whole, "comp", "left").select("key", F.coalesce("whole", "comp").alias("comp"), "n", "f"))


def text_key(text: Column) -> Column:
    """A 64-bit hash of the text's words."""
    return F.xxhash64(F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")), "^ | $", ""))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", similarity: float = 0.8,
                    band_count: int = 28, band_rows: int = 5, keys: bool = False) -> DataFrame:
    """One row per document: id, ``class_id``, ``n_shingles``.

    With ``keys`` also ``text_key`` and ``class_key``, which tell texts and classes apart whatever the ids are.
    """
    text = F.col(f"`{text_column}`")
    base = docs.select(F.col(f"`{id_column}`").alias("id"), text_key(text).alias("key"), text.alias("t"))
    kind = base.schema["id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "t"):
            h, n = bands(batch.column("t"), band_count, band_rows)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, h.size + 1, band_count), pa.int32()), pa.array(h.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array(n, pa.int64()), flat], names=["id", "key", "n_shingles", "h"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "t"):
            doc, element, _ = shingles(Texts(batch.column("t")))
            short = np.unique((doc.astype(np.uint64) << np.uint64(32)) + (element >> np.uint64(32)))
            cuts = np.searchsorted(short >> np.uint64(32), np.arange(batch.num_rows + 1))
            # parity of each hash bit: sets of difference d differ in d bits or fewer
            odd = np.bincount((short >> np.uint64(32)).astype(np.int64) * PARITIES + (short % np.uint64(PARITIES)).astype(np.int64), minlength=batch.num_rows * PARITIES) & 1
            marks = np.packbits(odd.astype(np.uint8)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(short.astype(np.uint32).view(np.int32))),
                                              pa.ListArray.from_arrays(pa.array(np.arange(0, len(marks) + 1, PARITIES // 64), pa.int32()), pa.array(marks))], names=["key", "s", "f"])

    signed = cut_lineage(base.mapInArrow(sign, f"id {kind}, key long, n_shingles long, h array<bigint>"))
    nodes = signed.where("n_shingles > 0").groupBy("key").agg(F.first("h").alias("h"))
    member = cut_lineage(nodes.select("key", F.explode("h").alias("bucket")))
    shared = member.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    member = cut_lineage(member.join(shared, "bucket"))
    wanted = cut_lineage(member.select("key").distinct())
    some = base.join(wanted, "key", "left_semi").dropDuplicates(["key"])
    content = cut_lineage(some.mapInArrow(sets, "key long, s array<int>, f array<bigint>"))
    label = cut_lineage(content.select("key", F.col("key").alias("comp"), F.size("s").alias("n"), "f"))
    content = content.select("key", "s")
    met = member.groupBy("bucket").agg(F.min_by("key", F.xxhash64("key")).alias("b"))
    pairs = member.join(met, "bucket").where("key != b").select(F.least("key", "b").alias("a"), F.greatest("key", "b").alias("b"))
    tried = cut_lineage(pairs.distinct())
    label = joined(label, linked(tried, content, label, similarity))
    held, open_ = unsettled(member, label)
    left = held.join(open_, "bucket").select("key").distinct()
    member = cut_lineage(rare_shingles(cut_lineage(content.join(left, "key", "left_semi")), similarity))
    shared = member.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    member = cut_lineage(member.join(shared, "bucket"))
    led, width = None, 1
    while True:
        held, open_ = unsettled(member, label)
        held = cut_lineage(held.join(open_, "bucket"))
        outside = held.where("comp != main")
        if led is not None:
            outside = outside.join(led, ["bucket", "key"], "left_anti")
        width *= 32
        turn = F.xxhash64("key", F.lit(width))
        met = outside.groupBy("bucket", F.pmod(turn, F.lit(width)).alias("part")).agg(F.min_by(F.struct(F.col("key").alias("b"), F.col("comp").alias("cb"), F.col("n").alias("nb"), F.col("f").alias("fb"), F.col("place").alias("pb")), turn).alias("x"))
        met = cut_lineage(met.select("bucket", "x.*"))
        if met.isEmpty():
            break
        leads = met.select("bucket", F.col("b").alias("key"))
        led = leads if led is None else led.union(leads)
        # sets whose sizes or parities differ by more cannot be that similar
        apart = sum(F.bit_count(F.col("f")[k].bitwiseXOR(F.col("fb")[k])) for k in range(PARITIES // 64))
        # in the first bucket that two sets share, what they have in common lies from their places there on
        common = F.least(F.col("n") - F.col("place"), F.col("nb") - F.col("pb"))
        near = common >= (F.col("n") + F.col("nb")) * (similarity / (1 + similarity)) - 1e-9
        alike = near & (F.least("n", "nb") >= F.lit(similarity) * F.greatest("n", "nb")) & (apart <= (F.col("n") + F.col("nb")) * ((1 - similarity) / (1 + similarity)) + 1e-9)
        pairs = held.join(met, "bucket").where("comp != cb").where(alike).select(F.least("key", "b").alias("a"), F.greatest("key", "b").alias("b"))
        pairs = cut_lineage(pairs.distinct().join(tried, ["a", "b"], "left_anti"))
        tried = tried.union(pairs)
        label = joined(label, linked(pairs, content, label, similarity))
    thin = signed.select("id", "n_shingles", "key").join(label, "key", "left")
    # texts without words stay alone: each is a class of its own id
    thin = thin.withColumn("comp", F.coalesce("comp", "key"))
    classes = thin.where("n_shingles > 0").groupBy("comp").agg(F.min("id").alias("class_id"))
    return (thin.join(classes, "comp", "left")
            .select(F.col("id").alias(id_column), F.when(F.col("n_shingles") > 0, F.col("class_id")).otherwise(F.col("id")).alias("class_id"), "n_shingles",
                    *([F.col("key").alias("text_key"), F.col("comp").alias("class_key")] if keys else [])))
