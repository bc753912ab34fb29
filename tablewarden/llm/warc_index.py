"""WARC archives with revisit records, and a globally ordered index of them by external merge.

Of records with equal payloads the one of the largest id is the response, the others revisit it. Tasks write
gzip-member archives to the shared folder; their names carry a fresh token, so that a repeated attempt never
touches another's file, and only the archives that committed tasks report are read. Each archive gives one run
of index lines, sorted by URL key and time. The runs are range-partitioned on the whole key (a hot URL spans
ranges) and each range merges its runs with a loser tree.

Null payloads are empty. Rows of equal payload and the same largest id are all responses; a null id never is
another's response. A null URL has an empty key. Other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.session import cut_lineage, fresh_path

ARCHIVE_BYTES = 8 << 20
PIECE = 1 << 16
ENTRY = "url_key string, capture long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, capture: int, payload: bytes, refers_to) -> bytes:
    """One gzip member. A revisit has no payload; its header keeps the payload's digest and size."""
    http = HTTP % len(payload)
    block = http if refers_to is not None else http + payload
    when = pd.Timestamp(capture, unit="s").strftime("%Y-%m-%dT%H:%M:%SZ")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
            f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}", f"WARC-Date: {when}", f"WARC-Payload-Digest: sha1:{digest(payload)}",
            f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        head.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def url_key(url: str) -> str:
    """Host labels reversed, then path and query, in lower case."""
    try:
        parts = urlsplit(url.lower())
    except ValueError:
        return url.lower()
    query = f"?{parts.query}" if parts.query else ""
    return ",".join(reversed(parts.netloc.split("."))) + ")" + (parts.path or "/") + query


def parse(data: bytes, archive: str) -> Iterator[tuple]:
    """Index lines of an archive; a payload that does not have its digest is an error."""
    import zlib
    at = 0
    while at < len(data):
        member, parts, end = zlib.decompressobj(31), [], at
        while not member.eof:  # in pieces: what is left over after a record is copied
            if end >= len(data):
                raise ValueError(f"{archive} ends inside the record at {at}")
            parts.append(member.decompress(data[end:end + PIECE]))
            end += PIECE
        raw = b"".join(parts)
        head, _, body = raw.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        block = body[:int(fields["Content-Length"])]
        payload = block.partition(b"\r\n\r\n")[2]
        kind, said = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if kind == "response" and digest(payload) != said:
            raise ValueError(f"payload of {fields['WARC-Record-ID']} in {archive} does not match its digest")
        number = lambda s: int(s[10:-1]) if len(s) > 11 else None
        yield (url_key(fields["WARC-Target-URI"]), int(pd.Timestamp(fields["WARC-Date"]).timestamp()), number(fields["WARC-Record-ID"]),
               int(fields["X-Payload-Length"]), said, kind, number(fields["WARC-Refers-To"]) if kind == "revisit" else None, archive, at)
        at = min(end, len(data)) - len(member.unused_data)


def merge(runs: list[list], key) -> Iterator:
    """k-way merge by a loser tree: inner nodes hold the loser of their match, the winner is replayed to the root."""
    k = len(runs)
    if not k:
        return
    place = [0] * k
    heads = [(0, key(r[0])) if r else (1,) for r in runs]
    tree = [-1] * k  # tree[0]: the winner

    def play(leaf: int) -> None:
        winner, node = leaf, (leaf + k) // 2
        while node:
            if tree[node] < 0:
                tree[node] = winner
                return
            if heads[tree[node]] < heads[winner]:
                tree[node], winner = winner, tree[node]
            node //= 2
        tree[0] = winner

    for leaf in range(k):
        play(leaf)
    while len(heads[tree[0]]) == 2:
        w = tree[0]
        yield runs[w][place[w]]
        place[w] += 1
        heads[w] = (0, key(runs[w][place[w]])) if place[w] < len(runs[w]) else (1,)
        play(w)


def order_of(row: tuple) -> tuple:
    return row[0], row[1], row[7], row[8]


def capture_index(pages: DataFrame, capture: Column, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html",
                  range_rows: int = 50_000) -> DataFrame:
    """Archives of ``pages``, then their index in order of URL key and ``capture`` (seconds), one row per record."""
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    body = F.coalesce(F.col(f"`{payload_column}`"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{url_column}`").alias("url"), capture.cast("long").alias("at"), body.alias("body"), F.sha1(body).alias("digest"))
    repeated = rows.groupBy("digest").agg(F.count("*").alias("n"), F.max("id").alias("kept")).where("n > 1 and kept is not null").select("digest", "kept")
    decided = rows.join(cut_lineage(repeated).hint("shuffle_hash"), "digest", "left").select("id", "url", "at", "body", F.when(~F.col("id").eqNullSafe(F.col("kept")), F.col("kept")).alias("of"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        store, path = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        store.create_dir(path, recursive=True)
        held: list[bytes] = []

        def flush() -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.warc.gz"
            with store.open_output_stream(f"{path}/{name}", compression=None) as out:
                out.write(b"".join(held))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([name])], names=["archive"])

        size = 0
        for batch in batches:
            for k in range(batch.num_rows):
                held.append(record(*(batch.column(c)[k].as_py() for c in ("id", "url", "at", "body", "of"))))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    size = 0
                    yield flush()
        if held:
            yield flush()

    archives = cut_lineage(decided.mapInArrow(write, "archive string"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        store, path = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                with store.open_input_stream(f"{path}/{name}", compression=None) as source:
                    run = sorted(parse(source.read(), name), key=order_of)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*run), kinds)], names=names)

    names = [c.split()[0] for c in ENTRY.split(", ")]
    kinds = [pa.string() if c.endswith("string") else pa.int64() for c in ENTRY.split(", ")]
    # a given number of parts stays; without one, a list of names is so small that it would be read in one task
    runs = cut_lineage(archives.repartition(max(1, -(-archives.count() // 4)), "archive").mapInArrow(read, ENTRY))
    ranges = max(1, -(-runs.count() // range_rows))
    # the sort only brings a range's slice of each run together, in the run's own order
    slices = runs.repartitionByRange(ranges, "url_key", "capture", "archive", "offset").sortWithinPartitions("archive", "url_key", "capture", "offset")

    def join_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[str, list[tuple]] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                parts.setdefault(row[7], []).append(row)
        merged = list(merge(list(parts.values()), order_of))
        if merged:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*merged), kinds)], names=names)

    return slices.mapInArrow(join_runs, ENTRY).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "capture", "archive", "offset")
