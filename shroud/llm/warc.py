"""WARC archives, index first (6).

``write_archives`` writes one gzip member per record into shard files in the
shared folder and returns the index: file, offset, length, URL and digest of
every record.  ``read_records`` takes any selection of the index, sorts it by
place and reads neighbouring records in one byte range each; only those ranges
are read.  Files are reached through ``pyarrow.fs`` by URI, so any store that it
knows (local, HDFS, S3, GCS) works; Spark itself only moves index rows.

Payloads are the UTF-8 bytes of the html (null: empty).  Of records with equal
payloads of at least ``min_revisit`` bytes the one with the smallest id is a
response, the others revisit it: their block keeps the HTTP headers, so the
payload's length and digest stay known.  Rows that repeat the smallest id are
responses too; rows with null id revisit a response with an id, and are responses
where there is none.  Null URLs are written as ``urn:page:<id>``.  An empty table
gives no file and no row.

A retried task writes a new file; the index names only files of tasks that ended
well, because its rows are committed by Spark.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shroud.llm.common import Scratch, project, read_table, text_bytes

VERSION = b"WARC/1.1\r\n"
DATE = b"2024-01-01T00:00:00Z"  # the pages carry no time; a constant keeps reruns equal
INDEX = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, file string, offset long, length long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, digest_ok boolean"


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if urlsplit(uri).scheme else f"file://{uri}")


def _clean(value: str) -> bytes:
    """A header value on one line."""
    return " ".join(value.split()).encode("utf-8", "surrogatepass")


def record_bytes(page_id: int | None, url: str, payload: bytes, digest: str, revisit: int | None, is_revisit: bool) -> bytes:
    """One record, as a gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if is_revisit else http + payload
    head = [
        b"WARC-Type: " + (b"revisit" if is_revisit else b"response"),
        b"WARC-Record-ID: <urn:uuid:%b>" % str(uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}")).encode(),
        b"WARC-Date: " + DATE,
        b"WARC-Target-URI: " + _clean(url),
        b"WARC-Payload-Digest: sha256:" + digest.encode(),
        b"X-Page-Id: " + str("" if page_id is None else page_id).encode(),
    ]
    if is_revisit:
        head += [
            b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            b"WARC-Refers-To: <urn:uuid:%b>" % str(uuid.uuid5(uuid.NAMESPACE_URL, f"page:{revisit}")).encode(),
            b"X-Refers-To-Page-Id: " + str(revisit).encode(),
        ]
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    raw = VERSION + b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def parse_record(member: bytes) -> dict:
    """Headers and payload of one gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if lines[0] + b"\r\n" != VERSION:
        raise ValueError("not a WARC record")
    fields = {}
    for line in lines[1:]:
        k, _, v = line.decode("utf-8", "surrogatepass").partition(":")
        fields[k.strip().lower()] = v.strip()
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    sent = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")[1:])}
    number = lambda x: int(x) if x else None
    return {
        "page_id": number(fields["x-page-id"]), "url": fields["warc-target-uri"], "record_type": fields["warc-type"],
        "refers_to": number(fields.get("x-refers-to-page-id")), "payload_bytes": int(sent[b"content-length"]),
        "payload_digest": fields["warc-payload-digest"].removeprefix("sha256:"), "payload": payload,
    }


def classify(pages: DataFrame, scratch: Scratch, min_revisit: int = 100) -> DataFrame:
    """page_id, url, payload, digest and refers_to (null: a response); only ids, lengths and digests are grouped."""
    payload = text_bytes("html")
    rows = project(pages, page_id="page_id", url="url", html="html").select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    first = rows.where(F.length("payload") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    # only digests that occur again are joined back: one row per repeated payload
    first = scratch.write(first.where("n > 1 and first is not null").select("digest", "first"), "repeated")
    rows = rows.join(first, "digest", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return rows.select("page_id", F.coalesce("url", F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))).alias("url"), "payload", "digest", refers.alias("refers_to"))


def write_archives(classified: DataFrame, folder: str, shard_bytes: int = 1 << 28) -> DataFrame:
    """Write the records and return the index rows (evaluate once: each evaluation writes files)."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _open(folder)
        store.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        try:
            for pdf in batches:
                rows = []
                for page_id, url, payload, digest, refers in zip(pdf["page_id"].astype("Int64"), pdf["url"], pdf["payload"], pdf["digest"], pdf["refers_to"].astype("Int64")):
                    page_id, refers = (None if x is pd.NA else int(x) for x in (page_id, refers))
                    if out is None or at >= shard_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)  # members are gzip already
                    member = record_bytes(page_id, url, payload, digest, refers, refers is not None)
                    out.write(member)
                    kind = "response" if refers is None else "revisit"
                    rows.append((page_id, url, kind, refers, len(payload), digest, f"{folder}/{name}", at, len(member)))
                    at += len(member)
                frame = pd.DataFrame(rows, columns=[c.split()[0] for c in INDEX.split(", ")])
                yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})
        finally:
            if out is not None:
                out.close()

    return classified.mapInPandas(write, INDEX)


def read_records(index: DataFrame, gap: int = 1 << 16, range_bytes: int = 1 << 23) -> DataFrame:
    """The selected records: sorted by place, neighbours read in one range of at most about ``range_bytes``."""

    def fetch(run: list[tuple[str, int, int]]) -> Iterator[dict]:
        uri, begin, _ = run[0]
        store, path = _open(uri)
        end = max(o + n for _, o, n in run)
        with store.open_input_file(path) as f:
            data = f.read_at(end - begin, begin)
        for _, offset, length in run:
            got = parse_record(data[offset - begin : offset - begin + length])
            payload = got.pop("payload")
            got["digest_ok"] = True
            if got["record_type"] == "response":
                got["digest_ok"] = hashlib.sha256(payload).hexdigest() == got["payload_digest"] and len(payload) == got["payload_bytes"]
            yield got

    def frame(rows: list[dict]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD.split(", ")]).astype({"page_id": "Int64", "refers_to": "Int64"})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run: list[tuple[str, int, int]] = []
        for pdf in batches:
            for file, offset, length in zip(pdf["file"], pdf["offset"].tolist(), pdf["length"].tolist()):
                last = run[-1] if run else None
                if last and (last[0] != file or offset > last[1] + last[2] + gap or offset + length - run[0][1] > range_bytes):
                    yield frame(list(fetch(run)))
                    run = []
                run.append((file, offset, length))
        if run:
            yield frame(list(fetch(run)))

    places = index.select("file", "offset", "length")
    # a stretch of a file is one unit of work: large files are read by many tasks
    stretch = (F.col("offset") / range_bytes).cast("long")
    # as many tasks as the archives have ranges: adaptive execution would merge them by the size of the index
    total = index.agg(F.sum("length")).first()[0] or 0
    places = places.repartition(1 + total // range_bytes, "file", stretch).sortWithinPartitions("file", "offset")
    return places.mapInPandas(read, RECORD)


def op6_warc(spark, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    classified = classify(read_table(spark, sf_dir, "pages"), scratch)
    index = scratch.write(write_archives(classified, scratch.path("archives")), "index")
    got = read_records(index)
    checked = F.when(F.col("digest_ok"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("payload differs from its digest")))
    return got.select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to")


#: DuckDB SQL for the rows of ``op6_warc``
OP6_SQL = """
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND page_id > least_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id > least_id THEN least_id END AS refers_to
FROM (SELECT *, min(page_id) OVER (PARTITION BY d) AS least_id
      FROM (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n, sha256(coalesce(html, '')) AS d FROM pages))
"""
