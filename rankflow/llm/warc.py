"""WARC archives: one gzip member per record, written by Spark tasks and read sequentially.

Records with equal payloads are stored once: the record with the largest page id is
the response, the others are revisits that refer to it. Equality is that of the
SHA-1 digests. Null html counts as an empty payload. Repeated rows with one page id
share a payload digest and so a kind: where the id is the largest, each is a
response. A null page id never is the largest; a group of nulls alone has no id to
refer to and stays as responses. A very long payload is one member and held whole by the
task that writes or reads it. An empty table writes no archive and gives no rows. Extra
columns of any name are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import open_fs, shared_dir, spread, written

CHUNK = 1 << 16


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id, url: str, payload: bytes, refers_to) -> bytes:
    """One gzip member. A revisit has an empty block and keeps digest and length of its payload in its header."""
    digest = base32_sha1(payload)
    block = payload if refers_to is None else b""
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Target-URI": url,
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Block-Digest": f"sha1:{base32_sha1(block)}",
        "X-Payload-Length": len(payload),
        "Content-Type": "text/html; charset=utf-8",
        "Content-Length": len(block),
    }
    if refers_to is not None:
        head |= {"WARC-Refers-To": f"<urn:page:{refers_to}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    lines = "".join(f"{k}: {str(v).translate({10: ' ', 13: ' '})}\r\n" for k, v in head.items())
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress(b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n") + pack.flush()


def members(source) -> Iterator[bytes]:
    """The inflated gzip members of a stream, one after the other, read in chunks."""
    raw = b""
    while raw or (raw := source.read(CHUNK)):
        inflate, out = zlib.decompressobj(31), []
        while True:
            out.append(inflate.decompress(raw))
            if inflate.eof:
                raw = inflate.unused_data
                break
            if not (raw := source.read(CHUNK)):
                raise ValueError("the archive ends inside a record")
        yield b"".join(out)


def read_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header and block of one record; framing and digest are verified."""
    top, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = top.decode().split("\r\n")
    head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    n = int(head["Content-Length"])
    block = rest[:n]
    if not version.startswith("WARC/1.") or len(block) != n or rest[n:] != b"\r\n\r\n":
        raise ValueError("bad framing")
    if head["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError("the block's digest differs")
    if head["WARC-Type"] == "response" and head["WARC-Payload-Digest"] != head["WARC-Block-Digest"]:
        raise ValueError("the payload's digest differs")
    return head, block


def write_archives(pages: DataFrame) -> DataFrame:
    """Writes a record per row (page_id, url, html); returns the manifest of finished files: path, bytes, records, root.

    Only digests and ids are shuffled for the grouping: a partial aggregate keeps the
    largest id of each digest that several rows have. Those are written first, so that the
    join which brings them back to the rows and their payloads has an exchange of its own
    on either side, and Spark can split a digest that a third of all pages share.
    """
    spark = pages.sparkSession
    folder = shared_dir(spark, "warc")
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html")).withColumn("key", F.unhex(F.sha1(F.encode("html", "utf-8"))))
    last = rows.groupBy("key").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "last")
    last = written(last, "warc-digests")
    marked = rows.join(last, "key", "left").select("page_id", "url", "html", F.when(F.col("page_id").eqNullSafe(F.col("last")), None).otherwise(F.col("last")).alias("refers_to"))
    marked = marked.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})  # ids pass through as text and stay exact

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = open_fs(folder)
        out, path, n = None, f"{root}/{uuid.uuid4().hex}.warc.gz", 0
        for pdf in batches:
            for page_id, url, html, refers_to in pdf.itertuples(index=False):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(path)
                out.write(record(page_id, url, html.encode(), refers_to))
                n += 1
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [path], "bytes": [fs.get_file_info(path).size], "records": [n]})

    return written(marked.mapInPandas(run, "path string, bytes long, records long"), "warc-manifest").withColumn("root", F.lit(folder))


def read_archives(manifest: DataFrame, blocks: bool = True) -> DataFrame:
    """Reads the archives record by record: page_id, payload_bytes, payload_digest, record_type, refers_to, and `html`, the stored block (null without `blocks`)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = lambda x: x[10:-1] or None if x else None
        for pdf in batches:
            for row in pdf.itertuples():
                fs, _ = open_fs(row.root)
                with fs.open_input_stream(row.path) as source:
                    found, size, n = [], 0, 0
                    for data in members(source):
                        head, block = read_record(data)
                        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        found.append((number(head["WARC-Record-ID"]), int(head["X-Payload-Length"]), digest, head["WARC-Type"], number(head.get("WARC-Refers-To")), block.decode() if blocks else None))
                        size, n = size + len(block) * blocks, n + 1
                        if size > 4_000_000 or len(found) >= 2000:
                            yield _frame(found)
                            found, size = [], 0
                    if n != row.records:
                        raise ValueError("records are missing")
                    if found:
                        yield _frame(found)

    rows = spread(manifest).mapInPandas(run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, html string")
    return rows.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


def _frame(found: list[tuple]) -> pd.DataFrame:
    pdf = pd.DataFrame(found, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"], dtype=object)
    return pdf.astype({"payload_bytes": "int64"})
