r"""Operator 11: web archives (WARC 1.1) of crawled pages, written, read back and put together by capture.

A page becomes three records: the request, the response with the payload, or a revisit that points to the response with the same
payload, and metadata with the page's identifier. Response and metadata name the request in WARC-Concurrent-To; only
through it can the metadata be told which response it belongs to. Records are gzip members of their own, as the
format asks for, so any reader of such archives reads these.

Reading takes records off a stream one by one; payloads are hashed in pieces, so neither a file nor a large record is held.
captures() joins the records that Concurrent-To connects, in whatever direction and over however many steps, into one nested row.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, rows, shared_dir, stored, table
from .components import components

#: Bytes of payload after which a task begins another file; bytes that are read at a time.
FILE, PIECE = 128 << 20, 1 << 20
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "application/http"
FIELDS = "application/warc-fields"


def _base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def _urn(*parts: object) -> str:
    """A record identifier that depends on the parts only."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(repr(parts).encode()).digest()[:16])}>"


def _record(kind: str, record_id: str, headers: list[tuple[str, str]], content_type: str, block: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id), *headers, ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    text = f"{VERSION}\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return gzip.compress(text.encode() + block + b"\r\n\r\n", 4, mtime=0)


def _uri(url: str) -> str:
    """url as a header can hold it: spaces and control characters are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f\x85\u2028\u2029]", lambda m: quote(m[0]), url)


def _capture(page_id: int | None, url: str | None, payload: bytes, sha1: str, holder: int | None, date: str) -> list[bytes]:
    """A page's records. holder: the page that has the payload, if it is known that several do."""
    digest, request = ("WARC-Payload-Digest", f"sha1:{_base32(sha1)}"), f"<urn:uuid:{uuid.uuid4()}>"
    uri = [] if url is None else [("WARC-Target-URI", _uri(url))]
    base, linked = [("WARC-Date", date), *uri], ("WARC-Concurrent-To", request)
    at = urlsplit(_uri(url)) if url and "[" not in url and "]" not in url else urlsplit("")
    path = (at.path or "/") + (f"?{at.query}" if at.query else "")
    out = [_record("request", request, base, f"{HTTP};msgtype=request", f"GET {path} HTTP/1.1\r\nHost: {at.netloc}\r\n\r\n".encode())]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if holder is None or holder == page_id:
        own = f"<urn:uuid:{uuid.uuid4()}>" if holder is None else _urn(sha1, holder)
        out.append(_record("response", own, [*base, linked, digest], f"{HTTP};msgtype=response", http + payload))
    else:
        told = [*base, linked, digest, ("WARC-Refers-To", _urn(sha1, holder)), ("WARC-Profile", REVISIT_PROFILE)]
        out.append(_record("revisit", f"<urn:uuid:{uuid.uuid4()}>", told, f"{HTTP};msgtype=response", http))
    said = {"page-id": page_id, "url": json.dumps(url) if url is not None and _uri(url) != url else None}
    fields = "".join(f"{k}: {v}\r\n" for k, v in said.items() if v is not None)
    out.append(_record("metadata", f"<urn:uuid:{uuid.uuid4()}>", [*base, linked], FIELDS, fields.encode()))
    return out


MANIFEST = "path string, n_pages long, n_bytes long"


def write_archives(pages: DataFrame, folder: str | None = None, least: int = 0, file_bytes: int = FILE, date: str | None = None) -> DataFrame:
    """The manifest of the archives that hold pages(page_id, url, html). The manifest is stored; a file of a lost task isn't in it.

    Of several pages with one payload of at least `least` bytes, those with the largest page_id are responses and the others revisits
    of it; rows that repeat that page_id are responses too, and so are all where every page_id is null. Null html is an empty payload,
    a null url gives no target, a null page_id no such field. Other columns aren't read. No pages, no files.
    """
    spark = pages.sparkSession
    folder = f"{folder or shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.coalesce("html", F.lit(""))
    marked = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("sha1"))
    # Payloads that several pages have. Stored, so that its size is known: Spark sends it to all tasks if it is small and else joins by shuffles.
    again = marked.where(F.octet_length("payload") >= least).groupBy("sha1").agg(F.max("page_id").alias("holder"), F.count("*").alias("n")).where("n > 1").drop("n")
    marked = marked.join(stored(again, "payloads"), "sha1", "left").select("page_id", "url", "payload", "sha1", "holder")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = root = out = None
        for ids, urls, texts, sha1s, holders in rows(batches, 128):
            for page in zip(ids, urls, texts, sha1s, holders):
                if out is None:
                    path = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                    where, root = fs.FileSystem.from_uri(path)
                    where.create_dir(root.rpartition("/")[0], recursive=True)
                    out, n, size = where.open_output_stream(root, compression=None), 0, 0
                    out.write(_record("warcinfo", f"<urn:uuid:{uuid.uuid4()}>", [("WARC-Date", date)], FIELDS, b"format: WARC File Format 1.1\r\n"))
                data = page[2].encode()
                for record in _capture(page[0], page[1], data, page[3], page[4], date):
                    out.write(record)
                n, size = n + 1, size + len(data)
                if size >= file_bytes:
                    out.close()
                    out = None
                    yield told(path, n, size)
        if out is not None:
            out.close()
            yield told(path, n, size)

    def told(path: str, n: int, size: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["path", "n_pages", "n_bytes"])

    return stored(marked.mapInArrow(write, MANIFEST), "archives")


def _pairs(lines: Iterator[bytes]) -> list[tuple[str, str]]:
    """Names and values of header lines; a line that begins with white space goes on with the one before."""
    found: list[tuple[str, str]] = []
    for line in lines:
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in (" ", "\t") and found:
            found[-1] = (found[-1][0], f"{found[-1][1]} {text.strip()}")
        elif ":" in text:
            name, _, value = text.partition(":")
            found.append((name.strip().lower(), value.strip()))
    return found


def _lines(stream, most: int | None = None) -> Iterator[bytes]:
    """Lines up to an empty one, which isn't returned, or to `most` bytes."""
    while most is None or most > 0:
        line = stream.readline() if most is None else stream.readline(most)
        if not line or line in (b"\r\n", b"\n"):
            return
        most = None if most is None else most - len(line)
        yield line


def records_of(stream, with_blocks: bool = False) -> Iterator[dict]:
    """The records of an archive, plain or in any division into gzip members, each as a dictionary; keys are those of RECORD but for the place."""
    start = stream.peek(2)[:2]
    if start == b"\x1f\x8b":
        import io

        stream = io.BufferedReader(gzip.GzipFile(fileobj=stream), PIECE)
    while True:
        first = stream.readline()
        while first in (b"\r\n", b"\n"):
            first = stream.readline()
        if not first:
            return
        if not first.startswith(b"WARC/"):
            raise ValueError(f"not a record: {first[:40]!r}")
        headers = _pairs(_lines(stream))
        one = dict(reversed(headers))  # of names that are repeated, the first
        left = size = int(one["content-length"])
        kind, content = one.get("warc-type", ""), one.get("content-type", "")
        http: list[bytes] = []
        if content.startswith(HTTP):
            http = list(_head(stream, size))
            left -= sum(map(len, http))
        n, hasher, kept = left, hashlib.sha1(), []
        while left:
            piece = stream.read(min(left, PIECE))
            if not piece:
                raise ValueError("the archive ends inside a record")
            hasher.update(piece)
            if with_blocks or content.startswith(FIELDS):
                kept.append(piece)
            left -= len(piece)
        body = b"".join(kept)
        yield {
            "type": kind, "record_id": one.get("warc-record-id"), "concurrent_to": [v for k, v in headers if k == "warc-concurrent-to"], "target_uri": one.get("warc-target-uri"),
            "refers_to": one.get("warc-refers-to"), "date": one.get("warc-date"), "digest": one.get("warc-payload-digest"), "headers": headers,
            "http": _pairs(iter(http[1:])), "fields": _pairs(iter(body.splitlines(True))) if content.startswith(FIELDS) else [],
            "payload_bytes": n, "payload_digest": base64.b32encode(hasher.digest()).decode(), "payload": body if with_blocks else None,
        }


def _head(stream, size: int) -> Iterator[bytes]:
    """The lines of a HTTP head in a block of size bytes, with the empty one at its end."""
    while size > 0:
        line = stream.readline(size)
        if not line:
            raise ValueError("the archive ends inside a record")
        size -= len(line)
        yield line
        if line in (b"\r\n", b"\n"):
            return


_MAP = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
RECORD = pa.schema([
    ("place", pa.string()), ("type", pa.string()), ("record_id", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("target_uri", pa.string()), ("refers_to", pa.string()), ("date", pa.string()), ("digest", pa.string()),
    ("headers", _MAP), ("http", _MAP), ("fields", _MAP), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()),
])
_PAIRS = "array<struct<name:string,value:string>>"
RECORD_DDL = f"place string, type string, record_id string, concurrent_to array<string>, target_uri string, refers_to string, date string, digest string, headers {_PAIRS}, http {_PAIRS}, fields {_PAIRS}, payload_bytes long, payload_digest string, payload binary"


def read_archives(files: DataFrame, with_blocks: bool = False) -> DataFrame:
    """The records of the archives that files(path) names, one task for each file at most. place: the file and the record's number in it. payload is null unless with_blocks."""
    import io

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = lambda x: [{"name": k, "value": v} for k, v in x]
        for (paths,) in rows(batches):
            for path in paths:
                where, at = fs.FileSystem.from_uri(path)
                out, room, n = [], PIECE, 0
                with where.open_input_stream(at, compression=None) as file:
                    for r in records_of(io.BufferedReader(file, PIECE), with_blocks):
                        n += 1
                        out.append(r | {"place": f"{path}#{n}"} | {k: pairs(r[k]) for k in ("headers", "http", "fields")})
                        room -= len(r["payload"] or b"")
                        if len(out) == 512 or room < 0:
                            yield pa.RecordBatch.from_pylist(out, RECORD)
                            out, room = [], PIECE
                if out:
                    yield pa.RecordBatch.from_pylist(out, RECORD)

    found = files.select("path").repartition(partitions(files.sparkSession)).mapInArrow(read, RECORD_DDL)
    return found if with_blocks else found.drop("payload")


def value_of(pairs: str | Column, name: str) -> Column:
    """The first value under a name, in lower case, or null."""
    return F.get(F.filter(pairs, lambda x: x["name"] == name), F.lit(0))["value"]


def captures(records: DataFrame) -> DataFrame:
    """(capture_id, requests, responses, metadata, others), each an array of records, for the records that Concurrent-To connects.

    Usually all of a capture name one that names none; then one grouping does it. Chains, circles and several names are followed
    by connected components. A record that nothing connects is a capture of its own; warcinfo records, which describe files, are in none.
    A record without an identifier goes by its place. records is read several times, so it should be stored.
    """
    known = records.where("type <> 'warcinfo'").withColumn("own", F.coalesce("record_id", "place"))
    links = records.where("size(concurrent_to) > 0 AND record_id IS NOT NULL AND type <> 'warcinfo'")
    ends = links.select(F.col("record_id").alias("target")).distinct()
    chained = links.where("size(concurrent_to) > 1").select("record_id").limit(1).count() or links.select(F.get("concurrent_to", F.lit(0)).alias("target")).join(ends, "target", "left_semi").limit(1).count()
    if chained:
        roots = components(links.select(F.col("record_id").alias("a"), F.explode("concurrent_to").alias("b")))
        hubs = roots.select(F.col("node").alias("own"), F.col("root").alias("hub"))
        known = known.join(hubs, "own", "left").withColumn("capture_id", F.coalesce("hub", "own"))
    else:
        known = known.withColumn("capture_id", F.coalesce(F.get("concurrent_to", F.lit(0)), F.col("own")))
    shown = F.struct(*[c for c in records.columns])
    of = lambda *kinds: F.collect_list(F.when(F.col("type").isin(*kinds), shown))
    named = ("request", "response", "revisit", "resource", "metadata")
    return known.groupBy("capture_id").agg(of("request").alias("requests"), of("response", "revisit", "resource").alias("responses"), of("metadata").alias("metadata"), F.collect_list(F.when(~F.col("type").isin(*named), shown)).alias("others"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    found = captures(stored(read_archives(files), "records")).select(F.get("responses", F.lit(0)).alias("r"), value_of(F.get("metadata", F.lit(0))["fields"], "page-id").cast("long").alias("page_id"))
    # A revisit has no payload: its size is that of the HTTP head, its digest that of the record's.
    size = F.when(F.col("r.type") == "revisit", value_of("r.http", "content-length").cast("long")).otherwise(F.col("r.payload_bytes"))
    digest = F.when(F.col("r.type") == "revisit", F.regexp_replace("r.digest", "^sha1:", "")).otherwise(F.col("r.payload_digest"))
    found = stored(found.select("page_id", size.alias("payload_bytes"), digest.alias("payload_digest"), F.col("r.type").alias("record_type"), F.col("r.refers_to").alias("target"), F.col("r.record_id").alias("own")), "captured")
    held = found.where("record_type = 'response'").groupBy(F.col("own").alias("target")).agg(F.max("page_id").alias("refers_to"))
    shown = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    first = found.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long"))
    return first.select(*shown).unionByName(found.where("record_type <> 'response'").join(held, "target", "left").select(*shown))


OP11_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT *, sha1(t) AS x, max(page_id) OVER (PARTITION BY t) AS held FROM p)
SELECT page_id, octet_length(encode(t))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(x, 1 + 5 * (k // 4), 5))::BIGINT // (32768 // (32 ** (k % 4))::BIGINT)) % 32)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN held IS NULL OR page_id = held THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN held IS NULL OR page_id = held THEN NULL ELSE held END AS refers_to
FROM d
"""
