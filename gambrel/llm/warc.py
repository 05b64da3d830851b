"""WARC archives: write captures as linked records, read archives, assemble transactions.

A capture is a request, a response (or a revisit of an equal payload) and a metadata record; the first and the last name
the second in WARC-Concurrent-To. Reading joins the three again into one nested row a capture.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gambrel.llm.common import materialise, quoted, scratch
from gambrel.llm.store import make_dir, open_fs

RECORDS = (
    "record_id string, type string, concurrent_to string, refers_to string, uri string, date string, "
    "payload_digest string, payload_bytes long, headers map<string,string>, payload binary"
)
#: Parts into which the ids of equal payloads are dealt.
SALTS = 16
#: Bytes of an archive read at a time.
READ_BYTES = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NONE = -(1 << 63)
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_name(kind: str, page, sha1: bytes, nth: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{kind}/{page}/{sha1.hex()}/{nth}')}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One gzip member with one record."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + pack.flush()


def capture_records(page, url: str | None, payload: bytes, sha1: bytes, refers, nth: int, date: str) -> bytes:
    uri = quote(url or "about:blank", safe="%/:=&?~#+!$,;'@()*[]")
    name = record_name("response", page, sha1, nth)
    digest = "sha1:" + base64.b32encode(sha1).decode()
    common = [("WARC-Date", date), ("WARC-Target-URI", uri)]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    main = [("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", name), *common, ("WARC-Payload-Digest", digest)]
    if refers is not None:
        main += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_name("response", refers, sha1, 1))]
    main.append(("Content-Type", "application/http; msgtype=response"))
    path = urlsplit(uri)
    asked = f"GET {path.path or '/'}{'?' + path.query if path.query else ''} HTTP/1.1\r\nHost: {path.netloc}\r\n\r\n".encode()
    request = [("WARC-Type", "request"), ("WARC-Record-ID", record_name("request", page, sha1, nth)), *common, ("WARC-Concurrent-To", name), ("Content-Type", "application/http; msgtype=request")]
    fields = "".join(f"{k}: {v}\r\n" for k, v in (("page-id", page), ("refers-to-page-id", refers)) if v is not None).encode()
    meta = [("WARC-Type", "metadata"), ("WARC-Record-ID", record_name("metadata", page, sha1, nth)), *common, ("WARC-Concurrent-To", name), ("Content-Type", "application/warc-fields")]
    return record(request, asked) + record(main, http + payload if refers is None else http) + record(meta, fields)


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", folder: str | None = None, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write every page as a capture, in one gzip archive a task, and return the committed manifest (path, captures).

    Null html is an empty payload, a null url is about:blank. Of captures with equal payloads the one with the largest id
    is the response and the others revisit it; rows that repeat that id and payload are responses too. Null ids never are
    the target unless all are null; then each is a response. Archives of attempts that Spark did not commit are not in the
    manifest. Payloads are shuffled once, by page; only digests and ids meet where payloads are equal.
    """
    folder = folder or scratch(pages.sparkSession, "warc")
    make_dir(folder)
    page = F.coalesce(quoted(id_col).cast("long"), F.lit(_NONE))
    rows = pages.select(page.alias("page"), quoted(url_col).alias("url"), F.coalesce(quoted(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("sha1", F.unhex(F.sha1("html")))
    last = rows.groupBy("sha1").agg(F.max("page").alias("refers"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # both sides grow with the pages, so none is broadcast; ids of one payload meet its last in SALTS parts
    ids = rows.select("page", "sha1").distinct().withColumn("salt", F.pmod(F.hash("page"), F.lit(SALTS)))
    last = last.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    revisits = ids.join(last.hint("merge"), ["sha1", "salt"]).where("page < refers").select("page", "sha1", "refers")
    linked = rows.join(revisits.hint("merge"), ["page", "sha1"], "left").withColumn("nth", F.row_number().over(Window.partitionBy("page", "sha1").orderBy("url")))
    linked = linked.select("page", "url", F.encode("html", "UTF-8").alias("payload"), "sha1", "refers", "nth")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = open_fs(f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz")
        out, n = None, 0
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                for page, url, payload, sha1, refers, nth in zip(*(c.to_pylist() for c in batch.slice(k, 64).columns)):
                    if out is None:
                        out = fs.open_output_stream(at, compression=None)
                        info = b"software: gambrel\r\nformat: WARC File Format 1.1\r\n"
                        out.write(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], info))
                    out.write(capture_records(None if page == _NONE else page, url, payload, sha1, refers, nth, date))
                    n += 1
        if out is not None:
            out.close()
            path = at if folder.startswith(("/", "file:")) else f"{folder}/{at.rpartition('/')[2]}"
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], names=["path", "captures"])

    return materialise(linked.mapInArrow(write, "path string, captures long"), "warc-manifest")


def members(source) -> Iterator[bytes]:
    """The gzip members of a file, each unpacked; holds one."""
    unpack, parts = zlib.decompressobj(31), []
    while True:
        data = source.read(READ_BYTES)
        if not data:
            return
        while data:
            parts.append(unpack.decompress(data))
            data = unpack.unused_data
            if unpack.eof:
                yield b"".join(parts)
                unpack, parts = zlib.decompressobj(31), []


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = dict(re.split(r":\s*", line, maxsplit=1) for line in lines if ":" in line)
    return headers, rest[: int(headers.get("Content-Length", 0))]


def read_row(raw: bytes) -> tuple:
    """A record as a row of RECORDS. Payload size and digest are of the bytes read; a revisit's are those it states."""
    headers, block = parse(raw)
    kind, inner, payload, digest, size = headers.get("WARC-Type"), {}, block, None, None
    if headers.get("Content-Type", "").startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        inner = dict(re.split(r":\s*", line, maxsplit=1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
    elif headers.get("Content-Type") == "application/warc-fields":
        inner = dict(re.split(r":\s*", line, maxsplit=1) for line in block.decode("utf-8", "replace").split("\r\n") if ":" in line)
    stated = headers.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None
    if kind == "revisit":
        digest, size, payload = stated, int(inner.get("Content-Length", 0)), None
    elif kind == "response":
        digest, size = digest32(payload), len(payload)
        if stated and stated != digest:
            raise ValueError(f"payload of {headers.get('WARC-Record-ID')} is damaged")
    return (headers.get("WARC-Record-ID"), kind, headers.get("WARC-Concurrent-To"), headers.get("WARC-Refers-To"), headers.get("WARC-Target-URI"), headers.get("WARC-Date"), digest, size, list(inner.items()), payload)


def read_archives(manifest: DataFrame) -> DataFrame:
    """The records of the manifest's archives; tasks stream whole files."""
    text, i64 = pa.string(), pa.int64()
    types = [text, text, text, text, text, text, text, i64, pa.map_(text, text), pa.binary()]
    names = [f.split()[0] for f in RECORDS.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = open_fs(path)
                rows = []
                with fs.open_input_stream(at, compression=None) as source:
                    for raw in members(source):
                        rows.append(read_row(raw))
                        if len(rows) == 192:
                            yield made(rows)
                            rows = []
                if rows:
                    yield made(rows)

    paths = manifest.select("path")
    return paths.repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism)).mapInArrow(read, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row a capture: capture_id, type, uri, date, payload_digest, payload_bytes, refers_to (record),
    response (headers, payload), request (record_id, headers), metadata (record_id, fields).

    Requests and metadata are joined to the response or revisit that they name in WARC-Concurrent-To. A capture without
    one of them has null there; records that name no capture in the archives are left out; of several requests or
    metadata records of one capture that with the least record id counts.
    """
    main = records.where(F.col("type").isin("response", "revisit")).select(
        F.col("record_id").alias("capture_id"), "type", "uri", "date", "payload_digest", "payload_bytes", "refers_to", F.struct("headers", "payload").alias("response")
    )

    def side(kind: str, fields: str) -> DataFrame:
        one = records.where(F.col("type") == kind).groupBy(F.col("concurrent_to").alias("capture_id"))
        return one.agg(F.min_by(F.struct("record_id", F.col("headers").alias(fields)), "record_id").alias(kind))

    # records of each kind grow alike, so none is broadcast
    return main.join(side("request", "headers").hint("merge"), "capture_id", "left").join(side("metadata", "fields").hint("merge"), "capture_id", "left")
