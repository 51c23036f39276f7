"""WARC archives: writing with an index first, reading by coalesced ranges.

Every record is one gzip member.  The writer returns one index row per record
(file, offset, length, URL, digest ...); a reader picks index rows, sorts
them by place and reads neighbouring records in one ranged read.  Archives
are written by the tasks through Arrow's file systems under a name of their
own; a task that is lost or repeated leaves a file that no index row names.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fiscus.llm.common import scratch_path, ship

INDEX = ("file string, offset long, length long, url string, digest string, page_id long, "
         "record_type string, refers_to long, payload_bytes long")
RECORD = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, "
          "payload_digest string, payload binary")
_CTL = re.compile(r"[\x00-\x20\x7f]")


def _urn(key) -> str:
    return f"<urn:x-page:{'null' if key is None else key}>"


def _key(urn: str):
    key = urn[len("<urn:x-page:"):-1]
    return None if key == "null" else int(key)


def record(page_id, url, payload: bytes, digest: str, refers_to, revisit: bool, date: str) -> bytes:
    """One record as a gzip member.  A revisit has the HTTP head only."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}",
            f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + _CTL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        head += [f"WARC-Refers-To: {_urn(refers_to)}",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def parse(member: bytes) -> dict:
    """The headers, HTTP content length and payload of one gzip member."""
    head, _, rest = zlib.decompress(member, 31).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    return {"fields": fields, "payload_bytes": size, "payload": payload}


def plan_records(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least: int) -> DataFrame:
    """Each page with its digest and, if an equal payload of at least ``least``
    bytes has a smaller id, the id that it revisits."""
    p = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"),
                     F.encode(F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256))
    first = (p.where(F.octet_length("payload") >= least).groupBy("digest")
             .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1 and first_id is not null").drop("n"))
    other = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return p.join(first, "digest", "left").select(
        "page_id", "url", "payload", "digest", F.when(other, F.col("first_id")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   least: int = 100, file_bytes: int = 64 << 20, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write ``folder``/archives and ``folder``/index; return the index.

    Of equal payloads of at least ``least`` bytes the smallest id is a
    response and the others revisit it; smaller ones are all responses.  Null
    payloads are empty; a null URL is left out; rows that repeat the smallest
    id are responses too; null ids never are what others revisit.  An empty
    table writes an empty index.
    """
    spark = pages.sparkSession
    ship(spark)

    def run(batches):
        fs, base = pafs.FileSystem.from_uri(f"{folder}/archives")
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                cols = [batch.column(i) for i in range(5)]
                for i in range(batch.num_rows):
                    key, url, payload, digest, ref = (c[i].as_py() for c in cols)
                    if out is None:
                        fs.create_dir(base, recursive=True)
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    member = record(key, url, payload, digest, ref, ref is not None, date)
                    out.write(member)
                    rows.append((f"{folder}/archives/{name}", at, len(member), url, digest, key,
                                 "response" if ref is None else "revisit", ref, len(payload)))
                    at += len(member)
                    if at >= file_bytes:
                        out.close()
                        out = None
                if rows:
                    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                                     [x.split()[0] for x in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    index = plan_records(pages, id_col, url_col, payload_col, least).mapInArrow(run, INDEX)
    index.write.parquet(f"{folder}/index")
    return read_index(spark, folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def coalesce(rows, gap: int, most: int):
    """Runs of (file, offset, length) rows, sorted by place, that one read
    covers: same file, at most ``gap`` bytes between, ``most`` bytes in all
    (a longer record is read alone)."""
    run = []
    for r in rows:
        if run and (r[0] != run[0][0] or r[1] > run[-1][1] + run[-1][2] + gap or r[1] + r[2] - run[0][1] > most):
            yield run
            run = []
        run.append(r)
    if run:
        yield run


def read_records(index: DataFrame, payloads: bool = True, gap: int = 64 << 10, most: int = 8 << 20) -> DataFrame:
    """The records that ``index`` selects, parsed and checked: page_id, url,
    record_type, refers_to, payload_bytes, payload_digest, payload (null for
    revisits, or if ``payloads`` is false).  A payload that differs from its
    digest is an error.  Index rows are dealt by place, not by key."""
    ship(index.sparkSession)
    places = index.select("file", "offset", "length", "url").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")

    def run(batches):
        files: dict = {}
        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(4))))
            found = []
            for span in coalesce(rows, gap, most):
                name, start = span[0][0], span[0][1]
                if name not in files:
                    for f in files.values():
                        f.close()
                    files.clear()
                    fs, path = pafs.FileSystem.from_uri(name)
                    files[name] = fs.open_input_file(path)
                data = files[name].read_at(span[-1][1] + span[-1][2] - start, start)
                for _, at, n, url in span:
                    r = parse(data[at - start:at - start + n])
                    h = r["fields"]
                    digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
                    whole = h["WARC-Type"] == "response"
                    if whole and (hashlib.sha256(r["payload"]).hexdigest() != digest or len(r["payload"]) != r["payload_bytes"]):
                        raise ValueError(f"damaged record at {name}:{at}")
                    found.append((_key(h["WARC-Record-ID"]), url, h["WARC-Type"],
                                  None if whole else _key(h["WARC-Refers-To"]), r["payload_bytes"], digest,
                                  r["payload"] if whole and payloads else None))
            if found:
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)],
                                                 [x.split()[0] for x in RECORD.split(", ")])
        for f in files.values():
            f.close()

    return places.mapInArrow(run, RECORD)


def round_trip(pages: DataFrame, **names) -> DataFrame:
    """Write all pages to scratch archives and read every record back."""
    folder = scratch_path(pages.sparkSession, "warc")
    return read_records(write_archives(pages, folder, **names), payloads=False)
