"""WARC archives with revisit resolution: one response a payload, later equal ones refer to it."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_rows, filesystem, small_batches
from lodestone.plans.storage import fresh_dir, materialize

#: Fixed values of the WARC format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: An archive is closed beyond so many bytes and the next begun.
ROLL = 256 << 20
RECORDS = "file string, page_id long, record_id string, record_type string, payload_digest string, payload_bytes long, refers_to_record string"


def record_id(page_id) -> str:
    """The same for the same page in every run."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to, revisit: bool, date: str) -> bytes:
    """One record with fresh headers: a response with its payload, or a revisit without."""
    block = HTTP + (b"" if revisit else payload)
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"\s", lambda m: f"%{ord(m[0]):02X}", url)))
    if page_id is not None:
        head.append(("Page-ID", str(page_id)))
    head += [("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"), ("WARC-Block-Digest", f"sha1:{digest_of(block)}")]
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"".join([VERSION, b"\r\n", *(f"{k}: {v}\r\n".encode() for k, v in head), b"\r\n", block, b"\r\n\r\n"])


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an uncompressed WARC stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if line.strip() != VERSION:
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode().partition(":")
            head[k.strip().lower()] = v.strip()
        yield head, stream.read(int(head["content-length"]))


def resolve(pages: DataFrame) -> DataFrame:
    """(pid, digest, first_id) of pages whose payload more than one record has.

    Only digests and ids are shuffled, summed by digest before they move; the join
    back is by digest, whose hot values Spark splits.
    """
    heads = pages.select("pid", "digest")
    firsts = heads.groupBy("digest").agg(F.min("pid").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    return heads.distinct().join(firsts.drop("n"), "digest")


def write_archives(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", archives: int | None = None) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as gzip WARC files; returns (file, records).

    The record with the least page_id of its payload (null ids last) is a response,
    the others refer to it; of repeated rows with that id, one is the response. Null
    html is an empty payload, an empty payload is a payload. Attempts write files of
    their own and only those that a finished task names are read, so that a lost
    executor leaves no half archive in the result. Other columns are ignored.
    """
    spark = pages.sparkSession
    small_batches(spark, 500)
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    pid = F.coalesce(F.col("page_id").cast("long"), F.lit((1 << 63) - 1))
    again = resolve(pages.select(pid.alias("pid"), F.sha1(payload).alias("digest"))).withColumn("shared", F.lit(True))
    # The payloads move once: the join is by what they are dealt by.
    rows = pages.select("page_id", "url", payload.alias("payload"), pid.alias("pid"), F.sha1(payload).alias("digest"))
    rows = rows.repartition(archives or int(spark.conf.get("spark.sql.shuffle.partitions")), "pid", "digest")
    rows = rows.join(again, ["pid", "digest"], "left").sortWithinPartitions("pid", "digest", "url")
    rows = rows.select("page_id", "url", "payload", "pid", "digest", "first_id", F.coalesce("shared", F.lit(False)).alias("shared"))

    def write(batches):
        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        out, name, n, last = None, "", 0, None
        try:
            for page_id, url, payload, pid, digest, first, shared in arrow_rows(batches, "page_id", "url", "payload", "pid", "digest", "first_id", "shared"):
                if out is None or out.tell() > ROLL:
                    if out is not None:
                        out.close()
                        yield name, n
                    name, n = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                revisit = shared and (pid != first or last == (pid, digest))
                last = pid, digest
                first = page_id if pid == first else first
                out.write(gzip.compress(record(page_id, url, payload, first, revisit, date), 6, mtime=0))
                n += 1
        finally:
            if out is not None:
                out.close()
        if out is not None:
            yield name, n

    def task(batches):
        import pyarrow as pa

        for name, n in write(batches):
            yield pa.RecordBatch.from_pydict({"file": [name], "records": [n]})

    return materialize(rows.mapInArrow(task, "file string, records long"), "warc-files")


def read_archives(files: DataFrame, folder: str) -> DataFrame:
    """RECORDS of the archives: headers, and the digest and length of the payloads that are there."""

    def task(batches):
        import pyarrow as pa

        fs, path = filesystem(folder)
        names = [x.split()[0] for x in RECORDS.split(", ")]
        for (file,) in arrow_rows(batches, "file"):
            rows = []
            with fs.open_input_stream(f"{path}/{file}", compression=None) as raw, gzip.open(raw) as stream:
                for head, block in records(stream):
                    kind = head["warc-type"]
                    payload = block.partition(b"\r\n\r\n")[2]
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and digest_of(payload) != digest:
                        raise ValueError(f"{file}: payload of {head['warc-record-id']} differs from its digest")
                    page = head.get("page-id")
                    rows.append((file, page and int(page), head["warc-record-id"], kind, digest, len(payload) if kind == "response" else None, head.get("warc-refers-to")))
                    if len(rows) == 2000:
                        yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)), strict=True)), schema=SCHEMA())
                        rows = []
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)), strict=True)), schema=SCHEMA())

    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("file").repartition(n, "file").mapInArrow(task, RECORDS)


def SCHEMA():
    import pyarrow as pa

    kinds = {"string": pa.string(), "long": pa.int64()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in RECORDS.split(", "))])


def resolve_revisits(found: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), one row a record.

    Headers are shuffled by payload digest: a revisit gets the length of the response
    that it names. A revisit whose response is missing keeps null there.
    """
    origins = found.where("record_type = 'response'").select(
        F.col("record_id").alias("origin"), F.col("payload_digest").alias("d"), F.col("page_id").alias("origin_page"), F.col("payload_bytes").alias("n")
    )
    revisits = found.where("record_type = 'revisit'").join(
        origins, (F.col("payload_digest") == F.col("d")) & (F.col("refers_to_record") == F.col("origin")), "left"
    )
    out = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    return found.where("record_type = 'response'").select(*out, F.lit(None).cast("long").alias("refers_to")).unionByName(
        revisits.select("page_id", F.col("n").alias("payload_bytes"), "payload_digest", "record_type", F.col("origin_page").alias("refers_to"))
    )


def deduplicate(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the archives of ``pages``, read them back and resolve their revisits."""
    folder = folder or fresh_dir(pages.sparkSession, "warc")
    files = write_archives(pages, folder)
    return resolve_revisits(materialize(read_archives(files, folder), "warc-records"))
