"""WARC archives: written as whole-file gzip streams, normalised to one gzip member a record with an offset index.

Writing is Spark's own text sink (one gzip stream a file, committed by task), so a lost executor costs only a retry.
The normaliser inflates each file's stream once, piece by piece, rewrites every record as its own member under a
temporary name, renames it when complete and leaves ``<archive>.idx`` beside it: offset, length and record id a line.

Null html is an empty payload; a null url has no target header; line breaks in a url are percent-encoded. Of equal
payloads of at least ``least_bytes`` the record with the largest page id is the response and the others are revisits of
it; rows that repeat that page id are responses too, and if all ids are null all are responses. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.shared import cut, new_path, written

LEAST_BYTES = 1000
ARCHIVE_BYTES = 32 << 20
#: A table of repeated payloads of up to so many rows (of about 64 bytes) is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 500_000
#: Record header texts.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def plan_records(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to)."""
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    p = p.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1(F.col("payload").cast("binary")))
    tops = p.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1").drop("n")
    tops = cut(tops)
    if tops.count() <= BROADCAST_ROWS:
        tops = F.broadcast(tops)
    p = p.join(tops, "payload_digest", "left")
    revisit = F.col("top").isNotNull() & (F.col("payload_bytes") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("top"))
    return p.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("top"))).drop("top")


def record_text(records: DataFrame) -> DataFrame:
    """One ``value`` a record: headers and block, without the record's last line break (the sink's separator)."""
    end = "\r\n"
    rid = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{end}Content-Type: text/html; charset=utf-8{end}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(end + end))
    is_revisit = F.col("record_type") == "revisit"
    block = F.when(is_revisit, http).otherwise(F.concat(http, F.col("payload")))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat(
        F.lit(f"WARC/1.1{end}WARC-Type: "), F.col("record_type"), F.lit(f"{end}WARC-Record-ID: "), rid(F.col("page_id")), F.lit(f"{end}WARC-Date: {DATE}{end}"),
        F.when(F.col("url").isNotNull(), F.concat(F.lit("WARC-Target-URI: "), url, F.lit(end))).otherwise(F.lit("")),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest"), F.lit(end),
        F.when(is_revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}{end}WARC-Refers-To: "), rid(F.col("refers_to")), F.lit(end))).otherwise(F.lit("")),
        F.lit(f"Content-Type: application/http; msgtype=response{end}Content-Length: "), F.octet_length(block).cast("string"), F.lit(end + end),
    )
    return records.select(F.concat(head, block, F.lit(end)).alias("value"))


def write_archives(records: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Whole-file gzip archives of about ``archive_bytes`` each."""
    mean = records.agg(F.coalesce(F.avg("payload_bytes"), F.lit(0.0)).alias("m")).first()["m"] + 500
    record_text(records).write.option("compression", "gzip").option("lineSep", "\r\n").option("maxRecordsPerFile", max(1, int(archive_bytes / mean))).text(path)


def inflate(content: bytes, piece: int = 1 << 20) -> Iterator[bytes]:
    """The inflated bytes of a gzip stream (or of several members in a row), piece by piece."""
    d, at = zlib.decompressobj(31), 0
    while at < len(content) or d.unused_data:
        if d.eof:
            rest = d.unused_data + content[at : at + piece]
            d, at = zlib.decompressobj(31), at + piece
            if not rest:
                return
        else:
            rest, at = content[at : at + piece], at + piece
        yield d.decompress(rest)


def records_of(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records (with their closing line breaks), cut from a stream by Content-Length."""
    buf = bytearray()
    need = None
    for piece in pieces:
        buf += piece
        while True:
            if need is None:
                head = buf.find(b"\r\n\r\n")
                if head < 0:
                    break
                need = head + 4 + int(field(bytes(buf[: head + 2]), b"Content-Length")) + 4
            if len(buf) < need:
                break
            yield bytes(buf[:need])
            del buf[:need]
            need = None
    if buf:
        raise ValueError("archive ends inside a record")


def field(head: bytes, name: bytes) -> str:
    for line in head.split(b"\r\n"):
        if line[: len(name) + 1] == name + b":":
            return line[len(name) + 1 :].strip().decode()
    return ""


def _page(urn: str) -> int | None:
    value = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if value in ("none", "") else int(value)


def normalise(spark, src: str, dst: str) -> DataFrame:
    """Rewrite every archive in ``src`` into ``dst``; one row an archive: (archive, records)."""

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(dst)
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                name = f"{base}/{path.rsplit('/', 1)[-1].removesuffix('.txt.gz')}.warc.gz"
                mark = uuid.uuid4().hex
                at, lines = 0, []
                with store.open_output_stream(f"{name}.{mark}") as out:
                    for record in records_of(inflate(content)):
                        c = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = c.compress(record) + c.flush()
                        out.write(member)
                        lines.append(f"{at} {len(member)} {field(record[: record.find(b'\r\n\r\n') + 2], b'WARC-Record-ID')}\n")
                        at += len(member)
                with store.open_output_stream(f"{name}.idx.{mark}") as out:
                    out.write("".join(lines).encode())
                store.move(f"{name}.idx.{mark}", f"{name}.idx")
                store.move(f"{name}.{mark}", name)
                yield pd.DataFrame({"archive": [name.rsplit("/", 1)[-1]], "records": [len(lines)]})

    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(dst)
    store.create_dir(base)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(src).select("path", "content")
    return written(files.mapInPandas(rewrite, "archive string, records long"), "warc-list")


def read_archives(archives: DataFrame, dst: str) -> DataFrame:
    """Read every record through the sidecar indexes: one row a record, digests of the payloads checked."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(dst)
        for batch in batches:
            for archive in batch["archive"]:
                with store.open_input_stream(f"{base}/{archive}.idx") as f:
                    index = f.read().decode().splitlines()
                rows = []
                with store.open_input_file(f"{base}/{archive}") as f:
                    for line in index:
                        at, length, rid = line.split(" ", 2)
                        f.seek(int(at))
                        record = zlib.decompress(f.read(int(length)), 31)
                        cut_at = record.find(b"\r\n\r\n")
                        head = record[: cut_at + 2]
                        if field(head, b"WARC-Record-ID") != rid:
                            raise ValueError(f"{archive} at {at}: not {rid}")
                        kind, digest = field(head, b"WARC-Type"), field(head, b"WARC-Payload-Digest").removeprefix("sha1:")
                        http_end = record.find(b"\r\n\r\n", cut_at + 4)
                        payload = record[http_end + 4 : -4]
                        if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"{archive} at {at}: payload digest differs")
                        size = int(field(record[cut_at + 4 : http_end + 2], b"Content-Length"))
                        rows.append((_page(rid), size, digest, kind, _page(field(head, b"WARC-Refers-To")), archive, int(at), int(length)))
                out = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "member_offset", "member_length"])
                yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, member_offset long, member_length long"
    n = max(1, archives.count())
    return archives.select("archive").repartition(min(n, 10_000)).mapInPandas(read, schema)


def round_trip(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write ``pages`` as archives in the shared folder, normalise them and read every record back."""
    spark = pages.sparkSession
    root = new_path(spark, "warc")
    if "://" not in root and not root.startswith("file:"):
        root = f"file://{root}"
    write_archives(plan_records(pages, least_bytes), f"{root}/whole")
    return read_archives(normalise(spark, f"{root}/whole", f"{root}/members"), f"{root}/members")
