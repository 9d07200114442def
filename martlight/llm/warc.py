"""WARC archives of pages: written with an index first, read back by coalesced byte ranges.

Writing: every task writes its pages as one archive, each record a gzip member of its own, and returns
a row per record: archive, offset, length, URL and digest. These rows are the index, kept as a table.
An archive counts only if the index names it, and every attempt of a task writes a new one, so a task
that runs again leaves nothing wrong behind. Of pages with equal payloads (of MIN_REVISIT bytes or
more) the one with the smallest id is a response; the others are revisits, which keep the HTTP header
but no payload.

Reading: the index rows of the records wanted are sorted by archive and offset; neighbouring ranges
are read in one go of bounded size. Every record is checked against the index.

Archives lie in the folder given, which all executors share; ``pyarrow.fs`` opens it by its URI.
Null html is an empty payload, null URLs leave their header out. Rows without an id are responses, as
are rows that repeat the id and payload of a response.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlight.llm.common import written
from martlight.session import scratch_path

MIN_REVISIT = 100
DATE = "2024-01-01T00:00:00Z"
#: Ranges less than GAP bytes apart are read together, up to READ bytes at once.
GAP = 64 << 10
READ = 8 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "archive string, offset long, length long, page_id long, url string, digest string, record_type string"


def file_system(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if "://" not in folder and not folder.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), folder
    if folder.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(folder)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One uncompressed WARC/1.1 record."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Date: {DATE}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Type, ids, digest and the payload (None of a revisit) with its full size."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    revisit = fields["WARC-Type"] == "revisit"

    def number(name: str) -> int | None:
        text = fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text else None

    return {
        "page_id": number("WARC-Record-ID"), "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To"),
        "digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"), "url": fields.get("WARC-Target-URI"),
        "payload": None if revisit else payload, "payload_bytes": size,
    }


def revisits(pages: DataFrame) -> DataFrame:
    """page_id, digest, refers_to of the pages whose payload an earlier page has."""
    html = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    digests = pages.select("page_id", F.sha2(html, 256).alias("digest"), F.length(html).alias("size"))
    digests = written(digests.where(F.col("size") >= MIN_REVISIT).where("page_id is not null").drop("size"), "digests")
    first = digests.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    # Only payloads that repeat: a few rows of unique keys, whatever their groups' sizes.
    first = first.where("n > 1").drop("n")
    return digests.join(first, "digest").where("page_id > refers_to").distinct()


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write every page's record below ``folder``; the index, one row per record.

    Pages stay in the split they are read in: only the small table of revisits may move.
    """
    marks = written(revisits(pages), "revisits")
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha2(F.encode(html, "utf-8"), 256).alias("digest"))
    rows = rows.join(marks, ["page_id", "digest"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = file_system(folder)
        name, out, offset = "", None, 0
        try:
            for batch in batches:
                index = []
                for row in batch.to_pylist():
                    if out is None:
                        store.create_dir(root, recursive=True)
                        name = f"pages-{uuid.uuid4().hex}.warc.gz"
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    refers_to = row["refers_to"]
                    raw = record(row["page_id"], row["url"], row["html"].encode(), row["digest"], refers_to)
                    member = zlib.compress(raw, 1, 31)
                    out.write(member)
                    kind = "response" if refers_to is None else "revisit"
                    index.append((name, offset, len(member), row["page_id"], row["url"], row["digest"], kind))
                    offset += len(member)
                if index:
                    columns = [pa.array(c) for c in zip(*index)]
                    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
                    yield pa.RecordBatch.from_arrays(
                        [c.cast(k) for c, k in zip(columns, kinds)],
                        names=[c.split()[0] for c in INDEX.split(", ")],
                    )
        finally:
            if out is not None:
                out.close()

    return written(rows.mapInArrow(run, INDEX), "index")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """page_id, url, payload (null of a revisit), payload_bytes, payload_digest, record_type, refers_to.

    Ranges of an archive that lie close together are one read: ``run`` numbers them, and the rows of
    a run are read by one task, in order.
    """
    # Runs of about READ bytes are what tasks share out, so a large archive has many readers.
    placed = index.select("archive", "offset", "length", "digest", F.expr(f"offset div {READ}").alias("run"))
    placed = placed.repartition("archive", "run").sortWithinPartitions("archive", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = file_system(folder)
        opened, stream = None, None
        for batch in batches:
            rows = batch.to_pylist()
            if not rows:
                continue
            at, found = 0, []
            while at < len(rows):
                first, stop = rows[at], at + 1
                end = first["offset"] + first["length"]
                while (
                    stop < len(rows) and rows[stop]["archive"] == first["archive"]
                    and 0 <= rows[stop]["offset"] - end <= GAP
                    and rows[stop]["offset"] + rows[stop]["length"] - first["offset"] <= READ
                ):
                    end = rows[stop]["offset"] + rows[stop]["length"]
                    stop += 1
                if opened != first["archive"]:
                    if stream is not None:
                        stream.close()
                    opened, stream = first["archive"], store.open_input_file(f"{root}/{first['archive']}")
                data = memoryview(stream.read_at(end - first["offset"], first["offset"]))
                for row in rows[at:stop]:
                    low = row["offset"] - first["offset"]
                    got = parse(zlib.decompress(data[low : low + row["length"]], 31))
                    full = got["payload"]
                    if got["digest"] != row["digest"] or full is not None and hashlib.sha256(full).hexdigest() != row["digest"]:
                        raise ValueError(f"record at {row['archive']}:{row['offset']} is not the one indexed")
                    found.append((
                        got["page_id"], got["url"], full, got["payload_bytes"], got["digest"], got["record_type"], got["refers_to"],
                    ))
                at = stop
            kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*found), kinds)],
                names=["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"],
            )
        if stream is not None:
            stream.close()

    return placed.mapInArrow(
        run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write all pages to archives in the shared folder and read every record back."""
    folder = scratch_path(pages.sparkSession, "warc")
    return read_records(write_archives(pages, folder), folder).drop("url", "payload")
