import gzip
import hashlib
from urllib.parse import urlparse

import pytest

from martlight.llm import warc
from martlight.session import scratch_path

LONG = "<p>" + "long enough to be a revisit " * 9 + "</p>"
ROWS = [
    (5, "http://a/5", LONG, 1), (3, "http://a/3", LONG, 2), (9, None, LONG, 3), (4, "http://a/\r\n4", "short", 4),
    (6, "http://a/6", "short", 5), (7, "http://a/7", None, 6), (8, "http://a/8", "", 7), (3, "http://a/3", LONG, 8),
    (3, "http://other", "é" * 60, 9), (None, "http://null", LONG, 10), (10, "u", "a\r\n\r\nWARC/1.1\r\n\r\n" * 20, 11),
    (11, "u", "x" * 300_000, 12), (12, "u", "x" * 300_000, 13),
]
SCHEMA = "page_id long, url string, html string, digest int"


def wanted(rows):
    first = {}
    for page, _, html, _ in rows:
        raw = (html or "").encode()
        if page is not None and len(raw) >= 100:
            first[raw] = min(page, first.get(raw, page))
    for page, _, html, _ in rows:
        raw = (html or "").encode()
        again = page is not None and len(raw) >= 100 and first[raw] < page
        yield (page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[raw] if again else None)


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


@pytest.mark.parametrize("splits", [1, 5])
def test_round_trip(spark, splits):
    pages = spark.createDataFrame(ROWS, SCHEMA).repartition(splits)
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    found = warc.archive_pages(pages).select(columns).collect()
    assert order(map(tuple, found)) == order(wanted(ROWS))


def test_payloads_and_index(spark):
    folder = scratch_path(spark, "warc")
    index = warc.write_archives(spark.createDataFrame(ROWS, SCHEMA), folder)
    rows = index.collect()
    assert len(rows) == len(ROWS)
    for row in rows:
        with open(f"{urlparse(folder).path}/{row['archive']}", "rb") as file:
            file.seek(row["offset"])
            raw = gzip.decompress(file.read(row["length"]))
        assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n")
        assert warc.parse(raw)["digest"] == row["digest"]
    some = warc.read_records(index.where("page_id in (4, 10, 11)"), folder).collect()
    payloads = {r["page_id"]: bytes(r["payload"]).decode() for r in some}
    assert payloads == {r[0]: r[2] for r in ROWS if r[0] in payloads} and len(payloads) == 3
    assert {r["url"] for r in some if r["page_id"] == 4} == {"http://a/%0D%0A4"}


def test_archives_are_plain_gzip_members(spark):
    folder = scratch_path(spark, "warc")
    index = warc.write_archives(spark.createDataFrame(ROWS, SCHEMA).coalesce(1), folder)
    with gzip.open(f"{urlparse(folder).path}/{index.first()['archive']}", "rb") as file:
        assert file.read().count(b"WARC-Record-ID") == len(ROWS)


def test_no_pages(spark):
    assert warc.archive_pages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_wrong_index_is_noticed(spark):
    folder = scratch_path(spark, "warc")
    index = warc.write_archives(spark.createDataFrame(ROWS, SCHEMA).coalesce(1), folder)
    with pytest.raises(Exception, match="not the one indexed"):
        warc.read_records(index.selectExpr("archive", "offset", "length", "sha2(digest, 256) as digest"), folder).collect()
