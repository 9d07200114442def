"""CSV uploads: line breaks between quotes, read in byte ranges by many tasks."""

import csv
import io
import os
import random

import pytest
from pyspark.sql import functions as F

from martlight.session import scratch_path
from martlight.sources import upload
from martlight.sources.upload import MALFORMED, ROW_INDEX, UnclosedQuote, read_raw


def write(spark, *texts):
    folder = scratch_path(spark, "csv")
    os.makedirs(folder)
    for k, text in enumerate(texts):
        with open(f"{folder}/{k}.csv", "w", newline="") as out:
            out.write(text)
    return folder


@pytest.fixture
def small_ranges(spark):
    """Byte ranges far smaller than a file, often smaller than a record."""
    changed = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "0",
               "spark.sql.files.minPartitionNum": "64"}
    for key, value in changed.items():
        spark.conf.set(key, value)
    yield
    for key in changed:
        spark.conf.unset(key)


def expected(*texts):
    """(row number, cells, whether it fits the header), as the standard library's reader sees them."""
    out = []
    for text in texts:
        rows = [r for r in csv.reader(io.StringIO(text, newline="")) if r and not (len(r) == 1 and not r[0].strip())]
        out += [(cells, len(cells) == len(rows[0])) for cells in rows[1:]]
    missing = upload.MISSING_TOKENS
    return [(k, [None if c in missing else c for c in cells], fits) for k, (cells, fits) in enumerate(out)]


def got(df):
    names = [c for c in df.columns if c not in (ROW_INDEX, MALFORMED)]
    rows = sorted(df.collect(), key=lambda r: r[ROW_INDEX])
    return [(r[ROW_INDEX], [r[c] for c in names], r[MALFORMED] is None) for r in rows]


def check(spark, *texts):
    found, wanted = got(read_raw(spark, write(spark, *texts))), expected(*texts)
    assert [k for k, _, _ in found] == list(range(len(wanted)))
    assert [f for _, _, f in found] == [f for _, _, f in wanted]
    for (_, cells, fits), (_, want, _) in zip(found, wanted):
        if fits:
            assert cells == want


def random_text(seed, rows=60):
    draw = random.Random(seed)
    pieces = ["x", "long words here " * 3, "\n", "\r\n", '""', ",", "é漢", " ", "12", "\n\n"]
    lines = ['id,"no\nte",last']
    for k in range(rows):
        inner = "".join(draw.choice(pieces) for _ in range(draw.randrange(8)))
        plain = draw.choice(["a", "", "5' or 6\" pipe", "n/a", "b c"])
        lines.append(f'{k},"{inner}",{plain}' if draw.random() < 0.6 else f"{k},{plain},{draw.choice(['q', '\"w\"'])}")
    return draw.choice(["\n", "\r\n"]).join(lines) + draw.choice(["", "\n"])


@pytest.mark.parametrize("seed", range(6))
def test_rows_of_the_standard_reader(spark, small_ranges, seed):
    check(spark, random_text(seed))


def test_several_files_blank_lines_and_odd_rows(spark, small_ranges):
    second = 'id,"no\nte",last\n\n1,"two\n\nlines",z\n   \n2,short\n3,"a",b,too many\n4,"' + "deep\n" * 200 + '",end\n'
    check(spark, random_text(11), second, 'id,"no\nte",last\n', random_text(12))


def test_one_file_is_read_by_several_tasks(spark, small_ranges):
    folder = write(spark, random_text(3, 400))
    lines = upload._lines(spark, folder)
    assert lines.rdd.getNumPartitions() >= 8
    ranges = upload._summed(lines)
    assert ranges.count() >= 8
    check(spark, random_text(3, 400))


def test_files_without_line_breaks_in_cells_are_read_as_they_are(spark):
    text = "a,b\n" + "".join(f'{k},"x, ""{k}"""\n' for k in range(50))
    df = read_raw(spark, write(spark, text))
    assert "Scan csv" in df._jdf.queryExecution().executedPlan().toString()
    assert got(df) == expected(text)


def test_unclosed_quote_is_refused(spark, small_ranges):
    folder = write(spark, 'a,b\n1,"x\n2,y\n' + "3,z\n" * 100)
    with pytest.raises(UnclosedQuote):
        read_raw(spark, folder)
    by_line = read_raw(spark, folder, multiline=False)
    assert by_line.count() == 102


def test_empty_and_header_only(spark):
    assert read_raw(spark, write(spark, 'a,"b\nc"\n')).count() == 0
    assert read_raw(spark, write(spark, "a,b\n")).count() == 0


def test_text_of_records_is_not_collected_for_single_lines(spark, small_ranges):
    """Only lines of records that span lines are brought together."""
    df = read_raw(spark, write(spark, random_text(5, 200)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" in plan and "Union" in plan and "PythonUDF" not in plan
    assert df.select(F.max(ROW_INDEX)).first()[0] == 199
