import hashlib

import numpy as np
import pytest

from tidewell.llm import warc
from tidewell.session import work_path

BIG = "x" * 1200
FAKE = (
    "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
)
PAGES = [
    (1, "http://a/1", "<p>small</p>", "extra"),
    (2, "http://a/2", "<p>small</p>", "extra"),
    (3, "http://b/3 with blank\r\nX-Evil: 1", BIG, None),
    (7, None, BIG, None),
    (5, "http://b/5", BIG, None),
    (8, "u", None, None),
    (9, "u", "", None),
    (10, "u", "before " + FAKE + "after", None),
    (11, "u", FAKE, None),
    (12, "u", "WARC/1.1\r\n" * 3, None),
    (13, "u", "text\r\n\r\nWARC/1.1\r\n\r\n", None),
    (14, "u", "é" * 700 + FAKE * 2, None),
    (15, "u", "é" * 700 + FAKE * 2, None),
    (None, "u", "no id", None),
    (None, "u", BIG, None),
    (16, "u", "y" * 999, None),
    (17, "u", "y" * 999, None),
    (18, "u", "Content-Length: 3\r\n\r\n", None),
    (20, "u", "z" * 3000, None),
    (20, "u", "z" * 3000, None),
]


def wanted(pages):
    by = {}
    for page, _, html, _ in pages:
        if page is not None:
            by[html or ""] = max(page, by.get(html or "", page))
    out = []
    for page, _, html, _ in pages:
        raw = (html or "").encode()
        top = by.get(html or "")
        again = len(raw) >= 1000 and top is not None and page != top
        out.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", top if again else None))
    return sorted(out, key=repr)


@pytest.fixture
def split(spark):
    """Byte ranges far smaller than the archives."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"]
    old = {n: spark.conf.get(n, None) for n in names}
    spark.conf.set(names[0], "700")
    spark.conf.set(names[1], "1")
    yield
    for n, v in old.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


SCHEMA = "page_id long, url string, html string, digest string"


def round_trip(spark, pages):
    path = work_path(spark, "archives")
    warc.write_warc(pages, path)
    return warc.read_warc(spark, path), path


def test_round_trip(spark):
    records, path = round_trip(spark, spark.createDataFrame(PAGES, SCHEMA).coalesce(2))
    got = records.collect()
    assert all(r.intact for r in got)
    assert sorted((tuple(r)[:5] for r in got), key=repr) == wanted(PAGES)
    text = spark.read.text(path, wholetext=True).collect()
    assert all(r.value.startswith("WARC/1.1\r\n") and r.value.endswith("\r\n\r\n") for r in text if r.value)
    assert not any("X-Evil" in line.split(":")[0] for r in text for line in r.value.split("\r\n"))


def test_round_trip_over_many_byte_ranges(spark, split):
    pages = spark.createDataFrame(PAGES * 3, SCHEMA).coalesce(1)
    got = sorted((tuple(r)[:5] for r in round_trip(spark, pages)[0].collect()), key=repr)
    assert got == wanted(PAGES * 3)


def test_thousands_of_magics_in_one_archive(spark, split):
    """Many broken records with many pieces each: no row is made for a piece and a record that does not cover it."""
    pages = [(i, "u", f"{i} " + "WARC/1.1\r\n" * 40, None) for i in range(60)] + [(60, "u", FAKE * 800, None), (61, "u", "end", None)]
    df = spark.createDataFrame(pages, SCHEMA).coalesce(1)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    got = sorted((tuple(r)[:5] for r in round_trip(spark, df)[0].collect()), key=repr)
    assert got == wanted(pages)


def test_cover_is_the_last_record_before(spark):
    places = [("f", off // 100 * 100, off % 100, off) for off in range(0, 400, 10)] + [("g", 0, 0, 0)]
    broken = [("f", 20, 25), ("f", 90, 230), ("f", 330, 5)]
    out = warc.covered(
        spark.createDataFrame(places, "file string, block long, rel long, off long"),
        spark.createDataFrame(broken, "file string, off long, need long"),
    )
    want = [("f", b, r, s, o) for f, b, r, o in places for g, s, n in broken if f == g and s <= o < s + n]
    assert sorted(tuple(r) for r in out.collect()) == sorted(want)


def test_no_pages(spark):
    assert round_trip(spark, spark.createDataFrame([], SCHEMA))[0].collect() == []


def test_file_that_starts_otherwise_has_no_records(spark):
    path = work_path(spark, "archives")
    spark.createDataFrame([("junk" + FAKE,)], "value string").write.text(path)
    assert warc.read_warc(spark, path).collect() == []


def test_exits_follow_chains():
    off, after = np.array([0, 5, 10, 20]), np.array([10, 7, 20, 40])
    assert warc.exits(off, after).tolist() == [40, 7, 40, 40]
    assert warc.exits(np.array([], np.int64), np.array([], np.int64)).tolist() == []
