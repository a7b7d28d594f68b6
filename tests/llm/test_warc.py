import base64
import hashlib
import io
import zipfile

import pytest

from corpusmill.llm import warc


def fetcher(raw, log=None):
    def fetch(at, n):
        if log is not None:
            log.append((at, n))
        return raw[at : at + n]

    return fetch


@pytest.mark.parametrize("zip64", [False, True])
def test_zip_is_read_by_range_and_by_the_library(zip64):
    members = [("archive/a", b"x" * 1000), ("indexes/i", b""), ("é", b"yz")]
    raw = warc.zip_write(members, zip64)
    z = warc.ZipRanges(fetcher(raw), len(raw))
    assert [(n, z.read(n)) for n in z.members] == members and z.read("archive/a", 10, 5) == b"xxxxx"
    lib = zipfile.ZipFile(io.BytesIO(raw))
    assert lib.testzip() is None and [(n, lib.read(n)) for n in lib.namelist()] == members


def test_archives_of_the_library_and_comments():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.comment = b"PK\5\6 not the end"
        with z.open("big", "w", force_zip64=True) as f:
            f.write(b"abc")
        z.writestr("packed", b"d" * 100, zipfile.ZIP_DEFLATED)
    raw = out.getvalue()
    z = warc.ZipRanges(fetcher(raw), len(raw))
    assert z.read("big") == b"abc"
    with pytest.raises(ValueError, match="not stored"):
        z.read("packed")
    with pytest.raises(ValueError, match="no end"):
        warc.ZipRanges(fetcher(b"nothing"), 7)


def test_records_are_fetched_one_by_one():
    records = [(k, warc.record(k, f"http://x/{k}", b"p" * k * 100_000, None, False)) for k in range(5)]
    raw, log = warc.package(records, zip64=True), []
    rows = list(warc.read_package(fetcher(raw, log), len(raw), span=0))
    assert [(r["page_id"], r["payload_bytes"]) for r in rows] == [(k, k * 100_000) for k in range(5)]
    assert len(log) >= 5 and rows[2]["payload"] == b"p" * 200_000
    few = []
    assert list(warc.read_package(fetcher(raw, few), len(raw))) == rows and len(few) == len(log) - 4


def test_damaged_payload_is_found():
    good = warc.record(1, None, b"abc", None, False)
    with pytest.raises(ValueError, match="digest"):
        warc.parse(good.replace(b"\r\n\r\nabc", b"\r\n\r\nabd"))


def test_round_trip(spark):
    nasty = "http://x/ \r\nWARC-Type: evil?ü=%20&a=1#f"
    rows = [(5, "http://a", "same é"), (3, None, "same é"), (9, nasty, "other"), (4, "http://b", None), (8, "http://c", ""), (None, "http://d", "null id"), (3, None, "same é")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int")
    got = warc.archive_round_trip(df).collect()
    assert len(got) == 7
    by = {r.page_id: r for r in got}
    assert (by[3].record_type, by[3].refers_to, by[5].record_type, by[5].refers_to) == ("response", None, "revisit", 3)
    assert (by[4].record_type, by[8].record_type, by[8].refers_to, by[8].payload_bytes) == ("response", "revisit", 4, 0)
    assert by[9].url == nasty and by[3].url is None and None in by
    assert by[5].payload_digest == by[3].payload_digest == base64.b32encode(hashlib.sha1("same é".encode()).digest()).decode()
    assert by[5].payload_bytes == len("same é".encode())
    assert warc.archive_round_trip(df.limit(0)).count() == 0
    few = {r.page_id: r.record_type for r in warc.archive_round_trip(df, least=6).collect()}
    assert few[8] == "response" and few[5] == "revisit"


def test_packages_are_files_of_bounded_size(spark, tmp_path):
    df = spark.range(50).selectExpr("id as page_id", "'u' as url", "repeat(cast(id as string), 2000) as html").coalesce(1)
    folder = f"file://{tmp_path}/packages"
    packages = warc.write_packages(df, folder, package_bytes=20_000).persist()
    assert packages.count() > 3 and packages.agg({"records": "sum"}).first()[0] == 50
    kinds = set()
    for r in packages.collect():
        with zipfile.ZipFile(tmp_path / "packages" / r.package) as z:
            assert z.testzip() is None and z.namelist() == [warc.ARCHIVE, warc.INDEX]
        kinds.add(b"PK\6\6" in (tmp_path / "packages" / r.package).read_bytes()[-200:])
    assert kinds == {True, False}  # ZIP64 directories and plain ones
    (tmp_path / "packages" / "left-by-a-lost-task.zip").write_bytes(b"half")
    got = warc.read_packages(packages, folder)
    assert got.count() == 50 and got.select("package").distinct().count() == packages.count()


def test_a_payload_longer_than_a_package(spark):
    df = spark.createDataFrame([(1, "u", "x" * 20_000_000, "p"), (2, "u", "y", "p"), (3, None, "x" * 20_000_000, "p")], "page_id long, url string, html string, package string")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_round_trip(df).collect()}
    assert got == {1: (20_000_000, "response", None), 2: (1, "response", None), 3: (20_000_000, "revisit", 1)}
