"""Archives written, read back and skipped through."""

import gzip
import io

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo

from notewarden.llm import warc
from notewarden.llm.common import scratch

LONG = "<p>" + "x" * 200 + "</p>"
PAGES = [(5, "http://a", LONG), (3, "http://b", LONG), (9, None, LONG), (1, "http://c", "short"), (2, "http://d", "short"), (4, "u", None), (6, "u", ""), (7, "http://e\r\nWARC-Type: x%0A", "<é🙂>" * 5000), (None, "n", LONG), (3, "http://b", LONG), (8, "x", "\r\n\r\nWARC/1.1\r\n\r\n" * 20)]


@pytest.fixture(scope="module")
def path(spark):
    out = scratch(spark, "warc-test")
    warc.write_archives(warc.page_records(spark.createDataFrame(PAGES, "page_id long, url string, html string")), out)
    return out


def test_round_trip(spark, path):
    rows = warc.read_archives(spark, path).collect()
    assert len(rows) == len(PAGES)
    by_url = {r.target_uri: r for r in rows}
    assert by_url[PAGES[7][1]].payload.decode() == PAGES[7][2]
    assert by_url["x"].payload.decode() == PAGES[10][2]
    assert by_url[None].record_type == "revisit" and by_url[None].refers_to == "<urn:page:3>" and by_url[None].payload == b"" and by_url[None].payload_length == len(LONG)
    assert {r.record_type for r in rows if r.record_id == "<urn:page:3>"} == {"response"}
    assert {r.record_type for r in rows if r.target_uri in ("http://c", "http://d", "u")} == {"response"}


def test_pushed_filters(spark, path):
    df = warc.read_archives(spark, path).filter((F.col("record_type") == "revisit") & (F.col("target_uri") == "http://a"))
    assert [r.refers_to for r in df.collect()] == ["<urn:page:3>"]
    reader = warc.WarcReader(path, {})
    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), EqualTo(("payload",), b"x"), EqualTo(("record_type",), "response")]))
    assert reader.wanted == {"record_type": "revisit"} and len(left) == 2


def test_headers_only(spark, path):
    rows = warc.read_archives(spark, path, payload=False).collect()
    assert len(rows) == len(PAGES) and all(r.payload is None for r in rows)


class Counted(io.BytesIO):
    taken = 0

    def size(self):
        return len(self.getvalue())

    def read(self, n=-1):
        out = super().read(n)
        self.taken += len(out)
        return out


def record(i, payload, kind="response"):
    return warc.build_record({"record_id": f"<{i}>", "record_type": kind, "target_uri": None, "warc_date": None, "payload_digest": None, "refers_to": None, "payload_length": None, "payload": payload})


def test_skips_unwanted_payloads():
    import os

    big = os.urandom(400_000)
    f = Counted(warc.gzip_member(record(1, big)) + warc.gzip_member(record(2, b"b", "revisit")))
    assert [r["record_id"] for r in warc.read_archive(f, {"record_type": "revisit"}, True)] == ["<2>"]
    assert f.taken < 10_000


@pytest.mark.parametrize("pack", [lambda b: b, gzip.compress, warc.gzip_member])
def test_plain_and_foreign_archives(pack):
    data = b"".join(pack(record(i, b"p" * i)) for i in (0, 3000, 70000))
    rows = list(warc.read_archive(Counted(data), {}, True))
    assert [len(r["payload"]) for r in rows] == [0, 3000, 70000]
    assert len(list(warc.read_archive(Counted(data), {"record_id": "<3000>"}, False))) == 1


def test_empty_table(spark):
    out = scratch(spark, "warc-empty")
    warc.write_archives(warc.page_records(spark.createDataFrame([], "page_id long, url string, html string")), out)
    assert warc.read_archives(spark, out).collect() == []


def test_second_write_keeps_the_first(spark):
    out = scratch(spark, "warc-twice")
    pages = lambda *rows: warc.page_records(spark.createDataFrame(list(rows), "page_id long, url string, html string, URL2 string"))
    warc.write_archives(pages((1, "http://x/a%20b", "one", "")), out)
    warc.write_archives(pages((2, " http://x/100%25/a%0Ab\n", "two", "")), out)
    rows = {r.record_id: (r.target_uri, r.payload) for r in warc.read_archives(spark, out).collect()}
    assert rows == {"<urn:page:1>": ("http://x/a%20b", b"one"), "<urn:page:2>": (" http://x/100%25/a%0Ab\n", b"two")}
    pages((3, None, None, "")).write.format("warc").mode("overwrite").save(out)
    assert [r.record_id for r in warc.read_archives(spark, out).collect()] == ["<urn:page:3>"]


def test_uris_stand_as_they_are():
    row = dict(record_id="<1>", record_type="response", target_uri="http://x/a%20b?c=%0A", warc_date=None, payload_digest=None, refers_to=None, payload_length=None, payload=b"p")
    data = warc.build_record(row)
    assert b"WARC-Target-URI: http://x/a%20b?c=%0A\r\n" in data and warc.CODED.encode() not in data
    for uri in (row["target_uri"], "a\r\nWARC-Type: x%0A", " x ", "", "é\n%25"):
        assert next(warc.read_archive(Counted(warc.build_record({**row, "target_uri": uri})), {}, True))["target_uri"] == uri


def test_several_records_in_a_member():
    data = b"".join(record(i, b"p" * i) for i in (0, 3000, 70000))
    for pack in (gzip.compress(data), gzip.compress(data) + warc.gzip_member(record(5, b"last")) + gzip.compress(data)):
        rows = list(warc.read_archive(Counted(pack), {}, True))
        assert [len(r["payload"]) for r in rows][:3] == [0, 3000, 70000] and len(rows) in (3, 7)
        assert {r["record_id"] for r in warc.read_archive(Counted(pack), {"record_id": "<3000>"}, False)} == {"<3000>"}


@pytest.mark.parametrize("pack", [lambda b: b, gzip.compress, warc.gzip_member])
def test_cut_short_raises(pack):
    data = pack(record(1, bytes(range(256)) * 200))
    for n in (10, 100, len(data) // 2):
        with pytest.raises(ValueError):
            list(warc.read_archive(Counted(data[:n]), {}, True))
        with pytest.raises(ValueError):
            list(warc.read_archive(Counted(data[:n]), {"record_id": "<9>"}, False))


def test_small_records_share_requests():
    class Requests(Counted):
        made = 0

        def read(self, n=-1):
            self.made += 1
            return super().read(n)

    f = Requests(b"".join(warc.gzip_member(record(i, b"p" * 500)) for i in range(4000)))
    assert len(list(warc.read_archive(f, {}, True))) == 4000 and f.made < 40 and f.taken <= f.size()
    big = Requests(b"".join(warc.gzip_member(record(i, __import__("os").urandom(300_000))) for i in range(20)))
    assert len(list(warc.read_archive(big, {}, False))) == 20 and big.taken < 20 * 10_000


def test_files_end_at_a_size(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", str(i) * 50) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    warc.register(spark)
    warc.page_records(pages).coalesce(1).write.format("warc").option("file_bytes", "1000").mode("append").save(str(tmp_path / "w"))
    assert len(list((tmp_path / "w").glob("*.warc.gz"))) > 3 and warc.read_archives(spark, str(tmp_path / "w")).count() == 40
