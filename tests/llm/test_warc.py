import base64
import gzip
import hashlib
import io
import os

import duckdb
import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNull, Not, StringStartsWith

from ledgerloom.llm import warc
from ledgerloom.llm.queries import ORACLES, QUERIES
from tests.llm.samples import SMALL

BIG = "x" * 1200
ROWS = [
    (1, "http://a b\n", "hi", 7), (2, "u", BIG, 7), (3, None, BIG, 7), (3, "u3", BIG, 7), (None, "n", BIG, 7),
    (None, None, None, 7), (5, "u", "é" * 999, 7), (6, "u", "hi", 7), (4, "z", "", 7), (9, "u", "é" * 999, 7),
    (8, "http://long", "<p>\r\n\r\nWARC/1.1\r\n" * 50_000, 7),
]
SCHEMA = "page_id long, url string, html string, payload int"


def brute(rows):
    out = []
    for page, _, html, *_ in rows:
        data = (html or "").encode()
        equal = [p for p, _, h, *_ in rows if h == html and p is not None]
        keeper = max(equal) if len(data) >= 1000 and equal else None
        revisit = keeper is not None and page != keeper
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", keeper if revisit else None))
    return sorted(out, key=str)


@pytest.fixture
def archive(spark, folder):
    """The pages in four archives: gzip and plain, one file or many."""
    pages = spark.createDataFrame(ROWS, SCHEMA)
    for name, options in (("gz", {}), ("plain", {"gzip": False}), ("small", {"file_bytes": 500}), ("best", {"level": 9})):
        warc.write_archive(pages, f"{folder}/{name}", **options)
    return folder


def test_round_trip(spark, folder):
    pages = spark.createDataFrame(ROWS, SCHEMA)
    got = sorted((tuple(r) for r in warc.round_trip(pages, f"{folder}/a").collect()), key=str)
    assert got == brute(ROWS)
    assert warc.round_trip(pages.limit(0), f"{folder}/none").collect() == []


def test_payloads_come_back(spark, archive):
    want = sorted((html or "").encode() for _, _, html, _ in ROWS if html != BIG and (html or "")[:1] != "é")
    want = sorted(want + [BIG.encode()] * 2 + [("é" * 999).encode()])
    for name in ("gz", "plain", "small", "best"):
        rows = warc.read_archive(spark, f"{archive}/{name}").where("record_type = 'response'").collect()
        assert sorted(bytes(r.payload) for r in rows) == want, name
        assert all(r.payload_length == len(r.payload) and r.headers["warc-type"] == "response" for r in rows)
        heads = warc.read_archive(spark, f"{archive}/{name}", payload=False).collect()
        assert len(heads) == len(ROWS) and all(r.payload is None for r in heads)
    assert len(os.listdir(f"{archive}/small")) > 3 and not any("pending" in f for f in os.listdir(f"{archive}/small"))


def test_filters_reach_the_scan(spark, archive):
    records = warc.read_archive(spark, f"{archive}/gz")
    plan = records.where("record_type = 'revisit' AND payload_length > 1500")._jdf.queryExecution().executedPlan().toString()
    assert plan.startswith("*(1) Project") and "Filter (" not in plan and plan.count("BatchScan warc") == 1
    for condition, n in (
        ("record_type = 'revisit'", 3), ("record_type <> 'revisit'", 8), ("refers_to IS NULL", 8), ("payload_length > 1500", 3),
        ("record_id IN ('<urn:page:1>', '<urn:page:3>')", 3), ("target_uri LIKE 'http%'", 2), ("target_uri IS NULL", 2),
        ("NOT (payload_length > 1500) AND refers_to IS NOT NULL", 2), ("length(payload) = 2", 2), ("target_uri LIKE '%long' OR payload_length = 0", 3),
    ):
        assert records.where(condition).count() == n, condition


def test_predicates():
    record = {c: None for c in (*warc.HEADER_COLUMNS, *warc.NUMBER_COLUMNS)} | {"record_type": "revisit", "content_length": 7}
    assert warc.predicate(EqualTo(("record_type",), "revisit"))(record)
    assert warc.predicate(Not(EqualTo(("target_uri",), "x")))(record) is None
    assert warc.predicate(In(("content_length",), (1, 7)))(record)
    assert warc.predicate(IsNull(("target_uri",)))(record)
    assert warc.predicate(Not(GreaterThan(("content_length",), 7)))(record)
    assert warc.predicate(EqualTo(("payload",), b"")) is None
    assert warc.predicate(StringStartsWith(("headers", "via"), "x")) is None
    assert warc.predicate(In(("record_type",), ("a", None))) is None


def members(name, archive):
    (path,) = [f"{archive}/{name}/{f}" for f in os.listdir(f"{archive}/{name}") if f.endswith(".gz")]
    return open(path, "rb").read()


def test_unwanted_payloads_are_not_inflated(spark, archive):
    """The large record costs one read of its head; a reader of gzip alone can read the files too."""
    data = members("gz", archive)
    assert gzip.decompress(data).count(b"WARC-Record-ID") == len(ROWS)

    class Counting(io.BytesIO):
        taken = 0

        def readinto(self, b):
            n = super().readinto(b)
            Counting.taken += n
            return n

    padded = warc.member(warc.encoded(dict.fromkeys(warc.WRITE_COLUMNS) | {"record_type": "response", "payload": os.urandom(3_000_000)}), 1)
    stream = io.BufferedReader(Counting(padded + data), 4096)
    found = list(warc.records(stream, "f", lambda r: r.columns["record_type"] == "revisit", True))
    assert len(found) == 3 and Counting.taken < len(data) + 100_000


def test_foreign_files(spark, folder):
    """Plain gzip members, other record types, folded headers, blank lines, revisits of other tools."""
    block = b"HTTP/1.1 404 Not Found\r\nX: y\r\n\r\nbody"
    response = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n\r\n%b\r\n\r\n" % (len(block), block)
    info = b"WARC/1.0\r\nwarc-type: warcinfo\r\nWarc-Filename: a\r\n b\r\nContent-Type: application/warc-fields\r\nContent-Length: 4\r\n\r\na: b\r\n\r\n"
    os.makedirs(f"{folder}/w/deep")
    open(f"{folder}/w/one.warc.gz", "wb").write(gzip.compress(info) + gzip.compress(response))
    open(f"{folder}/w/deep/two.warc", "wb").write(info + b"\r\n" + response)
    open(f"{folder}/w/_SUCCESS", "wb").write(b"")
    rows = warc.read_archive(spark, f"{folder}/w").orderBy("file", "offset").collect()
    assert [r.record_type for r in rows] == ["warcinfo", "response"] * 2
    assert [bytes(r.payload) for r in rows] == [b"a: b", b"body"] * 2
    assert rows[0].headers["warc-filename"] == "a b" and rows[1].payload_length == 4
    open(f"{folder}/w/three.warc", "wb").write(response[:-20])
    with pytest.raises(Exception, match="cut short"):
        warc.read_archive(spark, f"{folder}/w").collect()


def test_plan_packs_whole_files():
    groups = warc.planned([("c", 50), ("a", 60), ("b", 50), ("d", 500)], 110)
    assert [g.paths for g in groups] == [["a", "b"], ["c"], ["d"]]


def test_digest(spark):
    digest = hashlib.sha1(b"x").hexdigest()
    text = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    assert spark.createDataFrame([(text,)], "d string").select(warc.hex_of("d")).first()[0] == digest


def test_oracle(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SMALL}/pages.parquet'")
    want = sorted(con.execute(ORACLES["op12_warc"]).fetchall(), key=str)
    assert sorted((tuple(r) for r in QUERIES["op12_warc"](spark, SMALL).collect()), key=str) == want
