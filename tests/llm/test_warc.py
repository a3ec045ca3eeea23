import gzip
import hashlib
import io

from fluvial.llm.warc import archive_round_trip, assemble, iter_records, read_warc, refer_to_first, write_warc

PAGE = "page_id long, url string, html string, other int"


def test_round_trip_and_revisits(spark, tmp_path):
    long = "<p>é\r\n\r\nWARC/1.1\r\n" + "x" * 120
    rows = [(3, "http://a/b?c", long, 1), (1, "http://a", long, 1), (2, None, "short", 1), (4, "http://z/", "short", 1), (5, "http://n", None, 1), (None, "http://q", long, 1), (1, "http://a", long, 1)]
    got = sorted(archive_round_trip(spark.createDataFrame(rows, PAGE), str(tmp_path / "w")).collect(), key=lambda r: (r.page_id is None, r.page_id or 0))
    assert [(r.page_id, r.record_type, r.refers_to) for r in got] == [
        (1, "response", None), (1, "response", None), (2, "response", None), (3, "revisit", 1), (4, "response", None), (5, "response", None), (None, "revisit", 1)
    ]
    want = {1: long, 2: "short", 3: long, 4: "short", 5: "", None: long}
    for r in got:
        raw = want[r.page_id].encode()
        assert r.payload_bytes == len(raw) and r.payload_digest == hashlib.sha256(raw).hexdigest()


def test_archives_hold_whole_records(spark, tmp_path):
    path = str(tmp_path / "w")
    write_warc(refer_to_first(spark.createDataFrame([(1, "http://a/ü", "<p>ü</p>", 0)], PAGE)), path)
    names = [p for p in (tmp_path / "w").iterdir() if p.name.endswith(".gz")]
    records = [r for p in names for r in iter_records(io.BytesIO(gzip.decompress(p.read_bytes())))]
    kinds = {h["warc-type"]: (h, b) for h, b in records}
    assert set(kinds) == {"response", "request", "metadata"}
    assert kinds["response"][1].endswith("\r\n\r\n<p>ü</p>".encode())
    assert kinds["request"][0]["warc-concurrent-to"] == kinds["response"][0]["warc-record-id"]


def test_assembly_in_either_direction(spark):
    rows = [
        ("r1", "response", "q1", "head"), ("q1", "request", None, "get"), ("m1", "metadata", "q1", "note"),
        ("r2", "response", None, "head"), ("q2", "request", "r2", "get"), ("x", "metadata", "gone", "lost"),
    ]
    df = spark.createDataFrame(rows, "record_id string, record_type string, concurrent_to string, block string")
    got = {r.record_id: (r.request and r.request.record_id, r.metadata and r.metadata.record_id) for r in assemble(df).collect()}
    assert got == {"r1": ("q1", "m1"), "r2": ("q2", None)}


def test_record_gzip_members_and_plain(spark, tmp_path):
    one = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: 24\r\n\r\nHTTP/1.1 200 OK\r\n\r\nhello\r\n\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(one.replace(b"<a>", b"<b>")))
    (tmp_path / "c.warc").write_bytes(one.replace(b"<a>", b"<c>"))
    got = {r.record_id: bytes(r.payload) for r in read_warc(spark, str(tmp_path)).collect()}
    assert got == {"<a>": b"hello", "<b>": b"hello", "<c>": b"hello"}


def test_empty(spark, tmp_path):
    assert archive_round_trip(spark.createDataFrame([], PAGE), str(tmp_path / "w")).count() == 0
