import gzip
import hashlib
import io

from lattica.llm import warc


def pages(spark):
    big = "x" * 700_000 + "é" * 10
    rows = [(1, "http://a/ 1", "<p>small</p>"), (2, "http://b", "<p>small</p>"), (3, "http://c", big), (9, "http://d", big), (5, None, big), (9, "http://d", big), (6, "u", None), (7, "u", ""), (None, "u", big), (8, "u", "WARC/1.1\r\n\r\nfake\r\n\r\n" + "z" * 1200)]
    rows = [(*r, "clash", 1) for r in rows]
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload string, chunk int"), big


def test_round_trip_with_revisits(spark):
    frame, big = pages(spark)
    chunks = warc.archive(frame, with_data=True).collect()
    last = [r for r in chunks if r.last]
    assert len(last) == 10
    sha = lambda s: hashlib.sha1((s or "").encode()).hexdigest()
    for r in last:
        assert r.payload_digest == sha(big) if r.payload_bytes == len(big.encode()) else r.record_type == "response"
    types = sorted((str(r.page_id), r.record_type, r.refers_to) for r in last)
    assert types == sorted([("1", "response", None), ("2", "response", None), ("3", "revisit", 9), ("5", "revisit", 9), ("6", "response", None), ("7", "response", None), ("8", "response", None), ("9", "response", None), ("9", "response", None), ("None", "revisit", 9)])
    whole = {}
    for r in sorted((r for r in chunks if r.page_id == 8), key=lambda r: r.chunk):
        whole.setdefault(r.record_id, []).append(bytes(r.data))
    assert b"".join(whole["urn:page:8"]).decode() == frame.filter("page_id = 8").first().html
    stored = [r for r in chunks if r.page_id == 9]
    assert len(stored) == 2 * -(-len(big.encode()) // warc.CHUNK)
    for r in stored:
        assert r.bytes_so_far == min(len(big.encode()), (r.chunk + 1) * warc.CHUNK)
        assert r.digest_so_far == hashlib.sha1(big.encode()[: r.bytes_so_far]).hexdigest()


def test_chunks_of_a_plain_archive():
    head = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:4>\r\nWARC-Payload-Digest: sha1:0\r\nX-Payload-Length: 5\r\nX-Page-ID: 4\r\nContent-Length: 5\r\n\r\n"
    data = gzip.compress((head + "hello\r\n\r\n").encode()) * 2
    rows = list(warc.record_chunks(io.BytesIO(data), chunk=2))
    assert [r["data"] for r in rows] == [b"he", b"ll", b"o"] * 2 and [r["last"] for r in rows] == [False, False, True] * 2


def test_no_pages(spark):
    frame, _ = pages(spark)
    assert warc.archive(frame.limit(0)).count() == 0


def test_ids_of_any_characters(spark):
    big = "y" * 1500
    ids = ["plain", "a b\r\nX-Page-ID: forged", "é: <%41>", "", "zz \r\n"]
    frame = spark.createDataFrame([(i, "u", big if k > 2 else f"small {k}") for k, i in enumerate(ids)], "page_id string, url string, html string")
    found = warc.archive(frame).filter("last").collect()
    assert sorted(r.page_id for r in found) == sorted(ids)
    assert [(r.page_id, r.refers_to) for r in found if r.record_type == "revisit"] == [("", "zz \r\n")]
