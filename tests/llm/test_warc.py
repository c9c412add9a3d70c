import base64
import collections
import hashlib
import io
import tracemalloc

import pytest
import zstandard

from columnaut.llm import warc as W
from columnaut.llm.common import shared_path


def archive(records, samples=None):
    sink = io.BytesIO()
    writer = W.ArchiveWriter(sink, samples if samples is not None else records)
    for r in records:
        writer.write(r)
    return sink.getvalue()


DATE = "2024-05-06T07:08:09Z"


def record(i, payload=b"<p>text of a page</p>" * 30, refers=None, url="http://a.example/b?c=%20d"):
    payload = payload + str(i).encode()
    return W._record(W.record_id("test", i), i, url, payload, hashlib.sha1(payload).hexdigest(), DATE, refers)


def test_round_trip_with_dictionary():
    records = [record(i) for i in range(300)] + [record(300, refers=(W.record_id("test", 7), 7), url=None), record(None, url="http://é.example/ü \n")]
    raw = archive(records)
    assert raw[:4] == W.DICTIONARY_MAGIC
    assert len(raw) < len(archive(records, []))  # the dictionary is of use
    for chunk in (7, 1 << 20):
        back = list(W.read_archive(io.BytesIO(raw), chunk))
        assert [r for _, r, _ in back] == records and not any(w for *_, w in back)
    last = W.read_record(records[-1])
    assert last["page_id"] is None and last["url"] == "http://é.example/ü \n"
    assert W.read_record(records[-2])["refers_to"] == 7 and W.read_record(records[-2])["payload_bytes"] == 633
    assert W.read_record(records[-2])["refers_to_record"] == W.read_record(records[7])["record_id"] and W.read_record(records[-2])["url"] is None
    assert W.read_record(records[0])["url"] == "http://a.example/b?c=%20d" and W.read_record(records[0])["date"] == DATE
    assert W.read_record(record(1, url="urn:unknown"))["url"] == "urn:unknown" and W.read_record(record(1, url=""))["url"] == ""
    assert b"WARC-Target-URI: http://a.example/b?c=%20d\r\n" in records[0] and archive(records[:2])[:4] == W.ZSTD_MAGIC


def test_damage_is_reported_and_the_rest_read():
    records = [record(i) for i in range(50)]
    raw = bytearray(archive(records))
    places = [p for p, *_ in W.read_archive(io.BytesIO(bytes(raw)))]
    raw[places[10] + 12] ^= 255
    back = list(W.read_archive(io.BytesIO(bytes(raw))))
    assert [r for _, r, w in back if w is None] == records[:10] + records[11:]
    assert any(w for _, _, w in back)
    cut = list(W.read_archive(io.BytesIO(bytes(raw[: places[20] + 5]))))
    assert cut[-1][1] is None and "cut off" in cut[-1][2]


@pytest.mark.parametrize("old,new,what", [(b"WARC/1.1", b"WARD/1.1", "version"), (b"Content-Length: 7", b"Content-Length: 8", "match"), (b"WARC-Type", b"WARC-Tipe", "missing"), (b"<p>text", b"<q>text", "digest"), (b"WARC-Date: 2024", b"WARC-Date: year", "date"), (b"WARC-Date:", b"WARC-Then:", "missing"), (b"HTTP/1.1 200", b"HTTQ/1.1 200", "HTTP")])
def test_validation(old, new, what):
    good = record(1)
    W.read_record(good)
    assert old in good
    with pytest.raises(ValueError, match=what):
        W.read_record(good.replace(old, new, 1))


def foreign(kind, block, content_type, *more, version="WARC/1.0", end=b"\r\n\r\n"):
    head = [version, f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{kind}-1>", "WARC-Date: 2019-03-18T21:45:07Z", *more, f"Content-Type: {content_type}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + end


def test_archives_of_others():
    """Records shaped as public crawlers write them."""
    html, http = b"<html>page</html>", "application/http; msgtype=response"
    base32 = lambda x, a=hashlib.sha1: base64.b32encode(a(x).digest()).decode()
    chunks = b"7\r\n<html>p\r\n" b"A;ext=1\r\nage</html>\r\n0\r\n\r\n"
    ok = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n"
    cases = {
        "warcinfo": (foreign("warcinfo", b"software: crawler/1.0\r\nformat: WARC File Format 1.0\r\n", "application/warc-fields", "WARC-Filename: x.warc.gz"), None),
        "request": (foreign("request", b"GET / HTTP/1.1\r\nHost: a.example\r\n\r\n", "application/http; msgtype=request", "WARC-Target-URI: http://a.example/"), b""),
        "metadata": (foreign("metadata", b"fetchTimeMs: 12\r\n", "application/warc-fields", "WARC-Concurrent-To: <urn:uuid:response-1>"), b"fetchTimeMs: 12\r\n"),
        "conversion": (foreign("conversion", "plain text é".encode(), "text/plain", f"WARC-Block-Digest: sha1:{base32('plain text é'.encode())}"), "plain text é".encode()),
        "resource": (foreign("resource", b"x" * 70_000, "image/png", f"WARC-Payload-Digest: sha256:{hashlib.sha256(b'x' * 70_000).hexdigest()}"), b"x" * 70_000),
        "dns": (foreign("response", b"20190318\r\na.example. 300 IN A 10.0.0.1\r\n", "text/dns", "WARC-Target-URI: dns:a.example"), b"20190318\r\na.example. 300 IN A 10.0.0.1\r\n"),
        "no length": (foreign("response", ok + b"\r\n" + html, http), html),
        "length and digest": (foreign("response", ok + b"Content-Length: 17\r\n\r\n" + html, http, f"WARC-Payload-Digest: sha1:{base32(html)}", "WARC-IP-Address: 10.0.0.1"), html),
        "chunked": (foreign("response", ok + b"Transfer-Encoding: chunked\r\n\r\n" + chunks, http, f"WARC-Payload-Digest: sha1:{base32(html)}"), html),
        "chunked, digest as it stands": (foreign("response", ok + b"Transfer-Encoding: chunked\r\n\r\n" + chunks, http, f"WARC-Payload-Digest: sha1:{base32(chunks)}"), html),
        "folded header": (foreign("response", ok + b"X-A: b\r\n  c\r\n\r\n" + html, http, "X-Long: one\r\n two"), html),
        "unknown digest": (foreign("response", ok + b"\r\n" + html, http, "WARC-Payload-Digest: blake3:abc"), html),
        "truncated": (foreign("response", ok + b"Content-Length: 99\r\n\r\n" + html, http, "WARC-Truncated: length"), html),
        "future": (foreign("annotation", b"{}", "application/json", version="WARC/1.2"), b"{}"),
    }
    raw = archive([r for r, _ in cases.values()], [])
    assert raw[:4] == W.ZSTD_MAGIC
    for (name, (record, payload)), (_, back, wrong) in zip(cases.items(), W.read_archive(io.BytesIO(raw), 13)):
        assert back == record and wrong is None
        for given in (record, [record[i : i + 5] for i in range(0, len(record), 5)]):
            got = W.read_record(given)
            assert got["record_id"].startswith("urn:uuid:") and got["page_id"] is None
            if payload is not None:
                assert got["payload"] == payload and got["payload_digest"] == hashlib.sha1(payload).hexdigest(), name
        assert W.read_record(record, payloads=False)["payload"] is None
    revisit = foreign("revisit", b"", http, "WARC-Refers-To: <urn:uuid:response-1>", f"WARC-Payload-Digest: sha1:{base32(html)}")
    got = W.read_record(revisit)
    assert (got["refers_to_record"], got["payload_bytes"], got["payload_digest"]) == ("urn:uuid:response-1", None, hashlib.sha1(html).hexdigest())
    for bad in (foreign("response", ok + b"\r\n" + html, http, f"WARC-Payload-Digest: sha1:{base32(b'other')}"), foreign("revisit", b"", http), foreign("response", ok, http), foreign("response", ok + b"\r\n" + html, http, end=b"")):
        with pytest.raises(ValueError):
            W.read_record(bad)


def test_large_records_are_streamed():
    """A frame that expands to 300 MB is checked without being held."""
    zeros = zstandard.ZstdCompressor().compressobj()
    head = foreign("resource", b"", "text/plain", end=b"").replace(b"Content-Length: 0", b"Content-Length: %d" % (300 << 20))
    frame = b"".join([zeros.compress(head), *(zeros.compress(bytes(1 << 20)) for _ in range(300)), zeros.compress(b"\r\n\r\n"), zeros.flush()])
    tracemalloc.start()
    frames = W.Frames(io.BytesIO(frame + archive([record(1)], [])))
    got = [W.read_record(chunks, payloads=False) for _, chunks in frames]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [r["payload_bytes"] for r in got] == [300 << 20, 631] and peak < 40 << 20


@pytest.mark.parametrize("broadcast_rows", [500_000, 0])
def test_pages(spark, tmp_path, broadcast_rows):
    big = "é" * 600
    rows = [(1, "u", big), (2, "u", big), (5, None, big), (3, "u", "small"), (4, "u", "small"), (6, "u", None), (7, "u", ""), (8, "u", "x" * 2_000_000), (9, "v", "y" * 999), (10, "v", "y" * 999), (11, "v", "y" * 1000), (11, "v", "y" * 1000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'a' as digest", "1 as id", "2 as place")
    pages.repartition(3).write.parquet(str(tmp_path / "pages"))
    pages = spark.read.parquet(str(tmp_path / "pages"))
    folder = shared_path(spark, "warc-test")
    written = W.write_archives(pages, folder, broadcast_rows=broadcast_rows)
    assert sum(r.records for r in written.collect()) == len(rows)
    got = collections.defaultdict(list)
    for r in W.read_archives(written).collect():
        assert r.wrong is None
        got[r.page_id].append(r)
    html = {i: (h or "").encode() for i, _, h in rows}
    for i, rs in got.items():
        for r in rs:
            assert (r.payload_bytes, r.payload_digest) == (len(html[i]), hashlib.sha1(html[i]).hexdigest())
            assert r.payload is None or r.payload == html[i]
    kinds = {i: (rs[0].record_type, rs[0].refers_to) for i, rs in got.items()}
    assert kinds == {1: ("revisit", 5), 2: ("revisit", 5)} | {i: ("response", None) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11)}
    assert len(got[11]) == 2 and got[5][0].url is None
    ids = [r.record_id for rs in got.values() for r in rs]
    assert len(set(ids)) == len(ids) and {r.refers_to_record for i in (1, 2) for r in got[i]} == {got[5][0].record_id}
    assert W.read_archives(W.write_archives(pages.limit(0), folder + "x")).count() == 0
