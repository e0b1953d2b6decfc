"""Salvage within members: bad records, cut and damaged members, many members."""

import random
import time
import zlib

from tidemark.llm import warc


def plain(i, payload=None):
    payload = bytes([65 + i % 26]) * 50 if payload is None else payload
    return zlib.decompress(warc.record_bytes(i, "u", payload, warc.payload_digest(payload), None), 31)


def member(data):
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def told(data):
    got = list(warc.salvage(data))
    return [g[3][0]["warc-record-id"].strip("<>").split(":")[-1] for g in got if g[0] == "record"], [g for g in got if g[0] == "gap"]


def test_one_bad_record_in_a_sound_member():
    bad = plain(1).replace(b"B" * 50, b"B" * 20 + b"x" + b"B" * 29)
    data = member(plain(0) + bad + plain(2)) + member(plain(3))
    ids, gaps = told(data)
    assert ids == ["0", "2", "3"] and len(gaps) == 1 and "digest" in gaps[0][3] and f"bytes {len(plain(0))} to {len(plain(0) + bad)}" in gaps[0][3]
    short = plain(1).replace(b"Content-Length: 50", b"Content-Length: 70")
    assert told(member(plain(0) + short + plain(2)))[0] == ["0", "2"]


def test_cut_member_keeps_what_was_read():
    r = random.Random(1)
    records = [plain(i, r.randbytes(3000)) for i in range(8)]
    whole = member(b"".join(records))
    for cut in (len(whole) // 2, len(whole) - 3):
        ids, gaps = told(whole[:cut] + member(plain(9)))
        assert ids[-1] == "9" and ids[:-1] == [str(i) for i in range(len(ids) - 1)] and len(ids) >= 3 and gaps
    assert told(whole[:-3])[0] == [str(i) for i in range(7)]


def test_damaged_member_keeps_confirmed_records():
    r = random.Random(2)
    whole = bytearray(member(b"".join(plain(i, r.randbytes(40_000)) for i in range(6))))
    whole[len(whole) * 3 // 4] ^= 0xFF
    ids, gaps = told(bytes(whole) + member(plain(7)))
    assert ids[:3] == ["0", "1", "2"] and ids[-1] == "7" and gaps


def test_time_grows_with_the_archive():
    one = b"".join(warc.record_bytes(i, "u", b"p" * 200, warc.payload_digest(b"p" * 200), None) for i in range(20_000))
    start = time.time()
    assert sum(g[0] == "record" for g in warc.salvage(one)) == 20_000
    assert time.time() - start < 20


def test_long_payload_of_one_record():
    payload = b"long " * 3_000_000
    got = list(warc.salvage(warc.record_bytes(1, None, payload, warc.payload_digest(payload), None)))
    assert len(got) == 1 and got[0][3][1] == payload


def foreign(i, body, head=b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n", digest=None, kind="response", block=True):
    """A record as crawlers write them: an HTTP message, the payload digest of its body."""
    message = head + body
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{i}>"), ("WARC-Target-URI", "http://a.example/"), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest or f"sha1:{warc.payload_digest(body)}")]
    fields += [("WARC-Block-Digest", f"sha1:{warc.payload_digest(message)}")] if block else []
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"Content-Length: %d\r\n\r\n" % len(message) + message + b"\r\n\r\n"


def test_http_records_have_their_body_as_payload(spark):
    good = [foreign(0, b"<p>zero"), foreign(1, b"", block=False), foreign(2, b"two", digest="sha256:abc"), foreign(3, b"three", head=b"HTTP/1.0 404\n\n"), foreign(4, b"chunked", digest="sha1:" + "A" * 32)]
    ids, gaps = told(b"".join(good))
    assert ids == ["0", "1", "2", "3", "4"] and not gaps
    bad = foreign(5, b"five").replace(b"five\r", b"fXve\r")
    no_block = foreign(6, b"six", block=False).replace(b"six\r", b"sXx\r")
    ids, gaps = told(member(good[0] + bad + good[3] + no_block + good[2]))
    assert ids == ["0", "3", "2"] and [g[3].split(" (")[0] for g in gaps] == ["block digest doesn't hold", "payload digest doesn't hold"]
    df = spark.createDataFrame([("a", bytearray(b"".join(good[:4])), 1)], "archive string, content binary, part long")
    got = {r["page_id"]: bytes(r["payload"]) for r in warc.read_archives(df).collect()}
    assert got == {0: b"<p>zero", 1: b"", 2: b"two", 3: b"three"}
