import gzip
import random

from stepwright.llm import warc


def chunked(body: bytes, sizes) -> bytes:
    out, at = b"", 0
    for n in sizes:
        part = body[at : at + n]
        at += n
        if part:
            out += b"%X;ext=1\r\n%b\r\n" % (len(part), part)
    return out + b"0\r\nTrailer: x\r\n\r\n"


HEAD = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: gzip, chunked\r\n\r\n"


def test_decode_chunked_round_trip():
    rng = random.Random(3)
    for _ in range(200):
        body = rng.randbytes(rng.randrange(0, 400))
        sizes = [rng.randrange(1, 90) for _ in range(400)]
        assert warc.decode_chunked(chunked(body, sizes)) == (body, True)
    assert warc.decode_chunked(b"5\r\nabc") == (b"abc", False)
    assert warc.decode_chunked(b"zz\r\n") == (b"", False)
    assert warc.decode_chunked(b"3\r\nabcXX0\r\n\r\n") == (b"abc", False)
    assert warc.decode_chunked(b"") == (b"", False)


def rows(spark, records):
    df = spark.createDataFrame([(*r, "clash", 7) for r in records], warc.RECORDS.removesuffix(", damage string") + ", number string, segments int")
    return {r["record_id"]: r for r in warc.reassemble(df).collect()}


def test_reassembly(spark):
    body = b"x" * 5000
    whole = HEAD + chunked(body, [999] * 6)
    cut = [whole[k : k + 1500] for k in range(0, len(whole), 1500)]
    records = [("a" if k == 0 else f"a{k}", "response" if k == 0 else "continuation", "u" if k == 0 else None, None if k == 0 else "a", k + 1, len(whole) if k == len(cut) - 1 else None, c) for k, c in enumerate(cut)]
    random.Random(1).shuffle(records)
    records += [records[0]]  # a repeated row counts once
    records += [("gap", "response", "g", None, 1, None, b"x"), ("g3", "continuation", None, "gap", 3, 9, b"y")]
    records += [("late", "continuation", None, "lost", 2, 2, b"yy")]
    records += [("short", "response", "s", None, 1, None, b"abc"), ("s2", "continuation", None, "short", 2, 99, b"def")]
    records += [("bad", "response", "b", None, None, None, HEAD + b"5\r\nab")]
    records += [("plain", "resource", None, None, None, None, b"no head"), ("null", None, None, None, None, None, None), (None, "response", "n", None, 1, None, b"left out")]
    records += [("two", "response", "t", None, 1, None, b"b-bytes"), ("two", "response", "t", None, 1, None, b"a-bytes")]
    got = rows(spark, records)
    assert got["a"]["status"] == "ok" and got["a"]["body"] == body and got["a"]["segments"] == len(cut) and got["a"]["length"] == len(whole) and got["a"]["http_status"] == 200 and got["a"]["chunked"]
    assert {k: v["status"] for k, v in got.items()} == {"a": "ok", "gap": "missing_segment", "lost": "missing_segment", "short": "length_mismatch", "bad": "bad_framing", "plain": "ok", "null": "ok", "two": "ok"}
    assert got["plain"]["body"] == b"no head" and got["null"]["body"] == b"" and got["bad"]["body"] is None and got["two"]["body"] == b"a-bytes"
    assert rows(spark, []) == {}


def test_pages_round_trip(spark):
    pages = spark.createDataFrame([(1, "u1", "é" * 9000), (2, None, ""), (3, "u3", None), (None, "u4", "x"), (5, "u5", "a\r\n0\r\n\r\n")], "page_id long, url string, html string")
    got = {r["record_id"]: r for r in warc.reassemble(warc.records_of_pages(pages)).collect()}
    assert {k: (r["status"], bytes(r["body"]).decode(), r["target_uri"]) for k, r in got.items()} == {"urn:page:1": ("ok", "é" * 9000, "u1"), "urn:page:2": ("ok", "", None), "urn:page:3": ("ok", "", "u3"), "urn:page:5": ("ok", "a\r\n0\r\n\r\n", "u5")}


def test_read_files(spark, tmp_path):
    def record(head: dict, block: bytes) -> bytes:
        return b"WARC/1.0\r\n" + b"".join(b"%b: %b\r\n" % (k.encode(), v.encode()) for k, v in (head | {"Content-Length": str(len(block))}).items()) + b"\r\n" + block + b"\r\n\r\n"

    one = record({"WARC-Record-ID": "<a>", "WARC-Type": "response", "WARC-Segment-Number": "1", "WARC-Target-URI": "u"}, b"WARC/ inside ")
    two = record({"WARC-Record-ID": "<b>", "WARC-Type": "continuation", "WARC-Segment-Origin-ID": "<a>", "WARC-Segment-Number": "2", "WARC-Segment-Total-Length": "16"}, b"end")
    (tmp_path / "1.warc").write_bytes(one)
    (tmp_path / "2.warc.gz").write_bytes(gzip.compress(two))
    got = warc.reassemble(warc.read_warc(spark, str(tmp_path))).collect()
    assert [(r["record_id"], r["status"], bytes(r["body"])) for r in got] == [("a", "ok", b"WARC/ inside end")]


def a_record(head: dict, block: bytes) -> bytes:
    return b"WARC/1.0\r\n" + b"".join(b"%b: %b\r\n" % (k.encode(), v.encode()) for k, v in ({"Content-Length": str(len(block))} | head).items()) + b"\r\n" + block + b"\r\n\r\n"


def small(data: bytes, n: int = 7):
    """parse_stream() of data in chunks of n bytes."""
    return list(warc.parse_stream(warc.inflated(data[k : k + n] for k in range(0, len(data), n))))


def test_damaged_files():
    random.seed(4)
    records = [a_record({"WARC-Record-ID": f"<{k}>", "WARC-Type": "response"}, random.randbytes(300)) for k in range(5)]
    whole = [(str(k), None) for k in range(5)]
    names = lambda rows: [(r[0], r[7]) for r in rows]
    plain, zipped = b"".join(records), [gzip.compress(r) for r in records]
    for data in (plain, gzip.compress(plain), b"".join(zipped)):
        for n in (1, 7, 10_000):
            assert names(small(data, n)) == whole
        assert names(list(warc.parse_warc(data))) == whole
    assert small(b"") == [] and small(b"no records here") == [] and small(b"\x1f") == []
    # A file that breaks off: the last record has what there is.
    cut = small(plain[:-100])
    assert names(cut) == [*whole[:4], ("4", "truncated")] and len(cut[4][6]) == 300 - 96
    assert names(small(b"".join(zipped)[:-60])) == [*whole[:4], ("4", "truncated")]
    # Wrong heads: the next record is found.
    for bad in ({"Content-Length": "many"}, {"Content-Length": "-3"}, {"WARC-Segment-Number": "two"}):
        assert names(small(records[0] + a_record({"WARC-Record-ID": "<x>"} | bad, b"block") + records[1])) == [("0", None), ("x", "bad_head"), ("1", None)]
    assert [r[7] for r in small(records[0] + b"WARC/1.0\r\nno end" + b"x" * 70_000)] == [None, "bad_head"]
    # A damaged member: the others are read.
    broken = bytearray(zipped[1])
    broken[60:90] = bytes(30)
    got = names(small(zipped[0] + bytes(broken) + zipped[2]))
    assert got[0] == ("0", None) and got[-1] == ("2", None) and any(d for _, d in got)


def test_damage_fails_no_job(spark, tmp_path):
    good = a_record({"WARC-Record-ID": "<a>", "WARC-Type": "response"}, HEAD + b"0\r\n\r\n")
    (tmp_path / "1.warc").write_bytes(good + a_record({"WARC-Record-ID": "<r>", "WARC-Type": "request"}, b"GET /") + a_record({"WARC-Type": "warcinfo", "WARC-Record-ID": "<i>"}, b"x"))
    (tmp_path / "2.warc.gz").write_bytes(gzip.compress(a_record({"WARC-Record-ID": "<b>", "WARC-Type": "response"}, random.randbytes(5000)))[:-1000])
    (tmp_path / "3.warc").write_bytes(a_record({"WARC-Record-ID": "<c>", "WARC-Type": "response", "Content-Length": "abc"}, b"x"))
    (tmp_path / "4.warc").write_bytes(b"")
    got = {r["record_id"]: r["status"] for r in warc.reassemble(warc.read_warc(spark, str(tmp_path))).collect()}
    assert got == {"a": "ok", "b": "damaged", "c": "damaged"}
