import base64
import hashlib

from harrow.llm import core, warc

ROWS = [
    (1, "http://a.example/x?y#z", "<p>one</p>"),
    (2, None, "<p>one</p>"),
    (3, "http://b.example/ sp\r\nace", None),
    (4, "http://b.example", ""),
    (9, "http://c.example/é", "é\r\n\r\nWARC/1.1\r\nx" * 3),
    (8, "u", "é\r\n\r\nWARC/1.1\r\nx" * 3),
    (7, "v", "long " * 40000),
    (7, "v", "long " * 40000),
    (None, "w", "long " * 40000),
    (None, "w", "none"),
]


def test_round_trip(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.digest_rows(df).collect()), key=str)
    want, seen = [], set()
    first = {}
    for p, _, h in ROWS:
        if p is not None:
            first[h or ""] = min(first.get(h or "", p), p)
    for p, _, h in ROWS:
        raw = (h or "").encode()
        again = p is not None and (first[h or ""] != p or (p, h) in seen)
        seen.add((p, h))
        want.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None))
    assert got == sorted(want, key=str)


def test_nested_captures(spark):
    df = spark.createDataFrame(ROWS[:5], "page_id long, url string, html string")
    path = core.new_path(spark, "t")
    warc.write_captures(df, path, zipped=False)
    records = warc.read_records(spark, path)
    rows = warc.assemble(records).collect()
    assert len(rows) == 5 and all(r.request.type == "request" and r.metadata.fields.startswith("page: ") for r in rows)
    assert sorted(bytes(r.main.payload).decode() for r in rows if r.main.type == "response") == sorted(["<p>one</p>", "", ROWS[4][2]])


def test_small_payloads_stay_and_empty(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    assert {r.record_type for r in warc.digest_rows(df.where("page_id < 5"), min_bytes=100).collect()} == {"response"}
    assert warc.digest_rows(df.limit(0)).count() == 0


def test_members_and_pieces(spark, monkeypatch):
    """A gzip member a record, files bounded by bytes; readable by any gzip reader, however it was cut."""
    import gzip
    import random
    import zlib

    rng = random.Random(1)
    pages = [(i, f"http://x/{i}", "".join(rng.choice("abcdefgh ") for _ in range(rng.choice([10, 3000])))) for i in range(60)]
    monkeypatch.setattr(warc, "PIECE_BYTES", 4000)
    monkeypatch.setattr(warc, "FILE_PIECES", 2)
    path = core.new_path(spark, "t")
    warc.write_captures(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), path)
    files = [bytes(r.content) for r in spark.read.format("binaryFile").load(path).collect()]
    assert len(files) > 2 and sum(gzip.decompress(f).count(b"WARC/1.1\r\n") for f in files) == 180
    n, data = 0, files[0]
    while data:
        member = zlib.decompressobj(31)
        assert member.decompress(data).startswith(b"WARC/1.1\r\n")
        n, data = n + 1, member.unused_data
    assert n == gzip.decompress(files[0]).count(b"WARC/1.1\r\n")
    whole = gzip.decompress(files[0])
    want = list(warc.parse(files[0], True))
    for step in (1, 7, 1 << 20):
        monkeypatch.setattr(warc, "STEP_BYTES", step)
        assert list(warc.parse(files[0], True)) == list(warc.parse(whole, True)) == list(warc.parse(gzip.compress(whole), True)) == want


def test_large_records():
    import pyarrow as pa

    big = "x" * (17 << 20)
    out = list(warc._pieces(iter([pa.RecordBatch.from_arrays([pa.array([big, "y"])], ["value"])])))
    data = b"".join(r.as_py() + b"\0" for b in out for r in b.column(0))
    assert b"".join(warc.inflated(data)) == (big + "\r\n\r\n" + "y\r\n\r\n").encode()


def test_broken_archives():
    import pytest

    for bad in (b"what is this", b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc"):
        with pytest.raises(ValueError):
            list(warc.parse(bad, True))
