import gzip
import io
import zlib

import pytest

from glyphmill.llm import warc as W


def pages(n):
    return [(i, f"http://x.example/{i}", f"<p>page {i} 中</p>\r\n\r\nWARC/1.1\r\n\r\n" * (i % 7)) for i in range(n)]


def write(path, records, members=False):
    data = b"".join(gzip.compress(r) for r in records) if members else gzip.compress(b"".join(records))
    path.write_bytes(data)
    return f"file://{path}"


@pytest.mark.parametrize("members", [False, True])
def test_round_trip(tmp_path, members):
    records = [W.page_record(*p) for p in pages(300)]
    rows = W.normalise_file(write(tmp_path / "a.warc.gz", records, members), f"file://{tmp_path}/out") if (tmp_path / "out").mkdir() is None else []
    out = (tmp_path / "out" / rows[0][1]).read_bytes()
    assert gzip.decompress(out) == b"".join(records)
    assert len(rows) == 300
    offset = 0
    for row, record in zip(rows, records, strict=True):
        assert row[3] == offset
        assert W.read_member(f"file://{tmp_path}/out", row[1], row[3], row[4]) == record
        offset += row[4]
    assert offset == len(out)
    index = (tmp_path / "out" / (rows[0][1] + ".idx")).read_text().splitlines()
    assert len(index) == 300 and '"offset": 0' in index[0]


def test_records_larger_than_a_chunk(tmp_path):
    big = "x y" * 3_000_000
    records = [W.page_record(1, "u", big), W.page_record(2, None, None), W.page_record(None, "a\r\nb", "z")]
    got = list(W.records(io.BytesIO(gzip.compress(b"".join(records)))))
    assert [r for _, r, _ in got] == records
    assert got[0][2].endswith(big[-50:].encode())


@pytest.mark.parametrize("inside", range(6))
def test_a_chunk_that_ends_in_the_closing_blank_lines(inside):
    def padded(i, size):
        bare = len(W.page_record(i, "u", "x" * 10**6)) - 10**6  # the lengths in the headers have seven digits
        return W.page_record(i, "u", "x" * (size - bare))

    first = padded(1, W.CHUNK + 1000)
    records = [first, padded(2, 4 * W.CHUNK - len(first) + inside), *(W.page_record(i, f"v{i}", f"page {i}") for i in range(3, 60))]
    assert len(records[0]) + len(records[1]) == 4 * W.CHUNK + inside
    got = list(W.records(io.BytesIO(gzip.compress(b"".join(records)))))
    assert [r for _, r, _ in got] == records
    assert all(r.endswith(b"\r\n\r\n" + p + b"\r\n\r\n") for _, r, p in got)


def packed(data):
    return gzip.compress(data, mtime=0)


@pytest.mark.parametrize(("data", "whole", "errors"), [
    (b"", 0, 0),
    (packed(b""), 0, 0),
    (b"not gzip", 0, 1),
    (packed(W.page_record(1, "u", "a") + b"junk\r\n\r\n"), 1, 1),
    (packed(W.page_record(1, "u", "a") + W.page_record(2, "u", "b")[:-30]), 1, 1),
    (packed(W.page_record(1, "u", "a") * 2)[:-12], None, 1),
    (packed(b"WARC/1.1\r\nContent-Length: x\r\n\r\n"), 0, 1),
    (packed(W.page_record(1, "u", "a")) + b"\0" * 100, 1, 0),
    (packed(b"\r\n" * 9), 0, 0),
])
def test_broken_files(tmp_path, data, whole, errors):
    (tmp_path / "b.warc.gz").write_bytes(data)
    (tmp_path / "out").mkdir()
    rows = W.normalise_file(f"file://{tmp_path}/b.warc.gz", f"file://{tmp_path}/out")
    good = [r for r in rows if r[10] is None]
    assert whole is None or len(good) == whole
    assert len(rows) - len(good) == errors
    for r in good:
        assert W.read_member(f"file://{tmp_path}/out", r[1], r[3], r[4]).startswith(b"WARC/")


def by_hand(data):
    """The records of inflated bytes: each from its header's end on by its length, then what is blank."""
    out, at = [], 0
    while at < len(data):
        begin = at
        while data[at : at + 1] in (b"\r", b"\n"):
            at += 1
        head = data.index(b"\r\n\r\n", at) + 4
        size = next(int(x.split(b":")[1]) for x in data[at:head].split(b"\r\n") if x.lower().startswith(b"content-length"))
        at = head + size
        payload = data[head:at]
        while data[at : at + 1] in (b"\r", b"\n"):
            at += 1
        out.append((data[begin:at], payload))
    return out


def test_blank_bytes_stay(tmp_path):
    import random

    r = random.Random(1)
    (tmp_path / "out").mkdir()
    for k in range(20):
        records = [W.page_record(i, "u", "x" * r.randrange(50)).rstrip(b"\r\n") + r.choice((b"\r\n", b"\n", b"\r\n\r\n")) * r.randint(1, 9) for i in range(30)]
        if k == 0:
            records[3] += b"\r\n" * 3_000_000  # more than is held at once
        data = r.choice((b"", b"\r\n", b"\n\n\r\n")) + b"".join(records)
        got = list(W.records(io.BytesIO(packed(data))))
        assert [(x, p) for _, x, p in got] == by_hand(data)
        rows = W.normalise_file(write(tmp_path / f"{k}.warc.gz", [data]), f"file://{tmp_path}/out")
        assert len(rows) == 30 and gzip.decompress((tmp_path / "out" / rows[0][1]).read_bytes()) == data


def test_pages(spark):
    rows = [*pages(200), (None, None, None), (5, "u", ""), (5, "u", "")]
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, offset string, path string")
    out = W.normalise_pages(table.repartition(3)).collect()
    assert len(out) == len(rows)
    assert sorted((r["page_id"], r["payload_length"]) for r in out if r["page_id"] is not None) == sorted((p, len(W.page_record(p, u, h)) - W.page_record(p, u, h).index(b"HTTP/1.1") - 4) for p, u, h in rows if p is not None)
    assert not [r for r in out if r["error"]]
    assert W.normalise_pages(table.limit(0)).count() == 0


def test_members_inflate_alone():
    record = W.page_record(1, "u", "text")
    assert zlib.decompress(W.member(record), 31) == record
    assert W.member(record) == W.member(record)
