import gzip
import hashlib
import io
import random

import pytest

from ledgerloom.llm import warc

PAGES = "page_id long, url string, html string, kind string, digest string, payload string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], PAGES)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(1)
    big = "".join(draw.choices("abcdé\r\n <>", k=90_000))
    same = "<p>" + "s" * 200
    return [
        (1, "http://a/1", big), (2, "http://a/2", big), (3, "http://a/3", big + "!"), (9, None, same), (4, "u", same),
        (5, "u", None), (6, "u", ""), (7, "a b\r\nWARC-Type: x", "short"), (8, "u", "short"), (None, "u", same),
        (10, "u", "é\r\n\r\n0\r\n\r\nWARC/1.1\r\n" * 40), (4, "u", same), (1, "http://a/1", big), (None, "n", "n" * 300),
    ]


def expected(rows):
    first = {}
    for i, _, html in rows:
        raw = (html or "").encode()
        if len(raw) >= 100 and i is not None:
            first[raw] = min(first.get(raw, i), i)
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        lead = first.get(raw) if len(raw) >= 100 else None
        later = lead is not None and lead != i
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if later else "response", lead if later else None, True))
    return sorted(out, key=str)


def read(spark, path):
    found = warc.read_archives(spark, path)
    return sorted((tuple(r) for r in found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact").collect()), key=str)


def test_pages_come_back(spark, rows, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archives(pages(spark, rows), path)
    assert read(spark, path) == expected(rows)
    payloads = {r["page_id"]: r["payload"] for r in warc.read_archives(spark, path).filter("record_type = 'response'").collect()}
    assert bytes(payloads[3]).decode() == rows[2][2] and payloads[5] == b""


def test_archives_are_plain_records(spark, rows, tmp_path):
    path = tmp_path / "w"
    warc.write_archives(pages(spark, rows), str(path))
    kinds, longest = [], 0
    for file in path.glob("*.gz"):
        for fields, block in warc._read_records(io.BytesIO(gzip.decompress(file.read_bytes()))):
            kinds.append(fields["warc-type"])
            longest = max(longest, len(block))
    assert kinds.count("continuation") >= 9 and longest <= warc.SEGMENT_BYTES


def test_a_missing_segment_is_told(spark, rows, tmp_path):
    path, broken = tmp_path / "w", tmp_path / "b"
    warc.write_archives(pages(spark, rows[2:3]).coalesce(1), str(path))
    broken.mkdir()
    for n, file in enumerate(path.glob("*.gz")):
        raw = gzip.decompress(file.read_bytes())
        parts = raw.split(b"WARC/1.1\r\n")
        (broken / f"{n}.gz").write_bytes(gzip.compress(b"WARC/1.1\r\n".join([*parts[:2], *parts[3:]])))
    found = read(spark, str(broken))
    assert [r[0] for r in found] == [3] and found[0][1] is None and found[0][-1] is False


def test_hundreds_of_segments(spark, tmp_path):
    draw = random.Random(2)
    text = "".join(draw.choices("abcdé\r\n <>", k=60_000)) * 170
    rows = [(1, "u", text), (2, "u", text + "!"), (3, "u", text)]
    path = tmp_path / "w"
    warc.write_archives(pages(spark, rows), str(path))
    numbers = [
        int(line.split(b":")[1])
        for f in path.glob("*.gz")
        for line in gzip.open(f).read().split(b"\r\n")
        if line.lower().startswith(b"warc-segment-number")
    ]
    assert max(numbers) > 300
    assert read(spark, str(path)) == expected(rows)


def test_empty_table(spark, tmp_path):
    warc.write_archives(pages(spark, []), str(tmp_path / "w"))
    assert read(spark, str(tmp_path / "w")) == []


def test_chunked_framing():
    for size in (0, 1, warc.CHUNK_BYTES, 3 * warc.CHUNK_BYTES + 5):
        payload = random.Random(size).randbytes(size)
        assert warc.unchunked(warc.chunked(payload)) == payload
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabcdefg\r\n0\r\n\r\n")
