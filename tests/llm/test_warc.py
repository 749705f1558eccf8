"""WARC: round trips, revisits and damage."""

import base64
import gzip
import hashlib
import io
import random

import pytest

from plumbline.llm import warc

SCHEMA = "page_id bigint, url string, html string, digest string, first string, revisit string"


def pages_of():
    rng = random.Random(2)
    html = lambda n: "".join(rng.choice("<p>é日 \r\n\0WARC/1.1") for _ in range(n))
    same, long = html(400), html(300_000)
    rows = [(5, "http://a/b c", same), (3, "http://a/\r\nX: y", same), (9, None, same), (4, "http://é/", long), (6, "u", long), (7, "u", None), (2, "u", ""), (None, "u", same), (8, "u", html(50)), (3, "other", same), (None, "u", html(9)), (11, "u", "x"), (11, "u", "x")]
    return [(*r, "clash", "clash", "clash") for r in rows]


def expected(rows, least=0):
    out = []
    for page_id, _, html, *_ in rows:
        data = (html or "").encode()
        same = [r[0] for r in rows if (r[2] or "") == (html or "")]
        first = min((x for x in same if x is not None), default=None)
        revisit = len(data) >= least and first is not None and first != page_id
        out.append((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least,most", [(0, 1 << 30), (2, 1000)])
def test_round_trip(spark, tmp_path, least, most):
    rows = pages_of()
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    archives = warc.write(table, str(tmp_path / "x"), least=least, archive_bytes=most)
    found = warc.read(archives, keep=True).cache()
    assert sorted(map(tuple, warc.report(found).collect()), key=str) == expected(rows, least)
    kept = [r.payload for r in found.where("type = 'response'").collect()]
    assert {k or b"" for k in kept} == {(r[2] or "").encode() for r in rows}
    assert archives.agg({"records": "sum"}).first()[0] == len(rows)
    for path in [r.path for r in archives.collect()]:  # every member is one record, and plain gzip reads them all
        raw = gzip.open(path).read()
        assert raw.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and raw.endswith(b"\r\n\r\n")


def test_empty_table(spark, tmp_path):
    archives = warc.write(spark.createDataFrame([], SCHEMA), str(tmp_path / "none"))
    assert archives.count() == 0 and warc.report(warc.read(archives)).count() == 0


def all_of(raw, chunk=1 << 16, keep=True):
    f = io.BytesIO(raw)
    return list(warc.records(lambda n: f.read(min(n, chunk)), keep))


def member(k, payload=b"some payload"):
    digest = warc.base32(hashlib.sha1(payload).digest())
    return warc.page_record(k, "http://x/", digest, len(payload), payload, None)


@pytest.mark.parametrize("chunk", [1, 7, 1 << 16])
def test_chunks_of_any_size(chunk):
    data = [bytes([k]) * (50 * k) for k in range(5)]
    raw = b"".join(gzip.compress(member(k, x)) for k, x in enumerate(data))
    found = all_of(raw, chunk)
    assert [x["payload"] or b"" for x in found] == data and all(x["problem"] is None for x in found)
    assert [raw[x["offset"] : x["offset"] + 2] for x in found] == [b"\x1f\x8b"] * 5


@pytest.mark.parametrize(
    "damage,problems",
    [
        (lambda m: m.replace(b"some", b"sOme"), ["block digest"]),
        (lambda m: m.replace(b"Content-Length: 12\r\n\r\n", b"Content-Length: 12\r\n\r\nx"), ["length"]),
        (lambda m: m[:-3], ["length"]),
        (lambda m: m + m, ["length"]),
        (lambda m: b"nothing\r\n\r\n" + m, ["header"]),
        (lambda m: m.replace(b"WARC-Payload-Digest: sha1:", b"WARC-Payload-Digest: sha1:A"), ["payload digest"]),
        (lambda m: b"no empty line", ["header"]),
    ],
)
def test_damaged_records_are_told_and_passed_over(damage, problems):
    found = all_of(gzip.compress(member(1)) + gzip.compress(damage(member(2))) + gzip.compress(member(3)))
    assert [x["problem"] for x in found] == [None, *problems, None]


def test_broken_archives_end():
    good = gzip.compress(member(1))
    assert [x["problem"] for x in all_of(good + good[:-20])] == [None, "truncated"]
    assert [x["problem"] for x in all_of(good + b"rubbish that is no gzip member")] == [None, "gzip"]
    assert all_of(b"") == []


def test_a_damaged_record_is_an_error_of_the_report(spark, tmp_path):
    (tmp_path / "bad.warc.gz").write_bytes(gzip.compress(member(1).replace(b"some", b"sOme")))
    table = spark.createDataFrame([(str(tmp_path / "bad.warc.gz"),)], "path string")
    with pytest.raises(Exception, match="block digest"):
        warc.report(warc.read(table)).collect()
