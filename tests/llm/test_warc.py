from __future__ import annotations

import base64
import hashlib
import io
import zlib

import pytest
from pyspark.sql import functions as F

from slipstack.llm import warc


def archive(payloads, **more):
    return b"".join(warc.member(warc.record("response", f"urn:page:{i}", "http://x/", len(p), warc.base32_sha1(p), p)) for i, p in enumerate(payloads))


def test_read_back_of_chunks_of_any_size(monkeypatch):
    payloads = [b"", b"a", b"\r\n\r\n" * 50, bytes(range(256)) * 3000, b"WARC/1.1\r\n\r\n"]
    data = archive(payloads)
    for chunk in (7, 1 << 16):
        monkeypatch.setattr(warc, "CHUNK", chunk)
        rows = list(warc.read_archive(io.BytesIO(data)))
        assert [r["payload"] for r in rows] == payloads and not any(r["error"] for r in rows)
        members = [zlib.decompressobj(31).decompress(data[r["offset"] :])[:8] for r in rows]
        assert members == [b"WARC/1.1"] * len(rows)


def test_damage_is_named():
    data = archive([b"one" * 100, b"two" * 100, b"three"])
    second = list(warc.read_archive(io.BytesIO(data)))[1]["offset"]
    assert "ends inside" in list(warc.read_archive(io.BytesIO(data[:-3])))[-1]["error"]
    broken = bytearray(data)
    broken[second + 15] ^= 0xFF
    rows = list(warc.read_archive(io.BytesIO(bytes(broken))))
    assert rows[0]["error"] is None and rows[1]["error"] and len(rows) == 2
    record = warc.record("response", "urn:page:1", "http://x/", 3, warc.base32_sha1(b"abc"), b"abc")
    wrong = record.replace(b"\r\n\r\nabc", b"\r\n\r\nabd")
    (row,) = warc.read_archive(io.BytesIO(warc.member(wrong)))
    assert row["error"] == "block digest does not match"
    short = record.replace(b"Content-Length: 3", b"Content-Length: 4", 1)
    (row,) = warc.read_archive(io.BytesIO(warc.member(short)))
    assert row["error"]
    (row,) = warc.read_archive(io.BytesIO(warc.member(record + record)))
    assert "more than one" in row["error"]


def test_round_trip_with_copies_nulls_and_repeats(spark):
    pages = [(1, "http://a/\n x", "same"), (9, None, "same"), (5, "http://b", "same"), (2, "u", None), (3, "u", ""), (4, "u", "é" * 70000), (9, None, "same"), (None, "u", "same")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("size", F.lit(0))
    out = sorted(map(tuple, warc.round_trip(df).collect()), key=str)
    want = []
    for i, _, h in pages:
        data = (h or "").encode()
        same = [j for j, _, g in pages if (g or "") == (h or "") and j is not None]
        best = max(same) if i is not None else None
        revisit = i is not None and i < best
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", best if revisit else None))
    assert out == sorted(want, key=str)
    assert warc.round_trip(df.limit(0)).collect() == []


def test_small_payloads_stay_responses(spark):
    df = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "aaaa"), (4, "u", "aaaa")], "page_id long, url string, html string")
    roles = {r.page_id: r.response_id for r in warc.with_roles(df, 3).collect()}
    assert roles == {1: None, 2: None, 3: 4, 4: None}


def test_archives_roll(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", str(i) * 500) for i in range(30)], "page_id long, url string, html string").coalesce(1)
    archives = warc.write_archives(df, f"file://{tmp_path}/w", roll=400)
    assert archives.count() > 3 and archives.agg(F.sum("records")).first()[0] == 30
    back = warc.read_archives(archives, f"file://{tmp_path}/w")
    assert {bytes(r.payload).decode() for r in back.collect()} == {str(i) * 500 for i in range(30)}


def test_damage_fails_the_query(spark, tmp_path):
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "x.warc.gz").write_bytes(archive([b"abc"])[:-4])
    rows = spark.createDataFrame([(f"{tmp_path}/w/x.warc.gz", 1)], "path string, records long")
    assert warc.read_archives(rows, f"file://{tmp_path}/w").first()["error"]
    # Failing does not depend on the columns that are read.
    for path, records in (("x", 1), ("y", 2)):
        (tmp_path / "w" / "y.warc.gz").write_bytes(archive([b"abc"]))
        rows = spark.createDataFrame([(f"{tmp_path}/w/{path}.warc.gz", records)], "path string, records long")
        with pytest.raises(Exception, match="ends inside|1 records read, 2 written"):
            warc.read_archives(rows, f"file://{tmp_path}/w", strict=True).select("record_type").count()
    with pytest.raises(ValueError):
        warc.Member(io.BytesIO(b""), b"").until(b"x")
    with pytest.raises(ValueError, match="not a record"):
        warc.Member(io.BytesIO(warc.member(b"other" * 100_000)), b"").until(b"\r\n\r\n", warc.VERSION)


def test_heads_of_any_length(spark):
    df = spark.createDataFrame([(1, "http://a/" + "x" * 2_000_000, "one"), (2, "http://b", "two")], "page_id long, url string, html string").coalesce(1)
    assert warc.round_trip(df).count() == 2
    assert {r.page_id: r.payload_bytes for r in warc.round_trip(df).collect()} == {1: 3, 2: 3}
