from __future__ import annotations

import random
from dataclasses import replace

from pyspark.sql import functions as F

from phraseloom.llm import warc


def test_samples_hold_headers_and_places_all_over_the_record():
    rng = random.Random(1)
    body = b"".join(b"<%06d>" % i for i in range(50_000))
    data = warc.page_record("7", "http://h/7", body, "d" * 40, len(body), None, None, warc.DEFAULTS)
    found = warc.pieces(data, "d" * 40)
    assert len(found) <= warc.DEFAULTS.sample_bytes
    assert b"WARC-Record-ID: <urn:uuid:" in found and b"HTTP/1.1 200 OK" in found and found.endswith(data[-100:])
    held = [i for i in range(50_000) if b"<%06d>" % i in found]
    assert any(1_000 < i < 49_000 for i in held) and found == warc.pieces(data, "d" * 40) != warc.pieces(data, "e" * 40)
    for n in (0, 1, 8191, 8192, 8193, 9000, 20_000):
        some = bytes(rng.randrange(256) for _ in range(n))
        assert len(warc.pieces(some, "x")) <= warc.DEFAULTS.sample_bytes and (n > 8192 or warc.pieces(some, "x") == some)


def test_other_readers_can_resolve_a_revisit(spark, make, tmp_path):
    same = "same page " * 200
    pages = spark.createDataFrame([(1, "http://h/1", same), (2, None, same), (3, "http://h/3", same), (4, "http://h/4", "other")], "page_id long, url string, html string")
    manifest = warc.write_archives(pages, str(tmp_path / "a"))
    records = [(h, b) for r in manifest.collect() for h, b in warc.read_archive(r.path)]
    by_id = {h["WARC-Record-ID"]: (h, b) for h, b in records}
    assert len(by_id) == 4
    for h, b in records:
        assert h["Content-Type"] == "application/http;msgtype=response"
        if h["WARC-Type"] == "revisit":
            target, payload = by_id[h["WARC-Refers-To"]]
            assert (target["X-Page-ID"], payload.decode(), b) == ("3", same, b"")
            assert h["WARC-Refers-To-Target-URI"] == target["WARC-Target-URI"] == "http://h/3"
            assert h["WARC-Refers-To-Date"] == target["WARC-Date"] and target["WARC-Payload-Digest"] == h["WARC-Payload-Digest"]
    assert sorted(h["X-Page-ID"] for h, _ in records if h["WARC-Type"] == "revisit") == ["1", "2"]


def test_hard_rows(spark, hard):
    pages = hard.select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("html"), "spans", "key", "row")
    for name in ("name", "refers", "digest", "payload", "same", "of_id"):
        pages = pages.withColumn(name, F.lit("clash"))
    got = warc.archived(pages, replace(warc.DEFAULTS, sample_records=4)).collect()
    want = {(r.page_id, len((r.html or "").encode())) for r in pages.collect()}
    assert len(got) == pages.count() and {(r.page_id, r.payload_bytes) for r in got} == want
    assert warc.archived(pages.where("false")).collect() == []
