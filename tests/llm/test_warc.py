import base64
import hashlib
import random

import pytest
import zstandard

from clickfold.llm import queries, warc

PAGES = "page_id long, url string, html string, refers_to long"


def odd_pages():
    rng = random.Random(2)
    rows = [(i, f"http://h{i % 7}.example/ü {i}\r\nX: 1", f"<p>{i % 40 if i % 3 == 0 else i}</p>" + "é" * rng.randint(0, 300), 0) for i in range(400)]
    rows += [(1000 + i, None, "<html>same</html>", 0) for i in range(150)]
    rows += [(2000, "", None, 0), (2001, None, "", 0), (2002, "u", "x\r\n\r\ny", 0), (2003, "u", "z" * 700_000, 0), (2003, "u", "z" * 700_000, 0), (None, "u", "<html>same</html>", 0), (None, "u", "alone", 0)]
    return rows


def expected(rows):
    largest = {}
    for p, _, html, _ in rows:
        if p is not None:
            largest[html or ""] = max(largest.get(html or "", p), p)
    out = []
    for p, _, html, _ in rows:
        raw = (html or "").encode()
        top = largest.get(html or "")
        again = top is not None and (p is None or p < top)
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((p, len(raw), digest, "revisit" if again else "response", top if again else None))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    rows = odd_pages()
    spark.createDataFrame(rows, PAGES).repartition(4).write.parquet(f"{tmp_path}/pages.parquet")
    got = [tuple(r) for r in queries.op9_warc(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == expected(rows)


def test_payloads_and_urls_come_back(spark, tmp_path):
    rows = odd_pages()
    path = f"{tmp_path}/out"
    warc.write_archives(spark.createDataFrame(rows, PAGES), path, frame_bytes=2000, bundle_bytes=9000)
    html = {p: h or "" for p, _, h, _ in rows}
    back = warc.read_archives(spark, path, payloads=True).collect()
    assert len(back) == len(rows)
    for r in back:
        if r["record_type"] == "response" and r["page_id"] is not None:
            assert r["payload"].decode() == html[r["page_id"]]
        if r["url"] is not None:
            assert "\n" not in r["url"]
    some = warc.read_archives(spark, path, page_ids={5, 2002}).collect()
    assert sorted(r["page_id"] for r in some) == [5, 2002]


def test_one_page_opens_one_file_and_one_frame(spark, tmp_path):
    path = tmp_path / "out"
    warc.write_archives(spark.createDataFrame(odd_pages(), PAGES), str(path), frame_bytes=2000, bundle_bytes=9000)
    warc.record_places(spark, str(path)).write.parquet(f"{tmp_path}/places")
    places = spark.read.parquet(f"{tmp_path}/places")
    assert places.count() == len(odd_pages())
    r = places.where("page_id = 7").first()
    for f in sorted(path.glob("part-*")):  # all but the page's own frame becomes unreadable
        raw = bytearray(f.read_bytes())
        keep = range(r["frame_start"], r["frame_start"] + r["frame_bytes"]) if r["file"].endswith(f.name) else range(0)
        held = bytes(raw[keep.start : keep.stop])
        raw[:] = b"x" * len(raw)
        raw[keep.start : keep.stop] = held
        f.write_bytes(bytes(raw))
        if (crc := path / f".{f.name}.crc").exists():
            crc.unlink()
    (got,) = warc.read_record(spark, places, 7)
    assert got["page_id"] == 7 and got["payload"].decode() == {p: h for p, _, h, _ in odd_pages()}[7]
    assert warc.read_record(spark, places, -5) == []


def test_files_are_seekable_zstd(spark, tmp_path):
    path = tmp_path / "out"
    warc.write_archives(spark.createDataFrame(odd_pages(), PAGES).coalesce(1), str(path), frame_bytes=3000, bundle_bytes=6000)
    files = sorted(path.glob("part-*"))
    assert len(files) > 3
    for f in files:
        raw = f.read_bytes()
        assert raw[-4:] == bytes.fromhex("b1ea928f")
        # any zstd reader sees the records, skippable frames aside
        plain = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
        reader = warc.BundleReader(raw)
        assert plain == b"".join(reader.frame(k) for k in range(len(reader.frames)))
        assert plain.startswith(b"WARC/1.1\r\n")


def test_smaller_payloads_are_all_responses(spark, tmp_path):
    rows = [(i, None, "same" if i < 5 else "longer same", 0) for i in range(10)]
    warc.write_archives(spark.createDataFrame(rows, PAGES), f"{tmp_path}/out", min_revisit_bytes=6)
    got = {r["page_id"]: r["record_type"] for r in warc.read_archives(spark, f"{tmp_path}/out").collect()}
    assert [i for i, t in got.items() if t == "revisit"] and all(got[i] == "response" for i in range(5)) and got[9] == "response"


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], PAGES).write.parquet(f"{tmp_path}/pages.parquet")
    assert queries.op9_warc(spark, str(tmp_path)).collect() == []


def test_damaged_payload_is_noticed():
    raw = warc.record(1, "u", b"payload", None)
    assert warc.parse_record(raw)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parse_record(raw.replace(b"payload\r\n", b"pAyload\r\n"))
