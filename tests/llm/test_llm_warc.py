import io
import hashlib

import pytest
import zstandard

from lexframe.llm import warc


def page_rows(spark):
    big, other = "<p>é" + "x" * 1500 + "</p>", "y" * 1200
    rows = [
        (1, "http://a/1", big, 1), (2, "http://a/2", big, 1), (7, "http://a/7 b\r\nX: y", big, 1), (7, None, big, 2),
        (3, "http://a/3", other, 1), (4, None, "short", 1), (5, "", "short", 1), (6, "http://a/6", None, 1),
        (None, "http://a/n", big, None), (None, None, "", 1),
    ] + [(100 + k, f"http://b/{k}", "z" * 700 + str(k) * 900, 0) for k in range(300)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, record_type int"), rows


def test_round_trip(spark):
    pages, rows = page_rows(spark)
    manifest = warc.write_archives(warc.plan_records(pages.repartition(2)))
    read = warc.read_archives(manifest).collect()
    assert len(read) == len(rows) == sum(r["records"] for r in manifest.collect())
    want = []
    for page_id, _, html, _ in rows:
        payload = (html or "").encode()
        top = max((p for p, _, h, _ in rows if h == html and p is not None), default=None) if len(payload) >= 1000 else None
        copies = sum(h == html for _, _, h, _ in rows)
        revisit = copies > 1 and top is not None and page_id != top
        want.append((page_id, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response",
                     top if revisit else None, None if revisit else payload))
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"],
            None if r["payload"] is None else bytes(r["payload"])) for r in read]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {r["url"] for r in read if r["page_id"] == 7} == {"http://a/7%20b%0D%0AX:%20y", None}


def test_files_are_plain_archives(spark):
    manifest = warc.write_archives(warc.plan_records(page_rows(spark)[0].coalesce(1))).collect()
    for row in manifest:
        with open(row["path"].removeprefix("file://"), "rb") as file:
            data = file.read()
        assert len(data) == row["bytes"] and len(list(warc.frames(io.BytesIO(data)))) == row["records"]


def test_no_pages_no_archives(spark):
    pages = page_rows(spark)[0].limit(0)
    manifest = warc.write_archives(warc.plan_records(pages))
    assert manifest.count() == 0 and warc.read_archives(manifest).count() == 0


def archive(n=400):
    stream = io.BytesIO()
    stream.close = lambda: None
    writer = warc.ArchiveWriter(stream)
    for k in range(n):
        payload = (f"<html><body>{k} " + "some words that come again and again " * 40).encode()
        writer.add(warc.record({
            "page_id": k, "url": f"http://x/{k}", "payload": payload, "digest": hashlib.sha1(payload).hexdigest(),
            "response_id": None, "revisit": False,
        }))
    writer.close()
    return stream.getvalue()


def test_dictionary_is_leading_and_frames_are_records():
    data = archive()
    assert int.from_bytes(data[:4], "little") == warc.SKIPPABLE_DICTIONARY
    found = list(warc.frames(io.BytesIO(data), chunk=1000))
    assert [warc.parse_record(d)["page_id"] for _, d in found] == list(range(400))
    size = int.from_bytes(data[4:8], "little")
    offset, frame = found[7]
    alone = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8:8 + size]))
    assert alone.decompressobj().decompress(data[offset:found[8][0]]) == frame


def test_compressed_dictionary_is_read():
    data = archive()
    size = int.from_bytes(data[4:8], "little")
    packed = zstandard.ZstdCompressor(write_content_size=True).compress(data[8:8 + size])
    again = data[:4] + len(packed).to_bytes(4, "little") + packed + data[8 + size:]
    assert len(list(warc.frames(io.BytesIO(again)))) == 400


@pytest.mark.parametrize("damage", ["cut", "tail", "magic", "late dictionary"])
def test_damaged_archives_are_refused(damage):
    data = archive(20)
    data = {"cut": data[:-7], "tail": data + b"ab", "magic": data + b"abcdefgh",
            "late dictionary": data + (warc.SKIPPABLE_DICTIONARY).to_bytes(4, "little") + b"\1\0\0\0x"}[damage]
    with pytest.raises(warc.WarcError):
        list(warc.frames(io.BytesIO(data)))


def good_record():
    return warc.record({"page_id": 1, "url": "u", "payload": b"body", "digest": hashlib.sha1(b"body").hexdigest(),
                        "response_id": None, "revisit": False})


@pytest.mark.parametrize("old, new", [
    (b"WARC/1.1", b"WARC/9.9"), (b"WARC-Date", b"WARC-Dote"), (b"body\r\n\r\n", b"bod\r\n\r\n"), (b"body", b"bodY"),
    (b"Content-Length: 4", b"Content-Length: 5"), (b"WARC-Type: response", b"WARC-Type response"),
    (b"WARC-Date: ", b"WARC-Type: "),
])
def test_damaged_records_are_refused(old, new):
    assert warc.parse_record(good_record())["payload"] == b"body"
    with pytest.raises(warc.WarcError):
        warc.parse_record(good_record().replace(old, new, 1))


def test_errors_as_rows(spark, tmp_path):
    path = tmp_path / "x.warc.zst"
    path.write_bytes(archive(20)[:-7])
    manifest = spark.createDataFrame([(str(path),)], "path string")
    rows = warc.read_archives(manifest, on_error="row").collect()
    assert len(rows) == 20 and [r["error"] is not None for r in rows].count(True) == 1


def test_small_archives_share_a_task(spark):
    pages = page_rows(spark)[0]
    manifest = warc.write_archives(warc.plan_records(pages.repartition(4))).repartition(1)
    many = warc.read_archives(manifest.unionByName(manifest).unionByName(manifest).unionByName(manifest))
    assert many.rdd.getNumPartitions() <= max(8, manifest.count())
    assert many.count() == 4 * pages.count()
