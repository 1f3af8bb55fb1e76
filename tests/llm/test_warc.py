import hashlib
import io
import struct

import pytest
import zstandard
from marlstone.llm import warc
from marlstone.llm.common import materialize, scratch_dir


def archive(spark, rows, parts=2):
    folder = scratch_dir(spark, "test-warc")
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(parts)
    manifest = materialize(warc.write_archives(df, folder), "test")
    return folder, manifest, {r.page_id: r for r in warc.read_archives(spark, folder, manifest).collect()}


def test_round_trip_and_revisits(spark, prose):
    big, exact = "é" + prose(1, 300), "x" * 1000
    rows = [(k, f"http://e/{k}", f"<p>{prose(k, 60)}</p>", "d") for k in range(60)]
    rows += [(100, "u", big, "d"), (101, "u", big, "d"), (105, "u", big, "d"), (110, None, None, "d"), (111, "u\r\nInjected: 1", "", "d"), (112, "u", "small", "d"), (113, "u", "small", "d"), (120, "u", exact, "d"), (121, "u", exact, "d"), (130, "u", "x" * 999, "d"), (131, "u", "x" * 999, "d")]
    folder, manifest, got = archive(spark, rows)
    assert len(got) == len(rows)
    for page, _, html, _ in rows:
        data = (html or "").encode()
        assert (got[page].payload_bytes, got[page].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        if got[page].record_type == "response":
            assert bytes(got[page].payload) == data and got[page].refers_to is None
    assert {p: r.refers_to for p, r in got.items() if r.record_type == "revisit"} == {100: 105, 101: 105, 120: 121}
    assert got[111].url == "u Injected: 1" and got[110].url == ""
    # dictionary in front, every record on its own
    row = manifest.orderBy("file").first()
    data = open(f"{folder}/{row.file}", "rb").read()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == warc.DICT_FRAME_MAGIC and size == row.dict_bytes > 0
    one = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size])).decompressobj()
    assert one.decompress(data[8 + size :]).startswith(b"WARC/1.1\r\n")


def test_few_records_have_a_raw_dictionary(spark):
    folder, manifest, got = archive(spark, [(1, "u", "<p>a</p>", "d"), (1, "u", "<p>a</p>", "d")], 1)
    row = manifest.first()
    assert row.dict_bytes > 0 and row.records == 2 and got[1].record_type == "response" and bytes(got[1].payload) == b"<p>a</p>"
    assert struct.unpack("<I", open(f"{folder}/{row.file}", "rb").read(4))[0] == warc.DICT_FRAME_MAGIC
    assert archive(spark, [], 1)[2] == {}


def test_copies_beyond_the_broadcast_bound(spark, monkeypatch):
    from marlstone.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    rows = [(k, f"http://e/{k}", "y" * 2000 if k % 2 else "z" * (1000 + k), "d") for k in range(80)] + [(200, None, None, None), (201, None, "", None)]
    got = archive(spark, rows)[2]
    assert len(got) == 82 and {r.refers_to for k, r in got.items() if k % 2 and k < 79} == {79}
    assert all(r.record_type == "response" for k, r in got.items() if not k % 2 or k in (79, 201))


def test_cut_archive_is_an_error(spark):
    words = warc.build_dictionary([b"WARC/1.1 some header"])
    packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(words))
    frames = [packer.compress(warc.record(k, "u", "response", "0", b"x" * 5000, 5000)) for k in range(3)]
    whole = struct.pack("<II", warc.DICT_FRAME_MAGIC, len(words)) + words + b"".join(frames)
    edges = {len(whole) - len(frames[2]): 2, len(whole) - len(frames[2]) - len(frames[1]): 1, 8 + len(words): 0, len(whole): 3, 0: 0}
    for cut in range(len(whole) + 1):
        if cut in edges:  # a whole number of records
            assert len(list(warc.iterate_archive(io.BytesIO(whole[:cut])))) == edges[cut]
        else:
            with pytest.raises((ValueError, zstandard.ZstdError)):
                list(warc.iterate_archive(io.BytesIO(whole[:cut])))


def test_an_archive_without_its_last_record_is_an_error(spark):
    folder, manifest, _ = archive(spark, [(k, "u", f"<p>{k}</p>", "d") for k in range(3)], 1)
    short = manifest.withColumn("records", warc.F.col("records") + 1)
    with pytest.raises(Exception, match="the manifest has 4"):
        warc.read_archives(spark, folder, short).collect()
