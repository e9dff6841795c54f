import base64
import glob
import hashlib
import io

import zstandard

from millrace.llm import warc_bundles as warc

PAGES = [(1, "http://a/", "<p>x</p>"), (2, "http://b/ c\r\nd", "<p>x</p>"), (3, None, None), (4, "u", ""), (5, "v", "é" * 5), (None, "n", "alone"), (6, "w", "y" * 400_000), (6, "w", "y" * 400_000), (None, "n", "<p>x</p>")]
SCHEMA = "page_id long, url string, html string, payload string, n int, sha int"


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "p", 1, 2) for r in rows], SCHEMA)


def test_round_trip(spark, tmp_path):
    warc.write_archives(pages(spark), str(tmp_path / "w"))
    got = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert len(got) == len(PAGES)
    texts = {}
    for i, _, h in PAGES:
        texts.setdefault(h or "", []).append(i)
    for r in got:
        html = next(h or "" for i, _, h in PAGES if i == r.page_id and base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode() == r.payload_digest)
        newest = max((i for i in texts[html] if i is not None), default=None)
        assert r.payload_bytes == len(html.encode())
        if r.page_id == newest or newest is None:
            assert (r.record_type, r.refers_to, bytes(r.payload)) == ("response", None, html.encode())
        else:
            assert (r.record_type, r.refers_to, r.payload) == ("revisit", newest, None)
    assert next(r for r in got if r.page_id == 2).target_uri == "http://b/%20c%0D%0Ad"


def test_least_payload(spark, tmp_path):
    warc.write_archives(pages(spark), str(tmp_path / "w"), least=100)
    got = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert {r.record_type for r in got} == {"response"}  # the two long rows have the same, largest page_id


def test_files_are_seekable_and_standard(spark, tmp_path):
    many = [(k, f"http://h/{k}", f"<p>{k}</p>" * 2000) for k in range(300)]
    warc.write_archives(pages(spark, many).coalesce(1), str(tmp_path / "w"))
    (path,) = glob.glob(str(tmp_path / "w/part-*"))
    raw = open(path, "rb").read()
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert whole.count(b"WARC/1.1\r\n") == 300 and raw.endswith(warc.SEEK_MAGIC)
    with open(path, "rb") as f:
        reader = warc.SeekableReader(f)
        assert len({x[0] for x in reader.index.values()}) > 5  # frames
        for k in (0, 150, 299):
            assert warc.parsed(reader.read(f"<urn:page:{k}>"))[7] == many[k][2].encode()
    index = {r.record_id: r for r in warc.archive_index(spark, str(tmp_path / "w")).collect()}
    r = index["<urn:page:7>"]
    assert all(warc.parsed(warc.record_at(spark, index[f"<urn:page:{k}>"]))[7] == many[k][2].encode() for k in (0, 7, 299))
    frame = zstandard.ZstdDecompressor().decompress(raw[r.frame_offset : r.frame_offset + r.frame_bytes])
    assert frame[r.record_offset : r.record_offset + r.record_bytes].startswith(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:7>")


def test_each_record_has_its_identifier(spark, tmp_path):
    """Also those of null and of repeated page_ids; each is reachable by it."""
    warc.write_archives(pages(spark), str(tmp_path / "w"))
    index = warc.archive_index(spark, str(tmp_path / "w")).collect()
    assert len({r.record_id for r in index}) == len(PAGES) and {"<urn:page:1>", "<urn:page:5>"} <= {r.record_id for r in index}
    got = [warc.parsed(warc.record_at(spark, r)) for r in index]
    assert sorted(map(str, (x[1] for x in got))) == sorted(str(i) for i, _, _ in PAGES)
    assert [x[0] for x in got] == [r.record_id for r in index]


def test_files_are_of_bounded_size(spark, tmp_path, monkeypatch):
    """Each row of a pickled function's module has these bounds: files of two bundles at most."""
    monkeypatch.setattr(warc, "BUNDLES", 2)
    noise = [(k, "u", "".join(chr(97 + (k * 7919 + i * i) % 26) for i in range(300)) * 4000) for k in range(40)]  # over 1 MB each
    warc.write_archives(pages(spark, noise).coalesce(1), str(tmp_path / "w"))
    assert len(glob.glob(str(tmp_path / "w/part-*"))) >= 2
    assert warc.read_archives(spark, str(tmp_path / "w")).count() == 40


def test_several_bundles_in_a_file():
    bundles = []
    for k in range(3):
        w = warc.BundleWriter(frame_bytes=50)
        for j in range(4):
            w.add(f"{k}-{j}", f"record {k} {j} ".encode() * 5)
        bundles.append(w.close())
    reader = warc.SeekableReader(io.BytesIO(b"".join(bundles)))
    assert [n for n, _ in reader.records()] == [f"{k}-{j}" for k in range(3) for j in range(4)]
    assert reader.read("1-2") == b"record 1 2 " * 5


def test_damage_is_found():
    name, data = warc.record(1, "u", b"abc", 3, base64.b32encode(hashlib.sha1(b"abc").digest()).decode(), None, False, "d")
    import pytest

    with pytest.raises(ValueError, match="payload"):
        warc.parsed(data.replace(b"\r\nabc\r\n", b"\r\nabd\r\n"))


def test_no_pages(spark, tmp_path):
    warc.write_archives(pages(spark, []), str(tmp_path / "w"))
    assert warc.read_archives(spark, str(tmp_path / "w")).count() == 0 == warc.archive_index(spark, str(tmp_path / "w")).count()
