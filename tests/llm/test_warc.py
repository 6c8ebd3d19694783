import base64
import gzip
import hashlib
import random
import zlib

import pytest

from fencegraph.llm import warc


def raw(n, block):
    return warc.serialise([("WARC-Type", "response"), ("WARC-Record-ID", warc.record_id(str(n)))], block)


@pytest.mark.parametrize("step", [1, 7, 1 << 20])
def test_normaliser_gives_a_member_per_record(monkeypatch, step):
    monkeypatch.setattr(warc, "STEP", step)
    rng = random.Random(3)
    blocks = [b"", b"\r\n\r\n", b"WARC/1.1\r\nContent-Length: 9\r\n\r\n", bytes(rng.randrange(256) for _ in range(3000))] + [rng.randbytes(rng.randrange(200)) for _ in range(30)]
    whole = [raw(i, b) for i, b in enumerate(blocks)]
    for stream in (gzip.compress(b"".join(whole)), b"".join(gzip.compress(r) for r in whole), gzip.compress(b"".join(whole[:9])) + gzip.compress(b"".join(whole[9:]))):
        data, index = warc.normalise(stream)
        assert gzip.decompress(data) == b"".join(whole)
        assert [zlib.decompress(data[a : a + n], 31) for a, n in index] == whole
        assert sum(n for _, n in index) == len(data)
        assert [warc.parse(r).block for r in whole] == blocks


def test_broken_files_are_told():
    good = gzip.compress(raw(1, b"abc"))
    for bad in (good[:-12], gzip.compress(raw(1, b"abc")[:-3]), gzip.compress(b"no record at all\r\n\r\n")):
        with pytest.raises(Exception):
            warc.normalise(bad)
    assert warc.normalise(b"") == (b"", [])


@pytest.mark.parametrize("least", [0, 5])
def test_archives_read_back_as_written(spark, tmp_path, monkeypatch, least):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)
    rng = random.Random(least)
    pages = [(i, f"http://h/{i}\r\nX: y", rng.choice(["same page", "", "ü" * 40, f"own {i}", None, "abc"]), 1) for i in range(150)] + [(None, None, "same page", 1), (999, "u", "long " * 5000, 1)]
    pages += [pages[7], pages[7], (999, "u", "long " * 5000, 1)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, digest int")
    warc.write(df, "page_id", "url", "html", str(tmp_path / "s"), least_bytes=least)
    warc.rewrite(spark, str(tmp_path / "s"), str(tmp_path / "m"))
    got = sorted(((r.page_id, r.payload_bytes, r.digest, r.type, r.refers_to, bytes(r.payload)) for r in warc.read(spark, str(tmp_path / "m")).collect()), key=str)
    last = {}
    for i, _, h, _ in pages:
        if i is not None:
            last[h or ""] = max(i, last.get(h or "", i))
    want = []
    for i, _, h, _ in pages:
        p = (h or "").encode()
        head = last[h or ""] if len(p) >= least and i != last[h or ""] else None
        want.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if head is None else "revisit", head, p if head is None else b""))
    assert got == sorted(want, key=str)


def test_no_pages(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write(df, "page_id", "url", "html", str(tmp_path / "s"))
    warc.rewrite(spark, str(tmp_path / "s"), str(tmp_path / "m"))
    assert warc.read(spark, str(tmp_path / "m")).collect() == []
