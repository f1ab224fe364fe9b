"""Files as sources: listing of folder trees, chunks of PNG and JPEG files."""

import os
import struct
import zlib

import pytest

from imprynt.sources import files as X
from imprynt.sources.listing import list_library

EXTS = (".png", ".jpg", ".jpeg")


def touch(root, rel, data=b"x"):
    path = root / rel
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)


def rels(spark, root, exclude=X.EXCLUDE, follow=False, partitions=64):
    rows = list_library(spark, str(root), EXTS, exclude, follow, partitions)[0].collect()
    return sorted((r["rel_path"] for r in rows), key=lambda p: p.split("/"))


@pytest.mark.parametrize("partitions", [1, 3, 64])
def test_names_globs_and_pruned_folders(spark, tmp_path, partitions):
    for rel in ("a.png", "_a.png", "b.JPG", "c.Jpeg", "d.webp", "notes.txt", "_sub/deeper/e.png", ".trash/a.png", "x/.cache/b.png", "x/c.png", ".hidden.png", "skip_preview.png", "sub/skip_preview.png", "Z/ü.png"):
        touch(tmp_path, rel)
    with open(os.path.join(os.fsencode(tmp_path), b"bad\xff.png"), "wb") as f:
        f.write(b"x")
    want = [".hidden.png", "Z/ü.png", "_a.png", "_sub/deeper/e.png", "a.png", "b.JPG", "c.Jpeg", "x/c.png"]
    assert rels(spark, tmp_path, (*X.EXCLUDE, "**/*_preview.png"), partitions=partitions) == want
    assert list_library(spark, str(tmp_path), EXTS, X.EXCLUDE)[1].first()["skipped_names"] == 1
    assert "x/c.png" not in rels(spark, tmp_path, ("x/**",), partitions=partitions)


def test_size_and_time(spark, tmp_path):
    touch(tmp_path, "a.png", b"12345")
    os.utime(tmp_path / "a.png", ns=(1, 1_790_649_651_329_171_267))
    assert [tuple(r) for r in X.scan_library(spark, f"file://{tmp_path}").collect()] == [("a.png", 5, 1_790_649_651_329_171_267)]


@pytest.mark.parametrize("partitions", [1, 2, 64])
def test_links_are_followed_once_and_loops_end(spark, tmp_path, partitions):
    touch(tmp_path / "outside", "o.png")
    touch(tmp_path / "outside", "in/p.png")
    library = tmp_path / "library"
    touch(library, "real.png")
    touch(library, "a/x.png")
    (library / "b").symlink_to(tmp_path / "outside")
    (library / "c").symlink_to(tmp_path / "outside")
    (library / "0in").symlink_to(tmp_path / "outside" / "in")
    (library / "linked.png").symlink_to(tmp_path / "outside" / "o.png")
    (library / "a" / "loop").symlink_to(library / "a")
    (library / "again").symlink_to(library)
    (library / "gone.png").symlink_to(tmp_path / "nowhere.png")
    assert rels(spark, library, partitions=partitions) == ["a/x.png", "real.png"]
    assert rels(spark, library, follow=True, partitions=partitions) == ["0in/p.png", "a/x.png", "b/o.png", "linked.png", "real.png"]


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


HEAD = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 4, 8, 2, 0, 0, 0))


def texts(spark, data, **options):
    df = spark.createDataFrame([("f", bytearray(data))], "file_id string, content binary")
    return [(r["key"], r["text"], r["source"]) for r in X.extract_texts(df, **options).collect()]


def test_png_texts_are_utf8_first_and_reading_goes_on(spark):
    big, packed = b"a" * 5001, zlib.compress("größe".encode())
    data = HEAD + chunk(b"tEXt", "prompt\0größe €".encode()) + chunk(b"tEXt", b"old\0caf\xe9") + chunk(b"tEXt", b"no separator") + chunk(b"zTXt", b"big\0\0" + zlib.compress(big)) + chunk(b"zTXt", b"bad\0\0" + packed[:2] + b"\xff" * 9)
    data += chunk(b"zTXt", b"fits\0\0" + zlib.compress(big[:-1])) + chunk(b"iTXt", b"i\0\1\0de\0T\0" + packed) + chunk(b"iTXt", b"few\0\1") + chunk(b"zTXt", b"cut\0\0" + zlib.compress(b"whole text" * 100)[:-6]) + chunk(b"IEND", b"")
    got = texts(spark, data, most=5000)
    assert got[:2] == [("prompt", "größe €", "tEXt"), ("old", "café", "tEXt")]
    assert got[2:4] == [("fits", "a" * 5000, "zTXt"), ("i", "größe", "iTXt")]
    assert [g[0] for g in got[4:]] == ["cut"] and "whole text" in got[4][1]
    assert texts(spark, data[:-30], most=5000)[-1] == (None, None, "truncated")


def test_inflater_holds_no_more_than_it_gives():
    packed = zlib.compress(b"\0" * (8 << 20))
    assert X.Inflater((8 << 20) - 1, 4096).text(packed) is None
    assert X.Inflater(8 << 20, 4096).text(packed) == b"\0" * (8 << 20)
    assert X.Inflater(10).text(b"") == b"" and X.Inflater(10).text(b"no zlib") is None


def segment(marker, body):
    return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body


def test_jpeg_sizes_and_comments(spark):
    frame = lambda marker, w, h: segment(marker, struct.pack(">BHHB", 8, h, w, 3) + b"\0" * 9)
    soi = b"\xff\xd8"
    cases = {
        "plain": (soi + segment(0xE0, b"JFIF\0") + frame(0xC0, 640, 480) + segment(0xDA, b"") + b"data", (640, 480)),
        "progressive": (soi + b"\xff\xff\xff" + segment(0xC4, b"\0" * 20) + segment(0xFE, "größe\0".encode()) + frame(0xC2, 70_000 % 65536, 5) + b"\xff\xd9", (4464, 5)),
        "none": (soi + segment(0xE1, b"x") + b"\xff\xd9", (None, None)),
        "cut": (soi + segment(0xE0, b"JFIF\0") + b"\xff\xc0\x00", (None, None)),
    }
    df = spark.createDataFrame([(k, bytearray(v[0])) for k, v in cases.items()] + [("odd", bytearray(b"\xff")), ("null", None)], "file_id string, content binary")
    got = {r["file_id"]: (r["format"], r["width"], r["height"]) for r in X.with_image_header(df).collect()}
    assert got == {**{k: ("jpeg", *v[1]) for k, v in cases.items()}, "odd": (None, None, None), "null": (None, None, None)}
    assert texts(spark, cases["progressive"][0]) == [("Comment", "größe", "COM")]
    assert texts(spark, cases["cut"][0]) == [(None, None, "truncated")]
