import os
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from finscan.llm import tiff as M


@pytest.mark.parametrize("compression", sorted(M.ENCODERS))
@pytest.mark.parametrize("predictor", [1, 2])
def test_strips_round_trip(compression, predictor):
    for n in (1, 3, 200, 1500):
        payload = (b"aaaa the the of and " * 5000 + os.urandom(60_000))[: n * 64].ljust(n * 64, b"\0")
        media = M.write_tiff(payload, compression=compression, predictor=predictor, strip_rows=100)
        assert M.read_tiff(media) == [(64, n, 1, 8, payload)]


def entry(order, tag, kind, values):
    raw = struct.pack(order + {3: "H", 4: "I"}[kind] * len(values), *values)
    return struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")[:4]


def two_pages(order):
    """A tiled RGB page with a predictor and a 16-bit page, in one file."""
    rng = np.random.default_rng(1)
    rgb = rng.integers(0, 256, (20, 24, 3), np.uint8)
    padded = np.zeros((32, 32, 3), np.uint8)
    padded[:20, :24] = rgb
    tiles = []
    for y in (0, 16):
        for x in (0, 16):
            t = padded[y : y + 16, x : x + 16]
            d = np.diff(t.astype(np.int16), axis=1, prepend=0).astype(np.uint8)
            tiles.append(zlib.compress(d.tobytes()))
    grey = rng.integers(0, 65536, (5, 7), np.uint16)
    body, at = b"", 8
    places = []
    for t in [*tiles, grey.astype(order + "u2").tobytes()]:
        places.append(at + len(body))
        body += t + b"\0" * (len(t) % 2)
    tables = b""
    base = at + len(body)
    offsets = struct.pack(order + "4I", *places[:4])
    counts = struct.pack(order + "4I", *(len(t) for t in tiles))
    bits = struct.pack(order + "3H", 8, 8, 8)
    tables = offsets + counts + bits + b"\0\0"
    one_at = base + len(tables)
    ref = lambda tag, kind, n, where: struct.pack(order + "HHII", tag, kind, n, where)
    one = [entry(order, 256, 3, [24]), entry(order, 257, 3, [20]), ref(258, 3, 3, base + 32), entry(order, 259, 3, [8]), entry(order, 277, 3, [3]), entry(order, 317, 3, [2]), entry(order, 322, 3, [16]), entry(order, 323, 3, [16]), ref(324, 4, 4, base), ref(325, 4, 4, base + 16)]
    two_at = one_at + 2 + 12 * len(one) + 4
    two = [entry(order, 256, 3, [7]), entry(order, 257, 3, [5]), entry(order, 258, 3, [16]), entry(order, 273, 4, [places[4]]), entry(order, 279, 4, [70])]
    head = {"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, one_at)
    directory = lambda e, following: struct.pack(order + "H", len(e)) + b"".join(e) + struct.pack(order + "I", following)
    return head + body + tables + directory(one, two_at) + directory(two, 0), rgb, grey


@pytest.mark.parametrize("order", ["<", ">"])
def test_tiles_pages_and_byte_orders(spark, order):
    data, rgb, grey = two_pages(order)
    df = spark.createDataFrame([(1, data, "x"), (2, None, "x"), (3, b"", "x"), (4, b"not an image", "x"), (5, data[:-40], "x")], "doc_id long, media binary, page string")
    got = M.decode_pages(df, prefix="tiff_").orderBy("doc_id", "tiff_page").collect()
    assert [(r.doc_id, r.tiff_page) for r in got] == [(1, 0), (1, 1), (4, None), (5, None)]
    assert bytes(got[0].tiff_pixels) == rgb.tobytes() and got[0].tiff_samples == 3 and got[0].page == "x"
    assert bytes(got[1].tiff_pixels) == grey.astype("<u2").tobytes() and (got[1].tiff_width, got[1].tiff_height, got[1].tiff_bits) == (7, 5, 16)
    assert got[2].tiff_error and got[3].tiff_error


def test_texts_as_payloads(spark):
    texts = [None, "", "x" * 64, "y" * 65, "é" * 100_000, "x" * 64]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr("doc_id", "cast(text as binary) text")
    media = M.encode_payloads(df, "text")
    got = {r.doc_id: r for r in M.decode_pages(media.selectExpr("*", "media as stored")).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        assert got[i].n_bytes == len(raw) and bytes(got[i].pixels) == raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
    assert bytes(got[2].stored) == bytes(got[5].stored)
    assert M.decode_pages(M.encode_payloads(df.limit(0), "text")).count() == 0


def test_query_on_the_small_tables(spark):
    import hashlib

    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in M.op5_tiff_pages(spark, "/root/testdata/sf0.001").collect():
        raw = (docs[r.doc_id] or "").encode()
        full = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))


def test_damage_is_reported():
    good = M.write_tiff(b"a" * 640)
    for bad in (b"XX*\0", good[:20], b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 0) + struct.pack("<I", 8)):
        with pytest.raises(M.TiffError):
            M.read_tiff(bad)
    with pytest.raises(ValueError):
        M.write_tiff(b"abc")


def patched(media: bytes, tag: int, value: int, *, count: int | None = None) -> bytes:
    """media with one field of its first directory replaced."""
    out = bytearray(media)
    at, (n,) = 10, struct.unpack_from("<H", media, 8)
    for i in range(n):
        if struct.unpack_from("<H", media, at + 12 * i)[0] == tag:
            if count is not None:
                struct.pack_into("<I", out, at + 12 * i + 4, count)
            struct.pack_into("<I", out, at + 12 * i + 8, value)
    return bytes(out)


def test_damaged_files_give_rows(spark):
    payload = bytes(range(256)) * 40
    good = M.write_tiff(payload, strip_rows=32)
    where = struct.unpack_from("<I", good, 10 + 12 * [struct.unpack_from("<H", good, 10 + 12 * i)[0] for i in range(10)].index(279) + 8)[0]
    bad = [
        patched(good, 279, where, count=4),  # fewer sizes than places
        patched(patched(good, 256, 2**32 - 1), 257, 2**32 - 1),
        patched(good, 257, 10**6),
        patched(good, 256, 0),
        patched(good, 258, 8, count=2**32 - 1),
        patched(good, 278, 2**32 - 1),
        patched(good, 259, 5),
        patched(M.write_tiff(payload, tile=32), 322, 2**31),
    ]
    for compression in M.ENCODERS:
        media = M.write_tiff(payload, compression=compression, strip_rows=64, tile=None)
        bad += [media[: len(media) - 30]]
    two = M.write_tiff(payload, page_rows=80)
    df = spark.createDataFrame([(i, b) for i, b in enumerate([*bad, good, two, two[:-20]])], "doc_id long, media binary")
    got = M.decode_pages(df).orderBy("doc_id", F.col("page").asc_nulls_last()).collect()
    for i in range(len(bad)):
        mine = [r for r in got if r.doc_id == i]
        assert len(mine) == 1 and mine[0].page is None and mine[0].error, (i, mine)
    n = len(bad)
    assert [(r.doc_id, r.page, r.error is None) for r in got if r.doc_id >= n] == [(n, 0, True), (n + 1, 0, True), (n + 1, 1, True), (n + 2, None, False)]


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_any_bytes_are_read_or_refused(data):
    good = bytearray(M.write_tiff(b"abcd" * 160, compression=data.draw(st.sampled_from(sorted(M.ENCODERS))), tile=data.draw(st.sampled_from([None, 16]))))
    for _ in range(data.draw(st.integers(1, 6))):
        good[data.draw(st.integers(0, len(good) - 1))] = data.draw(st.integers(0, 255))
    try:
        M.read_tiff(bytes(good))
    except M.TiffError:
        pass


@pytest.mark.parametrize("compression", sorted(M.ENCODERS))
def test_tiles_and_pages_round_trip(compression):
    payload = os.urandom(64 * 100) + b"word " * 1280
    for tile in (None, 16, 32, 48):
        got = M.read_tiff(M.write_tiff(payload, compression=compression, predictor=2, tile=tile, page_rows=70))
        assert [g[1] for g in got] == [70, 70, 60] and b"".join(g[4] for g in got) == payload


def test_query_against_plain_code(spark):
    """All columns of the query, from the payloads alone; long texts have several pages."""
    import hashlib

    got = {r.doc_id: r for r in M.op5_tiff_pages(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(got) == len(docs) and any(r.payload_bytes > M.PAGE_ROWS * 64 for r in got.values())
    for d in docs:
        raw = (d.text or "").encode()
        full = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        media = M.write_tiff(full, page_rows=M.PAGE_ROWS, **({"predictor": 2} | M.style_of(full)))
        a = np.frombuffer(full, np.uint8).reshape(-1, 64).astype(float)
        share = np.unique(a, return_counts=True)[1] / a.size
        step = np.abs(a[1:] - a[:-1]).mean() if len(a) > 1 else 0.0
        text = f"64x{len(a)} mean={a.mean():.3f} dev={a.std():.3f} entropy={-(share * np.log2(share)).sum() + 0.0:.4f} step={step:.3f}"
        r = got[d.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        assert r.feature == text


def test_many_large_pages_are_not_held_at_once(monkeypatch):
    payload = bytes(range(256)) * 64
    media = M.write_tiff(payload, page_rows=16)
    monkeypatch.setattr(M, "BATCH_BYTES", 2000)
    assert b"".join(p[4] for p in M.sound(media)) == payload
    with pytest.raises(M.TiffError):
        M.sound(media[:-4])


def test_mean_of_a_feature_is_that_of_whole_numbers():
    """A mean half way between two printed values does not depend on the order of sums."""
    pixels = np.random.default_rng(2).integers(0, 256, 1600).astype(np.uint8)
    image = M.Described(64)
    image.add(pixels.tobytes())
    assert f" mean={int(pixels.sum()) / 1600:.3f} " in image.feature()
