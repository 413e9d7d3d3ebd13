import hashlib
import io
import struct
import zlib

import numpy as np
import odd
import pytest
from pyspark.sql import functions as F

from strandline.llm import media, url_filter
from strandline.llm.queries import RULES


def bmp(a, bits=24, down=False):
    h, w = a.shape[:2]
    rows = a if down else a[::-1]
    raw = b""
    for r in rows:
        line = r[:, 2::-1].tobytes() if bits == 24 else np.concatenate([r[:, 2::-1], np.zeros((w, 1), np.uint8)], axis=1).tobytes() if bits == 32 else r[:, 0].tobytes()
        raw += line + b"\0" * (-len(line) % 4)
    palette = b"".join(bytes([i, i, i, 0]) for i in range(256)) if bits == 8 else b""
    at = 54 + len(palette)
    return b"BM" + struct.pack("<IHHI", at + len(raw), 0, 0, at) + struct.pack("<IiiHHIIiiII", 40, w, -h if down else h, 1, bits, 0, len(raw), 0, 0, 0, 0) + palette + raw


@pytest.mark.parametrize("size", [(1, 1), (3, 5), (7, 4), (16, 33)])
def test_decoders(size):
    h, w = size
    g = np.random.default_rng(h)
    a = g.integers(0, 256, (h, w, 3)).astype(np.uint8)
    assert (media.decode_image(b"P6 # note\n%d %d\n255\n" % (w, h) + a.tobytes()) == a).all()
    assert (media.decode_image(b"P5\n%d %d 255\n" % (w, h) + a[:, :, 0].tobytes())[:, :, 0] == a[:, :, 0]).all()
    assert (media.decode_image(b"P3\n%d %d\n255\n" % (w, h) + " ".join(map(str, a.ravel())).encode()) == a).all()
    assert (media.decode_image(b"P2\n%d %d\n255\n" % (w, h) + " ".join(map(str, a[:, :, 1].ravel())).encode())[:, :, 0] == a[:, :, 1]).all()
    ink = a[:, :, 0] > 99
    assert (media.decode_image(b"P4\n%d %d\n" % (w, h) + np.packbits(ink, axis=1).tobytes())[:, :, 0] == np.where(ink, 0, 255)).all()
    assert (media.decode_image(b"P1\n%d %d\n" % (w, h) + " ".join(map(str, ink.ravel().astype(int))).encode())[:, :, 0] == np.where(ink, 0, 255)).all()
    wide = g.integers(0, 65536, (h, w)).astype(np.uint16)
    assert (media.decode_image(b"P5\n%d %d\n65535\n" % (w, h) + wide.astype(">u2").tobytes())[:, :, 0] == wide).all()
    for down in (False, True):
        assert (media.decode_image(bmp(a, 24, down)) == a).all()
        assert (media.decode_image(bmp(a, 32, down)) == a).all()
        assert (media.decode_image(bmp(a, 8, down))[:, :, 1] == a[:, :, 0]).all()
    for bad in (b"", b"P6\n3", b"P6\n9 9\n255\nabc", b"BM123", b"GIF89a"):
        with pytest.raises(ValueError):
            media.decode_image(bad)


@pytest.mark.parametrize(("size", "to"), [((6, 9), (2, 3)), ((7, 5), (3, 2)), ((2, 3), (5, 4)), ((50, 64), (8, 9)), ((1, 1), (3, 3))])
def test_area_resize(size, to, monkeypatch):
    a = np.random.default_rng(1).integers(0, 256, (*size, 2)).astype(float)
    fine = np.repeat(np.repeat(a, to[0], axis=0), to[1], axis=1)  # every target cell is whole here
    want = fine.reshape(to[0], size[0], to[1], size[1], 2).mean(axis=(1, 3))
    assert np.allclose(media.area_resize(a, *to), want)
    monkeypatch.setattr(media, "BAND", 3)
    assert np.allclose(media.area_resize(a, *to), want)


def test_texts_as_images(spark):
    data = odd.rows()
    got = media.text_digests(media.store_texts(odd.frame(spark, data))).collect()
    assert len(got) == len(data)
    texts = {}
    for i, t, *_ in data:
        raw = (t or "").encode()
        pay = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        texts.setdefault(i, []).append((len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-16:])))
    for r in got:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) in texts[r.doc_id]
        assert r.media_bytes > r.payload_bytes and len(r.feature) == 16
    same = {}
    for r in got:
        assert same.setdefault(r.payload_sha256, r[2:]) == r[2:]
    assert media.text_digests(media.store_texts(odd.frame(spark, []))).count() == 0


def test_tiles_of_media(spark):
    a = np.random.default_rng(2).integers(0, 256, (20, 30, 3)).astype(np.uint8)
    df = spark.createDataFrame([(1, bytearray(media.encode_ppm(a[:, :20].tobytes(), 20))), (2, bytearray(bmp(a))), (3, bytearray(b"junk")), (4, None)], "k long, m binary")
    got = {r.k: r for r in media.tiles(df, "k", "m", 4).collect()}
    tile = np.load(io.BytesIO(bytes(got[2].tile)))
    assert tile.shape == (4, 4, 3) and np.abs(tile - media.area_resize(a, 4, 4)).max() <= 0.5
    assert got[2].dhash == media.difference_hash(a) and got[3].tile is None and got[4].dhash is None


URLS = [
    ("https://A.Example.NET/en/1?x=http://q.net/", "a.example.net", "/en/1", "example.net/en/", "allow"),
    ("http://sub.net/", "sub.net", "/", "net/", "block"),
    ("http://sub.net", "sub.net", "", None, None),
    ("ftp://x.example.com/de/a#b", "x.example.com", "/de/a", "example.com/de/", "block"),
    ("https://w.org/fr/?q", "w.org", "/fr/", "org/fr/", "allow"),
    ("https://w.org?fr/", "w.org", "", None, None),
    ("https://w.org#/fr/", "w.org", "", None, None),
    ("https://fakeexample.net/en/", "fakeexample.net", "/en/", "net/", "block"),
    ("//no.net/", "", "", None, None),
    ("", "", "", None, None),
    (None, "", "", None, None),
    ("a://b://c.net/d", "b:", "//c.net/d", None, None),
    ("https://É.NET/", "É.net", "/", "net/", "block"),
]


def test_rules(spark):
    df = spark.createDataFrame([(i, u, "<p>", "h", 1, 2.0) for i, (u, *_) in enumerate(URLS * 2)], "page_id long, url string, html string, host string, rule int, verdict double")
    got = {r.page_id: r for r in url_filter.filter_urls(df, RULES).collect()}
    assert len(got) == 2 * len(URLS)
    for i, (_, host, path, rule, verdict) in enumerate(URLS * 2):
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")
        assert r.verdict == got[i % len(URLS)].verdict
    assert url_filter.filter_urls(df.limit(0), RULES).count() == 0


def test_trees_learn_from_given_labels(spark):
    bad = [(f"http://x{i}.shop.biz/win/{i * 7919}?a={i}&b=2&c=3", 1) for i in range(120)]
    good = [(f"https://site{i % 9}.org/page-{i}", 0) for i in range(120)]
    labelled = spark.createDataFrame(bad[::2] + good[::2], "url string, blocked int")
    rest = spark.createDataFrame([(u, y) for u, y in bad[1::2] + good[1::2]], "url string, y int")
    got = url_filter.filter_urls(rest, [], labelled=labelled, keep=("y",))
    assert got.where((F.col("verdict") == "block") != (F.col("y") == 1)).count() <= 3
    one = url_filter.filter_urls(rest, [], labelled=labelled.where("blocked = 1"), keep=("y",))
    assert one.where("verdict = 'block'").count() == rest.count()


def test_plan_is_native(spark):
    df = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    plan = url_filter.filter_urls(df, RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
