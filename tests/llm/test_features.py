"""Features against independent code, samples that no partitioning changes, caps that are gone."""

import collections
import hashlib
import io
import math
import random
import re

import numpy as np
import odd
import pytest
from pyspark.sql import functions as F

from strandline.llm import media, quality, url_filter


# -- media -------------------------------------------------------------------------------
def test_features_are_of_the_stored_bytes(spark):
    """A changed stored image has the features of what is stored."""
    data = [(i, t, "en", "s", 1) for i, t in enumerate(["one text", odd.prose(random.Random(1), 900), ""])]
    stored = media.store_texts(odd.frame(spark, data))
    other = {1: bytes(reversed(range(192))), 0: bytes([7] * 384), 2: bytes(192)}
    swap = F.udf(lambda k: bytearray(media.encode_ppm(other[k])), "binary")
    for r in media.text_digests(stored.withColumn("media", swap("doc_id"))).collect():
        image = np.frombuffer(other[r.doc_id], np.uint8).reshape(-1, 64, 3)
        assert r.feature == media.difference_hash(image) and r.payload_sha256 == hashlib.sha256(other[r.doc_id]).hexdigest()
        assert r.tile_sha256 == hashlib.sha256(media.tile(image)).hexdigest()


def test_difference_hash_by_hand():
    """Cells are means over exact areas; bits say which is brighter than its right neighbour."""
    a = np.random.default_rng(4).integers(0, 256, (16, 27, 3)).astype(np.uint8)
    cells = a.astype(float).mean(axis=2).reshape(8, 2, 9, 3).mean(axis=(1, 3)).round(6)
    bits = "".join("1" if cells[i, j] > cells[i, j + 1] else "0" for i in range(8) for j in range(8))
    assert media.difference_hash(a) == f"{int(bits, 2):016x}"
    assert np.load(io.BytesIO(media.tile(a, 2))).shape == (2, 2, 3)


@pytest.mark.parametrize("raw", [
    b"P2\n1 1\n255\n99999999999999999999", b"P2\n1 1\n9\n10", b"P5\n1 1\n0\n\x00", b"P5 99999999 99999999 255 ", b"P1\n5 5\n1",
    b"BM" + (62).to_bytes(4, "little") + bytes(4) + (58).to_bytes(4, "little") + (40).to_bytes(4, "little") + (1).to_bytes(4, "little") * 2 + b"\1\0\10\0" + bytes(16) + (1).to_bytes(4, "little") + bytes(4) + bytes(4) + b"\xff\0\0\0",
])
def test_broken_images_are_value_errors(spark, raw):
    with pytest.raises(ValueError):
        media.decode_image(raw)
    assert media.tiles(spark.createDataFrame([(1, bytearray(raw))], "k long, m binary"), "k", "m").first().tile is None


def test_samples_are_scaled_to_their_maximum():
    assert media.decode_image(b"P2\n3 1\n15\n0 5 15").ravel().tolist() == [0, 85, 255]
    assert media.decode_image(b"P5\n2 1\n1000\n" + np.array([500, 1000], ">u2").tobytes()).ravel().tolist() == [32768, 65535]


# -- quality -----------------------------------------------------------------------------
def test_convolution_by_hand():
    g = np.random.default_rng(3)
    chunks = g.integers(0, 256, (40, 2 * quality.HALF)).astype(np.uint8)
    net = quality.fit_net(chunks, (chunks[:, 0] > 127).astype(np.float32), np.ones(40, np.float32), epochs=2)
    text = bytes(g.integers(1, 256, 700).astype(np.uint8))
    raw = np.frombuffer(text.ljust(768, b"\0"), np.uint8).reshape(-1, quality.HALF)

    def half(row):
        at = range(0, quality.HALF, quality.STRIDE)
        out = []
        for k in at:  # a filter sees 16 bytes, at the end of a half its first 8
            x = net.embed[row[k : k + quality.STRIDE]].ravel() @ net.first
            if k + quality.STRIDE < quality.HALF:
                x = x + net.embed[row[k + quality.STRIDE : k + 2 * quality.STRIDE]].ravel() @ net.second
            out.append(np.maximum(x + net.bias, 0))
        return np.array(out)

    parts = [half(r) for r in raw]
    z = []
    for a, b in zip(parts, parts[1:], strict=False):
        both = np.concatenate([a, b])
        z.append(np.concatenate([both.max(axis=0), both.mean(axis=0)]) @ net.out + net.out_bias)
    got = net.summary(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]
    assert np.allclose(got, [np.mean(z), np.max(z), np.min(z)], atol=1e-4)


def _labelled(spark, parts):
    g = random.Random(8)
    rows = [(i, odd.prose(g, g.randint(5, 120)) + (" ok" if i % 2 else " zz"), "en", "s", 1) for i in range(300)]
    rows += [(7, "another row of a known id", "en", "s", 1)] * 3
    docs = odd.frame(spark, rows, parts)
    known = spark.createDataFrame([(i, i % 2) for i in range(300)], "id long, label int").repartition(parts)
    return docs, known


def test_the_sample_is_the_same_however_rows_are_dealt(spark):
    def taken(parts, n, size):
        docs, known = _labelled(spark, parts)
        return sorted(map(tuple, quality.sample(docs, known, "doc_id", "text", n, size).collect()))

    one = taken(1, 40, 1 << 20)
    assert one == taken(7, 40, 1 << 20) and len(one) == 80 and len({r[0] for r in one}) == 80
    few = taken(3, 40, 5000)
    assert few == taken(5, 40, 5000) and 0 < len(few) < 80
    assert all(sum(len(t.encode()) for _, t, y in few if y == k) <= 5000 for k in (0, 1))


def test_the_fit_sees_all_chunks_of_a_text(spark):
    import pyarrow as pa

    text = "".join(chr(97 + i % 26) for i in range(5000))
    got = next(iter(quality._chunks_of([pa.RecordBatch.from_arrays([pa.array([text]), pa.array([1], pa.int32())], ["text", "label"])])))
    n = math.ceil(5000 / quality.HALF) - 1
    assert got.num_rows == n and sum(got.column(2).to_pylist()) == pytest.approx(1)
    raw = text.encode().ljust((n + 1) * quality.HALF, b"\0")
    assert got.column(0).to_pylist() == [raw[k * quality.HALF : (k + 2) * quality.HALF] for k in range(n)]


# -- URLs ----------------------------------------------------------------------------------
def features(url):
    rest = url.split("://", 1)[1] if "://" in url else ""
    host = re.split("[/?#]", rest)[0].lower()
    path = re.split("[?#]", rest[len(host) :])[0]
    n = max(1, len(url))
    counts = collections.Counter(url).values()
    return {
        "length": len(url), "host_length": len(host), "path_length": len(path), "depth": path.count("/"), "labels": host.count("."),
        "digits": sum(c in "0123456789" for c in url) / n, "host_digits": sum(c in "0123456789" for c in host) / max(1, len(host)),
        "hyphens": host.count("-"), "parameters": ("?" in url) + url.count("&"), "fragment": float("#" in url),
        "entropy": round(-sum(c / n * math.log2(c / n) for c in counts), 6), "suffix1": host.split(".")[-1], "suffix2": ".".join(host.split(".")[-2:]),
    }


def urls(n=200):
    g = random.Random(2)
    return [f"http{'s' * g.randint(0, 1)}://{'-'.join(odd.word(g) for _ in range(g.randint(1, 3)))}{g.randint(0, 99)}.h{i}.{g.choice(['org', 'biz', 'net', 'io'])}/{'/'.join(odd.word(g) for _ in range(g.randint(0, 3)))}{g.choice(['', '?a=1&b=2', '#x'])}" for i in range(n)]


def test_lexical_features_by_hand(spark):
    given = [*urls(40), "", "no scheme", "a://b"]
    df = spark.createDataFrame([(u,) for u in given], "url string")
    for r in df.select("url", *[v.alias(k) for k, v in url_filter.lexical(F.col("url")).items()]).collect():
        want = features(r.url)
        for k, v in want.items():
            assert r[k] == v if isinstance(v, str) else r[k] == pytest.approx(v, abs=2e-6), (r.url, k)


def test_trees_by_hand(spark):
    """Every suffix counts, also beyond the most frequent; CASE gives what a walk through the trees gives."""
    given = urls(300)
    labelled = spark.createDataFrame([(u, i % 3 == 0) for i, u in enumerate(given)], "url string, b boolean").select("url", F.col("b").cast("int").alias("blocked"))
    model = url_filter.fit(labelled)
    share = {s: {r[s]: r.share for r in model.shares[s].collect()} for s in url_filter.SUFFIX}
    assert len(share["suffix2"]) == 300
    tally = collections.Counter(features(u)["suffix1"] for i, u in enumerate(given) if i % 3 == 0)
    total = collections.Counter(features(u)["suffix1"] for u in given)
    assert share["suffix1"] == {k: pytest.approx((tally[k] + 10 * model.prior) / (n + 10)) for k, n in total.items()}

    def walk(t, x):
        while isinstance(t, tuple):
            t = t[2] if x[t[0]] <= t[1] else t[3]
        return t

    got = {r.url: r.out for r in model.verdict(labelled.select("url"), "url", "out").collect()}
    for u in given:
        x = features(u)
        x |= {s: share[s].get(x[s], model.prior) for s in url_filter.SUFFIX}
        assert got[u] == ("block" if sum(walk(t, x) for t in model.trees) > 0 else "allow")


def test_the_fit_is_the_same_however_urls_are_dealt(spark):
    rows = [(u, int(i % 4 == 0)) for i, u in enumerate(urls(400))]
    trees = [url_filter.fit(spark.createDataFrame(rows, "url string, blocked int").repartition(k), fit_rows=150).trees for k in (1, 6)]
    flat = [re.sub(r"\d+\.\d+(e-?\d+)?", lambda m: f"{float(m[0]):.6f}", str(t)) for t in trees]
    assert flat[0] == flat[1]
