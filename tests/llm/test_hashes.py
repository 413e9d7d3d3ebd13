"""Words of regular build, which sums over powers of one base cannot tell apart, and forced collisions."""

import hashlib
import zlib

import numpy as np
import odd
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandline.llm import bpe, jaccard_join, lattice_lm, textkit, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


def regular(n):
    """The Thue-Morse word of n letters and its complement."""
    x = "a"
    while len(x) < n:
        x += x.translate({97: "b", 98: "a"})
    return x, x.translate({97: "b", 98: "a"})


def pairs(spark):
    rows = [(i, w, "en", "s", 1) for i, w in enumerate(w for n in (512, 1024, 2048, 8192) for w in regular(n))]
    return rows, odd.frame(spark, rows, 1)


@pytest.fixture(scope="module")
def library():
    tok = Tokenizer.from_file(PATH)
    tok.no_truncation()
    tok.no_padding()
    return tok


def test_word_hashes_differ():
    words = [w.encode() for n in (64, 512, 1024, 2048, 4096, 8192, 1 << 19) for w in regular(n)]
    data = np.frombuffer(b" ".join([*words, words[3].upper()]), np.uint8)
    starts, ends, _ = textkit.word_bounds(data, np.array([0, len(data)]))
    h = textkit.word_hashes(data, starts, ends)
    assert len(set(h[:-1].tolist())) == len(words) and h[-1] == h[3]


def test_ids_of_regular_words(spark, library):
    rows, df = pairs(spark)
    got = {r.doc_id: r for r in bpe.digests(df, PATH).collect()}
    for i, text, *_ in rows:
        ids = library.encode(text, add_special_tokens=False).ids
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    packed = {r.doc_id: r.ids_crc32 for r in tokens.read(tokens.write(df, PATH, 2), tokens.crc_of_ids, "ids_crc32 long").collect()}
    assert packed == {i: zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t, *_ in rows}


def test_cache_survives_equal_hashes(monkeypatch, library):
    monkeypatch.setattr(bpe, "word_hashes", lambda data, starts, ends: (data[starts] % 3).astype(np.uint64))
    word = bpe.WordBpe(PATH)
    cache = bpe.ChunkCache(lambda chunks: bpe.by_pieces(word, chunks, word.merge_many))
    texts = [odd.prose(__import__("random").Random(k), 40) + " x" * k + " " + "y" * 300 for k in range(6)] * 2
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum(list(map(len, raw)))])
    ids, n = cache.encode(np.frombuffer(b"".join(raw), np.uint8), off)
    at = np.concatenate([[0], np.cumsum(n)])
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_cache_is_bounded(monkeypatch):
    for name in ("CACHE_WORDS", "CACHE_BYTES", "CACHE_IDS"):
        monkeypatch.setattr(bpe, name, 2000)
    word = bpe.WordBpe(PATH)
    cache = bpe.ChunkCache(lambda chunks: bpe.by_pieces(word, chunks, word.merge_many))
    for k in range(50):
        raw = odd.prose(__import__("random").Random(k), 200).encode() + b" " + b"z" * 5000
        cache.encode(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        assert cache.have <= 4000 and cache.filled <= 6000 and len(cache.flat) <= 1 << 16


def test_regular_texts_do_not_link(spark):
    rows, df = pairs(spark)
    assert all(r.component_id == r.doc_id for r in jaccard_join.join(df).collect())


def test_regular_words_are_counted_apart(spark):
    rows, df = pairs(spark)
    got = lattice_lm.score(df, public_tokenizers.path("piece_bpe_32k.model"), F.col("doc_id") % 2 == 0, passes=1).collect()
    assert {r.doc_id: r.n_known for r in got} == {i: 2 if i % 2 == 0 else 1 for i, *_ in rows}
