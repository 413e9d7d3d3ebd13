import hashlib
import random
import zlib

import numpy as np
import odd
import pytest
from tokenizers import Tokenizer

from strandline.llm import bpe, tokens
from strandline.llm.queries import vocabulary

PATH = vocabulary("word_bpe_49k.json")
TEXTS = ["", "a", "  ", "it's İstanbul ΣΑΣ 12３ é é  x\x1cy <|endoftext|>z<|ENDOFTEXT|> <|startoftext|>", "x" * 700, "ab" * 700 + " \u0085q", "#%$^ don't I'LL I'Ve 🎉🎉 !!THE!! it's.don't,'s ''ll", "ﬁ ẛ̣ ǅ İ 　z a̸b ≮"]


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(PATH)


def test_ids_and_text_are_the_librarys(tok):
    one, _, _ = bpe._codec(PATH)
    g = random.Random(2)
    for t in TEXTS + ["".join(g.choice("aB '.!é1\n中<|>") for _ in range(g.randint(0, 60))) for _ in range(400)]:
        want = tok.encode(t, add_special_tokens=False).ids
        assert one.encode_text(t).tolist() == want, t
        assert one.decode(want) == tok.decode(want, skip_special_tokens=False)


def test_one_tree_and_many_trees_agree():
    one, _, _ = bpe._codec(PATH)
    g = random.Random(3)
    words = ["".join(g.choice("etaonis") for _ in range(g.randint(1, 90))).encode() for _ in range(300)]
    ids, n = one.merge_many(words)
    at = np.concatenate([[0], np.cumsum(n)])
    for i, w in enumerate(words):
        assert ids[at[i] : at[i + 1]].tolist() == one.merge_one(w).tolist()


def test_digests_of_odd_rows(spark, tok):
    data = odd.rows()
    got = bpe.digests(odd.frame(spark, data), PATH).collect()
    want = []
    for i, t, *_ in data:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert bpe.digests(odd.frame(spark, []), PATH).count() == 0


def test_encode_then_decode(spark, tok):
    ids = bpe.encode(odd.frame(spark, [(1, "Hello there, world!", "en", "s", 1), (2, None, None, None, None)]), PATH)
    back = {r.doc_id: r.text for r in bpe.decode(ids, PATH).collect()}
    assert back == {1: tok.decode(tok.encode("Hello there, world!", add_special_tokens=False).ids, skip_special_tokens=False), 2: ""}


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 13, 16, 17, 31, 32])
def test_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001)
    raw = tokens.pack(ids, bits)
    assert len(raw) == -(-1001 * bits // 8)
    assert tokens.unpack(raw, bits, 1001).tolist() == ids.tolist()
    assert tokens.width(1 << bits) == bits


def test_random_access(tmp_path):
    g = np.random.default_rng(1)
    docs = [g.integers(0, 49408, n) for n in (0, 5, 1000, 1, 0, 70_000, 3)]
    uri = f"file://{tmp_path}/a.tok"
    w = tokens.Writer(uri, 16, block=64)
    counts = np.array(list(map(len, docs)))
    w.add(np.arange(7), np.zeros(7, bool), np.concatenate(docs), counts)
    assert w.close() == (7, int(counts.sum()))
    r = tokens.Reader(uri)
    for i in (5, 0, 2, 6, 1):
        assert r.document(i).tolist() == docs[i].tolist()


def test_binary_output_of_odd_rows(spark, tok):
    data = odd.rows()
    got = tokens.read(tokens.write(odd.frame(spark, data), PATH, 2), tokens.crc_of_ids, "ids_crc32 long").collect()
    order = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    start, want = 0, []
    for i, t, *_ in order:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert tokens.read(tokens.write(odd.frame(spark, []), PATH, 2), tokens.crc_of_ids, "ids_crc32 long").count() == 0
