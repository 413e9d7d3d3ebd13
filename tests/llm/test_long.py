"""Very long texts, large groups of near copies, and paths beyond the bounds."""

import random

import numpy as np
import odd
import public_tokenizers
import pytest
from test_dedup import classes, smallest

from strandline.llm import components, decontam, jaccard_join, lattice_lm, suffix_dedup

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_long_words_as_short_ones(monkeypatch):
    pieces = lattice_lm.read_vocabulary(MODEL)
    logp = np.log(pieces.prior)
    g = random.Random(3)
    words = ["".join(odd.word(g) for _ in range(g.randint(3, 25))).encode() for _ in range(5)] + ["é".encode() * 9]
    weight = np.array([1.0, 2.0, 3.0, 1.0, 5.0, 2.0])
    want, uses = lattice_lm.word_logp(pieces, logp, words), lattice_lm.word_uses(pieces, logp, words, weight)
    monkeypatch.setattr(lattice_lm, "LONG", 4)
    monkeypatch.setattr(lattice_lm, "STRETCH", 7)
    assert np.allclose(lattice_lm.word_logp(pieces, logp, words), want)
    assert np.allclose(lattice_lm.word_uses(pieces, logp, words, weight), uses)


def test_scores_of_a_text_without_blanks(spark):
    g = random.Random(1)
    rows = [(1, "".join(odd.word(g) for _ in range(20_000)), "en", "s", 1), (2, "a b", "en", "s", 1)]
    from pyspark.sql import functions as F

    got = {r.doc_id: r for r in lattice_lm.score(odd.frame(spark, rows), MODEL, F.col("doc_id") == 2, passes=1).collect()}
    assert got[1].n_tokens == 2 and got[1].score < -10_000 and got[1].vocabulary_score < -10_000


@pytest.mark.parametrize("size", [300_000, 1_200_000, 5_000_000])
def test_repeats_far_apart_in_long_texts(spark, size):
    g = np.random.default_rng(size)
    letters = lambda n: bytes(g.integers(97, 123, n).astype(np.uint8)).decode()
    passage, n = letters(333), size // 3
    texts = [letters(n) + "A" + passage + "B" + letters(n) + "C" + passage + "D" + letters(n), "x " + passage + " y", letters(1000)]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.digests(odd.frame(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])).collect()}
    assert got == {0: (666, 2), 1: (333, 1), 2: (0, 0)}


def crowd(seed, n):
    """Near copies around the threshold, of a few centres that share text."""
    g = random.Random(seed)
    base = odd.prose(g, 60).split()
    out = []
    for k in range(n):
        w = list(base)
        if k % 5 == 0:  # a second centre, and shorter copies
            w = w[: 48 + k % 12]
        for _ in range(g.choice([0, 1, 1, 2, 2, 3, 4])):
            w[g.randrange(len(w))] = odd.word(g) + str(g.randrange(40))
        out.append((k, " ".join(w), "en", "s", 1))
    return out


@pytest.mark.parametrize(("seed", "n", "turns"), [(1, 700, 16), (2, 700, 1), (3, 300, 0)])
def test_crowds_against_brute_force(spark, monkeypatch, seed, n, turns):
    monkeypatch.setattr(jaccard_join, "TURNS", turns or 0.5)
    monkeypatch.setattr(jaccard_join, "STEP", 2)
    data = crowd(seed, n)
    got = jaccard_join.join(odd.frame(spark, data)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, classes(data)))


def test_a_large_group_of_near_copies(spark):
    """5,000 copies with one changed word each, all linked with the text itself."""
    g = random.Random(9)
    base = odd.prose(g, 80).split()
    data = [(0, " ".join(base), "en", "s", 1)]
    for k in range(1, 5000):
        w = list(base)
        w[g.randrange(len(w))] = f"w{k}"
        data.append((k, " ".join(w), "en", "s", 1))
    got = jaccard_join.join(odd.frame(spark, data)).select("component_id").distinct().collect()
    assert [r.component_id for r in got] == [0]


@pytest.mark.parametrize("local", [3, 10, 1000])
def test_components_of_any_number_of_parts(spark, local):
    g = random.Random(local)
    links = [(g.randint(0, 80), g.randint(0, 80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(30)] + [(500, k) for k in range(501, 560)]
    want = smallest({x for e in links for x in e}, links)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "u long, v long"), local).collect()}
    assert {n: got.get(n, n) for n in want} == want


def test_decontamination_beyond_the_broadcast_bound(spark):
    g = random.Random(6)
    items = [(k, odd.prose(g, n)) for k, n in enumerate([5, 6, 7, 8, 9, 10, 11, 12, 13, 20, 40] * 3)]
    rows = []
    for i in range(60):
        w = g.choice(items)[1].split()
        for _ in range(g.choice([0, 0, 1, 2, 3])):
            w[g.randrange(len(w))] = "zz" + odd.word(g)
        rows.append((i, " ".join([odd.prose(g, g.randint(0, 20)), *w, odd.prose(g, g.randint(0, 20))]), "en", "s", 1))
    docs, bench = odd.frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    one, two = (sorted(map(tuple, decontam.overlaps(docs, bench, broadcast_rows=n).collect())) for n in (10**6, 0))
    assert one == two and one
    plan = decontam.overlaps(docs, bench, broadcast_rows=0)._jdf.queryExecution().toString()
    assert "BroadcastExchange" not in plan or spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
