import collections
import itertools
import math
import random
import zlib

import numpy as np
import odd
from pyspark.sql import functions as F

from strandline.llm import decontam, langid, lattice_lm, quality
from strandline.llm.queries import vocabulary
from strandline.llm.shared import crc_of_id
from strandline.llm.textkit import text_buffer

VOCABULARY = vocabulary("piece_bpe_32k.model")


# -- decontamination -------------------------------------------------------------------
def test_masks_find_every_window_with_three_substitutions():
    n = decontam.WINDOW
    for bad in itertools.combinations(range(n), n - decontam.NEEDED):
        assert any(all(at + x not in bad for x in m) for m in decontam.MASKS for at in range(n - max(m))), bad


def tokens(text):
    out, word = [], ""
    for ch in (text or "").lower() + " ":
        if ch.isalnum():
            word += ch
        elif word:
            out.append(word)
            word = ""
    return out


def leaks(docs, items):
    found = set()
    for d, t in docs:
        a = tokens(t)
        for i, s in items:
            b = tokens(s)
            if len(b) < decontam.LEAST_WORDS:
                continue
            size = min(len(b), decontam.WINDOW)
            need = decontam.NEEDED if len(b) >= decontam.WINDOW else math.ceil(len(b) * 0.75)
            for shift in range(-len(b) + 1, len(a)):
                same = [0 <= shift + q < len(a) and a[shift + q] == b[q] for q in range(len(b))]
                if max(sum(same[k : k + size]) for k in range(len(b) - size + 1)) >= need:
                    found.add((d, i))
    return found


def test_leaks_against_brute_force(spark):
    g = random.Random(8)
    items = [(i, odd.prose(g, g.choice([13, 20, 40]))) for i in range(6)] + [(90, "four words are few"), (91, None), (92, ""), (93, "exactly six words in this one")]
    docs = []
    for k in range(60):
        w = items[g.randrange(6)][1].split()
        at, n = g.randrange(max(1, len(w) - 13)), g.randint(8, len(w))
        part = w[at : at + n]
        for _ in range(g.randint(0, 4)):
            part[g.randrange(len(part))] = "zz"
        docs.append((k, odd.prose(g, g.randint(0, 30)) + " " + ", ".join(part).upper() + " " + odd.prose(g, g.randint(0, 30))))
    docs += [(60, None), (61, ""), (62, "Exactly SIX words, in this one!"), (63, "four words are few"), (64, items[0][1])]
    left = odd.frame(spark, [(i, t, "en", "s", 1) for i, t in docs])
    right = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1)).withColumn("key", F.lit(2))
    for limit in (decontam.BROADCAST_ROWS, 0):  # the other way of joining gives the same
        got = decontam.overlaps(left, right, broadcast_rows=limit).collect()
        assert {(r.doc_id, r.item_id) for r in got} == leaks(docs, items)
        assert len(got) == len({(r.doc_id, r.item_id) for r in got})
    bad = {d for d, _ in leaks(docs, items)}
    kept = decontam.clean(left, right)
    assert kept.columns == left.columns and sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in docs if d not in bad)
    assert decontam.overlaps(left.limit(0), right).count() == 0 and decontam.overlaps(left, right.limit(0)).count() == 0
    plan = decontam.overlaps(left, right)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_null_ids_and_repeats(spark):
    text = " ".join(f"word{i}" for i in range(20))
    left = spark.createDataFrame([(None, text), (1, text), (1, text), (1, "clean"), (None, "clean")], "doc_id long, text string")
    items = spark.createDataFrame([(5, text)], "item_id long, text string")
    assert sorted(r.text for r in decontam.clean(left, items).collect()) == ["clean", "clean"]
    assert {(r.doc_id, r.item_id) for r in decontam.overlaps(left, items).collect()} == {(None, 5), (1, 5)}


# -- language model --------------------------------------------------------------------
def test_forward_sums_over_all_segmentations():
    pieces = lattice_lm.read_vocabulary(VOCABULARY)
    logp = np.log(pieces.prior)
    number = {t: i + 257 for i, t in enumerate(pieces.texts)}

    def total(word):
        if not word:
            return 1.0
        out = math.exp(logp[1 + word[0]]) * total(word[1:])
        for k in range(1, len(word) + 1):
            if word[:k] in number:
                out += math.exp(logp[number[word[:k]]]) * total(word[k:])
        return out

    words = [b"the", b"thing", b"a", b"x,", "été".encode(), b"zqx", b"the"]
    got = lattice_lm.word_logp(pieces, logp, words)
    assert np.allclose(got, [math.log(total(b" " + w)) for w in words])
    assert np.isfinite(lattice_lm.word_logp(pieces, logp, [b"x" * 5000])).all()


def test_expected_uses_are_the_gradient():
    pieces = lattice_lm.read_vocabulary(VOCABULARY)
    logp = np.log(pieces.prior)
    block = np.frombuffer(b" there over", np.uint8).reshape(1, -1)
    e = lattice_lm.expected(pieces, logp, block, np.array([2.0]))
    for i in np.argsort(-e)[:5]:
        up = logp.copy()
        up[i] += 1e-5
        slope = (lattice_lm.forward(pieces, up, block)[-1] - lattice_lm.forward(pieces, logp, block)[-1])[0] / 1e-5
        assert abs(2 * slope - e[i]) < 1e-3


def test_scores_of_odd_rows(spark):
    data = odd.rows()
    held = crc_of_id() % 7 == 2
    got = lattice_lm.score(odd.frame(spark, data), VOCABULARY, ~held).collect()
    is_held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = collections.Counter()
    for i, t, *_ in data:
        if not is_held(i):
            c.update([*odd.words(t), b"\n"])
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), len(odd.words(t)) + 1, sum(c[w] > 0 for w in [*odd.words(t), b"\n"]), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*odd.words(t), b"\n"]), 5)) for i, t, *_ in data)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    texts = collections.defaultdict(set)
    for r in got:
        texts[r.doc_id].add((r.n_tokens, round(r.score, 6)))
    assert texts[6] == texts[7] != texts[8]
    none = lattice_lm.score(odd.frame(spark, data), VOCABULARY, F.lit(False)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in none)
    assert lattice_lm.score(odd.frame(spark, []), VOCABULARY, ~held).count() == 0


# -- classifiers ------------------------------------------------------------------------
def test_quality_on_held_out_rows(spark, data):
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    held = crc_of_id() % 3 == 1
    got = quality.score(docs, quality.fit(docs, labels, ~held))
    rows = got.join(labels, "doc_id").where(held).collect()
    assert got.count() == docs.count() and len(rows) > 10
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.85
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_quality_of_odd_rows(spark):
    data = odd.rows()
    docs = odd.frame(spark, data)
    labels = spark.createDataFrame([(i, q, None, "t") for i, q in [(6, 1), (7, 1), (13, 0), (14, 0), (15, 0), (15, 0), (None, 1), (16, None), (17, 5), (999, 1)]], "doc_id long, quality int, toxic int, text string")
    net = quality.fit(docs, labels, F.lit(True))
    got = quality.score(docs, net).collect()
    assert len(got) == len(data) and all(0 <= r.score <= 1 for r in got)
    s = collections.defaultdict(set)
    for r in got:
        s[r.doc_id].add(round(r.score, 9))
    assert s[6] == s[7] and s[0] == s[1]
    assert {r.score for r in quality.score(docs, quality.fit(docs, labels.limit(0), F.lit(True))).collect()} == {0.5}
    assert {r.score for r in quality.score(docs, quality.fit(docs, labels.where("quality = 1"), F.lit(True))).collect()} == {1.0}
    assert quality.score(docs.limit(0), net).count() == 0


def test_pooling_in_steps_is_one_pooling():
    g = np.random.default_rng(1)
    net = quality.fit_net(g.integers(0, 256, (64, 512)).astype(np.uint8), g.integers(0, 2, 64).astype(np.float32), np.ones(64, np.float32), epochs=1)
    raw = g.integers(0, 256, (50, quality.HALF)).astype(np.uint8)
    a, b = net._pool(raw), net._pool(raw, step=7)
    assert np.allclose(a[0], b[0], atol=1e-5) and np.allclose(a[1], b[1], atol=1e-5)


def test_languages_on_held_out_rows(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    held = crc_of_id() % 4 == 2
    model = langid.fit(docs.where(~held), "lang", "text", F.col("doc_id"))
    rows = langid.predict(docs, model, keep=("lang",)).where(held).collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_languages_of_odd_rows(spark):
    data = odd.rows()
    docs = odd.frame(spark, data)
    model = langid.fit(docs, "lang", "text", F.col("doc_id"))
    got = langid.predict(docs, model, keep=("text", "score", "label")[:1]).collect()
    assert len(got) == len(data)
    for r in got:
        letter = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred in ("en", "fr")) if letter else (r.lang_pred, r.score) == ("und", 0.0)
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(docs.where(F.lit(False)), "lang", "text", F.col("doc_id"))).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0


def test_language_scores_of_long_rows_are_sums_of_their_pieces():
    import pyarrow as pa

    g = np.random.default_rng(3)
    table = g.normal(0, 1, (langid.NOTHING + 1, 2)).astype(np.float32)
    table[langid.NOTHING] = 0
    model = langid.Model(["a", "b"], table, np.zeros(2), 1.0)
    long = "".join(chr(c) for c in g.integers(97, 123, (1 << 20) + 7)) + "é𝒳"
    texts = ["", "ab", long, "x", "12 34", long[:50]]
    data, off = text_buffer(pa.array(texts))
    p, _, seen = model.score(data, off)
    assert seen.tolist() == [False, True, True, True, False, True]
    for i, t in enumerate(texts):
        points, at = langid.characters(*text_buffer(pa.array([t])))
        want = sum(table[s].sum(axis=0) for s in langid.grams(points, at)) / max(1, langid.totals(at)[0])
        want = np.exp(want - np.max(want))
        assert np.allclose(p[i], want / want.sum(), atol=1e-4)
