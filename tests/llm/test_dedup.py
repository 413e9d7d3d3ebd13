import collections
import hashlib
import random

import numpy as np
import odd
import pytest

from strandline.llm import components, jaccard_join, suffix_dedup


# -- suffix arrays -----------------------------------------------------------------
def test_suffix_array_against_sorting():
    g = random.Random(3)
    for _ in range(3000):
        x = [g.randint(0, g.choice([1, 2, 3, 6])) for _ in range(g.randint(0, 40))]
        assert suffix_dedup.suffix_array(x) == sorted(range(len(x)), key=lambda i: x[i:])


def removed(texts):
    """Brute force: which bytes of each text go."""
    n = suffix_dedup.LENGTH
    seen = collections.Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = True
        out.append(gone)
    return out


def digest(i, raw, gone):
    spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(raw) else 0
    return i, len(raw), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()


def passages(seed):
    """Texts that share passages of about LENGTH bytes, in one and in several rows."""
    g = random.Random(seed)
    shared = [odd.prose(g, g.randint(30, 60))[: g.choice([199, 200, 201, 215, 230, 400])] for _ in range(6)]
    out = []
    for i in range(60):
        parts = [odd.prose(g, g.randint(0, 40)) for _ in range(3)]
        out.append((i, " ".join([parts[0], g.choice(shared), parts[1], g.choice(shared), parts[2]]), "en", "s", 1))
    return out


@pytest.mark.parametrize(("data", "hot"), [(odd.rows(), suffix_dedup.HOT), (odd.rows(), 3), (passages(1), suffix_dedup.HOT), (passages(2), 2)])
def test_removed_bytes_against_brute_force(spark, data, hot):
    raw = [(t or "").encode() for _, t, *_ in data]
    want = [digest(i, r, gone) for (i, *_), r, gone in zip(data, raw, removed(raw), strict=True)]
    got = suffix_dedup.digests(odd.frame(spark, data), hot=hot).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_rest_of_texts_keeps_columns(spark):
    data = odd.rows()
    df = odd.frame(spark, data)
    got = suffix_dedup.keep_rest(df)
    assert got.columns == df.columns and got.count() == len(data)
    raw = [(t or "").encode() for _, t, *_ in data]
    want = [None if t is None else np.frombuffer(r, np.uint8)[~g].tobytes().decode("utf-8", "ignore") for (_, t, *_), r, g in zip(data, raw, removed(raw), strict=True)]
    assert sorted(map(str, (r.text for r in got.collect()))) == sorted(map(str, want))
    assert suffix_dedup.digests(odd.frame(spark, [])).count() == 0


# -- components ----------------------------------------------------------------------
def smallest(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    g = random.Random(5)
    links = [(g.randint(0, 60), g.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7), (200, 201), (201, 200)]
    want = {n: r for n, r in smallest({x for e in links for x in e}, links).items()}
    alone = {a for a, _ in links} | {b for _, b in links}
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert {n: got.get(n, n) for n in alone} == want


# -- similarity join --------------------------------------------------------------------
def shingles(text):
    w = odd.words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def rooted(data):
    """Brute force over rows: set sizes and roots."""
    sets = [shingles(t) for _, t, *_ in data]
    links = [(i, j) for i in range(len(data)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    return [len(x) for x in sets], smallest(range(len(data)), links)


def classes(data):
    """(id, size, smallest id of the component) of each row."""
    sizes, root = rooted(data)
    members = collections.defaultdict(list)
    for i, r in root.items():
        members[r].append(data[i][0])
    least = {r: min((x for x in ids if x is not None), default=None) for r, ids in members.items()}
    return [(data[i][0], sizes[i], least[root[i]]) for i in range(len(data))]


def crowds(seed):
    """Crowds of near copies, chains in which only neighbours link, boilerplate shared by many."""
    g = random.Random(seed)
    out, licence = [], odd.prose(g, 30)
    for n in (6, 12, 30, 90, 260):
        base = odd.prose(g, n).split()
        for _ in range(25):
            w = list(base)
            for _ in range(g.randint(0, max(1, n // 45))):
                w[g.randrange(len(w))] = odd.word(g) + "z"
            out.append(" ".join(w))
        chain = list(base)
        for k in range(8):
            chain = chain[max(1, n // 14) :] + [odd.word(g) + "y" for _ in range(max(1, n // 14))]
            out.append(" ".join(chain))
    out += [odd.prose(g, g.randint(5, 12)) + " " + licence for _ in range(30)]
    return [(i, t, "en", "s", 1) for i, t in enumerate(out)]


@pytest.mark.parametrize("data", [odd.rows(), crowds(1), crowds(2)])
def test_join_against_brute_force(spark, data):
    got = jaccard_join.join(odd.frame(spark, data)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, classes(data)))


def test_join_of_nothing(spark):
    assert jaccard_join.join(odd.frame(spark, [])).count() == 0


def test_one_of_each(spark):
    data = odd.rows()
    df = odd.frame(spark, data)
    got = jaccard_join.one_of_each(df)
    assert got.columns == df.columns
    sizes, root = rooted(data)
    best = {}
    for i, (k, t, *_) in enumerate(data):
        if sizes[i]:
            best.setdefault(root[i], set()).add((k is None, k or 0))
    kept = [(r.doc_id is None, r.doc_id or 0) for r in got.collect() if odd.words(r.text)]
    assert sorted(kept) == sorted(map(min, best.values()))


def test_signatures_cover_similar_sets():
    """Every pair of similar sets shares a signature of the smaller one's band."""
    g = np.random.default_rng(4)
    for n in (3, 4, 5, 7, 9, 16, 31, 60, 130, 500):
        for _ in range(40):
            a = np.unique(g.integers(0, 1 << 62, n).astype(np.uint64))
            room = len(a) // 7
            drop, add = g.integers(0, room + 1), g.integers(0, room + 1)
            b = np.unique(np.concatenate([g.permutation(a)[drop:], g.integers(0, 1 << 62, add).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both < 75 * (len(a) + len(b) - both) or (len(a) == both == len(b)):
                continue
            assert len(np.intersect1d(jaccard_join.all_signatures(a)[0], jaccard_join.all_signatures(b)[0]))
