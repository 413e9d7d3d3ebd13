"""Benchmark items under the window: every agreement of three quarters of the words is found."""

import itertools
import math

import pytest

from strandline.llm import decontam


def patterns(n):
    """Positions that agree, of every case with just enough of them."""
    return [set(x) for x in itertools.combinations(range(n), math.ceil(0.75 * n))]


@pytest.mark.parametrize("n", range(decontam.LEAST_WORDS, decontam.WINDOW))
def test_masks_find_every_agreement(n):
    for good in patterns(n):
        assert any(all(at + x in good for x in m) for m in decontam.masks_for(n) for at in range(n - max(m))), good


@pytest.mark.parametrize("n", [5, 6, 7, 8, 9, 10, 11, 12])
def test_every_agreement_is_found(spark, n):
    words = [f"w{i}" for i in range(n)]
    cases = [" ".join(w if i in good else f"x{i}" for i, w in enumerate(words)) for good in patterns(n)]
    # one word less, and items cut at a document's ends
    few = [" ".join(w if i in sorted(good)[1:] else f"x{i}" for i, w in enumerate(words)) for good in patterns(n)]
    need = math.ceil(0.75 * n)
    ends = [" ".join(words[:need]), " ".join(words[n - need :])]
    items = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    docs = [(k, f"{'before ' * (k % 3)}{t}{' after' * (k % 2)}") for k, t in enumerate(cases)] + [(1000 + k, t) for k, t in enumerate(ends)] + [(2000 + k, t) for k, t in enumerate(few)]
    left = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    got = {r.doc_id: (r.matched, r.total, r.item_words) for r in decontam.overlaps(left, items).collect()}
    assert got == {k: (need, need, n) for k in [*range(len(cases)), 1000, 1001]}


def test_other_items_change_nothing(spark, duck):
    texts = ["a b c d e", "f g h i j k l", "a b c d e f g h i", "p q r s t u v w x y z a b c d"]
    items = list(enumerate(texts))
    docs = [(k, " ".join(w if i not in bad else "zz" for i, w in enumerate(t.split()))) for k, (t, bad) in enumerate(itertools.product(texts, itertools.combinations(range(7), 2)))]
    left = spark.createDataFrame(docs, "doc_id long, text string")
    find = lambda some: {tuple(r) for r in decontam.overlaps(left, spark.createDataFrame(some, "item_id long, text string")).collect()}
    whole = find(items)
    assert whole == set().union(*(find([x]) for x in items))
    c = duck.cursor()
    c.execute("create temp table documents (doc_id bigint, text varchar)")
    c.execute("create temp table benchmark (item_id bigint, text varchar)")
    c.executemany("insert into documents values (?, ?)", docs)
    c.executemany("insert into benchmark values (?, ?)", items)
    assert whole == set(c.execute(decontam.SQL).fetchall())
