"""What language ID must take from all rows, not from a sample."""

import math

import numpy as np
from pyspark.sql import functions as F

from strandline.llm import langid


def table(spark):
    docs = [(i, f"the common words of row {i % 97}", "en") for i in range(3000)] + [(5000, "żółw łąka", "pl"), (5001, "źdźbło", "pl"), (5002, "ñandú", "es")]
    return docs, spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)


def test_rare_languages_are_learned(spark):
    docs, df = table(spark)
    model = langid.fit(df, "lang", "text", F.col("doc_id"), fit_rows=60)
    assert model.languages == ["en", "es", "pl"]
    got = {r.doc_id: r.lang_pred for r in langid.predict(df.where("doc_id >= 2999"), model).collect()}
    assert got == {2999: "en", 5000: "pl", 5001: "pl", 5002: "es"}
    assert langid.quotas({"a": 10, "b": 5}, 15) == {"a": 10, "b": 5}
    some = langid.quotas({"a": 10**6, "b": 3, "c": 500}, 400)
    assert some["b"] == 3 and 66 <= some["c"] < some["a"] and sum(some.values()) <= 400


def test_frequencies_are_of_all_rows(spark, monkeypatch):
    docs, df = table(spark)
    monkeypatch.setattr(langid, "fit_ftrl", lambda rows, n: (np.ones((langid.NOTHING + 1, n)), np.zeros(n)))
    model = langid.fit(df, "lang", "text", F.col("doc_id"), fit_rows=60, scale=1.0)
    count = np.zeros(langid.NOTHING + 1)
    for _, text, _ in docs:
        points = np.array([ord(c) for c in text], np.uint32)
        for slot in {int(x) for g in langid.grams(points, np.array([0, len(points)])) for x in g}:
            count[slot] += 1
    want = [math.log((1 + len(docs)) / (1 + c)) + 1 for c in count[: langid.NOTHING]]
    assert np.allclose(model.table[: langid.NOTHING, 0], want, rtol=1e-5)
