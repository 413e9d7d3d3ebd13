"""A corpus pipeline: five stages, each one operator over all rows its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``, in few files.  All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.llm import bpe, decontam, jaccard_join, langid, suffix_dedup
from strandline.llm.queries import vocabulary
from strandline.llm.shared import crc_of_id, fewer, settle, table


#: The calibrated probability that the likeliest language of a document must reach:
#: from here on it is more likely than all others together.
LEAST = 0.5


def language_id(spark, docs, sf_dir):
    """Documents whose language cannot be told go.

    Those are documents without a letter (null and empty ones among them) and those
    in which no language is more likely than all others together.  Learned from the
    labels in the table itself; without any label no document can be judged and all
    stay.  Repeated rows are judged alike; no other column counts.
    """
    model = langid.fit(docs.where(crc_of_id() % 4 != 2), "lang", "text", F.col("doc_id"))
    if model is None:
        return docs
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    out = langid.predict(plain, model, plain.columns[0], plain.columns[docs.columns.index("text")], tuple(plain.columns[1:]))
    out = out.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST))
    return fewer(out.select(*plain.columns).toDF(*docs.columns))


def ngram_jaccard_join(spark, docs, sf_dir):
    """One document of each group of near duplicates stays: the one of the smallest id.

    Of equal ids the text of the least hash stays, of equal rows one; null ids come
    last; texts without words link with nothing, and of such rows equal ones are one.
    """
    return fewer(jaccard_join.one_of_each(docs))


def suffix_array_dedup(spark, docs, sf_dir):
    """Bytes of 200-byte strings that stand twice or more go from the texts.

    All rows stay: null texts null, empty and short ones as they are, and a text that
    loses all its bytes empty.  ``n_chars`` counts what is left.
    """
    out = suffix_dedup.keep_rest(docs)
    return fewer(out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out)


def benchmark_decontamination(spark, docs, sf_dir):
    """Documents that overlap with a benchmark item go; null and empty texts overlap with none."""
    return fewer(decontam.clean(docs, table(spark, sf_dir, "benchmark")))


def bpe_encoding_and_decoding(spark, docs, sf_dir):
    """Token ids of every document, with digests of ids and of the decoded text.

    A null or empty text has no ids and decodes to the empty text.
    """
    return fewer(bpe.digests(docs, vocabulary("word_bpe_49k.json"), with_ids=True, keep=False))


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_encoding_and_decoding", bpe_encoding_and_decoding),
]

#: SQL cannot express the merges of BPE or the fit of the language model.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), "snappy")
    return STAGES[-1][1](spark, docs, sf_dir)
