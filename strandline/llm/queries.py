"""The queries of this subpackage, each one operator over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import bpe, decontam, jaccard_join, langid, lattice_lm, media, quality, suffix_dedup, tokens, url_filter
from .shared import crc_of_id, table


def vocabulary(name: str) -> str:
    """The place of a public tokenizer file; it is never copied into the repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_binary(spark, sf_dir):
    shards = tokens.write(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2)
    return tokens.read(shards, tokens.crc_of_ids, "ids_crc32 long")


def op2_suffix_dedup(spark, sf_dir):
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op3_media_tiles(spark, sf_dir):
    return media.text_digests(media.store_texts(table(spark, sf_dir, "documents")))


def op4_decontamination(spark, sf_dir):
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_lattice_lm(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = crc_of_id() % 7 == 2
    out = lattice_lm.score(docs, vocabulary("piece_bpe_32k.model"), ~held)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "vocabulary_score")


def op6_quality_cnn(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = crc_of_id() % 3 == 1
    net = quality.fit(docs, table(spark, sf_dir, "labels"), ~held)
    return quality.score(docs, net).select("doc_id", held.alias("held_out"), "score", "predicted")


def op7_bpe_segment_tree(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op8_jaccard_join(spark, sf_dir):
    return jaccard_join.join(table(spark, sf_dir, "documents"))


RULES = url_filter.rules(("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def op9_url_filter(spark, sf_dir):
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), RULES)


def op10_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = crc_of_id() % 4 == 2
    model = langid.fit(docs.where(~held), "lang", "text", F.col("doc_id"))
    return langid.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


_ALL = (op1_token_binary, op2_suffix_dedup, op3_media_tiles, op4_decontamination, op5_lattice_lm, op6_quality_cnn, op7_bpe_segment_tree, op8_jaccard_join, op9_url_filter, op10_language_id)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL = {"op4_decontamination": decontam.SQL}
