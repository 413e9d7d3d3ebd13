"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

Tokens are runs of letters and digits, lower-cased.  Each mask looks at five
positions of a short span and ignores the others, so a hit survives substitutions
at the ignored positions: with these three masks, any 13 aligned tokens of which
at least 10 agree share a hash (checked for all cases in the tests).  Hashes of
the corpus are joined with hashes of the benchmark; around each hit the aligned
tokens of document and item are compared, and a pair counts if some window of
WINDOW aligned tokens has at least NEEDED equal ones.

Items of 5 to 12 words need three quarters of their words, rounded up.  Shorter
masks of four positions are added for them, so that any such agreement shares a
hash as well (checked for all cases of each length), whatever other items exist.
Items of fewer than 5 words are no evidence and match nothing.

The benchmark's hashes are broadcast only if their counted number is at most
``broadcast_rows``; beyond it hashes with places alone are shuffled, and only rows
and items that hit get their tokens.

Behaviour on odd input: null or empty texts and empty tables give no rows; each
pair of id and item comes once, repeated rows of an id together; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import light, row_name, unused

MASKS = ((0, 1, 3, 6, 7), (0, 1, 5, 7, 8), (0, 1, 4, 5, 6))
#: Masks for items under WINDOW words, each with the most words of an item that it is for.
SHORT_MASKS = {(0, 1, 2, 4): 12, (0, 2, 3, 4): 8, (0, 1, 2, 3): 5, (0, 1, 3, 4): 5}
WINDOW, NEEDED = 13, 10
LEAST_WORDS = 5
#: Rows of benchmark hashes (24 bytes each and the item's tokens) that may be broadcast.
BROADCAST_ROWS = 200_000


def tokens(text: str):
    """Hashes of the tokens of a text column; null and empty texts have none."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    return F.transform(words, lambda x: F.xxhash64(x))


def masks_for(words: int) -> list[tuple[int, ...]]:
    """The masks that find an item of so many words."""
    return [*MASKS, *(m for m, most in SHORT_MASKS.items() if words <= most)]


def _seeds(df: DataFrame, h: str, masks: list[tuple[int, ...]], of_items: bool = False) -> DataFrame:
    """``df`` with a row for each seed: where it begins (p) and its key; items have those of their length alone."""
    spans = [max(m) + 1 for m in masks]
    last = min(spans)
    df = df.where(F.size(h) >= last).withColumn("p", F.explode(F.sequence(F.lit(0), F.size(h) - last)))

    at = lambda i: F.get(F.col(h), F.col("p") + i)  # noqa: E731  null beyond the end
    fits = lambda n: F.col("p") + n <= F.size(h)
    meant = lambda m: F.size(h) <= SHORT_MASKS[m] if of_items and m in SHORT_MASKS else F.lit(True)
    keys = [F.when(fits(s) & meant(m), F.xxhash64(F.lit(k), *[at(i) for i in m])) for k, (m, s) in enumerate(zip(masks, spans, strict=True))]
    return df.withColumn("key", F.explode(F.array(*keys)))


def overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Verified overlaps: id, item, matched (equal tokens of the best window),
    total (equal tokens of that alignment at most), item_words."""
    bench = items.select(F.col(item_col).alias("item"), tokens(item_text).alias("ih")).where(F.size("ih") >= LEAST_WORDS)
    sizes = bench.select(F.size("ih").alias("n")).groupBy().agg(F.sum("n").alias("all"), F.min("n").alias("least")).first()
    # only those that some item needs
    masks = masks_for(sizes["least"] or WINDOW)
    seeds = _seeds(bench, "ih", masks, of_items=True).where("key is not null").select("key", "item", F.col("p").alias("q"), "ih")
    seeds = seeds.dropDuplicates(["key", "item", "q"])
    rows = docs.select(F.col(id_col).alias("id"), tokens(text_col).alias("h"))
    if (sizes["all"] or 0) * len(masks) <= broadcast_rows:
        hits = _seeds(rows, "h", masks).join(F.broadcast(seeds), "key")
    else:
        rows = rows.withColumn("row", row_name("id", "h")).dropDuplicates(["row"])
        places = _seeds(rows, "h", masks).where("key is not null").select("row", "key", "p").join(seeds.select("key", "item", "q"), "key")
        places = places.groupBy("row", "item", (F.col("p") - F.col("q")).alias("p")).agg(F.lit(0).alias("q"))
        hits = places.join(rows, "row").join(bench, "item")
    n, shift = F.size("ih"), F.col("p") - F.col("q")
    # the document's tokens beside the item's: from shift on, cut at the document's ends
    lead = F.greatest(-shift, F.lit(0))
    beside = hits.select("id", "item", shift.alias("shift"), F.slice("h", F.greatest(shift, F.lit(0)) + 1, F.greatest(n - lead, F.lit(0))).alias("dh"), F.slice("ih", lead + 1, n).alias("bh"), n.alias("n"))
    each = beside.groupBy("id", "item", "shift", F.xxhash64("dh").alias("what")).agg(F.first("dh").alias("dh"), F.first("bh").alias("bh"), F.first("n").alias("n"))
    same = each.select("id", "item", "n", F.zip_with("dh", "bh", lambda a, b: F.coalesce((a == b).cast("int"), F.lit(0))).alias("same"))
    window = F.least(F.col("n"), F.lit(WINDOW))
    sums = F.transform(F.sequence(F.lit(1), F.greatest(F.size("same") - window + 1, F.lit(1))), lambda s: F.aggregate(F.slice("same", s, window), F.lit(0), lambda a, b: a + b))
    found = same.where(F.size("same") > 0).select("id", "item", "n", F.array_max(sums).alias("matched"), F.aggregate("same", F.lit(0), lambda a, b: a + b).alias("total"))
    need = F.when(F.col("n") >= WINDOW, F.lit(NEEDED)).otherwise(F.ceil(F.col("n") * 3 / 4))
    out = found.where(F.col("matched") >= need).groupBy("id", "item").agg(F.max("matched").alias("matched"), F.max("total").alias("total"), F.max("n").alias("item_words"))
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "matched", "total", "item_words")


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """The rows of ``docs`` without a verified overlap; all their columns."""
    name = unused(docs.columns, "row")
    marked = docs.withColumn(name, row_name(F.col(id_col), F.col(text_col)))
    bad = light(overlaps(marked, items, name, text_col, **names).select(name).distinct())
    return marked.join(bad, name, "left_anti").drop(name)


#: The same result in DuckDB's SQL, over every alignment that shares a token.
SQL = """
with dt as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as w from documents),
bt as (select item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as w from benchmark),
d as (select doc_id, unnest(w) as t, generate_subscripts(w, 1) as p from dt),
b as (select item_id, len(w) as n, unnest(w) as t, generate_subscripts(w, 1) as q from bt where len(w) >= 5),
m as (select doc_id, item_id, n, p - q as shift, q from d join b using (t)),
big as (select doc_id, item_id, shift, n, count(*) as total, list(q) as qs from m group by all having count(*) >= least(10, ceil(n * 0.75))),
win as (select doc_id, item_id, n, total, list_max(list_transform(qs, lambda a: len(list_filter(qs, lambda x: x >= a and x < a + 13)))) as matched from big)
select doc_id, item_id, max(matched)::int as matched, max(total)::int as total, max(n)::int as item_words
from win where matched >= (case when n >= 13 then 10 else ceil(n * 0.75) end) group by doc_id, item_id
"""
