"""Trees in cells: uniform ones as maps, others as VARIANT; queries by patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_pattern(text: str) -> bool:
    return isinstance(text, str) and "%" in text and all(p for p in text.split("/"))


def path(steps) -> str:
    """A variant path from keys."""
    return "$" + "".join("['" + str(s).replace("'", "\\'") + "']" for s in steps)


def get(tree: Column, steps, kind: str = "string", default=None) -> Column:
    """The leaf at a path, or a default."""
    got = F.try_variant_get(tree, path(steps), kind)
    return got if default is None else F.coalesce(got, F.lit(default))


def to_table(df: DataFrame, tree: str, pattern: str, kinds: dict[str, str] | None = None, leaf: bool = False) -> DataFrame:
    """One row per match of a pattern such as "school/%name/age/%age" in a VARIANT column.

    A part beginning with % captures a key, or, at the end, the leaf below; other parts
    must be there.  A plain last part must equal the leaf.  ``leaf`` keeps whole
    sub-trees at the last capture; otherwise a captured leaf is text or of its kind.
    """
    parts = pattern.split("/")
    kinds = kinds or {}
    kept = [c for c in df.columns if c != tree]
    names: list[str] = []
    at = df.withColumn("_at", F.col(tree)).drop(tree)
    for i, p in enumerate(parts):
        end = i == len(parts) - 1
        if p.startswith("%"):
            name = p[1:]
            if end:
                value = F.col("_at") if leaf else F.try_variant_get("_at", "$", kinds.get(name, "string"))
                at = at.withColumn(name, value)
                if not leaf:
                    at = at.where(F.col(name).isNotNull())
            else:
                at = _explode(at, [*kept, *names], name)
            names.append(name)
        elif end:
            at = at.where(F.try_variant_get("_at", "$", "string") == p)
        else:
            at = at.withColumn("_at", F.try_variant_get("_at", path([p]), "variant")).where(F.col("_at").isNotNull())
    return at.select(*kept, *names)


def _explode(at: DataFrame, kept: list[str], name: str) -> DataFrame:
    """One row per entry of the object in ``_at``: its key as ``name``."""
    entries = at.sparkSession.tvf.variant_explode(F.col("_at").outer())
    return at.lateralJoin(entries).where(F.col("key").isNotNull()).select(*kept, F.col("key").alias(name), F.col("value").alias("_at"))


def leaves(df: DataFrame, tree: str, depth: int) -> DataFrame:
    """Paths and leaves of a JSON text column down to a stated depth: k0, k1, ..., leaf."""
    kept = [c for c in df.columns if c != tree]
    at = df.withColumn("_at", F.try_parse_json(tree)).drop(tree)
    done = []
    for i in range(depth):
        at = _explode(at, [*kept, *[f"k{j}" for j in range(i)]], f"k{i}")
        is_branch = F.schema_of_variant("_at").startswith("OBJECT")
        ends = at.where(~is_branch) if i < depth - 1 else at
        pads = [F.lit(None).cast("string").alias(f"k{j}") for j in range(i + 1, depth)]
        done.append(ends.select(*kept, *[f"k{j}" for j in range(i + 1)], *pads, F.try_variant_get("_at", "$", "string").alias("leaf")))
        at = at.where(is_branch)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def from_table(df: DataFrame, pattern: str, by=()) -> DataFrame:
    """Rows as a tree of maps by a pattern, innermost level first; repeated paths raise.

    The pattern's captures name columns; plain parts become fixed keys.
    """
    parts = pattern.split("/")
    value: Column = F.col(parts[-1][1:]) if parts[-1].startswith("%") else F.lit(parts[-1])
    current = df.withColumn("_tree", value)
    keys = [p[1:] for p in parts[:-1] if p.startswith("%")]
    for p in reversed(parts[:-1]):
        if p.startswith("%"):
            keys.remove(p[1:])
            entry = F.struct(F.col(p[1:]).alias("key"), F.col("_tree").alias("value"))
            current = current.groupBy(*by, *keys).agg(F.map_from_entries(F.array_sort(F.collect_list(entry), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))).alias("_tree"))
        else:
            current = current.withColumn("_tree", F.create_map(F.lit(p), F.col("_tree")))
    return current.select(*by, F.col("_tree").alias("tree"))


def update(a: Column, b: Column, depth: int = 1) -> Column:
    """Deep merge of two map trees of the same depth; the right side wins."""
    if depth == 1:
        return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(y, x))
    return F.map_zip_with(a, b, lambda _, x, y: F.when(x.isNull(), y).when(y.isNull(), x).otherwise(update(x, y, depth - 1)))


def set_item(tree: Column, steps: list[str], value: Column) -> Column:
    """A map tree with the leaf at a path set."""
    key = F.lit(steps[0])
    if len(steps) == 1:
        new = F.create_map(key, value)
        return F.map_zip_with(tree, new, lambda _, x, y: F.coalesce(y, x))
    return F.transform_values(tree, lambda k, v: F.when(k == key, set_item(v, steps[1:], value)).otherwise(v))


def map_at_depth(tree: Column, function, depth: int = 1) -> Column:
    """A function at the sub-trees of a depth of a map tree."""
    if depth == 0:
        return function(tree)
    return F.transform_values(tree, lambda _, v: map_at_depth(v, function, depth - 1))


def vector_map(c: Column, function) -> Column:
    """A function of each number along the last axis of (nested) arrays."""
    return F.transform(c, function)


def vector_reduce(c: Column, start, function) -> Column:
    """An array to a number by a fold along it."""
    return F.aggregate(c, start, function)


def tree_text(tree: dict, indent: int = 0) -> str:
    """A nested dict as indented text, a line for each key; leaves stand beside their key."""
    lines = []
    for k, v in tree.items():
        if isinstance(v, dict):
            lines += [" " * indent + f"{k}:", *([tree_text(v, indent + 4)] if v else [])]
        else:
            lines.append(" " * indent + f"{k}: {v!r}")
    return "\n".join(lines)


def zipped(*arrays: Column) -> Column:
    """Arrays in step; those of one element are repeated, other lengths raise."""
    size = F.greatest(*[F.size(a) for a in arrays]) if len(arrays) > 1 else F.size(arrays[0])
    fits = F.lit(True)
    for a in arrays:
        fits = fits & ((F.size(a) == size) | (F.size(a) == 1))
    wide = [F.when(F.size(a) == 1, F.array_repeat(F.get(a, F.lit(0)), size.cast("int"))).otherwise(a) for a in arrays]
    return F.when(F.assert_true(fits, F.lit("arrays of unequal lengths")).isNull(), F.arrays_zip(*wide))
