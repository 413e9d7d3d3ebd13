"""URL filters: rules by host and path, then gradient-boosted trees on lexical features.

All of it is DataFrame expressions.  The trees are trained by histograms: one
aggregation for each level sums gradients by node, feature and bin (a bounded
table), from which the driver picks the splits.  The trained trees become one
nested CASE expression, so that scoring is a projection without a shuffle.

Training takes labelled URLs; without any others, the URLs that a rule judges are
the labels.  Shares of blocked URLs by suffix are counted over all of them and
joined to the rows.  The trees take at most ``fit_rows`` of them, in order of a
hash of the URL.  Scoring covers all rows.

Behaviour on odd input: a null URL or one without "://" has an empty host and
path and is judged by the trees; with no labelled URL, or one kind alone, what
no rule judges gets that kind, or ``allow``; repeated URLs get equal verdicts;
other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, onto, settle, unused

#: Labelled URLs that the fit may see at most.
FIT_ROWS = 20_000
TREES, DEPTH, BINS, RATE, LEAF = 10, 2, 16, 0.4, 5.0

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def rules(*given: tuple[str, str]) -> list[Rule]:
    """(verdict, "host/path") pairs, longest first; of equal rules the first wins."""
    out = []
    for verdict, text in given:
        host, slash, path = text.partition("/")
        out.append(Rule(verdict, host.translate(str.maketrans(_UPPER, _LOWER)), slash + path))
    return sorted(out, key=lambda r: -len(r.name))


def rest(url: Column) -> Column:
    """What follows the first "://"; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(rest(url), F.lit("")), r"^([^/?#]*)", 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(rest(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def judge(given: list[Rule], h: Column, p: Column) -> tuple[Column, Column]:
    """The longest fitting rule's name and verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(given):
        fits = ((h == r.host) | h.endswith("." + r.host)) & p.startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def _count(text: Column, what: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))


def suffix(h: Column, labels: int) -> Column:
    return F.substring_index(h, ".", -labels)


def lexical(url: Column) -> dict[str, Column]:
    """Features of a URL's text; ``suffix1`` and ``suffix2`` are text."""
    u = F.coalesce(url, F.lit(""))
    h, p = host(url), path(url)
    n = F.greatest(F.length(u), F.lit(1))
    marks = F.split(u, "")
    counts = F.transform(F.array_distinct(marks), lambda c: F.length(u) - F.length(F.replace(u, c, F.lit(""))))
    entropy = F.log2(n) - F.aggregate(counts, F.lit(0.0), lambda a, c: a + F.when(c > 0, c * F.log2(c)).otherwise(0.0)) / n
    return {
        "length": F.length(u).cast("double"),
        "host_length": F.length(h).cast("double"),
        "path_length": F.length(p).cast("double"),
        "depth": _count(p, "/").cast("double"),
        "labels": _count(h, ".").cast("double"),
        "digits": F.length(F.regexp_replace(u, "[^0-9]", "")) / n,
        "host_digits": F.length(F.regexp_replace(h, "[^0-9]", "")) / F.greatest(F.length(h), F.lit(1)),
        "hyphens": _count(h, "-").cast("double"),
        "parameters": (F.when(F.contains(u, F.lit("?")), 1).otherwise(0) + _count(u, "&")).cast("double"),
        "fragment": F.contains(u, F.lit("#")).cast("double"),
        "entropy": F.round(entropy, 6),
        "suffix1": suffix(h, 1),
        "suffix2": suffix(h, 2),
    }


NUMBERS = ("length", "host_length", "path_length", "depth", "labels", "digits", "host_digits", "hyphens", "parameters", "fragment", "entropy")


@dataclass
class Trees:
    prior: float
    shares: dict[str, DataFrame]  # share of blocked URLs by suffix, settled
    trees: list  # nested (feature, threshold, left, right) or a leaf's value
    constant: str | None = None

    def margin(self, features: dict[str, Column]) -> Column:
        def one(t):
            return F.lit(float(t)) if not isinstance(t, tuple) else F.when(features[t[0]] <= t[1], one(t[2])).otherwise(one(t[3]))

        total = F.lit(0.0)
        for t in self.trees:
            total = total + one(t)
        return total

    def verdict(self, df: DataFrame, url: str, out: str) -> DataFrame:
        """``df`` with the verdict in column ``out``; features in a projection of their own."""
        if self.constant:
            return df.withColumn(out, F.lit(self.constant))
        names = {k: unused(df.columns, f"url_{k}") for k in (*NUMBERS, *SUFFIX)}
        wide = df.withColumns({names[k]: v for k, v in lexical(F.col(url)).items()})
        for s in SUFFIX:
            wide = with_share(wide, names[s], self.shares[s], self.prior)
        m = self.margin({k: F.col(v) for k, v in names.items()})
        return wide.withColumn(out, F.when(m > 0, "block").otherwise("allow")).drop(*names.values())


SUFFIX = ("suffix1", "suffix2")


def with_share(rows: DataFrame, column: str, shares: DataFrame, prior: float) -> DataFrame:
    """A column of suffixes replaced by their shares; unknown ones have the prior."""
    value = unused(rows.columns, "share")
    one = shares.toDF(column, value)
    both = rows.join(F.broadcast(one), column, "left") if shares.count() <= BROADCAST_ROWS else onto(rows, one, column)
    return both.withColumn(column, F.coalesce(value, F.lit(prior))).drop(value)


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> Trees:
    """Boosted trees from columns url and blocked (0 or 1)."""
    rows = labelled.where("url is not null and blocked is not null").groupBy("url").agg(F.max("blocked").cast("double").alias("y"))
    total = rows.agg(F.count("*").alias("n"), F.sum("y").alias("y")).first()
    if not total.n or total.y in (0, total.n):
        return Trees(0.5, {}, [], "block" if total.n and total.y else "allow")
    prior = total.y / total.n
    ends = rows.select("y", *[v.alias(k) for k, v in lexical(F.col("url")).items() if k in SUFFIX])
    shares = {s: settle(ends.groupBy(s).agg(((F.sum("y") + 10 * prior) / (F.count("*") + 10)).alias("share"))) for s in SUFFIX}
    if total.n > fit_rows:
        top, margin = 1 << 30, fit_rows + 8 * int(fit_rows**0.5) + 16
        rows = rows.withColumn("mark", F.pmod(F.xxhash64("url", F.lit(31)), F.lit(top))).where(F.col("mark") <= int(min(1, margin / total.n) * top))
        rows = rows.orderBy("mark", "url").limit(fit_rows).drop("mark")
    raw = rows.select("y", *[v.alias(k) for k, v in lexical(F.col("url")).items()])
    for s in SUFFIX:
        raw = with_share(raw, s, shares[s], prior)
    raw = settle(raw)
    if raw.select("y").distinct().count() < 2:
        return Trees(0.5, {}, [], "block" if raw.first().y else "allow")
    model = Trees(prior, shares, [])
    names = [*NUMBERS, *SUFFIX]
    cuts = dict(zip(names, [sorted(set(c)) for c in raw.approxQuantile(names, [i / BINS for i in range(1, BINS)], 0.005)], strict=True))
    binned = settle(raw.select("y", *names, *[_bin(k, cuts[k]).alias(f"bin_{k}") for k in names]).groupBy("y", *names, *[f"bin_{k}" for k in names]).agg(F.count("*").alias("w")))
    columns = {k: F.col(k) for k in names}
    bias = _logit(prior)
    model.trees.append(bias)
    for _ in range(TREES):
        prob = 1 / (1 + F.exp(-model.margin(columns)))
        grads = binned.withColumns({"g": (prob - F.col("y")) * F.col("w"), "h": prob * (1 - prob) * F.col("w")})
        model.trees.append(_grow(grads, names, cuts))
    return model


def _bin(name: str, cuts: list[float]) -> Column:
    """The number of cuts below the value."""
    return sum([(F.col(name) > t).cast("int") for t in cuts], F.lit(0))


def _logit(p: float) -> float:
    import math

    return math.log(p / (1 - p))


def _grow(grads: DataFrame, names: list[str], cuts: dict):
    """One tree, level by level; each level is one aggregation."""
    splits: dict[int, tuple] = {}
    values: dict[int, float] = {}
    node = F.lit(1)
    for level in range(DEPTH + 1):
        at = grads.withColumn("node", node)
        cells = F.inline(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"bin_{k}").alias("b")) for i, k in enumerate(names)]))
        table = at.select("node", "g", "h", cells).groupBy("node", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
        by: dict[int, dict] = {}
        for r in table:
            by.setdefault(r.node, {}).setdefault(r.f, []).append((r.b, r.g, r.h))
        for k, features in sorted(by.items()):
            if k < 1 << level:
                continue  # a leaf of a level above
            g, h = (sum(c[i] for c in features[0]) for i in (1, 2))
            values[k] = -RATE * g / (h + 1)
            best = (1e-6, None)
            for f in sorted(features):
                left_g = left_h = 0.0
                for b, cg, ch in sorted(features[f]):
                    left_g, left_h = left_g + cg, left_h + ch
                    if b >= len(cuts[names[f]]) or left_h < LEAF or h - left_h < LEAF:
                        continue
                    gain = left_g**2 / (left_h + 1) + (g - left_g) ** 2 / (h - left_h + 1) - g**2 / (h + 1)
                    if gain > best[0] + 1e-9:
                        best = (gain, (names[f], cuts[names[f]][b]))
            if best[1] and level < DEPTH:
                splits[k] = best[1]
        fresh = {k: s for k, s in splits.items() if k >= 1 << level}
        if not fresh:
            break
        step = node
        for k, (f, t) in fresh.items():
            step = F.when(node == k, F.when(F.col(f) <= t, 2 * k).otherwise(2 * k + 1)).otherwise(step)
        node = step

    def build(k):
        return (*splits[k], build(2 * k), build(2 * k + 1)) if k in splits else values.get(k, 0.0)

    return build(1)


def filter_urls(pages: DataFrame, given: list[Rule], url_col: str = "url", labelled: DataFrame | None = None, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``keep``, host, path, rule and verdict of every row."""
    rows = pages.select(*[F.col(c).alias(f"keep{i}") for i, c in enumerate(keep)], F.col(url_col).alias("url"))
    rows = rows.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    name, verdict = judge(given, F.col("host"), F.col("path"))
    rows = rows.withColumns({"rule": name, "by_rule": verdict})
    if labelled is None:
        labelled = rows.where("by_rule is not null").select("url", (F.col("by_rule") == "block").cast("int").alias("blocked"))
    rows = fit(labelled).verdict(rows, "url", "by_trees")
    return rows.select(*[F.col(f"keep{i}").alias(c) for i, c in enumerate(keep)], "host", "path", "rule", F.coalesce("by_rule", "by_trees").alias("verdict"))
