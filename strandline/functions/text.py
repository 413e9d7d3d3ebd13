"""Text functions as Column expressions; null stays null."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The letters.
ALPHABET = "abcdefghijklmnopqrstuvwxyz"
# Market sectors whose case is restored.
SECTORS = ("Comdty", "Index", "Curncy", "Corp", "Pfd", "Equity", "Govt", "Mtge")
# Suffixes of numbers and the powers of ten that they stand for.
POWERS = {"million": 6, "billion": 9, "trillion": 12, "percent": -2, "mln": 6, "bln": 9, "tln": 12, "trl": 12, "pct": -2, "mn": 6, "bn": 9, "tn": 12, "bp": -4, "%": -2, "m": 6, "k": 3, "b": 9, "t": 12, "crore": 7, "lakh": 5}
# Characters that leave a heading, and those that become "_".
GONE, BREAKS = "\"',;.()£$#:?", "/ &"


def over(function):
    """A text function that also maps arrays of text."""

    def run(c: Column, array: bool = False) -> Column:
        return F.transform(c, function) if array else function(c)

    return run


lower, upper = over(F.lower), over(F.upper)
capitalize = over(lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30))))
proper = over(F.initcap)


def strip(c: Column, chars: str | None = None) -> Column:
    """Without white space (or the given characters) at both ends."""
    if chars is not None:
        return F.btrim(c, F.lit(chars))
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def two_decimals(c: Column) -> Column:
    return F.format_string("%.2f", c.cast("double"))


def replace(c: Column, old, new: str = "") -> Column:
    """Replace literals, one after the other, until none is left.

    A literal inside its own replacement raises, since that would never end.  A run
    that shrinks to its own beginning is one regular expression; other literals that
    a replacement could make anew are replaced as often as a text can need it.
    """
    for o in [old] if isinstance(old, str) else list(old):
        if o in new:
            raise ValueError(f"{o!r} is in its replacement")
        if len(set(o + new)) == 1 and o:
            ch = re.escape(o[0])
            k, n = len(o), len(new)
            # a run of r >= k characters loses k - n at a time until fewer than k are left
            run = F.regexp_replace(c, f"{ch}{{{k},}}", o[0] * n) if k - n == 1 else None
            c = run if run is not None else _settle(c, o, new)
        elif not new or not _remakes(o, new):
            c = F.replace(c, F.lit(o), F.lit(new)) if not _remakes(o, new) else _settle(c, o, new)
        else:
            c = _settle(c, o, new)
    return c


def _remakes(old: str, new: str) -> bool:
    """Whether putting ``new`` for ``old`` can bring about another ``old``."""
    if not new:
        return len(old) > 1
    return any(old.startswith(new[i:]) for i in range(len(new))) or any(old.endswith(new[: i + 1]) for i in range(len(new))) or new in old


def _settle(c: Column, old: str, new: str) -> Column:
    """Replace until nothing changes: each round shortens a text, so its length bounds the rounds."""
    rounds = F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1)))
    done = F.aggregate(rounds, c, lambda t, _: F.when(F.contains(t, F.lit(old)), F.replace(t, F.lit(old), F.lit(new))).otherwise(t))
    return F.when(F.contains(c, F.lit(old)), done).otherwise(c)


def split(c: Column, separators=" ", drop_empty: bool = False) -> Column:
    """Parts between separators (one or many literals)."""
    seps = [separators] if isinstance(separators, str) else list(separators)
    pattern = "|".join(re.escape(s) for s in sorted(seps, key=len, reverse=True))
    out = F.split(c, pattern, -1)
    return F.filter(out, lambda x: x != "") if drop_empty else out


def as_ascii(c: Column) -> Column:
    """Printable ASCII characters, without the backslash."""
    return F.regexp_replace(c, r"[^\x20-\x5B\x5D-\x7E]", "")


def clean_name(c: Column) -> Column:
    """A column name from a heading: trimmed, punctuation gone, breaks to "_", lower case."""
    return F.lower(F.translate(F.translate(strip(c), GONE, ""), BREAKS, "_" * len(BREAKS)))


def ticker_case(c: Column) -> Column:
    """Upper case, but the first market sector found, at the end or before a blank, in its own case."""
    up = F.upper(c)
    out = up
    for s in reversed(SECTORS):
        big = " " + s.upper()
        out = F.when(up.endswith(big) | F.contains(up, F.lit(big + " ")), F.replace(up, F.lit(big), F.lit(" " + s))).otherwise(out)
    return out


def as_float(c: Column) -> Column:
    """A number from text with separators and suffixes (1,200; 5%; 20bp; 1.5 bn); null if it is none."""
    t = F.lower(F.regexp_replace(c, "[, ]", ""))
    shape = r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?)([a-z%]*)$"
    number = F.regexp_extract(t, shape, 1).try_cast("double")
    suffix = F.regexp_extract(t, shape, 2)
    power = F.try_element_at(F.create_map(*[F.lit(x) for kv in POWERS.items() for x in kv]), suffix)
    times = F.when(power >= 0, F.pow(F.lit(10.0), power)).otherwise(1 / F.pow(F.lit(10.0), -power))
    return number * F.when(suffix == "", F.lit(1.0)).otherwise(times)


def common_prefix(c: Column) -> Column:
    """Aggregate: the longest common beginning; that of the least and the greatest text."""
    a, b = F.min(c), F.max(c)
    places = F.sequence(F.lit(0), F.least(F.length(a), F.length(b)))
    same = F.filter(places, lambda n: F.left(a, n) == F.left(b, n))
    return F.left(a, F.array_max(same))


def without_prefix(c: Column, prefix: Column, separator: str | None = None) -> Column:
    """The text without a common beginning; with a separator, only whole parts go."""
    n = F.length(prefix)
    if separator is not None:
        cut = F.length(F.substring_index(prefix, separator, -1))
        n = F.when(F.contains(prefix, F.lit(separator)), n - cut).otherwise(0)
    return F.substring(c, n + 1, F.length(c))
