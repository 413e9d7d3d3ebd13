"""Dates as Column expressions: parsing, bumps, ranges, clocks, formats, zones.

Stamps are TIMESTAMP_NTZ.  Months, quarters and years overflow instead of clamping
(31 August plus three months is 1 December) and drop the time of day.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NTZ = "timestamp_ntz"

# Month codes of futures contracts, January to December.
FUTURES_MONTHS = "FGHJKMNQUVXZ"
# Month names by their first three letters.
MONTH_NAMES = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
# Named bumps.
NAMED = {"spot": "0b", "on": "1b", "o/n": "1b", "tn": "2b", "t/n": "2b", "sn": "3b", "s/n": "3b"}

_STEP = re.compile(r"([+-]?)(\d+)([a-zA-Z])")


def parse_bump(text: str) -> list[tuple[int, str]]:
    """Steps (number, unit) of a bump such as "3m", "-1b" or "1y1m-1d"; each has its own sign."""
    text = NAMED.get(text.strip().lower(), text.strip().lower())
    out, at = [], 0
    for m in _STEP.finditer(text):
        if m.start() != at:
            break
        out.append((int(m[1] + m[2]), m[3]))
        at = m.end()
    if at != len(text) or not out or any(u not in "dwmqyhnsb" for _, u in out):
        raise ValueError(f"not a bump: {text}")
    return out


def parse_steps(text: str) -> list[str]:
    """The single steps of a bump, as text with their signs."""
    parse_bump(text)
    return [m[0] for m in _STEP.finditer(NAMED.get(text.strip().lower(), text.strip().lower()))]


def is_bump(value) -> bool:
    if isinstance(value, int):
        return value < 1500
    try:
        return bool(parse_bump(value))
    except (ValueError, AttributeError):
        return False


def negative(bump):
    """The opposite bump."""
    if isinstance(bump, int):
        return -bump
    return "".join(f"{-n:+d}{u}" for n, u in parse_bump(bump))


def midnight(t: Column) -> Column:
    return t.cast("date").cast(NTZ)


def overflow(t: Column, months) -> Column:
    """The day of the month counted on from the first of the month ``months`` away."""
    first = F.add_months(F.trunc(t.cast("date"), "MM"), months)
    return F.date_add(first, F.dayofmonth(t) - 1).cast(NTZ)


def end_of_month(t: Column) -> Column:
    return F.last_day(t.cast("date")).cast(NTZ)


def weekday_bump(t: Column, n: Column | int) -> Column:
    """n weekdays on; a weekend counts as the Monday after it."""
    n = n if isinstance(n, Column) else F.lit(n)
    day = F.weekday(t)
    ahead = F.when(day > 4, 7 - day).otherwise(0)
    start = F.when(day > 4, 0).otherwise(day)
    weeks = F.floor(n / 5)
    rest = n - weeks * 5
    days = ahead + weeks * 7 + rest + F.when(start + rest > 4, 2).otherwise(0)
    return plus_days(t, days.cast("int"))


def plus_days(t: Column, n) -> Column:
    n = n if isinstance(n, Column) else F.lit(n)
    return (t.cast(NTZ) + F.make_dt_interval(days=n.cast("int"))).cast(NTZ)


def bump(t: Column, *bumps, eom: bool | int = False) -> Column:
    """A stamp moved by whole days (int) or bump texts, one after the other.

    ``eom`` counts from the end of the month: the distance to the next month's first is
    kept (with a number n, only for stamps at most n days before it).
    """
    for b in bumps:
        if isinstance(b, int):
            t = plus_days(t, b)
        elif eom is False:
            t = _steps(t, b)
        else:
            first = F.add_months(F.trunc(t.cast("date"), "MM"), 1).cast(NTZ)
            moved = (_steps(first, b) - (first - t)).cast(NTZ)
            t = moved if eom is True else F.when(F.datediff(first, t) <= eom, moved).otherwise(_steps(t, b))
    return t


def _steps(t: Column, text: str) -> Column:
    for n, unit in parse_bump(text):
        if unit in "dw":
            t = plus_days(t, n * (7 if unit == "w" else 1))
        elif unit in "mqy":
            t = overflow(t, n * {"m": 1, "q": 3, "y": 12}[unit])
        elif unit == "b":
            t = weekday_bump(t, n)
        else:
            part = {"h": "hours", "n": "mins", "s": "secs"}[unit]
            t = (t.cast(NTZ) + F.make_dt_interval(**{part: F.lit(n)})).cast(NTZ)
    return t


def bump_index(df: DataFrame, idx: str, *bumps, keep: str = "last", by=(), eom: bool = False) -> DataFrame:
    """A series with its index moved; of stamps that then coincide the last (first) stays."""
    from ..operators.slices import one_per_index

    moved = df.withColumns({"_was": F.col(idx), idx: bump(F.col(idx), *bumps, eom=eom)})
    rest = [c for c in df.columns if c != idx and c not in by]
    return one_per_index(moved, idx, "_was", by, keep).select(*by, idx, *rest)


# -- construction and parsing -------------------------------------------------------
def year_month(y: Column, m: Column) -> tuple[Column, Column]:
    """Year and month with the month brought to 1 to 12."""
    k = y * 12 + m - 1
    return F.floor(k / 12).cast("int"), (F.pmod(k, F.lit(12)) + 1).cast("int")


def from_parts(y: Column, m: Column, d: Column) -> Column:
    """The d-th day counted from the first of a month; month and day may overflow."""
    y, m = year_month(y, m)
    return F.date_add(F.make_date(y, m, F.lit(1)), (d - 1).cast("int")).cast(NTZ)


def month_number(m: Column) -> Column:
    """1 to 12 from a number, a name, or a futures letter."""
    text = F.lower(F.trim(m.cast("string")))
    out = text.try_cast("int")
    by_name = F.try_element_at(F.create_map(*[F.lit(x) for i, n in enumerate(MONTH_NAMES) for x in (n, i + 1)]), F.substring(text, 1, 3))
    by_letter = F.try_element_at(F.create_map(*[F.lit(x) for i, n in enumerate(FUTURES_MONTHS.lower()) for x in (n, i + 1)]), text)
    return F.when(F.length(text) == 1, F.coalesce(by_letter, out)).otherwise(F.coalesce(out, by_name))


def nth_weekday(y: Column, m: Column, n: int, day: Column | int) -> Column:
    """The n-th weekday (0 is Monday) of a month; negative from its end."""
    day = day if isinstance(day, Column) else F.lit(day)
    first = from_parts(y, m, F.lit(1)) if n > 0 else from_parts(y, m + 1, F.lit(1))
    ahead = F.pmod(day - F.weekday(first), F.lit(7))
    return plus_days(first, ahead + 7 * (n - 1 if n > 0 else n))


def from_number(n: Column, today: Column) -> Column:
    """A number as a date, by its size: days from today, a year, a spreadsheet serial, a
    proleptic ordinal, yyyymmdd, or seconds since 1970."""
    whole = n.cast("bigint")
    part = F.make_dt_interval(secs=((n - whole) * 86400).cast("decimal(18,6)"))
    days = lambda base, k: (F.date_add(F.lit(base).cast("date"), k.cast("int"))).cast(NTZ) + part
    ymd = from_parts(F.floor(whole / 10000).cast("int"), (F.floor(whole / 100) % 100).cast("int"), (whole % 100).cast("int"))
    seconds = F.timestamp_seconds(n)
    return (
        F.when(whole <= 1500, plus_days(midnight(today), whole.cast("int")) + part)
        .when(whole <= 3000, F.make_date(whole.cast("int"), F.lit(1), F.lit(1)).cast(NTZ) + part)
        .when(whole < 300_000, days("1899-12-30", whole))
        .when(whole < 1_095_000, days("0001-01-01", whole - 1))
        .when((whole > 10_000_101) & (whole < 30_001_231), ymd + part)
        .otherwise(F.convert_timezone(F.current_timezone(), F.lit("UTC"), seconds.cast(NTZ)))
    )


# What a text must look like for a format to fit.  A format that fails costs an exception,
# so each text meets at most one of a group; no two shapes of a group have texts in common.
# Shapes are of the text as given: code that Java compiles has no room to change it first.
_YEAR, _HM = r"[+-]?\d{4,}", r" \d+:\d+"
_WHOLE = (
    (_YEAR + r"-\d+-\d+", "yyyy-M-d"),
    (_YEAR + r"-\d+-\d+[Tt]\d+:\d+:\d+", "yyyy-M-d'T'H:m:s"),
    (_YEAR + r"-\d+-\d+" + _HM + r":\d+", "yyyy-M-d H:m:s"),
    (_YEAR + r"-\d+-\d+" + _HM, "yyyy-M-d H:m"),
    (_YEAR + r"-\d+", "yyyy-M"),
    (r"[+-]?\d{8,}", "yyyyMMdd"),
    (_YEAR + r"/\d+/\d+", "yyyy/M/d"),
)
_DAY_MONTH = r"(?:\d+/\d+/|\d{1,2}[-. ]\d{1,2}[-. ])"
_SLASHED = ((_YEAR, "yyyy"), (r"\d\d", "yy"), (_YEAR + _HM + r":\d+", "yyyy H:m:s"), (_YEAR + _HM, "yyyy H:m"))
_NAME, _GAP = r"[^-\d ]", "[- ]+"
_NAMED_MONTH = (
    (r"\d+" + _GAP + _NAME + "{3}" + _GAP + _YEAR, "d MMM yyyy"),
    (r"\d+" + _GAP + f"(?:{_NAME}{{1,2}}|{_NAME}{{4,}})" + _GAP + _YEAR, "d MMMM yyyy"),
    (_NAME + "+" + _GAP + _YEAR, "MMM yyyy"),
    (_NAME + "+" + _GAP + r"\d+" + _GAP + _YEAR, "MMM d yyyy"),
)


def _by_shape(t: Column, shapes, text: Column) -> Column:
    """Text as a stamp by the format that fits the shape of ``t``; null where none does."""
    (shape, fmt), *rest = shapes
    form = F.when(t.rlike(f"^{shape}$"), fmt)
    for shape, fmt in rest:
        form = form.when(t.rlike(f"^{shape}$"), fmt)
    return F.try_to_timestamp(text, form).cast(NTZ)


def parse(text: Column, dialect: str = "uk") -> Column:
    """Text as a stamp; day first ("uk") or month first ("us"); null where nothing fits."""
    t = F.trim(text)
    first = "d/M/" if dialect == "uk" else "M/d/"
    slashed = F.regexp_replace(t, r"^(\d{1,2})[-. ](\d{1,2})[-. ]", "$1/$2/")
    named = F.initcap(F.regexp_replace(t, "[- ]+", " "))
    return F.coalesce(_by_shape(t, _WHOLE, t), _by_shape(t, [(_DAY_MONTH + shape, first + f) for shape, f in _SLASHED], slashed), _by_shape(t, _NAMED_MONTH, named))


# -- ranges -------------------------------------------------------------------------
def sequence(t0: Column, t1: Column, step) -> Column:
    """An array of stamps from t0 to t1: whole days, or one bump text.

    Each stamp is counted from t0, so month steps do not drift; a step in the wrong
    direction gives an empty array.
    """
    steps = [(step, "d")] if isinstance(step, int) else parse_bump(step)
    if len(steps) != 1 or not steps[0][0]:
        raise ValueError("a range takes one step that is not 0")
    n, unit = steps[0]
    span = F.datediff(t1, t0)
    ahead = (span >= 0) if n > 0 else (span <= 0)
    per = {"d": 1, "w": 7, "m": 28, "q": 84, "y": 365, "b": 1}.get(unit)
    if per is None:
        one = {"h": 3600, "n": 60, "s": 1}[unit] * abs(n)
        seconds = (F.unix_micros(t1.cast("timestamp")) - F.unix_micros(t0.cast("timestamp"))) / 1_000_000
        many = F.floor(F.abs(seconds) / one).cast("int")
        made = F.transform(F.sequence(F.lit(0), many), lambda k: t0.cast(NTZ) + F.make_dt_interval(secs=k * (one if n > 0 else -one)))
        return F.when((seconds >= 0) if n > 0 else (seconds <= 0), made).otherwise(F.slice(made, 1, 0))
    many = F.floor(F.abs(span) / (per * abs(n))).cast("int") + 1
    at = {
        "d": lambda k: plus_days(t0, k * n),
        "w": lambda k: plus_days(t0, k * n * 7),
        "b": lambda k: weekday_bump(t0, k * n),
        "m": lambda k: overflow(t0, k * n),
        "q": lambda k: overflow(t0, k * n * 3),
        "y": lambda k: overflow(t0, k * n * 12),
    }[unit]
    made = F.transform(F.sequence(F.lit(0), many), at)
    inside = F.filter(made, lambda t: (t <= t1) if n > 0 else (t >= t1))
    return F.when(ahead, inside).otherwise(F.slice(inside, 1, 0))


# -- clocks ---------------------------------------------------------------------------
def ordinal(t: Column) -> Column:
    return F.datediff(t.cast("date"), F.lit("0001-01-01").cast("date")) + 1


def weekday_ordinal(t: Column) -> Column:
    """Weekdays since 1900-01-01, a Monday; a weekend has the number of the Monday after
    it, or, where that is in another month, of the Friday before it."""
    n = F.datediff(t.cast("date"), F.lit("1900-01-01").cast("date"))
    day = F.weekday(t)
    crosses = F.month(F.date_add(t.cast("date"), (7 - day).cast("int"))) != F.month(t)
    return F.floor(n / 7) * 5 + F.when((day > 4) & crosses, 4).otherwise(F.least(day, F.lit(5)))


def day_fraction(t: Column) -> Column:
    return (F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)) / F.lit(86400.0)


def clock(t: Column, kind: str | None) -> Column:
    """A number that grows with time: d days, w weeks, m months, q quarters, y years,
    f days with fraction, b weekdays, k weekdays with fraction; null without a kind."""
    if kind is None:
        return F.lit(None).cast("double")
    kinds = {
        "d": lambda: ordinal(t),
        "w": lambda: F.floor(ordinal(t) / 7),
        "m": lambda: F.year(t) * 12 + F.month(t),
        "q": lambda: F.year(t) * 4 + F.quarter(t) - 1,
        "y": lambda: F.year(t),
        "f": lambda: ordinal(t) + day_fraction(t),
        "b": lambda: weekday_ordinal(t),
        "k": lambda: weekday_ordinal(t) + F.when(F.weekday(t) > 4, 0.0).otherwise(day_fraction(t)),
    }
    return kinds[kind]()


def counter(idx: str, by=(), start: int = 0) -> Column:
    """The row's number in its series, from ``start`` + 1."""
    from ..operators.fill import frames

    return F.row_number().over(frames(idx, by)[3]) + start


# -- text and zones --------------------------------------------------------------------
# Directives of C's strftime and their letters here.
_LETTERS = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD", "f": "SSSSSS", "p": "a", "I": "hh"}


def java_format(fmt: str) -> str:
    """A strftime format, or a shorthand such as "Ymd" or "Y-m-d", for date_format."""
    if "%" in fmt:
        return re.sub(r"%(\w)", lambda m: _LETTERS[m[1]], fmt)
    return "".join(_LETTERS.get(c, c if not c.isalpha() else f"'{c}'") for c in fmt)


def to_text(t: Column, fmt: str | None = None) -> Column:
    """yyyymmdd at midnight, else the ISO form; or by a format; "-" is short for "Y-m-d"."""
    if fmt is None:
        whole = t == midnight(t)
        return F.when(whole, F.date_format(t, "yyyyMMdd")).otherwise(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"))
    return F.date_format(t, java_format(fmt if any(c.isalnum() for c in fmt) else fmt.join("Ymd")))


def set_zone(t: Column, zone: str) -> Column:
    """A wall clock's stamp as an instant of a zone (TIMESTAMP); the clock's reading stays."""
    return F.to_utc_timestamp(t.cast(NTZ).cast("timestamp"), zone)


def or_now(t: Column, otherwise: Column | None = None) -> Column:
    """The stamp, or another (the present) where it is null."""
    return F.coalesce(t, (F.current_timestamp() if otherwise is None else otherwise).cast(NTZ))


def convert_zone(t: Column, source: str, target: str) -> Column:
    """The same instant on another zone's clock."""
    return F.convert_timezone(F.lit(source), F.lit(target), t.cast(NTZ))


def seconds_of_day(text: Column) -> Column:
    """"9", "0930", "93000", "9:30" or "09:30:15" as seconds of the day; null otherwise."""
    t = F.trim(text.cast("string"))
    part = lambda i: F.coalesce(F.try_element_at(F.split(t, ":"), F.lit(i)).try_cast("int"), F.lit(0))
    colon = part(1) * 3600 + part(2) * 60 + part(3)
    n = t.try_cast("int")
    digits = F.when(F.length(t) <= 2, n * 3600).when(F.length(t) <= 4, F.floor(n / 100) * 3600 + (n % 100) * 60).otherwise(F.floor(n / 10000) * 3600 + (F.floor(n / 100) % 100) * 60 + n % 100)
    return F.when(t.rlike(r"^\d{1,2}(:\d{1,2}){1,2}$"), colon).when(t.rlike(r"^\d{1,6}$"), digits).cast("int")
