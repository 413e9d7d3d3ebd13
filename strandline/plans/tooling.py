"""Tools around plans: chains, retries, timing, concurrent actions, settings, names."""

from __future__ import annotations

import functools
import inspect
import json
import logging
import os
import time
import zoneinfo
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession


# -- chains --------------------------------------------------------------------------
def chain(df: DataFrame, *steps) -> DataFrame:
    """Apply steps in turn: functions of a frame, or (function, arguments...) tuples."""
    for s in steps:
        df = s[0](df, *s[1:]) if isinstance(s, tuple) else s(df)
    return df


def try_back(function: Callable) -> Callable:
    """On an error the first argument comes back."""

    @functools.wraps(function)
    def run(first, *a, **k):
        try:
            return function(first, *a, **k)
        except Exception:
            return first

    return run


def retry(function: Callable, repeat: int = 0, sleep: float = 0, value=None) -> Callable:
    """Try again after errors; in the end give ``value`` back."""

    @functools.wraps(function)
    def run(*a, **k):
        for i in range(repeat + 1):
            try:
                return function(*a, **k)
            except Exception:
                if i < repeat:
                    time.sleep(sleep)
        return value

    return run


def timed(function: Callable, n: int = 1) -> Callable:
    """Run n times; returns (the last result, seconds) and logs them."""

    @functools.wraps(function)
    def run(*a, **k):
        began = time.perf_counter()
        for _ in range(n):
            out = function(*a, **k)
        took = time.perf_counter() - began
        logger().info("%s: %d runs in %.3f s", function.__name__, n, took)
        return out, took

    return run


def gather(*actions: Callable, workers: int = 8) -> list:
    """Run independent Spark actions side by side; results in order, the first error raised."""
    with ThreadPoolExecutor(max(1, min(workers, len(actions) or 1))) as pool:
        return [f.result() for f in [pool.submit(a) for a in actions]]


def keyed_cache(function: Callable) -> Callable:
    """Memoise by arguments; arguments that cannot be keys are not cached."""
    kept: dict = {}

    @functools.wraps(function)
    def run(*a, **k):
        try:
            key = (a, tuple(sorted(k.items())))
            hash(key)
        except TypeError:
            return function(*a, **k)
        if key not in kept:
            kept[key] = function(*a, **k)
        return kept[key]

    run.clear = kept.clear
    return run


# -- functions with options ------------------------------------------------------------
class Wrapper:
    """A base of function wrappers with options.

    A subclass defines ``run(*args, **kwargs)`` and calls ``self.function``.  Without a
    function an instance is a decorator.  Wrapping what already has a wrapper of the
    same class updates that one's options instead of running it twice; wrappers of
    other classes between them stay in their order.
    """

    def __init__(self, function: Callable | None = None, **options):
        between = []
        while isinstance(function, Wrapper):
            if type(function) is type(self):
                options = function.options | options
            else:
                between.append(function)
            function = function.function
        for w in reversed(between):
            function = type(w)(function, **w.options)
        self.function, self.options = function, options

    def __call__(self, *args, **kwargs):
        if self.function is None:
            return type(self)(*args, **self.options)
        return self.run(*args, **kwargs)

    def run(self, *args, **kwargs):
        return self.function(*args, **kwargs)

    @property
    def __wrapped__(self):
        return self.function

    @property
    def __name__(self) -> str:
        return getattr(self.function, "__name__", type(self).__name__)

    def __repr__(self) -> str:
        return f"{type(self).__name__}({self.__name__}, {', '.join(f'{k}={v!r}' for k, v in self.options.items())})"


def specification(function: Callable) -> dict:
    """Names, defaults and catch-alls of a function's parameters."""
    p = inspect.signature(function).parameters.values()
    return {
        "args": [x.name for x in p if x.kind in (x.POSITIONAL_ONLY, x.POSITIONAL_OR_KEYWORD)],
        "kwonly": [x.name for x in p if x.kind is x.KEYWORD_ONLY],
        "defaults": {x.name: x.default for x in p if x.default is not x.empty},
        "varargs": next((x.name for x in p if x.kind is x.VAR_POSITIONAL), None),
        "varkw": next((x.name for x in p if x.kind is x.VAR_KEYWORD), None),
    }


class Partial(Wrapper):
    """Keywords given beforehand, and ``kw``, names that a function's catch-all takes:
    they become parameters of its own, so that columns can be bound to them."""

    @property
    def __signature__(self) -> inspect.Signature:
        own = [p for p in inspect.signature(self.function).parameters.values() if p.kind is not p.VAR_KEYWORD and p.name not in self.options]
        more = [inspect.Parameter(n, inspect.Parameter.KEYWORD_ONLY) for n in self.options.get("kw", ()) if n not in self.options]
        return inspect.Signature(own + more)

    def run(self, *args, **kwargs):
        given = {k: v for k, v in self.options.items() if k != "kw"}
        return self.function(*args, **given | kwargs)


def partialize(function: Callable, *args, **kwargs) -> Callable:
    """A partial of those keywords that the function takes."""
    spec = specification(function)
    if not spec["varkw"]:
        kwargs = {k: v for k, v in kwargs.items() if k in spec["args"] + spec["kwonly"]}
    return functools.partial(function, *args, **kwargs)


class Picked(Wrapper):
    """Arguments that are mappings or frames lend the member of the parameter's name.

    ``remap`` {parameter: member} renames; ``strict`` raises where there is none, else
    the argument goes on as it is.
    """

    def run(self, *args, **kwargs):
        names = specification(self.function)["args"]
        given = dict(zip(names, args, strict=False)) | kwargs
        remap, strict = self.options.get("remap", {}), self.options.get("strict", False)

        def pick(name, value):
            member = remap.get(name, name)
            keys = value.columns if isinstance(value, DataFrame) else value.keys() if isinstance(value, dict) else None
            if keys is None:
                return value
            if member in keys:
                return value[member]
            if strict:
                raise KeyError(member)
            return value

        return self.function(*args[len(names) :], **{k: pick(k, v) for k, v in given.items()})


def attributes(value, names=None, base=None, *default) -> dict:
    """Attributes of an object as a dict: the named ones, or those that ``base`` lacks."""
    if names is None:
        have = set(dir(base)) if base is not None else set(dir(object))
        names = [n for n in dir(value) if n not in have and not n.startswith("_")]
    return {n: getattr(value, n, *default) for n in ([names] if isinstance(names, str) else names)}


def same_attributes(a, b, names) -> bool:
    return attributes(a, names, None, None) == attributes(b, names, None, None)


# -- names ---------------------------------------------------------------------------
class Names(list):
    """Column names in first-seen order, each once: + or | joins, & meets, - takes away, % keeps those with a text."""

    def __init__(self, names: Iterable = ()):
        super().__init__(dict.fromkeys([names] if isinstance(names, str) else names))

    def __add__(self, other):
        return Names([*self, *Names(other)])

    __or__ = __add__

    def __and__(self, other):
        return Names(n for n in self if n in Names(other))

    def __sub__(self, other):
        return Names(n for n in self if n not in Names(other))

    def __rsub__(self, other):
        return Names(other) - self

    def __mod__(self, text):
        return Names(n for n in self if isinstance(n, str) and text in n)

    def __truediv__(self, test):
        """Without members of a type, those that pass a predicate, or those that equal a value."""
        if isinstance(test, type):
            return Names(n for n in self if not isinstance(n, test))
        return Names(n for n in self if not (test(n) if callable(test) else n == test))


# -- settings --------------------------------------------------------------------------
def read_settings(spark: SparkSession, *paths: str) -> dict:
    """JSON files of settings, later ones over earlier ones, set on the session."""
    out: dict = {}
    for p in paths:
        if os.path.exists(p):
            with open(p, encoding="utf-8") as f:
                out |= json.load(f)
    for k, v in out.items():
        spark.conf.set(k, str(v))
    return out


def write_settings(settings: dict, *paths: str) -> str:
    """Write to the first place that takes it."""
    for p in paths:
        try:
            os.makedirs(os.path.dirname(p) or ".", exist_ok=True)
            with open(p, "w", encoding="utf-8") as f:
                json.dump(settings, f)
            return p
        except OSError:
            continue
    raise OSError("no place to write settings")


@functools.cache
def logger(name: str = "strandline", level: str = "INFO") -> logging.Logger:
    out = logging.getLogger(name)
    out.setLevel(level)
    return out


@functools.cache
def _zones() -> dict[str, str]:
    out = {}
    for z in sorted(zoneinfo.available_timezones()):
        out.setdefault(z.lower(), z)
        out.setdefault(z.rsplit("/", 1)[-1].replace("_", " ").lower(), z)
    return out


# Zones of countries and of abbreviations.
COUNTRY_ZONES = {"uk": "Europe/London", "gb": "Europe/London", "us": "America/New_York", "jp": "Asia/Tokyo", "hk": "Asia/Hong_Kong", "cn": "Asia/Shanghai", "au": "Australia/Sydney", "sg": "Asia/Singapore", "in": "Asia/Kolkata", "de": "Europe/Berlin", "fr": "Europe/Paris", "ch": "Europe/Zurich"}
SHORT_ZONES = {"est": "America/New_York", "edt": "America/New_York", "et": "America/New_York", "cst": "America/Chicago", "ct": "America/Chicago", "pst": "America/Los_Angeles", "pt": "America/Los_Angeles", "bst": "Europe/London", "cet": "Europe/Paris", "jst": "Asia/Tokyo", "hkt": "Asia/Hong_Kong", "ist": "Asia/Kolkata", "aest": "Australia/Sydney", "utc": "UTC", "gmt": "GMT"}


def zone(name: str) -> str:
    """A time zone's id from the id itself, a city's name, a country's code or an abbreviation."""
    low = name.strip().lower()
    found = COUNTRY_ZONES.get(low) or SHORT_ZONES.get(low) or _zones().get(low)
    if found is None:
        raise ValueError(f"no such time zone: {name}")
    return found
