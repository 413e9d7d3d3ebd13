"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of one to three lower-cased characters, each counted
over the whole text, divided by the number of n-grams and weighted by inverse
document frequency.  Weights are fitted by follow-the-regularised-leader with
elastic-net penalties; a temperature, fitted on rows kept aside, calibrates the
probabilities.  A score is linear in the counts, so prediction is one table
look-up per n-gram and a sum per text.

The weights are fitted on a bounded sample of labelled rows (``fit_rows``), chosen
by language and by a hash of id and text, so that every language has rows in it.
Document frequencies are counted over all labelled rows.  Prediction covers every
row and every character.

Behaviour on odd input: text that is null or has no letter gets ``und`` with
score 0; without any labelled row everything is ``und``; ties between languages
go to the first in alphabetical order; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .shared import lean
from .textkit import slices

#: Rows that the fit may see at most.
FIT_ROWS = 4000
BITS = 16
ORDERS = (1, 2, 3)
NOTHING = 1 << BITS  # the slot of positions without an n-gram

_BMP = range(1 << 16)
_lower = np.array([ord(x) if len(x := chr(c).lower()) == 1 and ord(x) < 1 << 16 else c for c in _BMP], np.uint32)
_letter = np.array([chr(c).isalpha() for c in _BMP])


def characters(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the rows in one array, and the rows' offsets in it."""
    try:
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        if len(off) == 2:  # one row, which may be very long
            return points, np.array([0, len(points)])
        return points, np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[off]
    except UnicodeDecodeError:
        rows = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(off.tolist(), off[1:].tolist(), strict=False)]
        return np.frombuffer("".join(rows).encode("utf-32-le", "replace"), np.uint32), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)


def grams(points: np.ndarray, off: np.ndarray):
    """For each order the slot of the n-gram that begins at each character."""
    low = np.where(points < 1 << 16, _lower[np.minimum(points, 0xFFFF)], points)
    code = np.zeros(len(low), np.uint32)
    starts, ends = off[:-1], off[1:]
    for n in ORDERS:
        code = code * np.uint32(0x01000193) if n > 1 else code
        code[: len(low) - n + 1] ^= low[n - 1 :] if n > 1 else low
        slot = ((code + np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        for j in range(1, n):
            last = ends - j
            slot[last[last >= starts]] = NOTHING
        yield slot


def totals(off: np.ndarray) -> np.ndarray:
    size = np.diff(off)
    return sum(np.maximum(size - n + 1, 0) for n in ORDERS)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # weights times idf, by slot; the last row is zero
    bias: np.ndarray
    temperature: float

    def score(self, data, off) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of the rows, the choice, and whether there is a letter."""
        points, at = characters(data, off)
        n = len(at) - 1
        sums = np.zeros((n, len(self.languages)))
        seen = np.zeros(n, bool)
        full = np.flatnonzero(np.diff(at) > 0)
        if len(full):
            step = 1 << 20
            # rows in pieces of bounded size; n-grams that cross a piece's end are kept by an overlap
            for lo in range(0, len(points), step):
                hi = min(len(points), lo + step)
                ext = min(len(points), hi + ORDERS[-1] - 1)
                a, b = np.searchsorted(at, lo, "right") - 1, np.searchsorted(at, hi, "left")
                own = np.clip(at[a : b + 1], lo, None)
                cut = np.minimum(own, ext) - lo
                part = points[lo : lo + cut[-1]]
                begin, stop = np.minimum(cut[:-1], hi - lo), np.minimum(cut[1:], hi - lo)
                some = np.flatnonzero(stop > begin)
                for slot in grams(part, cut):
                    w = self.table[slot[: hi - lo]]
                    sums[a + some] += np.add.reduceat(w, begin[some], axis=0)
                letters = np.where(part[: hi - lo] < 1 << 16, _letter[np.minimum(part[: hi - lo], 0xFFFF)], False)
                for i in np.flatnonzero(part[: hi - lo] >= 1 << 16):
                    letters[i] = chr(part[i]).isalpha()
                seen[a + some] |= np.logical_or.reduceat(letters, begin[some])
        z = (sums / np.maximum(totals(at), 1)[:, None] + self.bias) / self.temperature
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        return p, p.argmax(axis=1), seen


def fit_ftrl(rows, languages: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.02):
    """Weights (slot by language) and biases; rows: (label, slots, values)."""
    size = NOTHING + 1
    z, n = np.zeros((size, languages)), np.zeros((size, languages))
    zb, nb = np.zeros(languages), np.zeros(languages)

    def weights(z, n, l1):
        w = -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            y, at, x = rows[i]
            w, b = weights(z[at], n[at], l1), weights(zb, nb, 0.0)
            s = x @ w + b
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
            zb += p - (np.sqrt(nb + p * p) - np.sqrt(nb)) / alpha * b
            nb += p * p
    return weights(z, n, l1), weights(zb, nb, 0.0)


def _temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The temperature of the least negative log likelihood, by golden section."""

    def loss(log_t):
        s = scores / np.exp(log_t)
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]))

    lo, hi, r = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def _features(batches):
    for batch, data, off in slices(batches, 1):
        points, at = characters(data, off)
        slots = list(grams(points, at))
        out = []
        for i, (a, b) in enumerate(zip(at.tolist(), at[1:].tolist(), strict=False)):
            u, c = np.unique(np.concatenate([s[a:b] for s in slots]), return_counts=True)
            keep = u < NOTHING
            out.append((batch.column(0)[i].as_py(), batch.column(2)[i].as_py(), u[keep].astype("<i4").tobytes(), (c[keep] / max(1, c[keep].sum())).astype("<f4").tobytes()))
        if out:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*out, strict=True))), ["label", "h", "slots", "tf"])


def _frequencies(batches):
    """Rows with each slot, and at NOTHING all rows; one count a task and slot."""
    total, last = np.zeros(NOTHING + 1, np.int64), np.zeros(NOTHING + 1, np.int64)
    for _, data, off in slices(batches, 0):
        points, at = characters(data, off)
        slots = list(grams(points, at))
        for a, b in zip(at.tolist(), at[1:].tolist(), strict=False):
            s = np.concatenate([x[a:b] for x in slots])
            here = np.arange(len(s))
            last[s] = here
            once = s[last[s] == here]
            total[once[once < NOTHING]] += 1
            total[NOTHING] += 1
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["slot", "n"])


def quotas(counts: dict, rows: int) -> dict:
    """Rows of the sample by language: at least one, half of ``rows`` dealt evenly and the rest by size."""
    if sum(counts.values()) <= rows:
        return dict(counts)
    even = {k: min(c, max(1, rows // (2 * len(counts)))) for k, c in counts.items()}
    rest, free = max(0, rows - sum(even.values())), sum(counts.values()) - sum(even.values())
    return {k: e + rest * (counts[k] - e) // max(1, free) for k, e in even.items()}


def sampled(df, rows: int):
    """The rows (label, text, h) of a sample, and how many of them each language may have.

    About as many rows as the quota and a margin are below a language's limit, and its
    least hash always is; repeated rows of an id come once."""
    found = df.groupBy("label").agg(F.count("*").alias("n"), F.min("h").alias("least")).collect()
    quota = quotas({r.label: r.n for r in found}, rows)
    top = 1 << 30
    below = lambda q, n: top if q >= n else int((q + 4 * q**0.5 + 8) / n * top)
    limits = [(r.label, max(r.least, below(quota[r.label], r.n))) for r in found]
    if not limits:
        return df, quota
    most = df.sparkSession.createDataFrame(limits, "label string, most long")
    return df.join(F.broadcast(most), "label").where(F.col("h") <= F.col("most")).drop("most").dropDuplicates(["label", "h"]), quota


def fit(df, label_col: str, text_col: str, key, fit_rows: int = FIT_ROWS, scale: float = 60.0) -> Model | None:
    """Fit on a sample of at most ``fit_rows`` rows, or one a language; None without any labelled text."""
    text = F.col(text_col)
    known = df.where(F.col(label_col).isNotNull() & text.isNotNull() & (F.length(text) > 0))
    known = known.select(F.col(label_col).cast("string").alias("label"), text.alias("text"), F.pmod(F.xxhash64(key, text, F.lit(11)), F.lit(1 << 30)).alias("h"))
    rows, quota = sampled(known, fit_rows)
    if not quota:
        return None
    near = rows.select("label", "text", "h").mapInArrow(lean(_features), "label string, h long, slots binary, tf binary").collect()
    left, got = dict(quota), []
    for r in sorted(near, key=lambda r: (r.h, r.label, bytes(r.slots), bytes(r.tf))):
        if left[r.label] > 0:
            left[r.label] -= 1
            got.append(r)
    got = sorted((r.label, bytes(r.slots), bytes(r.tf)) for r in got)
    languages = sorted({r[0] for r in got})
    data = [(languages.index(a), np.frombuffer(s, "<i4"), np.frombuffer(t, "<f4").astype(float)) for a, s, t in got]
    df_count = np.zeros(NOTHING + 1)
    for r in known.select("text").mapInArrow(lean(_frequencies), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        df_count[r.slot] = r.n
    idf = np.log((1 + df_count[NOTHING]) / (1 + df_count)) + 1
    data = [(y, at, x * idf[at] * scale) for y, at, x in data]
    # every fifth row is kept aside, but never the first of a language
    aside = {i for i in range(0, len(data), 5) if i and data[i][0] == data[i - 1][0]} if len(data) >= 50 else set()
    held = [data[i] for i in sorted(aside)] or data
    train = [r for i, r in enumerate(data) if i not in aside]
    w, b = fit_ftrl(train, len(languages))
    table = (w * idf[:, None] * scale).astype(np.float32)
    table[NOTHING] = 0
    scores = np.array([x @ w[at] + b for _, at, x in held])
    return Model(languages, table, b, _temperature(scores, np.array([y for y, _, _ in held])))


def predict(df, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()):
    """The id column (and ``keep``), ``lang_pred`` and ``score`` of every row."""
    spark, kept = df.sparkSession, [id_col, *keep]
    if model is None:
        return df.select(*kept, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = spark.sparkContext.broadcast(model)  # a fixed number of slots

    def run(batches):
        m = shared.value
        names = np.array([*m.languages, "und"], object)
        for batch, data, off in slices(batches, 0):
            p, best, letter = m.score(data, off)
            best = np.where(letter, best, len(m.languages))
            score = np.where(letter, p[np.arange(len(p)), np.minimum(best, len(m.languages) - 1)], 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(names[best], pa.string()), pa.array(score)], fields)

    fields = [*[f"c{i}" for i in range(len(kept))], "lang_pred", "score"]
    rows = df.select(F.col(text_col).alias("text"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(kept)])
    schema = ", ".join(f"c{i} {dict(df.dtypes)[c]}" for i, c in enumerate(kept))
    return rows.mapInArrow(lean(run), f"{schema}, lang_pred string, score double").toDF(*kept, "lang_pred", "score")
