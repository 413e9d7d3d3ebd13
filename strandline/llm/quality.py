"""Quality classifier: a byte-level convolutional network in numpy.

A text is a row of bytes, padded with zeros to whole half chunks of 256 bytes.
Learned filters, 16 bytes wide at every eighth byte, run over all of it.  A chunk
is two neighbouring half chunks, so chunks overlap by half and cover the whole
text; its filters are max-pooled and averaged and give one logit.  The mean,
largest and smallest chunk logits of a text give its probability.

The fit takes all chunks of a bounded sample of labelled texts: of each label up to
``fit_rows`` whole texts of together ``fit_bytes``, in order of a hash of the id.
Each text weighs the same.  Scoring covers every byte of every row.

Behaviour on odd input: a null or empty text is scored as one blank chunk;
without labels of both kinds every score is the share of label 1, or 0.5 without
any; labels other than 0 and 1 and repeated labels of an id are ignored (the
largest counts), as are other rows of an id in the fit than that of the least hash;
equal texts give equal scores; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .shared import lean, settle
from .textkit import slices

#: Labelled texts of each label that the fit may see at most, and their bytes (all of a text or none).
FIT_ROWS, FIT_BYTES = 800, 3 << 20
STRIDE, EMBED, FILTERS = 8, 8, 32
HALF = 256
WINDOWS = HALF // STRIDE


@dataclass
class Net:
    embed: np.ndarray  # 256 bytes by EMBED
    first: np.ndarray  # the filters' first STRIDE bytes, by FILTERS
    second: np.ndarray  # and their last
    bias: np.ndarray
    out: np.ndarray  # of pooled maxima and means
    out_bias: float
    head: np.ndarray  # of mean, largest and smallest chunk logit
    head_bias: float

    def chunk_logits(self, raw: np.ndarray) -> np.ndarray:
        """raw: (halves, HALF) bytes of one or more texts, one after the other.

        Row i is the logit of the chunk of half i and half i + 1.
        """
        a, b = self._pool(raw)
        nxt = np.minimum(np.arange(len(raw)) + 1, len(raw) - 1)
        pooled = np.concatenate([np.maximum(a, a[nxt]), (b + b[nxt]) / 2], axis=1)
        return pooled @ self.out + self.out_bias

    def _pool(self, raw: np.ndarray, step: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """Maxima and means of the filters over the windows that begin in each half."""
        n = len(raw)
        top, mean = np.empty((n, FILTERS), np.float32), np.empty((n, FILTERS), np.float32)
        for at in range(0, n, step):
            part = raw[at : at + step]
            x = self.embed[part].reshape(len(part) * WINDOWS, STRIDE * EMBED)
            y = (x @ self.first).reshape(len(part), WINDOWS, FILTERS)
            # the window that begins with a half's last block sees no further bytes
            y[:, :-1] += (x @ self.second).reshape(len(part), WINDOWS, FILTERS)[:, 1:]
            y += self.bias
            np.maximum(y, 0, out=y)
            top[at : at + step], mean[at : at + step] = y.max(axis=1), y.mean(axis=1)
        return top, mean

    def summary(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Mean, largest and smallest chunk logit of each text."""
        raw, first = halves(data, off)
        z = self.chunk_logits(raw)
        many = np.diff(np.append(first, len(raw)))
        use = np.ones(len(raw), bool)
        last = first + many - 1
        use[last[many > 1]] = False  # a text's last half begins no chunk of its own
        single = last[many == 1]
        if len(single):  # the chunk of a single half is that half twice
            a, b = self._pool(raw[single])
            z[single] = np.concatenate([a, b], axis=1) @ self.out + self.out_bias
        n = np.where(many > 1, many - 1, 1)
        z64 = z[use].astype(np.float64)
        at = np.cumsum(n) - n
        return np.stack([np.add.reduceat(z64, at) / n, np.maximum.reduceat(z64, at), np.minimum.reduceat(z64, at)], axis=1)

    def probability(self, data, off) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.summary(data, off) @ self.head + self.head_bias, -40, 40)))


def halves(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts in rows of HALF bytes, padded with zeros, and each text's first row."""
    size = np.diff(off)
    many = np.maximum(1, -(-size // HALF))
    first = np.cumsum(many) - many
    out = np.zeros(int(many.sum()) * HALF, np.uint8)
    for a, b, c in zip(off.tolist(), off[1:].tolist(), (first * HALF).tolist(), strict=False):
        out[c : c + b - a] = data[a:b]
    return out.reshape(-1, HALF), first


def fit_net(chunks: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 0.004, seed: int = 5) -> Net:
    """Adam on the logistic loss of single chunks; chunks: (n, 2 * HALF) bytes."""
    g = np.random.default_rng(seed)
    p = {
        "embed": g.normal(0, 0.5, (256, EMBED)).astype(np.float32),
        "first": g.normal(0, 0.12, (STRIDE * EMBED, FILTERS)).astype(np.float32),
        "second": g.normal(0, 0.12, (STRIDE * EMBED, FILTERS)).astype(np.float32),
        "bias": np.zeros(FILTERS, np.float32),
        "out": g.normal(0, 0.1, 2 * FILTERS).astype(np.float32),
        "out_bias": np.zeros(1, np.float32),
    }
    m1, m2 = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    for _ in range(epochs):
        order = g.permutation(len(chunks))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            raw, n = chunks[pick], len(pick)
            x = p["embed"][raw].reshape(n, 2, WINDOWS, STRIDE * EMBED)
            y_ = x @ p["first"]
            y_[:, :, :-1] += (x @ p["second"])[:, :, 1:]
            act = np.maximum(y_ + p["bias"], 0).reshape(n, 2 * WINDOWS, FILTERS)
            where = act.argmax(axis=1)
            top, mean = act.max(axis=1), act.mean(axis=1)
            pooled = np.concatenate([top, mean], axis=1)
            z = pooled @ p["out"] + p["out_bias"]
            d = (1 / (1 + np.exp(-z)) - y[pick]) * weight[pick] / n
            grad = {"out": pooled.T @ d, "out_bias": d.sum(keepdims=True)}
            dp = d[:, None] * p["out"]
            da = np.repeat(dp[:, None, FILTERS:] / (2 * WINDOWS), 2 * WINDOWS, axis=1)
            i, j = np.indices(where.shape)
            da[i, where, j] += dp[:, :FILTERS]
            da *= act > 0
            da = da.reshape(n, 2, WINDOWS, FILTERS)
            grad["bias"] = da.sum(axis=(0, 1, 2))
            flat = x.reshape(-1, STRIDE * EMBED)
            grad["first"] = flat.T @ da.reshape(-1, FILTERS)
            shifted = np.zeros_like(da)
            shifted[:, :, 1:] = da[:, :, :-1]
            grad["second"] = flat.T @ shifted.reshape(-1, FILTERS)
            dx = da.reshape(-1, FILTERS) @ p["first"].T + shifted.reshape(-1, FILTERS) @ p["second"].T
            dx = dx.reshape(-1, EMBED)
            grad["embed"] = np.stack([np.bincount(raw.ravel(), dx[:, k], 256) for k in range(EMBED)], axis=1)
            step += 1
            for k, v in grad.items():
                v = v.astype(np.float32) + 1e-4 * p[k]
                m1[k] = 0.9 * m1[k] + 0.1 * v
                m2[k] = 0.999 * m2[k] + 0.001 * v * v
                p[k] -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return Net(p["embed"], p["first"], p["second"], p["bias"], p["out"], float(p["out_bias"][0]), np.array([1.0, 0.0, 0.0]), 0.0)


def fit_head(net: Net, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Net:
    """Logistic regression of the texts' three summaries, by Newton steps."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    a = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(4)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag([0.05, 0.05, 0.05, 1e-6]) * len(x) * 0.02
        w += np.linalg.solve(h, a.T @ (weight * (y - p)) - np.array([0.05, 0.05, 0.05, 0]) * len(x) * 0.02 * w)
    net.head = w[:3] / scale
    net.head_bias = float(w[3] - (w[:3] * mean / scale).sum())
    return net


def _chunks_of(batches):
    """All chunks of each text, and the share of the text in each."""
    for batch, data, off in slices(batches, 0, 1 << 20):
        raw, first = halves(data, off)
        many = np.diff(np.append(first, len(raw)))
        out, labels, share = [], [], []
        for f, m, label in zip(first.tolist(), many.tolist(), batch.column(1).to_pylist(), strict=True):
            own = range(max(1, m - 1))
            out += [raw[f + at].tobytes() + raw[f + min(at + 1, m - 1)].tobytes() for at in own]
            labels += [label] * len(own)
            share += [1 / len(own)] * len(own)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(labels, pa.int32()), pa.array(share)], ["chunk", "label", "share"])


def sample(docs, known, id_col: str, text_col: str, fit_rows: int, fit_bytes: int):
    """Columns id, text, label of the sample: one row an id, whatever the partitions.

    Only hashes and sizes of a few more than 2 * ``fit_rows`` rows reach the driver.
    """
    spark, top = docs.sparkSession, 1 << 30
    count = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    margin = fit_rows + 8 * int(fit_rows**0.5) + 16
    below = F.lit(0)
    for k, n in count.items():
        below = F.when(F.col("label") == k, top if margin >= n else int(margin / n * top)).otherwise(below)
    near = known.withColumn("h", F.pmod(F.xxhash64("id", F.lit(23)), F.lit(top))).where(F.col("h") <= below)
    near = spark.createDataFrame(sorted(map(tuple, near.collect())), near.schema)  # a stable pick, sent back
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(near), "id")
    texts = texts.groupBy("id", "label", "h").agg(F.min(F.struct(F.xxhash64("text").alias("k"), F.col("text"))).alias("x")).select("id", "label", "h", F.col("x.text").alias("text"))
    texts = settle(texts)
    picks, used = [], {}
    for r in sorted(texts.select("id", "label", "h", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).collect(), key=lambda r: (r.h, str(r.id))):
        rows, size = used.get(r.label, (0, 0))
        if rows < fit_rows and (size + r.size <= fit_bytes or not rows):
            used[r.label] = rows + 1, size + r.size
            picks.append((r.id,))
    return texts.join(F.broadcast(spark.createDataFrame(picks, texts.select("id").schema)), "id", "left_semi").select("id", "text", "label")


def fit(docs, labels, train, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> Net | float:
    """A net, or a constant score where there are not two kinds of labels.

    ``train`` is a condition on the id column of the labels.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & train).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    count = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(count) < 2:
        return float(max(count, default=0.5))
    texts = sample(docs, known, id_col, text_col, fit_rows, fit_bytes).select("text", "label")
    got = texts.mapInArrow(_chunks_of, "chunk binary, label int, share double").toArrow()
    if not got.num_rows or len(set(got["label"].to_pylist())) < 2:
        return float(count[1] / (count[0] + count[1]))
    both = sorted(zip(map(bytes, got["chunk"].to_pylist()), got["label"].to_pylist(), got["share"].to_pylist(), strict=True))
    chunks = np.frombuffer(b"".join(c for c, *_ in both), np.uint8).reshape(-1, 2 * HALF)
    y, share = np.array([k for _, k, _ in both], np.float32), np.array([s for *_, s in both])
    weight = share / np.where(y == 1, share[y == 1].sum(), share[y == 0].sum()) * len(y) / 2
    net = fit_net(chunks, y, weight.astype(np.float32))

    def run(batches):
        for batch, data, off in slices(batches, 0, 1 << 20):
            s = net.summary(data, off)
            yield pa.RecordBatch.from_arrays([pa.array(s[:, 0]), pa.array(s[:, 1]), pa.array(s[:, 2]), batch.column(1)], ["a", "b", "c", "label"])

    rows = np.array(sorted(map(tuple, texts.mapInArrow(run, "a double, b double, c double, label int").collect())))
    y = rows[:, 3]
    prior = count[1] / (count[0] + count[1])
    share = y.mean()
    weight = np.where(y == 1, prior / share, (1 - prior) / (1 - share)) if 0 < share < 1 else np.ones(len(y))
    return fit_head(net, rows[:, :3], y, weight)


def score(docs, net: Net | float, id_col: str = "doc_id", text_col: str = "text"):
    """The id column, ``score`` (probability of label 1) and ``predicted`` of every row."""
    if isinstance(net, float):
        return docs.select(id_col, F.lit(net).alias("score"), F.lit(int(net >= 0.5)).alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(net)  # of a fixed size

    def run(batches):
        for batch, data, off in slices(batches, 1, 1 << 20):
            p = shared.value.probability(data, off)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["id", "score", "predicted"])

    rows = docs.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text")
    return rows.mapInArrow(lean(run), f"id {dict(docs.dtypes)[id_col]}, score double, predicted int").withColumnRenamed("id", id_col)
