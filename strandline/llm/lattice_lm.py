"""LM scoring by the likelihood of subword lattices.

A word's probability is the sum over all its segmentations into pieces of an
existing vocabulary; the vocabulary's own scores give the first weights, which
expectation maximisation over the training words adapts (the vocabulary itself
is never trained).  A forward recursion in log space returns the sum.  A training
word is one more way through its lattice, an arc over the whole word: with N
training tokens of T kinds such arcs share the weight N / (N + T), after Witten
and Bell, and the pieces the rest.  A text is its words, each begun by the word
mark, then one end; its score is the log10 of the product.  Pieces, bytes and the
end share one distribution, so the scores are log probabilities.  Beside it stands
``vocabulary_score``, the same sum with the vocabulary's own weights alone, of
which nothing is learned.

How it runs.  Texts become blocks: a list of the block's distinct words, cut
into buckets by the words' hash, and the texts as numbers into that list.
Buckets gather the counts of each word over the whole corpus (one entry for each
block and word, however often it occurs, so no word is hot), give every distinct
word its probability once, and send the values back to the blocks.  Nothing that
grows with the corpus reaches the driver; pieces' weights are of a fixed size.

Behaviour on odd input: a null or empty text is the end alone; without training
texts the counts are zero and the weights are the vocabulary's own; repeated
ids are scored row by row; other columns are ignored.  Words are told apart
within a block by a 64-bit hash and between blocks by their bytes; one of more than
LONG bytes, as in a text without blanks, goes through its lattice piece by piece.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .shared import cuts_of, lean, settle, trim
from .textkit import _BASE, gathered, planes, slices, unplanes, word_bounds, word_hashes

#: Bytes of text in a block (a longer text is a block of its own).
BLOCK = 4 << 20
#: Bytes of a word from which its lattice is walked alone, STRETCH ends at a time.
LONG, STRETCH = 2048, 1 << 15
#: Passes of expectation maximisation.
PASSES = 3
#: Weight of the vocabulary's own distribution when weights are adapted, in pieces.
PRIOR = 200.0
#: Rows times length of a matrix of words.
CELLS = 1 << 19
#: Expected counts are summed as integers of this unit, so that no order of adding matters.
UNIT = float(1 << 20)

_U = np.uint64
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SIGN = (np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93)) | _U(1)
END = 0  # the end's number; bytes are 1 to 256, then pieces


@dataclass
class Pieces:
    """An existing vocabulary as hashed byte strings; a blank stands for the word mark."""

    texts: list[bytes]
    prior: np.ndarray  # probabilities of end, bytes and pieces

    def __post_init__(self):
        keys = np.array([_hash(t) for t in self.texts], _U)
        order = np.argsort(keys)
        self.keys, self.numbers = keys[order], order + 257
        self.lengths = sorted({len(t) for t in self.texts})
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(keys >> _U(44)).astype(np.int64)] = True

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose key is a piece's, and the piece's number."""
        rows = np.flatnonzero(self.sieve[(keys >> _U(44)).astype(np.int64)])
        if not len(rows):
            return rows, rows
        at = np.minimum(np.searchsorted(self.keys, keys[rows]), len(self.keys) - 1)
        ok = self.keys[at] == keys[rows]
        return rows[ok], self.numbers[at[ok]]


def _finish(h, n: int):
    with np.errstate(over="ignore"):
        h = (h + _U(n)) * _U(0x9FB21C651E98DF25)
        return (h ^ (h >> _U(32))) * _U(0x9E3779B97F4A7C15)


def _hash(text: bytes) -> int:
    h = 0
    for b in text:
        h = (h * _BASE + int(_SIGN[b])) & (1 << 64) - 1
    return int(_finish(np.array([h], _U), len(text))[0])


def read_vocabulary(path: str) -> Pieces:
    """Pieces of a sentencepiece model with the weights that its scores rank.

    Scores of its BPE pieces are the negative ranks of their merges; the weight
    of a rank falls like 1 / (rank + 50).
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts, scores = [], []
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        t = model.id_to_piece(i).replace("▁", " ")
        if t.rstrip(" ") and " " not in t[1:]:
            texts.append(t.encode())
            scores.append(model.get_score(i))
    texts.append(b" ")
    scores.append(0.0)
    weight = 1 / (np.maximum(-np.array(scores), 0) + 50)
    full = np.concatenate([[weight.max()], np.full(256, weight.min() / 4), weight])
    return Pieces(texts, full / full.sum())


def _arcs(pieces: Pieces, block: np.ndarray):
    """block: (words, length) bytes, a blank first.  For each end the arcs into it:
    (end, length, rows, numbers)."""
    n, size = block.shape
    with np.errstate(over="ignore"):
        head = np.zeros((size + 1, n), _U)
        for j in range(size):
            head[j + 1] = head[j] * _U(_BASE) + _SIGN[block[:, j]]
        power = {k: _U(pow(_BASE, k, 1 << 64)) for k in pieces.lengths}
        for j in range(1, size + 1):
            for k in pieces.lengths:
                if k > j:
                    break
                rows, numbers = pieces.find(_finish(head[j] - head[j - k] * power[k], k))
                if len(rows):
                    yield j, k, rows, numbers


def forward(pieces: Pieces, logp: np.ndarray, block: np.ndarray, arcs=None) -> np.ndarray:
    """Log probabilities of all prefixes, (length + 1, words)."""
    n, size = block.shape
    a = np.full((size + 1, n), -np.inf)
    a[0] = 0
    done = 0
    for j, k, rows, numbers in arcs if arcs is not None else _arcs(pieces, block):
        while done < j:
            done += 1
            a[done] = np.logaddexp(a[done], a[done - 1] + logp[1 + block[:, done - 1]])
        a[j, rows] = np.logaddexp(a[j, rows], a[j - k, rows] + logp[numbers])
    while done < size:
        done += 1
        a[done] = np.logaddexp(a[done], a[done - 1] + logp[1 + block[:, done - 1]])
    return a


def expected(pieces: Pieces, logp: np.ndarray, block: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece and byte over the weighted words."""
    n, size = block.shape
    arcs = list(_arcs(pieces, block))
    a = forward(pieces, logp, block, arcs)
    b = np.full((size + 1, n), -np.inf)
    b[size] = 0
    out = np.zeros(len(logp))
    z = a[size]
    at = len(arcs) - 1
    for j in range(size, 0, -1):
        byte = 1 + block[:, j - 1].astype(np.int64)
        through = logp[byte] + b[j]
        b[j - 1] = np.logaddexp(b[j - 1], through)
        out += np.bincount(byte, weight * np.exp(a[j - 1] + through - z), len(logp))
        while at >= 0 and arcs[at][0] == j:
            _, k, rows, numbers = arcs[at]
            through = logp[numbers] + b[j, rows]
            b[j - k, rows] = np.logaddexp(b[j - k, rows], through)
            out += np.bincount(numbers, weight[rows] * np.exp(a[j - k, rows] + through - z[rows]), len(logp))
            at -= 1
    return out


def _long_arcs(pieces: Pieces, word: np.ndarray, first: int, last: int):
    """For ends first to last - 1 of one long word (a blank first) the arcs into each: (length, number)."""
    ends = np.arange(first, last)
    h = np.zeros(len(ends), _U)
    found = []
    with np.errstate(over="ignore"):
        for k in range(1, pieces.lengths[-1] + 1):
            ok = ends >= k
            h[ok] += _SIGN[word[ends[ok] - k]] * _U(pow(_BASE, k - 1, 1 << 64))
            if k in pieces.lengths:
                rows, numbers = pieces.find(_finish(h, k))
                here = ok[rows]
                found.append((rows[here], np.full(int(here.sum()), k), numbers[here]))
    rows, length, number = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(rows, kind="stable")
    cuts = np.searchsorted(rows[order], np.arange(len(ends) + 1)).tolist()
    length, number = length[order].tolist(), number[order].tolist()
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield list(zip(length[a:b], number[a:b], strict=True))


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values)) if top > -math.inf else top


def long_forward(pieces: Pieces, logp: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Log probabilities of all prefixes of one long word (bytes, a blank first)."""
    n, p = len(word), logp.tolist()
    a = [0.0]
    for first in range(1, n + 1, STRETCH):
        last = min(n + 1, first + STRETCH)
        for j, arcs in zip(range(first, last), _long_arcs(pieces, word, first, last), strict=True):
            a.append(_log_sum([a[j - 1] + p[1 + int(word[j - 1])], *[a[j - k] + p[i] for k, i in arcs]]))
    return np.array(a)


def long_expected(pieces: Pieces, logp: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece and byte over one long word."""
    n, p = len(word), logp.tolist()
    a = long_forward(pieces, logp, word).tolist()
    b, out = [-math.inf] * n + [0.0], [0.0] * len(p)

    def use(j: int, k: int, i: int) -> None:
        through = p[i] + b[j]
        out[i] += math.exp(a[j - k] + through - a[n])
        b[j - k] = _log_sum([b[j - k], through])

    for last in range(n + 1, 1, -STRETCH):
        first = max(1, last - STRETCH)
        for j, arcs in reversed(list(zip(range(first, last), _long_arcs(pieces, word, first, last), strict=True))):
            use(j, 1, 1 + int(word[j - 1]))
            for k, i in arcs:
                use(j, k, i)
    return np.array(out)


def matrices(words: list[bytes]):
    """The words, a blank before each, as matrices of equal length: (places, matrix)."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):
        n = int(size[order[at]])
        to = int(np.searchsorted(size[order], n, "right"))
        for a in range(at, to, max(1, CELLS // (n + 1))):
            part = order[a : min(to, a + max(1, CELLS // (n + 1)))]
            block = np.full((len(part), n + 1), 32, np.uint8)
            block[:, 1:] = np.frombuffer(b"".join([words[i] for i in part]), np.uint8).reshape(len(part), n)
            yield part, block
        at = to


def word_logp(pieces: Pieces, logp: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Natural log probabilities of the words."""
    out = np.zeros(len(words))
    for part, block in matrices(words):
        out[part] = forward(pieces, logp, block)[-1] if block.shape[1] <= LONG else [long_forward(pieces, logp, w)[-1] for w in block]
    return out


def word_uses(pieces: Pieces, logp: np.ndarray, words: list[bytes], weight: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece and byte over the weighted words."""
    out = np.zeros(len(logp))
    for part, block in matrices(words):
        if block.shape[1] <= LONG:
            out += expected(pieces, logp, block, weight[part])
        else:
            for i, w in zip(part, block, strict=True):
                out += weight[i] * long_expected(pieces, logp, w)
    return out


def _words(blob: bytes) -> list[bytes]:
    return blob.split(b"\n") if blob else []


def _blocks(buckets: int):
    """Texts to blocks; columns id, text, train."""

    def run(batches):
        import pandas as pd

        for batch, data, off in slices(gathered(batches, 1, BLOCK), 1, 2 * BLOCK):
            starts, ends, counts = word_bounds(data, off)
            hashes = word_hashes(data, starts, ends)
            codes, uniques = pd.factorize(hashes)
            first = np.zeros(len(uniques), np.int64)
            first[codes[::-1]] = np.arange(len(codes))[::-1]
            bucket = (uniques % _U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            train = np.asarray(batch.column(2)).astype(bool)
            uses = np.bincount(codes[np.repeat(train, counts)], minlength=len(uniques))[order]
            raw = _FOLD[data].tobytes()
            s, e = starts[first[order]].tolist(), ends[first[order]].tolist()
            texts = [raw[a:b] for a, b in zip(s, e, strict=True)]
            name = uuid.uuid4().int >> 66
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
            rows = [(name, -1, None, None, batch.column(0).to_pylist(), counts.astype("<i4").tobytes(), planes(place[codes], 4))]
            rows += [(name, k, b"\n".join(texts[a:b]), uses[a:b].astype("<i4").tobytes(), None, None, None) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
            types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(batch.column(0).type), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    names = ["block", "bucket", "words", "uses", "ids", "sizes", "codes"]
    return lean(run)


_BLOCK_SCHEMA = "block long, bucket int, words binary, uses binary, ids array<{}>, sizes binary, codes binary"


def _gather(t: pa.Table) -> pa.Table:
    """A bucket's distinct words, their counts, and where each block's words are."""
    index: dict[bytes, int] = {}
    places, uses = [], []
    for blob, u in zip(t["words"].to_pylist(), t["uses"].to_pylist(), strict=True):
        places.append(np.array([index.setdefault(w, len(index)) for w in _words(blob)], np.int64))
        uses.append(np.frombuffer(u, "<i4"))
    c = np.bincount(np.concatenate(places), np.concatenate(uses), len(index)).astype(np.int64)
    return pa.table({
        "bucket": pa.array([t["bucket"][0].as_py()], pa.int32()),
        "words": pa.array([b"\n".join(index)], pa.binary()),
        "counts": pa.array([c.astype("<i8").tobytes()], pa.binary()),
        "total": pa.array([int(c.sum())]),
        "kinds": pa.array([int((c > 0).sum())]),
        "blocks": pa.array([t["block"].to_pylist()], pa.list_(pa.int64())),
        "places": pa.array([[p.astype("<i4").tobytes() for p in places]], pa.list_(pa.binary())),
    })


def score(docs, path: str, train, id_col: str = "doc_id", text_col: str = "text", passes: int = PASSES):
    """Per row: the id column, n_tokens, n_known, train_tokens, base_score, score, vocabulary_score.

    ``train`` is a condition on ``docs``.  base_score is the add-one unigram score
    over whole words of the training rows; score is the lattice's, and
    vocabulary_score that of the lattice with the vocabulary's own weights.
    """
    spark = docs.sparkSession
    buckets = cuts_of(docs, text_col)
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    blocks = settle(rows.mapInArrow(_blocks(buckets), _BLOCK_SCHEMA.format(kind)))
    schema = "bucket int, words binary, counts binary, total long, kinds long, blocks array<long>, places array<binary>"
    table = settle(blocks.where("bucket >= 0").select("bucket", "block", "words", "uses").groupBy("bucket").applyInArrow(_gather, schema))
    sums = table.agg(F.sum("total").alias("n"), F.sum("kinds").alias("v")).first()
    trained = rows.where("train").count()
    total, kinds = (sums.n or 0) + trained, (sums.v or 0) + (trained > 0)
    pieces = read_vocabulary(path)
    p = pieces.prior
    vocabulary = spark.sparkContext.broadcast(pieces)  # of a fixed size
    for _ in range(passes if trained else 0):
        logp = spark.sparkContext.broadcast(np.log(p))

        def uses(batches, logp=logp):
            out = np.zeros(len(logp.value))  # of the whole task, so that it sends each piece once
            for batch in batches:
                for blob, c in zip(batch.column(0), batch.column(1), strict=True):
                    words, c = _words(blob.as_py()), np.frombuffer(c.as_py(), "<i8")
                    known = np.flatnonzero(c)
                    words, c = [words[i] for i in known], c[known]
                    out += word_uses(vocabulary.value, logp.value, words, c.astype(float))
            some = np.flatnonzero(out > 0)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.rint(out[some] * UNIT).astype(np.int64))], ["piece", "n"])

        got = table.select("words", "counts").mapInArrow(lean(uses), "piece long, n long").groupBy("piece").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect()
        counts = np.zeros(len(p))
        for r in got:
            counts[r.piece] = float(r.n) / UNIT
        counts[END] = trained
        p = counts + PRIOR * pieces.prior
        p /= p.sum()
    final = spark.sparkContext.broadcast(np.log(p))
    own = spark.sparkContext.broadcast(np.log(pieces.prior))
    arc, rest = (1 / (total + kinds), np.log(kinds / (total + kinds))) if total else (0.0, 0.0)

    def values(batches):
        for batch in batches:
            for row in batch.to_pylist():
                words = _words(row["words"])
                lp, vp = word_logp(vocabulary.value, final.value, words), word_logp(vocabulary.value, own.value, words)
                c = np.frombuffer(row["counts"], "<i8")
                with np.errstate(divide="ignore"):
                    lp = np.logaddexp(np.log(c * arc), rest + lp)
                at = [np.frombuffer(x, "<i4") for x in row["places"]]
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["blocks"], pa.int64()), pa.array([row["bucket"]] * len(at), pa.int32()),
                    *[pa.array([v[x].astype("<f8").tobytes() for x in at], pa.binary()) for v in (lp, vp)], pa.array([planes(c[x], 8) for x in at], pa.binary()),
                ], ["block", "bucket", "lp", "vp", "c"])

    def finish(t: pa.Table) -> pa.Table:
        t = t.sort_by("bucket")
        head = t.slice(0, 1).to_pylist()[0]  # bucket -1, the texts
        counts = np.frombuffer(head["sizes"], "<i4").astype(np.int64)
        codes = unplanes(head["codes"], 4).astype(np.int64)
        lp, vp = (np.concatenate([np.empty(0), *[np.frombuffer(x, "<f8") for x in t[k].to_pylist()[1:]]]) for k in ("lp", "vp"))
        c = np.concatenate([np.empty(0, np.int64), *[unplanes(x, 8).astype(np.int64) for x in t["c"].to_pylist()[1:]]])
        full, low = np.flatnonzero(counts), np.log(10)
        begins = (np.cumsum(counts) - counts)[full]
        out = {k: np.zeros(len(counts)) for k in ("base", "score", "own", "known")}
        if len(full):
            under = np.log10(total + kinds + 1)
            for k, v in (("base", np.log10(c + 1) - under), ("score", lp / low), ("own", vp / low), ("known", (c > 0).astype(float))):
                out[k][full] = np.add.reduceat(v[codes], begins)
        end = np.log10((trained + 1) / (total + kinds + 1))
        trim()
        return pa.table({
            "id": pa.array(head["ids"], t.schema.field("ids").type.value_type), "n_tokens": pa.array(counts + 1), "n_known": pa.array(out["known"].astype(np.int64) + (trained > 0)),
            "base_score": pa.array(out["base"] + end), "score": pa.array(out["score"] + np.log10(trained * arc + np.exp(rest + final.value[END]))), "vocabulary_score": pa.array(out["own"] + own.value[END] / low),
        })

    back = table.select("bucket", "words", "counts", "blocks", "places").mapInArrow(lean(values), "block long, bucket int, lp binary, vp binary, c binary")
    heads = blocks.where("bucket < 0").select("block", "bucket", "ids", "sizes", "codes", F.lit(None).cast("binary").alias("lp"), F.lit(None).cast("binary").alias("vp"), F.lit(None).cast("binary").alias("c"))
    both = heads.unionByName(back, allowMissingColumns=True)
    out = both.groupBy("block").applyInArrow(finish, f"id {kind}, n_tokens long, n_known long, base_score double, score double, vocabulary_score double")
    return out.select(F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", "vocabulary_score")
