"""N-gram Jaccard join by a partition of the universe and the pigeonhole principle.

The set of a text is its distinct word shingles (64-bit hashes).  Sets link when
their Jaccard similarity is at least ``num / den`` (three quarters); then they
differ in at most H = floor((|r| + |s|) (1 - t) / (1 + t)) shingles.

Size bands are [2^c, 2^(c+1)).  The band of the smaller set of a pair fixes its
scheme: the universe of shingles is cut by hash into segments, some of which
index their subset (a pair that agrees there is found) and some also the subsets
with one shingle deleted (found up to one difference).  A non-empty segment of
the first kind covers one difference, of the second kind two.  If a set's
segments cover more than H differences, every partner shares a signature with it.
``allocate`` picks the numbers of both kinds of segments for a band at least cost.
A set whose segments happen to cover too few takes part in a second scheme of
the band, in which every shingle is a segment of its own.

Signatures meet in buckets.  A signature of at most ``HOT`` sets gives its pairs
(a fixed bound).  A signature of more is hot and counts for nothing unless a set
has too little cover without its hot signatures.  Only pairs of two such sets can
be lost, and only they go on, in levels (``_resolve``):

1. Of each hot signature the member that stands in most of them leads, and every
   member is verified against its leader L, once for all signatures that L leads.
2. Sets x and y of which one does not link with L hold at most
   min(|x & L|, |y & L|) common shingles within L.  If that is too few to link,
   they must share a shingle outside L, and so the shingles of x - L become
   signatures of the next level, with hot ones and cover as before.  The few sets
   for which it is not, meet under a signature of their own, whose next leader is
   smaller than L, as two sets at least as large as L always need one outside it.
3. What now lies in one component is done.  Where a leader's group still spans
   several components and all but the largest have few members, these are verified
   against the group; the others go to the next level, where more count as few.

So no group is gathered in one place or multiplied out, and no pair is listed
that already lies in one component.

Segments that index deletions come out of ``allocate`` for sets of 2 and 3
shingles alone; from 4 on, plain subsets cost less in every band.

Every candidate pair is verified on the whole sets (64-bit hashes of shingles).
Texts of equal sets are one node throughout; components come from star steps on the links.

Behaviour on odd input: a null text or one without words has the empty set, links
with nothing and is its own component; with fewer than five words the whole
sequence is one shingle; repeated ids are joined row by row; a null id stays in
its component but never names it; other columns are ignored.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import dealt, lean, light, onto, release, row_name, settle, trim, unused
from .textkit import mix, planes, ragged, shingle_hashes, slices, unplanes, word_bounds, word_hashes

K = 5
NUM, DEN = 75, 100
#: Members of a signature that are paired directly.
HOT = 4
#: Signatures that a task holds before it sends them to the buckets.
FLUSH = 1_000_000
#: Buckets of signatures at least: so many that a bucket has a set once or not at all, at
#: any size of the table, and that a bucket's task needs little memory.
BUCKETS = 512
#: Bytes of text worked on at a time.
PART = 2 << 20
#: Members that share one copy of a leader's set in verification.
FAN = 512
#: Members outside a group's largest component that count as few; STEP times more each level.
TURNS, STEP = 16, 4

_U = np.uint64


def largest_difference(a: int, b: int) -> int:
    """H of two set sizes."""
    return (a + b) * (DEN - NUM) // (DEN + NUM)


def least_overlap(a, b):
    """The least common shingles with which sets of these sizes link."""
    return -(-(a + b) * NUM // (DEN + NUM))


def partner_limit(n: int) -> int:
    return n * DEN // NUM


@functools.cache
def allocate(band: int) -> tuple[int, int]:
    """(segments, how many of them index deletions) of the cheapest plan for a band.

    The cost of a plan is the mean number of signatures of a set of the band, the
    cost of the second scheme times how often it is needed, and, as a measure of
    wrong candidates, the number of signatures of a single shingle.  Set sizes of
    segments are drawn with a fixed seed, so all tasks agree.
    """
    low, high = 1 << band, (1 << band + 1) - 1
    need = largest_difference(high, partner_limit(high)) + 1
    best = (float("inf"), (1, 0))
    plans = {(max(1, int(need * x + 0.999)), 0) for x in (1.0, 1.1, 1.2, 1.35, 1.6)}
    plans |= {(s, d) for x in (1.0, 1.2, 1.5) for share in (0.34, 0.67, 1.0) for s in [max(1, int(need * x / (1 + share) + 0.999))] for d in [max(1, int(s * share))]}
    for segments, deleting in sorted(plans):
        g = np.random.default_rng(band)
        cost = 0.0
        for n in np.linspace(max(3, low), high, 8).astype(int):
            for _ in range(4):
                size = np.bincount(g.integers(0, segments, n), minlength=segments)
                d, e = size[:deleting], size[deleting:]
                cover = (e > 0).sum() + np.minimum(d, 2).sum()
                signs = (e > 0).sum() + (d > 0).sum() + d[d > 1].sum()
                single = (e == 1).sum() + (d == 1).sum() + 2 * (d == 2).sum()
                short = cover < largest_difference(n, partner_limit(n)) + 1
                cost += (signs + 2 * single + short * 8 * n) / n
        best = min(best, (cost, (segments, deleting)))
    return best[1]


def _signatures(u: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Signatures of a set under a band's scheme, whether each is of a segment with
    deletions, and the whole cover."""
    segments, deleting = allocate(band)
    seed = _U((2 * band + 3) * 0x9E3779B97F4A7C15 & (1 << 64) - 1 | 1)
    seg = ((((u * seed) >> _U(32)) * _U(segments)) >> _U(32)).astype(np.int64)
    order = np.argsort(seg, kind="stable")
    seg, v = seg[order], u[order]
    begin = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
    size = np.diff(np.append(begin, len(seg)))
    sums = np.add.reduceat(v, begin)  # shingles are mixed already, so their sum tells a subset
    salt = (seg[begin].astype(_U) + _U(1)) * seed
    out = mix(sums ^ salt)
    if not deleting:
        return out, np.zeros(len(out), bool), len(out)
    kind = seg[begin] < deleting
    cover = np.where(kind, np.minimum(size, 2), 1)
    many = np.flatnonzero(kind & (size > 1))
    if len(many):
        at = ragged(size[many], begin[many])
        less = mix((np.repeat(sums[many], size[many]) - v[at]) ^ np.repeat(salt[many], size[many]))
        return np.concatenate([out, less]), np.concatenate([kind, np.ones(len(less), bool)]), int(cover.sum())
    return out, kind, int(cover.sum())


def roles(n: int) -> list[tuple[int, int]]:
    """(band, cover needed) of the schemes that a set of n shingles takes part in."""
    if n < 3:
        return []  # only equal sets are similar enough
    band = n.bit_length() - 1
    out = [(band, largest_difference(n, partner_limit(n)) + 1)]
    if -(-n * NUM // DEN) <= (1 << band) - 1:
        out.append((band - 1, largest_difference(n, (1 << band) - 1) + 1))
    return out


def shingle_sets(data, off):
    """The sorted distinct shingles of each row."""
    starts, ends, counts = word_bounds(data, off)
    flat, many = shingle_hashes(word_hashes(data, starts, ends), counts, K)
    at = np.concatenate([[0], np.cumsum(many)]).tolist()
    for a, b in zip(at, at[1:], strict=False):
        yield np.unique(flat[a:b])


def node_of(u: np.ndarray) -> int:
    """The key of a set, as a signed 64-bit integer."""
    a, b = np.add.reduceat(u, [0]), np.add.reduceat(u * (u >> _U(9)), [0])
    return int(mix(mix(a + _U(len(u))) ^ b).astype(np.int64)[0])


def all_signatures(u: np.ndarray):
    """(signatures with scheme and kind in the high byte, [(scheme, slack)]).

    The slack is how much cover may be lost before a partner can be missed.  A
    signature of a segment with deletions counts for two, as equal subsets must
    have equal signatures whatever their size.
    """
    out, notes = [], []
    for band, need in roles(len(u)):
        s, w, cover = _signatures(u, band)
        out.append(s >> _U(8) | (w.astype(_U) | _U(band << 1)) << _U(56))
        notes.append((band, cover - need))
        if cover < need:
            out.append(mix(u ^ _U(0xC0FFEE + band)) >> _U(8) | _U(64 + band << 1) << _U(56))
            notes.append((64 + band, len(u) - need))
    return (np.concatenate(out) if out else np.empty(0, _U)), notes


def sketch(u: np.ndarray) -> bytes:
    """Counts of the shingles by their leading bits, 255 for more; empty for a set under 8."""
    bits = min(12, len(u).bit_length() - 1)
    if bits < 3:
        return b""
    return np.minimum(np.bincount((u >> _U(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def may_link(na: int, a: bytes, nb: int, b: bytes) -> bool:
    """False only if sets of these sizes and sketches cannot be similar enough."""
    if min(na, nb) * DEN < max(na, nb) * NUM:
        return False
    if not a or not b:
        return True
    x, y = np.frombuffer(a, np.uint8).astype(np.int64), np.frombuffer(b, np.uint8).astype(np.int64)
    if x.max() == 255 or y.max() == 255:
        return True
    if len(x) != len(y):
        x, y = (x, y) if len(x) > len(y) else (y, x)
        x = x.reshape(len(y), -1).sum(axis=1)
    both = int(np.minimum(x, y).sum())
    return both * DEN >= NUM * (na + nb - both)


def _describe(batches):
    """Per row: its name, id, n, node and sketch."""
    for batch, data, off in slices(batches, 1, PART):
        sets = list(shingle_sets(data, off))
        yield pa.RecordBatch.from_arrays([
            batch.column(0), batch.column(2), pa.array([len(u) for u in sets], pa.int64()),
            pa.array([node_of(u) if len(u) else None for u in sets], pa.int64()), pa.array([sketch(u) for u in sets], pa.binary()),
        ], ["row", "id", "n", "node", "sketch"])


_HOT_NAMES = ["kind", "bucket", "signs", "nodes", "keys", "sizes"]


#: What rows of the buckets' table hold: signatures of a bucket, members that a task
#: found hot, slacks, links, sizes below which a signature's leader must be.
_SIGNS, _MEMBERS, _SLACK, _LINK, _CAP = range(5)


def _longs(x) -> bytes:
    return np.asarray(x, np.int64).astype("<i8").tobytes()


def _packed(signs, index, keys, sizes, notes, buckets: int, width: int, more=()) -> pa.RecordBatch:
    """Signatures by bucket; members of those that are hot within a task leave at once,
    as do the slacks of the sets and what else comes (kind, values, values).

    Of a signature the leading ``width`` bytes count.
    """
    rows = [(kind, -1, _longs(a), _longs(b), b"", b"") for kind, a, b in more if len(a)]
    if signs:
        s, i = np.concatenate(signs) >> _U(64 - 8 * width), np.concatenate(index)
        order = np.argsort(s, kind="stable")
        s, i = s[order], i[order]
        keys, sizes = np.array(keys, np.int64), np.array(sizes, np.int32)
        begin = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        many = np.diff(np.append(begin, len(s)))
        rank = np.arange(len(s)) - np.repeat(begin, many)
        hot = np.repeat(many > HOT, many)
        note = np.array(notes, np.int64)
        rows.append((_SLACK, -1, _longs(keys[note[:, 0]]), _longs(note[:, 1] << 40 | np.maximum(note[:, 2], -1) + 1), b"", b""))
        if hot.any():
            rows.append((_MEMBERS, -1, _longs(s[hot].astype(np.int64)), _longs(keys[i[hot]]), b"", b""))
        keep = ~hot | (rank <= HOT)  # of a hot one enough to show that it is hot
        s, i = s[keep], i[keep]
        bucket = (mix(s) % _U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        s, i = s[order], i[order]
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if b > a:
                own, at = np.unique(i[a:b], return_inverse=True)
                rows.append((_SIGNS, k, planes(s[a:b], width), planes(at, 4), _longs(keys[own]), sizes[own].astype("<i4").tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 6, [pa.int32(), pa.int32(), *[pa.binary()] * 4], strict=True)], _HOT_NAMES)


def _send(buckets: int):
    """The signatures of all texts."""

    def run(batches):
        signs, index, keys, sizes, notes, seen, total = [], [], [], [], [], set(), 0
        for _, data, off in slices(batches, 0, PART):
            for u in shingle_sets(data, off):
                if len(u) < 3:
                    continue
                node = node_of(u)
                if node in seen:
                    continue
                seen.add(node)
                s, own = all_signatures(u)
                signs.append(s)
                index.append(np.full(len(s), len(keys)))
                notes += [(len(keys), *x) for x in own]
                keys.append(node)
                sizes.append(len(u))
                total += len(s)
                if total >= FLUSH:
                    yield _packed(signs, index, keys, sizes, notes, buckets, 6)
                    signs, index, keys, sizes, notes, seen, total = [], [], [], [], [], set(), 0
        if total:
            yield _packed(signs, index, keys, sizes, notes, buckets, 6)

    return lean(run)


def similar_sizes(a, b):
    low, high = np.minimum(a, b), np.maximum(a, b)
    return low * DEN >= high * NUM


def _meet(t: pa.Table) -> pa.Table:
    """Pairs (kind 0) of the bucket's small signatures, members of its hot ones (kind 1)."""
    signs, nodes, sizes = [], [], []
    for s, at, keys, n in zip(*[t[c].to_pylist() for c in ("signs", "nodes", "keys", "sizes")], strict=True):
        at = unplanes(at, 4).astype(np.int64)
        signs.append(unplanes(s, len(s) // len(at)))
        nodes.append(np.frombuffer(keys, "<i8")[at])
        sizes.append(np.frombuffer(n, "<i4")[at])
    s, node, n = np.concatenate(signs), np.concatenate(nodes), np.concatenate(sizes).astype(np.int64)
    order = np.lexsort((node, s))
    s, node, n = s[order], node[order], n[order]
    first = np.concatenate([[True], (s[1:] != s[:-1]) | (node[1:] != node[:-1])])
    s, node, n = s[first], node[first], n[first]
    begin = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    many = np.repeat(np.diff(np.append(begin, len(s))), np.diff(np.append(begin, len(s))))
    rank = np.arange(len(s)) - np.repeat(begin, np.diff(np.append(begin, len(s))))
    hot = many > HOT
    a, b = [], []
    for step in range(1, HOT):
        i = np.flatnonzero(~hot & (rank + step < many))
        if not len(i):
            break
        i = i[similar_sizes(n[i], n[i + step])]
        a.append(node[i])
        b.append(node[i + step])
    pairs = np.unique(np.stack([np.concatenate([np.empty(0, np.int64), *a]), np.concatenate([np.empty(0, np.int64), *b])], axis=1), axis=0)
    return pa.table({
        "kind": pa.array(np.concatenate([np.zeros(len(pairs), np.int32), np.ones(hot.sum(), np.int32)])),
        "a": pa.array(np.concatenate([pairs[:, 0], s[hot].astype(np.int64)])),
        "b": pa.array(np.concatenate([pairs[:, 1], node[hot]])),
    })


def _meet_or_pass(t: pa.Table) -> pa.Table:
    """A bucket's pairs (kind _SIGNS) and hot members; all else as it comes."""
    kind = t["kind"][0].as_py()
    if kind == _SIGNS:
        out = _meet(t)
        trim()
        return out
    a, b = (np.concatenate([np.frombuffer(x, "<i8") for x in t[c].to_pylist()]) for c in ("signs", "nodes"))
    return pa.table({"kind": pa.array(np.full(len(a), kind, np.int32)), "a": pa.array(a), "b": pa.array(b)})


_PACKED = "kind int, bucket int, signs binary, nodes binary, keys binary, sizes binary"


def _met(sent: DataFrame, buckets: int) -> DataFrame:
    """What the buckets say: kind and two numbers."""
    place = F.when(F.col("kind") == _SIGNS, F.col("bucket").cast("long")).otherwise(F.pmod(F.xxhash64("signs"), F.lit(buckets)) - F.col("kind") * buckets)
    return settle(sent.withColumn("place", place).groupBy("place").applyInArrow(lambda t: _meet_or_pass(t), "kind int, a long, b long"))


def _verify(batches):
    """Rows in order of (a, salt), the leader's set (b null) before its partners'."""
    key, lead = None, None
    for batch in batches:
        a, salt, b, sets = (batch.column(i).to_pylist() for i in range(4))
        out = []
        for x, y, z, s in zip(a, salt, b, sets, strict=True):
            own = np.frombuffer(s, "<u8")
            if z is None:
                key, lead = (x, y), own
            elif key == (x, y):
                both = len(np.intersect1d(lead, own, assume_unique=True))
                if both * DEN >= NUM * (len(lead) + len(own) - both):
                    out.append((x, z))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["u", "v"])


def _compare(buckets: int):
    """Rows like those of _verify, with the least size among a leader's partners: their links,
    and what lies outside the leader as signatures."""

    def run(batches):
        key, lead, least = None, None, 0
        signs, index, keys, sizes, notes, total = [], [], [], [], [], 0
        links, caps = [], {}
        for batch in batches:
            for x, y, z, s, low in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                own = np.frombuffer(s, "<u8")
                if z is None:
                    key, lead, least = (x, y), own, low
                    scheme = int(mix(np.array([x], np.int64).view(_U))[0] >> _U(42))
                    salt = mix(np.array([x], np.int64).view(_U) ^ _U(0x0DDBA11))[0]
                    continue
                if key != (x, y):
                    continue
                n, nl = len(own), len(lead)
                at = np.minimum(np.searchsorted(lead, own), nl - 1)
                inside = lead[at] == own
                both = int(inside.sum())
                rest = own[~inside]
                if both >= least_overlap(n, nl):
                    links.append((x, z))
                    need = (n - nl) * NUM // (DEN + NUM) + 1
                else:
                    need = least_overlap(n, max(least, -(-n * NUM // DEN))) - both
                out = mix(rest ^ salt) >> _U(24)
                if need <= 0 and n * NUM <= nl * DEN:
                    open_to = mix(np.array([salt], _U)) >> _U(24)
                    out = np.append(out, open_to)
                    caps[scheme << 41 | int(open_to[0])] = nl
                if len(out):
                    signs.append(out | _U(scheme << 41))
                    index.append(np.full(len(out), len(keys)))
                    notes.append((len(keys), scheme, max(need, 0) - 1))
                    keys.append(z)
                    sizes.append(n)
                    total += len(out)
                if total >= FLUSH:
                    yield _packed(signs, index, keys, sizes, notes, buckets, 8, more(links, caps))
                    signs, index, keys, sizes, notes, total, links, caps = [], [], [], [], [], 0, [], {}
        if signs or links:
            yield _packed(signs, index, keys, sizes, notes, buckets, 8, more(links, caps))

    def more(links, caps):
        return [(_LINK, [a for a, _ in links], [b for _, b in links]), (_CAP, list(caps), list(caps.values()))]

    return lean(run)


def _filter(batches):
    """Pairs whose sketches do not rule a link out."""
    for batch in batches:
        a, b = batch.column(0), batch.column(1)
        na, x, nb, y = (batch.column(i).to_pylist() for i in range(2, 6))
        ok = pa.array([may_link(*v) for v in zip(na, x, nb, y, strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([a.filter(ok), b.filter(ok)], ["a", "b"])


def _led(pairs: DataFrame, sets: DataFrame, least: bool = False) -> DataFrame:
    """Rows a, salt, b, set for _verify: each leader's set before those of its partners.

    A leader's partners are dealt to as many copies of it as the square root of the
    pairs by FAN, so that one with most of the pairs is shared by many tasks.
    ``least`` adds the least size n among a leader's partners to its rows.
    """
    copies = 1 + math.isqrt(pairs.count() // FAN)
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(copies)).cast("int"))
    lead, more = salted.select("a", "salt").distinct(), []
    if least:  # at most ``copies`` rows a leader
        lead = salted.groupBy("a", "salt").agg(F.min("n").alias("low")).withColumn("low", F.min("low").over(Window.partitionBy("a")))
        more = [F.lit(None).cast("long").alias("low")]
    lead = lead.join(sets, lead.a == sets.node).select("a", "salt", F.lit(None).cast("long").alias("b"), "set", *["low"] * least)
    rest = salted.join(sets, salted.b == sets.node).select("a", "salt", "b", "set", *more)
    return lead.union(rest).repartition(dealt(pairs.sparkSession), "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())


class _Sets:
    """The distinct sets: node, n, sketch, and the name of one row of each."""

    def __init__(self, named: DataFrame, described: DataFrame):
        self.named = named
        one = described.where("node is not null").groupBy("node").agg(F.min(F.struct("row", "n", "sketch")).alias("x"))
        self.nodes = settle(one.select("node", "x.*"))

    def of(self, nodes: DataFrame) -> DataFrame:
        """Columns node, set for the nodes of a DataFrame (column node, distinct), from one text of each."""
        row = light(self.nodes.join(nodes, "node", "left_semi").select("node", "row"))

        def run(batches):
            for batch, data, off in slices(batches, 1, PART):
                got = [(k, u) for k, u in zip(batch.column(0).to_pylist(), shingle_sets(data, off), strict=True) if k == node_of(u)]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], pa.int64()), pa.array([u.astype("<u8").tobytes() for _, u in got], pa.binary())], ["node", "set"])

        return settle(self.named.join(row, "row").select("node", "text").mapInArrow(lean(run), "node long, set binary"), "lz4")

    def likely(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) without those that their sketches rule out."""
        x = self.nodes.select("node", "n", "sketch").toDF("a", "na", "xa")
        y = self.nodes.select("node", "n", "sketch").toDF("b", "nb", "xb")
        rows = pairs.distinct().join(x, "a").join(y, "b").select("a", "b", "na", "xa", "nb", "xb")
        return settle(rows.mapInArrow(lean(_filter), "a long, b long"))


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the settled pairs (a, b: different nodes) that link, as u, v."""
    return settle(_led(pairs, sets).mapInArrow(lean(_verify), "u long, v long"))


def _short_of_cover(met: DataFrame) -> DataFrame:
    """Hot signatures' members that have too little cover without their hot signatures: sign, node."""
    note = met.where(f"kind = {_SLACK}").select(F.col("a").alias("node"), F.col("b").alias("note")).distinct()
    note = note.select("node", F.shiftright("note", 40).alias("scheme"), (F.col("note").bitwiseAND((1 << 40) - 1) - 1).alias("slack"))
    hot = met.where(f"kind = {_MEMBERS}").select(F.col("a").alias("sign"), F.col("b").alias("node")).distinct()
    hot = hot.withColumn("scheme", F.shiftrightunsigned("sign", 41))
    lost = hot.groupBy("node", "scheme").agg(F.sum(1 + F.shiftright("sign", 40).bitwiseAND(1)).alias("lost"))
    own = note.join(lost, ["node", "scheme"]).where("lost > slack").select("node", "scheme").distinct()
    return hot.join(own, ["node", "scheme"], "left_semi").select("sign", "node")


def _leaders(members: DataFrame, sizes: DataFrame, caps: DataFrame | None) -> DataFrame:
    """Of each signature the member that stands in most signatures (column a); under a cap,
    of those that are smaller than it."""
    own = members.groupBy("node").agg(F.count("*").alias("often")).join(sizes, "node")
    rows = members.join(own, "node")
    if caps is not None:
        rows = rows.join(caps, "sign", "left").where("cap is null or n < cap")
    return rows.groupBy("sign").agg(F.max_by("node", F.struct("often", "node")).alias("a"))


def _resolve(members: DataFrame, links: DataFrame, sets: _Sets, buckets: int) -> DataFrame:
    """Components (node, root) of the links and of those among the members (sign, node)."""
    if members.isEmpty():
        return components(links)
    known = sets.of(members.select("node").distinct())
    sizes = known.select("node", (F.octet_length("set") / 8).cast("long").alias("n"))
    edges, caps, turns = links, None, TURNS
    while True:
        lead = _leaders(members, sizes, caps)
        pairs = settle(members.join(lead, "sign").where("a <> node").select("a", F.col("node").alias("b")).distinct().join(sizes.withColumnRenamed("node", "b"), "b").select("a", "b", "n"), narrow=True)
        out = _met(_led(pairs, known, least=True).mapInArrow(_compare(buckets), _PACKED), buckets)
        roots = components(edges.union(out.where(f"kind = {_LINK}").select("a", "b")))

        def rooted(rows: DataFrame, node: str, name: str, roots: DataFrame = roots) -> DataFrame:
            return rows.join(roots.select(F.col("node").alias(node), F.col("root").alias(name)), node, "left").withColumn(name, F.coalesce(name, node))

        cross = rooted(rooted(out.where("kind = 0").select("a", "b").distinct(), "a", "ra"), "b", "rb").where("ra <> rb").select("a", "b")
        caps = out.where(f"kind = {_CAP}").select(F.col("a").alias("sign"), F.col("b").alias("cap")).distinct()
        left = rooted(_short_of_cover(out), "node", "root").join(sizes, "node").withColumn("scheme", F.shiftrightunsigned("sign", 41))
        split = left.groupBy("sign").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("sign")
        left = settle(left.join(split, "sign", "left_semi"), narrow=True)
        # a leader's signatures as one group: of those with few members outside the
        # largest component these are compared with the rest of the group
        group = settle(left.select("scheme", "node", "root", "n").distinct(), narrow=True)
        parts = group.groupBy("scheme", "root").agg(F.count("*").alias("k")).groupBy("scheme").agg(F.sum("k").alias("all"), F.max("k").alias("most"), F.max_by("root", F.struct("k", "root")).alias("big"))
        few = parts.where(F.col("all") - F.col("most") <= turns).select("scheme", "big")
        group = group.join(few, "scheme")
        one = group.where("root <> big").select("scheme", F.col("node").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"))
        ask = group.join(one, "scheme").where(f"ra <> root and least(n, na) * {DEN} >= greatest(n, na) * {NUM} and (root = big or a < node)")
        new = _links(settle(cross.union(ask.select("a", F.col("node").alias("b"))).distinct(), narrow=True), known)
        edges = roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(new)
        members = settle(left.join(few, "scheme", "left_anti").select("sign", "node"), narrow=True)
        turns *= STEP
        if members.isEmpty():
            return components(edges)


def _rooted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: row (its name), id, n, node and root (null: an empty set)."""
    buckets = max(BUCKETS, 4 * dealt(docs.sparkSession))
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    named = rows.select(row_name("id", "text").alias("row"), "id", "text")
    described = settle(named.select("row", "text", "id").mapInArrow(lean(_describe), f"row string, id {kind}, n long, node long, sketch binary"))
    met = _met(rows.select("text").mapInArrow(_send(buckets), _PACKED), buckets)
    sets = _Sets(named, described)
    pairs = sets.likely(met.where("kind = 0").select("a", "b"))
    links = _links(pairs, sets.of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()))
    members = settle(_short_of_cover(met), narrow=True)
    release(met)
    roots = _resolve(members, links, sets, buckets)
    own = settle(described.select("row", "id", "n", "node"))
    release(described)
    return onto(own, roots, "node").withColumn("root", F.coalesce("root", "node"))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id column, n_shingles and component_id."""
    own = settle(_rooted(docs, id_col, text_col))
    least = settle(own.where("root is not null").groupBy("root").agg(F.min("id").alias("least")))
    out = onto(own, least, "root")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates; all their columns.

    Of each component the row of the smallest id stays (a null id only if there is
    no other; of equal ids the text of the least hash); all rows with empty sets
    stay, of equal ones one.
    """
    name = unused(docs.columns, "row")
    own = settle(_rooted(docs, id_col, text_col))
    first = own.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("row"))).alias("f")).select(F.col("f.row").alias(name))
    many = own.groupBy("row").count().where("count > 1").select(F.col("row").alias(name))
    gone = own.where("root is not null").select(F.col("row").alias(name)).distinct().join(first, name, "left_anti")
    marked = docs.withColumn(name, row_name(F.col(id_col), F.col(text_col)))
    many, gone = light(many), light(gone)
    left = marked.join(gone, name, "left_anti")
    if not many.isEmpty():  # of rows with one id and text one stays
        again = left.join(many, name, "left_semi").dropDuplicates([name])
        left = left.join(many, name, "left_anti").unionByName(again)
    return left.drop(name)
