"""Suffix-array dedup: bytes of strings of LENGTH bytes that start twice or more go.

``suffix_array`` builds suffix arrays by linear grouping: suffixes stand in groups
by their Lyndon prefix so far, groups are taken in descending order, and each
member finds the previous suffix of a smaller group by its pointer; suffixes found
so, and how often, leave their group for groups just above it.  When all are done,
every group holds the suffixes of one longest Lyndon prefix, and one pass in
ascending order emits each group's order.  No recursion and no renaming.

How a corpus is cut so that each suffix array is small and no repeat is lost:

1. Every window of LENGTH bytes has an anchor, the least hash among its GRAM-byte
   strings; equal windows have equal anchors at equal places.  Anchors' hashes are
   counted over the corpus; windows with an anchor that stands once are unique.
2. Windows of a repeated anchor go in runs of RUN neighbours at fixed distances
   from it.  All windows of a run share a core (LENGTH - RUN + 1 bytes) and differ in
   RUN - 1 bytes on either side.  The bytes beside a core and the core as one symbol
   make a string of 2 RUN - 1 symbols.  Equal strings are one weighted string.
3. Where the strings of a core differ, a suffix array over them tells which
   windows repeat: those suffixes that share RUN symbols with a neighbour.
   A core whose strings are all equal has weight two or more and repeats whole.

Anchors above HOT occurrences use runs of one window, whose strings have no
sides, so that they spread over buckets and are only counted.  A block of texts
sends each distinct hash or string once with its count; the answers come back to
the block.  Its rows stay in a file of the shared folder, under a name that only
the block's own rows carry, so that texts are neither shuffled nor joined by id;
what a lost or repeated task left there under another name is never read.  Matches never cross
rows.  Hashes of 64 bits tell anchors and cores apart.

Behaviour on odd input: null and empty texts and texts under LENGTH bytes stay
whole; a text that stands in two rows goes whole from both; bytes are judged on
the input; repeated ids and other columns pass through unchanged.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cuts_of, lean, settle, shared_dir, trim
from .textkit import SLICE, _ipw, _pw, gathered, mix, planes, ragged, slices, text_buffer, unplanes

LENGTH = 200
GRAM = 32
RUN = 16
#: Occurrences of an anchor from which its windows are counted one by one.
HOT = 20_000
#: Bytes of text in a block (a longer text is a block of its own).
BLOCK = 4 << 20
#: Symbols in one suffix array.
SYMBOLS = 1 << 16

_U = np.uint64
_POS = _U((1 << 21) - 1)
_BYTE = mix(np.arange(256, dtype=_U) + _U(0x77AA)) | _U(1)


# -- suffix arrays ---------------------------------------------------------------
def suffix_array(text: list[int]) -> list[int]:
    """Start positions of the suffixes of ``text`` in ascending order."""
    n = len(text)
    if not n:
        return []
    by: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        by.setdefault(c, []).append(i)
    groups = [by[c] for c in sorted(by)]  # members by group number
    below = list(range(-1, len(groups) - 1))  # the group under each, a linked list
    above = [*range(1, len(groups)), -1]
    group = [0] * n
    for k, members in enumerate(groups):
        for i in members:
            group[i] = k
    done = [False] * len(groups)
    jump = list(range(-1, n - 1))  # previous suffix of a smaller group, or on the way to it
    length = [1] * n  # of the Lyndon prefix so far
    at = len(groups) - 1
    while at >= 0:
        done[at] = True
        size = length[groups[at][0]]
        times: dict[int, int] = {}
        for i in groups[at]:
            j = jump[i]
            while j >= 0 and done[group[j]]:
                j = jump[j]
            k = jump[i]  # shorten the way for later
            while k != j:
                jump[k], k = j, jump[k]
            jump[i] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        split: dict[int, dict[int, list[int]]] = {}
        for j, c in times.items():
            length[j] += c * size
            split.setdefault(group[j], {}).setdefault(c, []).append(j)
        for k, parts in split.items():
            moved = sum(map(len, parts.values()))
            counts = sorted(parts)
            if moved == len(groups[k]):
                groups[k] = parts[counts[0]]  # nothing is left: the least count keeps the number
                counts = counts[1:]
            elif counts:
                leave = times
                groups[k] = [i for i in groups[k] if i not in leave]
            low = k
            for c in counts:
                new = len(groups)
                groups.append(parts[c])
                done.append(False)
                for j in parts[c]:
                    group[j] = new
                up = above[low]
                above.append(up)
                below.append(low)
                above[low] = new
                if up >= 0:
                    below[up] = new
                low = new
        at = below[at]
    # emission: a group's order is that of what follows the Lyndon prefixes
    first = 0
    while below[first] >= 0:
        first = below[first]
    start, place = [0] * len(groups), 0
    while first >= 0:
        start[first] = place
        place += len(groups[first])
        first = above[first]
    head, chain = [-1] * (n + 1), [-1] * n  # suffixes by what follows their prefix
    for i in range(n):
        t = i + length[i]
        chain[i], head[t] = head[t], i
    out = [0] * n
    for i in range(-1, n):
        j = head[n if i < 0 else out[i]]
        while j >= 0:
            k = group[j]
            out[start[k]] = j
            start[k] += 1
            j = chain[j]
    return out


def repeated_windows(strings: np.ndarray, core: np.ndarray) -> np.ndarray:
    """For strings of 2 RUN - 1 symbols, which of the RUN windows of each repeat in another.

    strings: (n, 2 RUN - 2) bytes beside the cores; core: (n,) numbers of cores.
    Returns (n, RUN) booleans.
    """
    n, side = len(strings), RUN - 1
    width = 2 * RUN
    table = np.zeros((n, width), np.int64)
    table[:, :side] = strings[:, :side]
    table[:, side + 1 : -1] = strings[:, side:]
    table[:, side] = core + 256
    table[:, :-1] += n
    table[:, -1] = np.arange(n)  # a separate end for each string
    flat = table.ravel()
    order = np.array(suffix_array(flat.tolist()), np.int64)
    order = order[order % width < RUN]  # suffixes that are windows; others cannot reach RUN symbols with a core
    shared = np.ones(max(len(order) - 1, 0), bool)
    for k in range(RUN):
        shared &= flat[order[1:] + k] == flat[order[:-1] + k]
    hit = np.zeros(len(order), bool)
    hit[1:] |= shared
    hit[:-1] |= shared
    out = np.zeros((n, RUN), bool)
    rows = order[hit]
    out[rows // width, rows % width] = True
    return out


# -- hashes of byte ranges ---------------------------------------------------------
def _prefix(part: np.ndarray) -> np.ndarray:
    out = np.empty(len(part) + 1, _U)
    out[0] = 0
    np.cumsum(_BYTE[part] * _pw[: len(part)], out=out[1:])
    return out


def range_hashes(data: np.ndarray, begins: np.ndarray, length: int) -> np.ndarray:
    """Hashes of data[b : b + length] for ascending begins."""
    out = np.empty(len(begins), _U)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(begins):
            base = int(begins[at])
            to = int(np.searchsorted(begins, base + SLICE - length, "right"))
            rel = begins[at:to] - base
            p = _prefix(data[base : int(begins[to - 1]) + length])
            out[at:to] = (p[rel + length] - p[rel]) * _ipw[rel]
            at = to
    return mix(out)


def anchors(data: np.ndarray, off: np.ndarray):
    """(place, hash, first window, last window) of the anchors of all rows."""
    got = []
    rows = np.flatnonzero(np.diff(off) >= LENGTH)
    piece: list[tuple[int, int]] = []  # ranges of window starts, close together

    def flush():
        if not piece:
            return
        lo, hi = piece[0][0], piece[-1][1] + LENGTH - 1
        with np.errstate(over="ignore"):
            p = _prefix(data[lo:hi])
            h = mix((p[GRAM:] - p[:-GRAM]) * _ipw[: hi - lo - GRAM + 1])
        key = (h & ~_POS) | np.arange(len(h), dtype=_U)
        span, have = LENGTH - GRAM + 1, 1
        low = key
        while 2 * have <= span:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        if have < span:
            low = np.minimum(low[: len(low) - (span - have)], low[span - have :])
        sizes = np.array([b - a for a, b in piece])
        starts = ragged(sizes, np.array([a for a, _ in piece]) - lo)
        place = (low[starts] & _POS).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.append(first[1:], len(place)) - 1
        got.append((place[first] + lo, h[place[first]], starts[first] + lo, starts[last] + lo))

    for r in rows.tolist():
        a, end = int(off[r]), int(off[r + 1]) - LENGTH + 1
        while a < end:
            if piece and a + LENGTH - piece[0][0] >= SLICE:
                flush()
                piece = []
            b = min(end, (piece[0][0] if piece else a) + SLICE - LENGTH)
            piece.append((a, b))
            a = b
    flush()
    if not got:
        z = np.empty(0, np.int64)
        return z, np.empty(0, _U), z, z
    place, h, lo, hi = (np.concatenate(x) for x in zip(*got, strict=True))
    # an anchor whose windows were cut between two pieces is one anchor
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return place[first], h[first], lo[first], np.append(hi[first[1:] - 1], hi[-1])


# -- blocks -----------------------------------------------------------------------
def _freeze(batch: pa.RecordBatch, uri: str) -> None:
    """Write a block's rows or places; under their name they are whole or not there."""
    store, path = fs.FileSystem.from_uri(uri)
    part = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out, pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=5))) as w:
        w.write_batch(batch)
    if store.get_file_info(path).type != fs.FileType.NotFound:
        store.delete_file(path)  # of an attempt before; not all stores move onto a file
    store.move(part, path)


def _thaw(uri: str) -> pa.RecordBatch:
    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(path) as f:
        return pa.ipc.open_stream(f).read_next_batch()


_FIELDS = [("block", pa.int64()), ("bucket", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())]
_SCHEMA = "block long, bucket int, a binary, b binary, c binary"
_ARROW = pa.schema(_FIELDS)


def _rows(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True) if rows else [()] * 5, _FIELDS, strict=True)]


def _distinct(h: np.ndarray, buckets: int):
    """Distinct hashes in order of bucket, their counts, codes of the inputs, cuts by bucket."""
    u, codes, n = np.unique(h, return_inverse=True, return_counts=True)
    bucket = (mix(u) % _U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return u[order], n[order], place[codes], np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()


def _send_anchors(text: int, buckets: int, folder: str):
    def run(batches):
        for batch, data, off in slices(gathered(batches, text, BLOCK), text, 2 * BLOCK):
            name = uuid.uuid4().int >> 66
            _freeze(batch, f"{folder}/{name}.rows")
            u, n, _, cuts = _distinct(anchors(data, off)[1], buckets)
            rows = [(name, -1, None, None, None)]
            rows += [(name, k, planes(u[a:b], 8), planes(n[a:b], 4), None) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
            yield pa.RecordBatch.from_arrays(_rows(rows), schema=_ARROW)

    return lean(run)


def _judge_anchors(t: pa.Table, hot: int) -> pa.Table:
    """Per block: 0 for anchors that stand once, 1 for repeated ones, 2 for hot ones."""
    hashes = [unplanes(x, 8) for x in t["a"].to_pylist()]
    counts = [unplanes(x, 4).astype(np.int64) for x in t["b"].to_pylist()]
    _, codes = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(codes, np.concatenate(counts))[codes]
    kind = ((total > 1).astype(np.uint8) + ((total > 1) & (total > hot))).astype(np.uint8)
    cuts = np.cumsum([0, *map(len, hashes)]).tolist()
    rows = [(k, b, kind[i:j].tobytes(), None, None) for k, b, i, j in zip(t["block"].to_pylist(), t["bucket"].to_pylist(), cuts, cuts[1:], strict=False)]
    return pa.Table.from_arrays(_rows(rows), schema=_ARROW)


def _records(data, off, kind: np.ndarray, place, lo, hi):
    """Core begins, run flag (False: a single window) of the windows of repeated anchors."""
    run = kind == 1
    a, first, last = place[run], (place - hi)[run] // RUN, (place - lo)[run] // RUN
    many = last - first + 1
    runs = np.repeat(a, many) - RUN * ragged(many, first)
    hot = kind == 2
    single = ragged((hi - lo + 1)[hot], lo[hot])
    return np.unique(runs), single  # two anchors of a text may name one place


def _sides(data, off, cores: np.ndarray) -> np.ndarray:
    """The RUN - 1 bytes before and after each core; 0 beyond the row."""
    shift = np.concatenate([np.arange(1 - RUN, 0), np.arange(LENGTH - RUN + 1, LENGTH)])
    out = np.empty((len(cores), len(shift)), np.uint8)
    for a in range(0, len(cores), 1 << 14):
        part = cores[a : a + (1 << 14)]
        row = np.searchsorted(off, part, "right") - 1
        at = part[:, None] + shift
        ok = (at >= off[row][:, None]) & (at < off[row + 1][:, None])
        out[a : a + len(part)] = np.where(ok, data[np.clip(at, 0, len(data) - 1)], 0)
    return out


def _send_strings(text: int, buckets: int, folder: str):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("bucket")
        block = t["block"][0].as_py()
        data, off = text_buffer(_thaw(f"{folder}/{block}.rows").column(text))
        place, h, lo, hi = anchors(data, off)
        _, _, codes, _ = _distinct(h, buckets)
        kinds = np.concatenate([np.empty(0, np.uint8), *[np.frombuffer(x, np.uint8) for x in t["a"].to_pylist()[1:]]])
        runs, single = _records(data, off, kinds[codes], place, lo, hi)
        core = range_hashes(data, runs, LENGTH - RUN + 1)
        side = _sides(data, off, runs)
        alone = mix(range_hashes(data, single, LENGTH) ^ _U(0x51D3))
        ident = np.concatenate([mix(core ^ _of_sides(side)), alone])
        # order by core's bucket, so that all strings of a core meet
        u, first, codes, n = np.unique(ident, return_index=True, return_inverse=True, return_counts=True)
        cores = np.concatenate([core, alone])[first]
        bucket = (mix(cores) % _U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        at = np.empty(len(order), np.int64)
        at[order] = np.arange(len(order))
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
        sides = np.concatenate([side, np.zeros((len(alone), 2 * RUN - 2), np.uint8)])[first][order]
        cores, n = cores[order], np.minimum(n[order], 2)
        where = np.concatenate([runs, -1 - single])
        _freeze(pa.RecordBatch.from_arrays([pa.array([where.astype("<i4").tobytes()]), pa.array([planes(at[codes], 4)])], ["where", "codes"]), f"{folder}/{block}.places")
        rows = [(block, k, planes(cores[a:b], 8), sides[a:b].T.tobytes(), n[a:b].astype(np.uint8).tobytes()) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
        out = pa.Table.from_arrays(_rows(rows), schema=_ARROW)
        trim()
        return out

    return run


def _of_sides(side: np.ndarray) -> np.ndarray:
    out = np.zeros(len(side), _U)
    with np.errstate(over="ignore"):
        for k in range(side.shape[1]):
            out += _BYTE[side[:, k]] * _pw[k + 1]
    return mix(out)


def _judge_strings(t: pa.Table) -> pa.Table:
    """Per block and string a mask of RUN bits: the windows that repeat."""
    cores, sides, counts = [], [], []
    for a, b, c in zip(t["a"].to_pylist(), t["b"].to_pylist(), t["c"].to_pylist(), strict=True):
        cores.append(unplanes(a, 8))
        counts.append(np.frombuffer(c, np.uint8))
        sides.append(np.frombuffer(b, np.uint8).reshape(2 * RUN - 2, -1).T)
    core, side, n = np.concatenate(cores), np.concatenate(sides), np.concatenate(counts).astype(np.int64)
    _, first, codes = np.unique(mix(core ^ _of_sides(side)), return_index=True, return_inverse=True)
    total = np.bincount(codes, n)
    mask = np.where(total > 1, (1 << RUN) - 1, 0).astype(np.int64)
    own = core[first]
    order = np.argsort(own, kind="stable")
    begin = np.flatnonzero(np.concatenate([[True], own[order][1:] != own[order][:-1]]))
    many = np.diff(np.append(begin, len(order)))
    # cores with different strings, as many as SYMBOLS allow in one suffix array
    pick = np.flatnonzero((many > 1) & (np.minimum.reduceat(total[order], begin) < 2)) if len(order) else begin
    at = 0
    while at < len(pick):
        sizes = np.cumsum(many[pick[at:]]) * 2 * RUN
        to = at + max(1, int(np.searchsorted(sizes, SYMBOLS, "right")))
        members = order[ragged(many[pick[at:to]], begin[pick[at:to]])]
        number = np.repeat(np.arange(to - at), many[pick[at:to]])
        hit = repeated_windows(side[first[members]], number)
        mask[members] |= hit @ (1 << np.arange(RUN))
        at = to
    mask = mask[codes]
    cuts = np.cumsum([0, *map(len, counts)]).tolist()
    rows = [(k, b, mask[i:j].astype("<u2").tobytes(), None, None) for k, b, i, j in zip(t["block"].to_pylist(), t["bucket"].to_pylist(), cuts, cuts[1:], strict=False)]
    return pa.Table.from_arrays(_rows(rows), schema=_ARROW)


def _removed(t: pa.Table, text: int, folder: str):
    """The block's rows, its bytes and offsets, and which bytes go."""
    t = t.sort_by("bucket")
    block = t["block"][0].as_py()
    batch = _thaw(f"{folder}/{block}.rows")
    data, off = text_buffer(batch.column(text))
    head = _thaw(f"{folder}/{block}.places").to_pylist()[0]
    mask = np.concatenate([np.empty(0, np.uint16), *[np.frombuffer(x, "<u2") for x in t["a"].to_pylist()[1:]]])
    where = np.frombuffer(head["where"], "<i4").astype(np.int64)
    mask = mask[unplanes(head["codes"], 4).astype(np.int64)]
    cover = np.zeros(len(data) + LENGTH + 1, np.int32)
    single = where < 0
    hit = -1 - where[single & (mask > 0)]
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + LENGTH, -1)
    core, bits = where[~single], mask[~single]
    row = np.searchsorted(off, core, "right") - 1
    for k in range(RUN):
        s = core - (RUN - 1) + k
        s = s[((bits >> k) & 1 == 1) & (s >= off[row]) & (s + LENGTH <= off[row + 1])]
        np.add.at(cover, s, 1)
        np.add.at(cover, s + LENGTH, -1)
    return batch, data, off, np.cumsum(cover[: len(data)]) > 0


def remove(docs: DataFrame, id_col: str, text_col: str, finish, fields: str, hot: int = HOT) -> DataFrame:
    """Runs the operator; ``finish(batch, data, off, gone)`` makes a block's output table."""
    spark = docs.sparkSession
    buckets = cuts_of(docs, text_col)
    text = docs.columns.index(text_col)
    folder = shared_dir(spark)
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    blocks = settle(docs.mapInArrow(_send_anchors(text, buckets, folder), _SCHEMA))
    heads = blocks.where("bucket < 0")
    # small rows stand for much work: the numbers of parts are stated, not left to their bytes
    kinds = blocks.where("bucket >= 0").repartition(buckets, "bucket").groupBy("bucket").applyInArrow(lambda t: _judge_anchors(t, hot), _SCHEMA)
    strings = heads.union(kinds).repartition(buckets, "block").groupBy("block").applyInArrow(_send_strings(text, buckets, folder), _SCHEMA)
    masks = strings.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(lambda t: _judge_strings(t), _SCHEMA)

    def last(t: pa.Table) -> pa.Table:
        out = finish(*_removed(t, text, folder))
        trim()
        return out

    return heads.union(masks).repartition(buckets, "block").groupBy("block").applyInArrow(last, fields)


def _spans(off, gone) -> np.ndarray:
    """Number of maximal removed runs of each row."""
    if not len(gone):
        return np.zeros(len(off) - 1, np.int64)
    start = gone.copy()
    start[1:] &= ~gone[:-1]
    inner = off[:-1][np.diff(off) > 0]
    start[inner] = gone[inner]
    total = np.concatenate([[0], np.cumsum(start)])
    return total[off[1:]] - total[off[:-1]]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """Per row: the id column, n_bytes, n_removed, n_spans and kept_sha256."""

    def finish(batch, data, off, gone):
        total = np.concatenate([[0], np.cumsum(gone)])
        kept = data[~gone].tobytes()
        n = np.diff(off) - (total[off[1:]] - total[off[:-1]])
        at = np.concatenate([[0], np.cumsum(n)]).tolist()
        sha = [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(at, at[1:], strict=False)]
        return pa.table({"id": batch.column(0), "n_bytes": pa.array(np.diff(off)), "n_removed": pa.array(np.diff(off) - n), "n_spans": pa.array(_spans(off, gone)), "kept_sha256": pa.array(sha, pa.string())})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = remove(rows, "id", "text", finish, f"id {dict(docs.dtypes)[id_col]}, n_bytes long, n_removed long, n_spans long, kept_sha256 string", hot)
    return out.withColumnRenamed("id", id_col)


def keep_rest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with what is left of their texts; halves of cut characters go too."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text = names.index(text_col)

    def finish(batch, data, off, gone):
        keep = ~gone
        total = np.concatenate([[0], np.cumsum(keep)])
        raw, at = data[keep].tobytes(), total[off].tolist()
        null = batch.column(text).is_null().to_pylist()
        new = pa.array([None if z else raw[a:b].decode("utf-8", "ignore") for a, b, z in zip(at, at[1:], null, strict=False)], pa.string())
        columns = [new if i == text else c for i, c in enumerate(batch.columns)]
        return pa.Table.from_arrays(columns, names=batch.schema.names)

    schema = ", ".join(f"c{i} {t}" for i, (_, t) in enumerate(docs.dtypes))
    return remove(plain, f"c{names.index(id_col)}", f"c{text}", finish, schema).toDF(*names)
