"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A word is a row of symbols.  The leaves of its segment tree hold the rank of the
merge of each symbol with its right neighbour, joined with the position, so that
the root is the leftmost pair of the lowest rank.  A merge changes three leaves
(the pair, the one before it and the one that vanished), each in logarithmic
time.  It ends when the root says that nothing can be merged.

Many words run side by side: the trees of all words of one width form a matrix,
and a step takes the root of each, merges and updates with array operations.

Words of a text are cached by hash, so that a frequent word is merged once; every
hit is compared by its bytes, and the cache is bounded in entries, bytes and ids.

Behaviour on odd input: a null or empty text has no ids and decodes to the
empty text; ids of special tokens are emitted where their strings stand in the
text; equal texts give equal rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex

from .shared import lean
from .textkit import SLICE, SPACE, ragged, slices, word_hashes

#: Characters that end a chunk: Unicode's White_Space.
_WHITE = regex.compile(r"\p{White_Space}+")
_INF = np.int64(1) << 62
_POS = 32
#: Chunks, their bytes and their ids in the cache of a worker before it is emptied; with
#: the longest chunk that is kept they bound its memory to about 100 MB.
CACHE_WORDS, CACHE_BYTES, CACHE_IDS = 800_000, 12 << 20, 4 << 20
#: Bytes of a chunk beyond which it is not kept.
KEPT = 256
#: Chunks in the cache's young part, a dict, before they move to sorted arrays.
YOUNG = 100_000
#: Words at least this long run alone (a matrix of trees would be mostly empty).
ALONE = 512


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in keep:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


class WordBpe:
    """A byte-level BPE with word ends, read from a tokenizer file; never trained."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.tokens = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        self.splitter = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        chars = byte_symbols()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + self.suffix] for c in chars], np.int64)
        left = np.array([vocab[a] for a, _ in model["merges"]], np.int64)
        right = np.array([vocab[b] for _, b in model["merges"]], np.int64)
        made = np.array([vocab[a + b] for a, b in model["merges"]], np.int64)
        key = (left << 17) | right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], order.astype(np.int64), made
        self.pairs = {int(k): int(r) for k, r in zip(self.keys, self.ranks, strict=True)}

    # -- pair ranks -----------------------------------------------------------
    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 17) | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], _INF >> _POS)

    # -- merging --------------------------------------------------------------
    def merge_many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in one array, and the number of ids of each word."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        counts = np.zeros(len(words), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        rows_of: list[np.ndarray] = []
        width = 2
        done = lens == 0
        while not done.all():
            if width >= ALONE:
                for i in np.flatnonzero(~done):
                    ids = self.merge_one(words[i])
                    counts[i] = len(ids)
                    found.append((ids, np.array([len(ids)])))
                    rows_of.append(np.array([i]))
                break
            rows = np.flatnonzero(~done & (lens <= width))
            step = max(1, (1 << 19) // width)
            for a in range(0, len(rows), step):
                part = rows[a : a + step]
                ids, n = self._lockstep([words[i] for i in part], lens[part], width)
                counts[part] = n
                found.append((ids, n))
                rows_of.append(part)
            done[rows] = True
            width *= 2
        out = np.empty(int(counts.sum()), np.int32)
        begins = np.cumsum(counts) - counts
        for (ids, n), rows in zip(found, rows_of, strict=True):
            out[ragged(n, begins[rows])] = ids
        return out, counts

    def _lockstep(self, words: list[bytes], lens: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        n, w = len(words), width
        raw = np.frombuffer(b"".join(words), np.uint8)
        where = ragged(lens, np.arange(n) * w)
        sym = np.zeros(n * w + 1, np.int64)
        sym[where] = self.inner[raw]
        ends = np.arange(n) * w + lens - 1
        sym[ends] = self.last[raw[np.cumsum(lens) - 1]]
        col = np.tile(np.arange(w), n)
        nxt = np.append(col + 1, 0)
        prv = np.append(col - 1, 0)
        live = np.zeros(n * w, bool)
        live[where] = True
        tree = np.full(n * 2 * w, _INF, np.int64)
        inner = np.setdiff1d(where, ends, assume_unique=True)
        tree[(inner // w) * 2 * w + w + inner % w] = (self.rank(sym[inner], sym[inner + 1]) << _POS) | (inner % w)
        tree[tree >= _INF] = _INF
        grid = tree.reshape(n, 2 * w)
        size = w
        while size > 1:
            half = size // 2
            grid[:, half:size] = np.minimum(grid[:, size : 2 * size : 2], grid[:, size + 1 : 2 * size : 2])
            size = half
        rows = np.arange(n)
        while True:
            root = grid[rows, 1]
            rows = rows[root < _INF]
            if not len(rows):
                break
            root = root[root < _INF]
            base, tbase = rows * w, rows * 2 * w
            pos = root & 0xFFFFFFFF
            gone = nxt[base + pos]
            right = nxt[base + gone]
            left = prv[base + pos]
            made = self.made[root >> _POS]
            sym[base + pos] = made
            nxt[base + pos] = right
            live[base + gone] = False
            has_r, has_l = right < lens[rows], left >= 0
            prv[(base + right)[has_r]] = pos[has_r]
            new = np.full(len(rows), _INF, np.int64)
            new[has_r] = (self.rank(made[has_r], sym[(base + right)[has_r]]) << _POS) | pos[has_r]
            new[new >= _INF] = _INF
            tree[tbase + w + gone] = _INF
            tree[tbase + w + pos] = new
            before = (self.rank(sym[(base + left)[has_l]], made[has_l]) << _POS) | left[has_l]
            before[before >= _INF] = _INF
            tree[(tbase + w + left)[has_l]] = before
            lifted = (gone, pos, np.where(has_l, left, pos))
            nodes = [w + x for x in lifted]
            while nodes[0][0] > 1:
                nodes = [x >> 1 for x in nodes]
                for x in nodes:
                    a = tbase + 2 * x
                    tree[tbase + x] = np.minimum(tree[a], tree[a + 1])
        kept = np.flatnonzero(live)
        return sym[kept].astype(np.int32), np.bincount(kept // w, minlength=n)

    def merge_one(self, word: bytes) -> np.ndarray:
        """One word by its own segment tree; for words of any length."""
        raw = np.frombuffer(word, np.uint8)
        n = len(raw)
        sym = self.inner[raw]
        sym[-1] = self.last[raw[-1]]
        w = 1 << max(1, (n - 1).bit_length())
        first = np.full(2 * w, _INF, np.int64)
        first[w : w + n - 1] = (self.rank(sym[:-1], sym[1:]) << _POS) | np.arange(n - 1)
        size = w
        while size > 1:
            first[size // 2 : size] = np.minimum(first[size : 2 * size : 2], first[size + 1 : 2 * size : 2])
            size //= 2
        inf, pairs = int(_INF), self.pairs
        tree, sym, made = np.minimum(first, _INF).tolist(), sym.tolist(), self.made
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, j: int) -> None:
            r = pairs.get((sym[i] << 17) | sym[j]) if j < n else None
            lift(i, inf if r is None else (r << _POS) | i)

        def lift(i: int, value: int) -> None:
            i += w
            tree[i] = value
            while i > 1:
                i >>= 1
                a, b = tree[2 * i], tree[2 * i + 1]
                low = a if a < b else b
                if tree[i] == low:
                    break
                tree[i] = low

        while tree[1] < inf:
            pos = tree[1] & 0xFFFFFFFF
            gone = nxt[pos]
            sym[pos], nxt[pos] = int(made[tree[1] >> _POS]), nxt[gone]
            if nxt[gone] < n:
                prv[nxt[gone]] = pos
            lift(gone, inf)
            sym[gone] = -1
            put(pos, nxt[pos])
            if prv[pos] >= 0:
                put(prv[pos], pos)
        return np.array([x for x in sym if x >= 0], np.int32)

    # -- words of a chunk ------------------------------------------------------
    def pieces(self, chunk: str) -> list[bytes]:
        """The words of a text without special tokens, normalised, as bytes."""
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ")
            chunk = _WHITE.sub(" ", chunk)
        return [x.encode() for x in self.pattern.findall(chunk.lower())]

    def encode_text(self, text: str) -> np.ndarray:
        """Ids of one whole text, special tokens included; no cache."""
        out, at = [], 0
        for m in [*self.splitter.finditer(text), None]:
            part = text[at : m.start() if m else len(text)]
            words = self.pieces(part)
            if words:
                out.append(self.merge_many(words)[0])
            if m:
                out.append(np.array([self.special[m[0]]], np.int32))
                at = m.end()
        return np.concatenate(out) if out else np.empty(0, np.int32)

    def decode(self, ids) -> str:
        """Tokens joined by blanks, as a tokenizer without decoder does."""
        return " ".join([self.tokens[int(i)] for i in ids])


#: 0 white space, 1 ASCII letter or digit, 2 other ASCII but the apostrophe, 3 the rest.
_KIND = np.full(256, 3, np.uint8)
_KIND[33:127] = 2
_KIND[39] = 3
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = 1
_KIND[SPACE] = 0


def chunk_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Like word_bounds, but letters and digits are cut from ASCII punctuation.

    No word of the vocabulary's pattern crosses such a cut; the apostrophe, which
    begins the contractions, never is at one.
    """
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(off) - 1, np.int64)
    kind = _KIND[data]
    cut = np.zeros(n + 1, bool)  # a chunk may not cross this place
    cut[off] = True
    cut[1:n] |= (kind[1:] ^ kind[:-1]) == 3  # 1 beside 2, or 0 beside 3
    solid = kind > 0
    edge = np.zeros(n + 1, bool)
    edge[:n] = solid
    edge[1:n] &= ~solid[:-1] | cut[1:n]
    starts = np.flatnonzero(edge[:n])
    edge[1:] = solid
    edge[0] = False
    edge[1:n] &= ~solid[1:] | cut[1:n]
    return starts, np.flatnonzero(edge), np.diff(np.searchsorted(starts, off))


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


class ChunkCache:
    """Ids of the chunks of texts, found by the chunk's hash and checked by its bytes.

    ``encode_new`` maps a list of chunks (text) to (ids, counts).
    """

    def __init__(self, encode_new):
        self.encode_new = encode_new
        self.clear()

    def clear(self) -> None:
        self.young: dict[int, int] = {}
        self.old, self.old_at = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.flat, self.raw = np.empty(1 << 16, np.int32), np.empty(1 << 16, np.uint8)
        self.used = self.have = self.filled = 0
        self.begin, self.count, self.raw_at, self.size = (np.zeros(1 << 14, np.int64) for _ in range(4))

    def lookup(self, data: np.ndarray, starts, ends) -> np.ndarray:
        """The cache's index of each chunk."""
        import pandas as pd

        size = ends - starts
        keep = np.flatnonzero(size <= KEPT)
        codes, uniques = pd.factorize(word_hashes(data, starts, ends)[keep])
        if self.have + len(uniques) > CACHE_WORDS or self.filled > CACHE_BYTES or self.used > CACHE_IDS:
            self.clear()
        at = np.full(len(uniques), -1, np.int64)
        if len(self.old):
            i = np.minimum(np.searchsorted(self.old, uniques), len(self.old) - 1)
            at = np.where(self.old[i] == uniques, self.old_at[i], -1)
        if self.young:
            rest, get = np.flatnonzero(at < 0), self.young.get
            at[rest] = [get(h, -1) for h in uniques[rest].tolist()]
        new = np.flatnonzero(at < 0)
        low = _FOLD[data]
        if len(new):
            where = np.empty(len(uniques), np.int64)
            where[codes[::-1]] = keep[::-1]  # the first place of each
            at[new] = self._add(data, low, starts[where[new]], size[where[new]])
            self._name(uniques[new], at[new])
        out = np.empty(len(starts), np.int64)
        out[keep] = at[codes]
        other = np.concatenate([np.flatnonzero(size > KEPT), keep[~self._same(low, starts[keep], size[keep], out[keep])]])
        if len(other):  # too long to keep, or another chunk of the same hash
            out[other] = self._add(data, low[:0], starts[other], size[other])
        return out

    def _same(self, low, starts, size, at) -> np.ndarray:
        """Which chunks have the bytes of the entries."""
        same = size == self.size[at]
        total = np.cumsum(size)
        i = 0
        while i < len(size):
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + SLICE, "right")))
            n = np.where(same[i:j], size[i:j], 0)
            full = np.flatnonzero(n)
            if len(full):
                n = n[full]
                equal = low[ragged(n, starts[i:j][full])] == self.raw[ragged(n, self.raw_at[at[i:j][full]])]
                same[i + full] &= np.logical_and.reduceat(equal, np.cumsum(n) - n)
            i = j
        return same

    def _add(self, data, low, starts, size) -> np.ndarray:
        """New entries for chunks; without ``low`` their bytes are not kept."""
        raw = data.tobytes()
        ids, n = self.encode_new([raw[a : a + k].decode("utf-8", "replace") for a, k in zip(starts.tolist(), size.tolist(), strict=True)])
        have, now = self.have, self.have + len(starts)
        keep = size if len(low) else np.zeros(len(size), np.int64)
        own = low[ragged(keep, starts)]
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while self.filled + len(own) > len(self.raw):
            self.raw = np.concatenate([self.raw, np.empty_like(self.raw)])
        while now > len(self.begin):
            self.begin, self.count, self.raw_at, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.count, self.raw_at, self.size))
        self.flat[self.used : self.used + len(ids)] = ids
        self.raw[self.filled : self.filled + len(own)] = own
        self.count[have:now], self.begin[have:now] = n, self.used + np.cumsum(n) - n
        self.size[have:now], self.raw_at[have:now] = keep, self.filled + np.cumsum(keep) - keep
        self.used, self.have, self.filled = self.used + len(ids), now, self.filled + len(own)
        return np.arange(have, now)

    def _name(self, hashes, at) -> None:
        self.young.update(zip(hashes.tolist(), at.tolist(), strict=True))
        if len(self.young) > YOUNG:
            keys = np.concatenate([self.old, np.fromiter(self.young, np.uint64, len(self.young))])
            order = np.argsort(keys, kind="stable")
            self.old, self.old_at = keys[order], np.concatenate([self.old_at, np.fromiter(self.young.values(), np.int64, len(self.young))])[order]
            self.young = {}

    def encode(self, data, off) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows in one array, and the number of ids of each row."""
        starts, ends, words = chunk_bounds(data, off)
        at = self.lookup(data, starts, ends)
        n = self.count[at]
        ids = self.flat[ragged(n, self.begin[at])]
        ends_w = np.cumsum(words)
        total = np.concatenate([[0], np.cumsum(n)])
        return ids, total[ends_w] - total[ends_w - words]


def odd_rows(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows that hold "<|", which may begin a special token: they take the slow path."""
    hit = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124)) if len(data) > 1 else np.empty(0, np.int64)
    return np.unique(np.searchsorted(off, hit, "right") - 1)


def encode_rows(cache: ChunkCache, whole, data: np.ndarray, off: np.ndarray):
    """(ids, counts) of every row; ``whole`` encodes a text that may hold special tokens."""
    ids, counts = cache.encode(data, off)
    odd = odd_rows(data, off)
    if len(odd):
        parts, at = [], np.concatenate([[0], np.cumsum(counts)])
        prev = 0
        for r in odd:
            own = whole(data[off[r] : off[r + 1]].tobytes().decode("utf-8", "replace"))
            parts += [ids[at[prev] : at[r]], np.asarray(own, np.int32)]
            counts[r] = len(own)
            prev = r + 1
        ids = np.concatenate([*parts, ids[at[prev] :]])
    return ids, counts


def by_pieces(bpe: WordBpe, chunks: list[str], merge) -> tuple[np.ndarray, np.ndarray]:
    """Ids of chunks and their number by chunk; ``merge`` gets each distinct word once."""
    words: dict[bytes, int] = {}
    per, many = [], np.ones(len(chunks), np.int64)
    for i, c in enumerate(chunks):
        if c.isascii() and c.isalpha():
            per.append(words.setdefault(c.lower().encode(), len(words)))
            continue
        own = bpe.pieces(c)
        many[i] = len(own)
        per += [words.setdefault(p, len(words)) for p in own]
    if not words:
        return np.empty(0, np.int32), many
    ids, n = merge(list(words))
    per = np.array(per, np.int64)
    begins = np.cumsum(n) - n
    total = np.concatenate([[0], np.cumsum(n[per])])
    ends = np.cumsum(many)
    return ids[ragged(n[per], begins[per])], total[ends] - total[ends - many]


_state: dict[str, tuple] = {}


def _codec(path: str):
    """The worker's vocabulary and cache; kept between tasks, unless one gives them back."""
    if path not in _state:
        bpe = WordBpe(path)

        _state[path] = (bpe, ChunkCache(lambda chunks: by_pieces(bpe, chunks, bpe.merge_many)), np.array([bpe.tokens.get(i, "") for i in range(max(bpe.tokens) + 1)], object))
    return _state[path]


def encode(df, path: str, id_col: str = "doc_id", text_col: str = "text"):
    """One row per input row: the id column and ``ids array<int>``."""

    def run(batches):
        bpe, cache, _ = _codec(path)
        for batch, data, off in slices(batches, 1, 1 << 20):
            ids, n = encode_rows(cache, bpe.encode_text, data, off)
            offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids))], ["id", "ids"])

    out = df.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text").mapInArrow(lean(run), f"id {dict(df.dtypes)[id_col]}, ids array<int>")
    return out.withColumnRenamed("id", id_col)


def decode(df, path: str, id_col: str = "doc_id", ids_col: str = "ids"):
    """One row per input row: the id column and the decoded ``text``."""

    def run(batches):
        bpe, _, names = _codec(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([" ".join(names[x].tolist()) if (x := np.asarray(v or [], np.int64)).size else "" for v in batch.column(1).to_pylist()], pa.string())], ["id", "text"])

    out = df.selectExpr(f"`{id_col}` as id", f"`{ids_col}` as ids").mapInArrow(run, f"id {dict(df.dtypes)[id_col]}, text string")
    return out.withColumnRenamed("id", id_col)


def digests(df, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, keep: bool = True):
    """Encode, decode and return n_tokens, ids_sha256, decoded_sha256 (and ids) of each row.

    Without ``keep`` a worker gives its vocabulary and cache back when a task ends, as
    the steps that follow need the memory.
    """

    def run(batches):
        try:
            yield from rows(batches)
        finally:
            if not keep:
                _state.pop(path, None)

    def rows(batches):
        bpe, cache, names = _codec(path)
        for batch, data, off in slices(batches, 1, 1 << 20):
            ids, n = encode_rows(cache, bpe.encode_text, data, off)
            raw, tokens = memoryview(ids.astype("<u4").tobytes()), names[ids].tolist()
            at = np.concatenate([[0], np.cumsum(n)]).tolist()
            a = [hashlib.sha256(raw[4 * i : 4 * j]).hexdigest() for i, j in zip(at, at[1:], strict=False)]
            b = [hashlib.sha256(" ".join(tokens[i:j]).encode()).hexdigest() for i, j in zip(at, at[1:], strict=False)]
            more = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))] if with_ids else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b), *more], names_out)

    names_out = ["id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
    schema = f"id {dict(df.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    out = df.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text").mapInArrow(lean(run), schema)
    return out.withColumnRenamed("id", id_col)
