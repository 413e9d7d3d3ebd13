"""Token ids in fixed-width binary shards.

Every id takes the smallest number of bits that the vocabulary needs.  A shard
holds blocks of BLOCK ids, each begun on a byte boundary, then an index:

    payload   the packed blocks, one after the other
    starts    int64[n_docs + 1], first id of each document within the shard
    doc_ids   int64[n_docs]
    null      uint8[n_docs], 1 where the document's id is null
    blocks    int64[n_blocks + 1], byte offset of each block
    footer    magic "SLTOK1\\0\\0" and uint64 bits, block, n_docs, n_tokens, n_blocks

A reader finds the blocks of any document from the index and unpacks them with
array operations.  A writer streams blocks, so its memory is bounded by one block
and the index.  A shard gets a name of its own for each attempt of its task;
only the names that the driver hears of are read, so a lost executor or a
speculative copy never leaves a half-written shard in use.

Behaviour on odd input: a null or empty text has the end id alone; rows stand in
ascending order of id, null ids first, rows of one id by text; ids that are not
integers are an error; an empty table has no shard; other columns are ignored.
"""

from __future__ import annotations

import functools
import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import functions as F

from .bpe import ChunkCache, encode_rows
from .shared import dealt, lean, shared_dir
from .textkit import ragged, slices

MAGIC = b"SLTOK1\0\0"
BLOCK = 1 << 16


def width(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as consecutive ``bits``-wide little-endian fields."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    raw = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(raw.ravel(), bitorder="little").tobytes()


def unpack(blob, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(blob, f"<u{bits // 8}", n).astype(np.int64)
    raw = np.unpackbits(np.frombuffer(blob, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    full = np.zeros((n, 32), np.uint8)
    full[:, :bits] = raw
    return np.packbits(full, axis=1, bitorder="little").view("<u4").ravel().astype(np.int64)


def place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


class Writer:
    def __init__(self, uri: str, bits: int, block: int = BLOCK):
        self.bits, self.block = bits, block
        store, path = place(uri)
        self.out = store.open_output_stream(path)
        self.rest = np.empty(0, np.int64)
        self.counts: list[np.ndarray] = []
        self.ids: list[np.ndarray] = []
        self.null: list[np.ndarray] = []
        self.offsets = [0]
        self.n_tokens = 0

    def add(self, doc_ids: np.ndarray, null: np.ndarray, tokens: np.ndarray, counts: np.ndarray) -> None:
        self.ids.append(doc_ids)
        self.null.append(null)
        self.counts.append(counts)
        self.n_tokens += len(tokens)
        rest = np.concatenate([self.rest, tokens])
        whole = len(rest) // self.block * self.block
        for a in range(0, whole, self.block):
            self._put(rest[a : a + self.block])
        self.rest = rest[whole:]

    def _put(self, ids: np.ndarray) -> None:
        self.out.write(raw := pack(ids, self.bits))
        self.offsets.append(self.offsets[-1] + len(raw))

    def close(self) -> tuple[int, int]:
        if len(self.rest):
            self._put(self.rest)
        counts = np.concatenate([[0], *self.counts]).astype("<i8")
        n = len(counts) - 1
        self.out.write(np.cumsum(counts).astype("<i8").tobytes())
        self.out.write(np.concatenate([np.empty(0, np.int64), *self.ids]).astype("<i8").tobytes())
        self.out.write(np.concatenate([np.empty(0, bool), *self.null]).astype(np.uint8).tobytes())
        self.out.write(np.array(self.offsets, "<i8").tobytes())
        self.out.write(MAGIC + np.array([self.bits, self.block, n, self.n_tokens, len(self.offsets) - 1], "<u8").tobytes())
        self.out.close()
        return n, self.n_tokens


class Reader:
    """Random access to the documents of a shard."""

    def __init__(self, uri: str):
        store, path = place(uri)
        self.file = store.open_input_file(path)
        size = self.file.size()
        foot = self.file.read_at(48, size - 48)
        if foot[:8] != MAGIC:
            raise ValueError(f"not a shard: {uri}")
        self.bits, self.block, n, self.n_tokens, nb = map(int, np.frombuffer(foot[8:], "<u8"))
        index = self.file.read_at(size - 48 - (at := size - 48 - 8 * (n + 1) - 9 * n - 8 * (nb + 1)), at)
        self.starts = np.frombuffer(index, "<i8", n + 1)
        self.doc_ids = np.frombuffer(index, "<i8", n, 8 * (n + 1))
        self.null = np.frombuffer(index, np.uint8, n, 8 * (n + 1) + 8 * n).astype(bool)
        self.offsets = np.frombuffer(index, "<i8", nb + 1, 8 * (n + 1) + 9 * n)

    def tokens(self, a: int, b: int) -> np.ndarray:
        """Ids number a to b-1 of the shard."""
        if a >= b:
            return np.empty(0, np.int64)
        first, last = a // self.block, (b - 1) // self.block
        raw = memoryview(self.file.read_at(int(self.offsets[last + 1] - self.offsets[first]), int(self.offsets[first])))
        parts, base = [], int(self.offsets[first])
        for k in range(first, last + 1):
            n = min(self.block, self.n_tokens - k * self.block)
            parts.append(unpack(raw[int(self.offsets[k]) - base : int(self.offsets[k + 1]) - base], self.bits, n))
        return np.concatenate(parts)[a - first * self.block : b - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.tokens(int(self.starts[i]), int(self.starts[i + 1]))


@functools.cache
def _library(path: str):
    """The library's tokenizer on one thread, without truncation and padding, and the cache
    of a worker: texts are cut between words, and every new chunk goes through all of the
    library's steps.  Texts that may hold special tokens go through it whole.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok, ChunkCache(lambda chunks: encode_whole(tok, chunks)), lambda text: encode_whole(tok, [text])[0]


def encode_whole(tok, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts by the library in one array, and their number by text."""
    found = [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
    n = np.fromiter(map(len, found), np.int64, len(found))
    return np.fromiter((x for ids in found for x in ids), np.int32, int(n.sum())), n


def write(df, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", out_uri: str | None = None):
    """Encode all texts and write shards in ascending order of id.

    Returns the table of shards: path, base (ids in all shards before), n_docs,
    n_tokens.  The driver gets one such row for each shard.
    """
    spark = df.sparkSession
    if dict(df.dtypes)[id_col] not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} must hold integers, as shards store them")
    folder = out_uri or shared_dir(spark)
    store, base = place(folder)
    store.create_dir(base, recursive=True)

    def run(batches):
        from pyspark import TaskContext

        tok, cache, whole = _library(path)
        out = None
        for batch, data, off in slices(batches, 1):
            if out is None:
                name = f"{folder}/shard-{TaskContext.get().partitionId():07d}-{uuid.uuid4().hex}.tok"
                out = Writer(name, width(tok.get_vocab_size()))
            ids, n = encode_rows(cache, whole, data, off)
            full = np.full(len(ids) + len(n), end_id, np.int64)
            begins = np.cumsum(n) - n
            full[ragged(n, begins + np.arange(len(n)))] = ids
            keys = batch.column(0)
            null = np.asarray(keys.is_null()) if keys.null_count else np.zeros(len(keys), bool)
            out.add(keys.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), null, full, n + 1)
        if out is not None:
            docs, tokens = out.close()
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "path": [name], "n_docs": [docs], "n_tokens": [tokens]})

    rows = df.selectExpr(f"cast(`{id_col}` as bigint) as id", f"`{text_col}` as text")
    rows = rows.withColumn("head", F.substring("text", 1, 32))  # rows of one id, or without, need not meet in one task
    rows = rows.repartitionByRange(dealt(spark), "id", "head").sortWithinPartitions("id", "text")
    shards = sorted(rows.mapInArrow(lean(run), "part long, path string, n_docs long, n_tokens long").collect())
    out, base_ids = [], 0
    for s in shards:
        out.append((s.path, base_ids, s.n_docs, s.n_tokens))
        base_ids += s.n_tokens
    return spark.createDataFrame(out, "path string, base long, n_docs long, n_tokens long").repartition(max(1, len(out)))


def read(shards, per_doc, fields: str, step: int = 1 << 20):
    """Rows of every document of the shards, read back.

    ``per_doc(ids)`` gives the extra values of a document, named in ``fields``.
    """

    def run(batches):
        for batch in batches:
            for s in batch.to_pylist():
                r = Reader(s["path"])
                i, n = 0, len(r.doc_ids)
                while i < n:
                    j = min(n, max(i + 1, int(np.searchsorted(r.starts, r.starts[i] + step, "right")) - 1))
                    ids, lo = r.tokens(int(r.starts[i]), int(r.starts[j])), int(r.starts[i])
                    cuts = (r.starts[i : j + 1] - lo).tolist()
                    extra = [per_doc(ids[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
                    cols = [pa.array(r.doc_ids[i:j], mask=r.null[i:j]), pa.array(r.starts[i:j] + s["base"]), pa.array(np.diff(r.starts[i : j + 1])), *map(pa.array, zip(*extra, strict=True))]
                    yield pa.RecordBatch.from_arrays(cols, names)
                    i = j

    schema = f"doc_id long, start long, n_tokens long, {fields}"
    names = [f.strip().split()[0] for f in schema.split(",")]
    return shards.mapInArrow(lean(run), schema)


def crc_of_ids(ids: np.ndarray) -> tuple[int]:
    return (zlib.crc32(ids.astype("<u4").tobytes()),)
