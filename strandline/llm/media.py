"""Media columns: Netpbm and BMP to numpy, area resize, NPY tiles, difference hashes.

Media are bytes in a binary column.  ``decode_image`` reads Netpbm (P1 to P6) and
uncompressed BMP (8, 24, 32 bits); samples of
another maximum than 255 or 65,535 are scaled to it.  ``area_resize`` averages each target cell
over the exact area that it covers, by an integral image that is built from a
bounded number of rows at a time.  ``tiles`` writes the resized image as NPY
bytes with its difference hash.  ``store_texts`` keeps any text losslessly as an
8-bit image, and ``text_digests`` reads it back.

Behaviour on odd input: a null or empty text becomes one row of 64 blank pixels;
equal texts give equal values; media that cannot be decoded raise ValueError in
``decode_image`` and give null tiles in ``tiles``; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import re
import zlib

import numpy as np
import pyarrow as pa

from .shared import lean, settle
from .textkit import slices

#: Pixels in a row of an image that keeps a text; three bytes each.
ROW = 64
UNIT = 3 * ROW
#: Rows of an image that go into the integral image at a time.
BAND = 4096


def encode_ppm(pixels: bytes, row: int = ROW) -> bytes:
    return b"P6\n%d %d\n255\n" % (row, len(pixels) // (3 * row)) + pixels


def _netpbm_head(raw: bytes, n: int) -> tuple[list[int], int]:
    """``n`` header numbers after the magic, and where the raster begins."""
    out, at = [], 2
    while len(out) < n:
        m = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)").match(raw, at)
        if not m:
            raise ValueError("netpbm header")
        out.append(int(m[1]))
        at = m.end()
    return out, at + 1


def decode_netpbm(raw: bytes) -> np.ndarray:
    """uint8 or uint16 array of shape (height, width, channels)."""
    kind = raw[1:2]
    if raw[:1] != b"P" or kind not in b"123456" or not kind:
        raise ValueError("not a netpbm image")
    (w, h, *top), at = _netpbm_head(raw, 2 if kind in b"14" else 3)
    channels = 3 if kind in b"36" else 1
    n = w * h * channels
    if kind == b"4":
        bits = np.unpackbits(np.frombuffer(raw, np.uint8, h * ((w + 7) // 8), at).reshape(h, -1), axis=1)[:, :w]
        return ((1 - bits) * 255).astype(np.uint8).reshape(h, w, 1)
    if kind == b"1":
        bits = np.array([c == 49 for c in raw[at - 1 :] if c in (48, 49)][:n], np.uint8)
        return ((1 - bits) * 255).reshape(h, w, 1)
    wide = top[0] > 255
    if kind in b"23":
        flat = np.array(raw[at - 1 :].split()[:n], np.int64)
        if len(flat) != n:
            raise ValueError("netpbm raster is short")
        return _scaled(flat, top[0], wide).reshape(h, w, channels)
    if len(raw) - at < n * (1 + wide):
        raise ValueError("netpbm raster is short")
    return _scaled(np.frombuffer(raw, ">u2" if wide else np.uint8, n, at), top[0], wide).reshape(h, w, channels)


def _scaled(flat: np.ndarray, top: int, wide: bool) -> np.ndarray:
    """Samples of 0 to ``top`` as whole 8- or 16-bit values."""
    full, kind = (65535, np.uint16) if wide else (255, np.uint8)
    if not 0 < top <= full or (len(flat) and (flat.max() > top or flat.min() < 0)):
        raise ValueError("netpbm sample")
    return flat.astype(kind, copy=False) if top == full else np.rint(flat * (full / top)).astype(kind)


def decode_bmp(raw: bytes) -> np.ndarray:
    """uint8 array (height, width, channels), red first, top row first."""
    if raw[:2] != b"BM" or len(raw) < 54:
        raise ValueError("not a bitmap")
    number = lambda at, n, signed=False: int.from_bytes(raw[at : at + n], "little", signed=signed)
    at, head, w, h, bits, packing = number(10, 4), number(14, 4), number(18, 4, True), number(22, 4, True), number(28, 2), number(30, 4)
    if packing not in (0, 3) or bits not in (8, 24, 32):
        raise ValueError("bitmap of an unknown kind")
    if packing == 3 and (bits != 32 or [number(k, 4) for k in (54, 58, 62)] != [0xFF0000, 0xFF00, 0xFF]):
        raise ValueError("bitmap with other masks than those of plain colours")
    stride = (w * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(raw, np.uint8, stride * abs(h), at).reshape(abs(h), stride)[:, : w * bits // 8]
    rows = rows[::-1] if h > 0 else rows
    if bits == 8:
        palette = np.frombuffer(raw, np.uint8, 4 * (number(46, 4) or 256), 14 + head).reshape(-1, 4)
        return np.ascontiguousarray(palette[rows][:, :, 2::-1])
    return np.ascontiguousarray(rows.reshape(abs(h), w, bits // 8)[:, :, 2::-1])


def decode_image(raw: bytes) -> np.ndarray:
    try:
        return decode_bmp(raw) if raw[:2] == b"BM" else decode_netpbm(raw)
    except (IndexError, OverflowError, MemoryError) as e:
        raise ValueError("broken image") from e


def _cuts(n: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the cells' edges fall: whole part and fraction."""
    edge = np.arange(cells + 1) * (n / cells)
    whole = np.minimum(edge.astype(np.int64), n)
    return whole, edge - whole


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over the exact areas of ``height`` by ``width`` cells, as float64.

    The integral image is summed along rows for BAND rows at a time; its last
    row is carried on, and only its values at the cells' edges are kept.
    """
    if image.ndim == 2:
        image = image[:, :, None]
    h, w, c = image.shape
    if not h or not w:
        return np.zeros((height, width, c))
    xi, xf = _cuts(w, width)
    yi, yf = _cuts(h, height)
    carry = np.zeros((width + 1, c))
    at_edge = np.zeros((height + 1, width + 1, c))
    want = np.unique(np.concatenate([yi, np.minimum(yi + 1, h)]))
    kept = {0: carry}
    for a in range(0, h, BAND):
        band = np.zeros((min(BAND, h - a), w + 1, c))
        np.cumsum(image[a : a + BAND], axis=1, out=band[:, 1:], dtype=np.float64)
        sums = band[:, xi] + (band[:, np.minimum(xi + 1, w)] - band[:, xi]) * xf[None, :, None]
        sums = np.cumsum(sums, axis=0) + carry
        for y in want[(want > a) & (want <= a + len(sums))]:
            kept[int(y)] = sums[y - a - 1]
        carry = sums[-1]
    for i, (y, f) in enumerate(zip(yi.tolist(), yf.tolist(), strict=True)):
        low = kept[y]
        at_edge[i] = low + (kept[min(y + 1, h)] - low) * f
    cells = at_edge[1:, 1:] - at_edge[:-1, 1:] - at_edge[1:, :-1] + at_edge[:-1, :-1]
    return cells / ((h / height) * (w / width))


def gray(image: np.ndarray) -> np.ndarray:
    return image.mean(axis=2) if image.ndim == 3 else image


def difference_hash(image: np.ndarray) -> str:
    """64 bits: is each cell of an 8 by 9 reduction brighter than its right neighbour."""
    small = np.round(gray(area_resize(image, 8, 9)), 6)
    return np.packbits(small[:, :-1] > small[:, 1:]).tobytes().hex()


def npy_bytes(a: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, a, allow_pickle=False)
    return out.getvalue()


def tile(image: np.ndarray, size: int = 16) -> bytes:
    """NPY bytes of the image area-resized to ``size`` by ``size``, uint8."""
    return npy_bytes(np.clip(np.rint(area_resize(image, size, size)), 0, 255).astype(np.uint8))


def tiles(df, id_col: str, media_col: str, size: int = 16):
    """One row per input row: the id column, ``tile`` (NPY bytes) and ``dhash``."""

    def run(batches):
        for batch in batches:
            out = []
            for raw in batch.column(1):
                try:
                    image = decode_image(raw.as_py() or b"")
                    out.append((tile(image, size), difference_hash(image)))
                except ValueError:
                    out.append((None, None))
            a, b = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a, pa.binary()), pa.array(b, pa.string())], ["id", "tile", "dhash"])

    out = df.selectExpr(f"`{id_col}` as id", f"`{media_col}` as media").mapInArrow(run, f"id {dict(df.dtypes)[id_col]}, tile binary, dhash string")
    return out.withColumnRenamed("id", id_col)


def pad(n: int, unit: int = UNIT) -> int:
    """Bytes to a positive multiple of ``unit``."""
    return max(unit, -(-n // unit) * unit)


def store_texts(df, id_col: str = "doc_id", text_col: str = "text"):
    """Each text as a Netpbm image: id column, n_bytes and media.

    The table is written to the shared folder; what is returned reads it back.
    """

    def run(batches):
        for batch, data, off in slices(batches, 1):
            out = [encode_ppm(data[a:b].tobytes().ljust(pad(b - a), b" ")) for a, b in zip(off.tolist(), off[1:].tolist(), strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(off)), pa.array(out, pa.binary())], ["id", "n_bytes", "media"])

    kind = dict(df.dtypes)[id_col]
    rows = df.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text")
    return settle(rows.mapInArrow(lean(run), f"id {kind}, n_bytes long, media binary")).withColumnRenamed("id", id_col)


def text_digests(stored, id_col: str = "doc_id"):
    """What the stored images hold, decoded from their bytes, with the features of what was decoded."""

    def run(batches):
        for batch in batches:
            rows = []
            for raw in batch.column(2):
                media = raw.as_buffer()
                image = decode_netpbm(media.to_pybytes())
                payload = image.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), media.size, hashlib.sha256(media).hexdigest(), difference_hash(image), hashlib.sha256(tile(image)).hexdigest()))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, zip(*rows, strict=True))], names)

    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile_sha256"]
    kind = dict(stored.dtypes)[id_col]
    out = stored.selectExpr(f"`{id_col}` as id", "n_bytes", "media")
    return out.mapInArrow(lean(run), f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_sha256 string").withColumnRenamed("id", id_col)
