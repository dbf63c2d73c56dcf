"""Operator 9: binary media columns. Payloads are stored as PNG and hashed from what is read back."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import map_rows

SIGNATURE = b"\x89PNG\r\n\x1a\n"
SIDE = 24
TILE = SIDE * SIDE


class DamagedPng(ValueError):
    """The bytes are not a whole, unaltered 8-bit greyscale PNG."""


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _filtered(rows: np.ndarray) -> np.ndarray:
    """Rows behind their filter type: of None, Sub and Up the one with the least sum of absolute differences."""
    left, above = np.zeros_like(rows), np.zeros_like(rows)
    left[:, 1:], above[1:] = rows[:, :-1], rows[:-1]
    forms = np.stack([rows, rows - left, rows - above])
    kind = np.abs(forms.view(np.int8).astype(np.int32)).sum(axis=2).argmin(axis=0)
    return np.hstack([kind.astype(np.uint8)[:, None], np.take_along_axis(forms, kind[None, :, None], axis=0)[0]])


def encode_png(payload: bytes, width: int = SIDE, level: int = 6) -> bytes:
    """``payload`` (a positive multiple of ``width``) as an 8-bit greyscale PNG.

    Rows take filter None, which suits text; where that hardly deflates, each row's best filter is
    tried and the smaller form kept.
    """
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    packed = zlib.compress(np.hstack([np.zeros((len(rows), 1), np.uint8), rows]).tobytes(), level)
    if len(packed) > 0.9 * len(payload):
        packed = min(packed, zlib.compress(_filtered(rows).tobytes(), level), key=len)
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", packed) + _chunk(b"IEND", b"")


def _chunks(data: bytes):
    if data[:8] != SIGNATURE:
        raise DamagedPng("no PNG signature")
    at = 8
    while at < len(data):
        if at + 12 > len(data):
            raise DamagedPng("a chunk is cut off")
        (size,) = struct.unpack_from(">I", data, at)
        kind, body, crc = data[at + 4 : at + 8], data[at + 8 : at + 8 + size], data[at + 8 + size : at + 12 + size]
        if len(crc) < 4 or struct.unpack(">I", crc)[0] != zlib.crc32(kind + body):
            raise DamagedPng(f"checksum of {kind!r} fails")
        yield kind, body
        at += 12 + size


def unfilter(lines: np.ndarray) -> np.ndarray:
    """Undo the five row filters. Runs of None and of Up rows, and each Sub row, go as whole arrays."""
    kinds, raw = lines[:, 0], lines[:, 1:]
    if kinds.size and kinds.max() > 4:
        raise DamagedPng("unknown filter")
    out = raw.copy()
    sub = kinds == 1
    out[sub] = np.cumsum(raw[sub], axis=1, dtype=np.uint8)
    edges = np.flatnonzero(np.diff(kinds)) + 1
    for lo, hi in zip(np.r_[0, edges], np.r_[edges, len(kinds)]):
        if hi <= lo or kinds[lo] in (0, 1):
            continue
        before = out[lo - 1] if lo else np.zeros(raw.shape[1], np.uint8)
        if kinds[lo] == 2:
            out[lo:hi] = np.cumsum(np.vstack([before, raw[lo:hi]]), axis=0, dtype=np.uint8)[1:]
            continue
        for r in range(lo, hi):
            up, row, a, c = before.tolist(), raw[r].tolist(), 0, 0
            for i, b in enumerate(up):
                if kinds[lo] == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    near = sorted((abs(p - v), k) for k, v in enumerate((a, b, c)))[0][1]
                    guess = (a, b, c)[near]
                a, c = (row[i] + guess) & 255, b
                row[i] = a
            out[r] = before = np.array(row, np.uint8)
    return out


def decode_png(data: bytes) -> np.ndarray:
    """The samples of an 8-bit greyscale PNG; every chunk's checksum is tested."""
    head, packed, ended = None, [], False
    for kind, body in _chunks(data):
        if kind == b"IHDR":
            if len(body) != 13:
                raise DamagedPng("the header is no header")
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            ended = True
    if not head or not ended or head[2:] != (8, 0, 0, 0, 0):
        raise DamagedPng("not a whole 8-bit greyscale PNG")
    if not head[0] or not head[1]:
        raise DamagedPng("the image is empty")
    size, stream = head[1] * (head[0] + 1), zlib.decompressobj()
    try:
        flat = np.frombuffer(stream.decompress(b"".join(packed), size + 1), np.uint8)
    except zlib.error as e:
        raise DamagedPng(str(e)) from e
    if flat.size != size or not stream.eof and stream.decompress(stream.unconsumed_tail, 1) + stream.flush(1):
        raise DamagedPng("the samples do not fill the image")
    return unfilter(flat.reshape(head[1], head[0] + 1))


def _cosines(n: int = SIDE, k: int = 8) -> np.ndarray:
    return np.cos(np.pi / n * (np.arange(n) + 0.5) * np.arange(k)[:, None])


def _cells(x: np.ndarray, axis: int) -> np.ndarray:
    """Means over ``SIDE`` stretches of equal length along an axis; a sample on a border counts for both by its share."""
    n = x.shape[axis]
    if n == SIDE:
        return x
    sums = np.concatenate((np.zeros_like(np.take(x, [0], axis)), np.cumsum(x, axis=axis)), axis=axis)
    at = np.arange(SIDE + 1) * n / SIDE
    low = np.minimum(at.astype(int), n - 1)
    shape = [1, 1]
    shape[axis] = -1
    upto = np.take(sums, low, axis) + (at - low).reshape(shape) * np.take(x, low, axis)
    return np.diff(upto, axis=axis) * (SIDE / n)


def cosine_hash(samples: np.ndarray) -> str:
    """64 bits in hex: the sign against their median of the 8 x 8 lowest frequencies.

    An image of any size is averaged into ``SIDE`` x ``SIDE`` cells of equal area before the transform.
    Frequencies are rounded first, so that a flat image has no bits rather than those of rounding.
    """
    bands = _cells(samples.astype(np.float64), 0)
    bands = _cells(bands, 1)
    c = _cosines()
    low = np.round(c @ bands @ c.T, 4).ravel()
    low[0] = 0.0  # brightness carries no shape
    bits = low > np.median(low)
    return np.packbits(bits).tobytes().hex()


def pad(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\xff" * (TILE - len(raw) if len(raw) < TILE else -len(raw) % TILE)


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: int = 6) -> DataFrame:
    """Each text as a PNG in a binary column: ``doc_id, n_bytes, media``.

    A null or empty text is one tile of padding. Rows are independent, so nulls in the id,
    repeated rows and empty tables pass through, and other columns are not read.
    """

    def encode(ids: list, texts: list) -> list:
        both = [pad(t) for t in texts]
        return [ids, [n for n, _ in both], [encode_png(p, level=level) for _, p in both]]

    return map_rows(df, [id_col, text_col], encode, f"doc_id {df.schema[id_col].dataType.simpleString()}, n_bytes long, media binary")


def describe(media: DataFrame) -> DataFrame:
    """Decode the stored bytes of :func:`store` and digest what is read back.

    A damaged image, an empty one or a null has null digests and the reason in ``damage``, which is null
    for whole images. Null ids and repeated rows pass through; an empty table gives no rows.
    """

    def read(ids: list, sizes: list, images: list) -> list:
        rows = []
        for n, png in zip(sizes, images):
            try:
                samples = decode_png(png or b"")
            except DamagedPng as e:
                rows.append((None,) * 6 + (str(e),))
                continue
            payload = samples.tobytes()
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(png), hashlib.sha256(png).hexdigest(), cosine_hash(samples), None))
        return [ids, sizes, *([r[i] for r in rows] for i in range(7))]

    kind = media.schema["doc_id"].dataType.simpleString()
    return map_rows(media, ["doc_id", "n_bytes", "media"], read, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, damage string")


def near(feature_a: Column, feature_b: Column) -> Column:
    """Bits in which two cosine hashes differ, as a native expression."""
    halves = [(F.conv(F.substring(f, 1, 8), 16, 10).cast("long"), F.conv(F.substring(f, 9, 8), 16, 10).cast("long")) for f in (feature_a, feature_b)]
    return sum((F.bit_count(a.bitwiseXOR(b)) for a, b in zip(*halves)), F.lit(0))
