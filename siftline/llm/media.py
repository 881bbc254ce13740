"""Media columns: lossless 8-bit greyscale PNG in binary columns, and cosine-transform hashes.

``encode_png`` and ``decode_png`` speak the PNG format: signature, IHDR, IDAT and IEND chunks with their
CRC-32, a zlib stream, and the five row filters. Rows are filtered and unfiltered with numpy.
``cosine_hash`` reduces the samples to a small grid, takes the low frequencies of its cosine
transform, and compares each with their median: 64 bits.

Defined cases: a null or empty text gives one row of samples of value 255. Only ``text`` counts;
rows that repeat give equal values; extra columns are ignored. A damaged PNG raises ``ValueError``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import fields
from .memory import trim

WIDTH = 576
FILL = 255
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHUNK = 1 << 20
GRID, LOW = 32, 8


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def filtered(samples: np.ndarray) -> np.ndarray:
    """Rows with their filter byte: of none, left and above, whichever leaves the smallest signed sum."""
    left = samples.copy()
    left[:, 1:] -= samples[:, :-1]
    above = samples.copy()
    above[1:] -= samples[:-1]
    cost = np.stack([np.abs(x.view(np.int8).astype(np.int16)).sum(axis=1, dtype=np.int64) for x in (samples, left, above)])
    kind = cost.argmin(axis=0)
    out = np.empty((samples.shape[0], samples.shape[1] + 1), np.uint8)
    out[:, 0] = kind
    for k, x in enumerate((samples, left, above)):
        out[kind == k, 1:] = x[kind == k]
    return out


def unfiltered(rows: np.ndarray) -> np.ndarray:
    """Samples of filtered rows; all five filters of the format for one byte a sample."""
    kinds, out = rows[:, 0], rows[:, 1:].copy()
    zero = np.zeros(out.shape[1], np.uint8)
    sub = kinds == 1
    out[sub] = np.cumsum(out[sub], axis=1, dtype=np.uint8)
    for y in np.flatnonzero(kinds >= 2):
        above = out[y - 1] if y else zero
        if kinds[y] == 2:
            out[y] += above
        elif kinds[y] in (3, 4):
            left = corner = 0
            for x in range(out.shape[1]):
                up = int(above[x])
                if kinds[y] == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    near = (abs(p - left), abs(p - up), abs(p - corner))
                    guess = left if near[0] <= near[1] and near[0] <= near[2] else up if near[1] <= near[2] else corner
                left, corner = (int(out[y, x]) + guess) & 255, up
                out[y, x] = left
        else:
            raise ValueError(f"row filter {kinds[y]}")
    return out


def encode_png(payload: bytes, width: int = WIDTH, level: int = 1) -> bytes:
    """A PNG whose samples are ``payload``; its length is a positive multiple of ``width``."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, width)
    body = zlib.compress(filtered(samples).tobytes(), level)
    head = struct.pack(">IIBBBBB", width, samples.shape[0], 8, 0, 0, 0, 0)
    data = b"".join(_chunk(b"IDAT", body[k : k + CHUNK]) for k in range(0, len(body), CHUNK))
    return SIGNATURE + _chunk(b"IHDR", head) + data + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> np.ndarray:
    """The samples of an 8-bit greyscale PNG; ``ValueError`` if a checksum or length is wrong."""
    if media[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, size, body, ended = 8, None, [], False
    while at < len(media):
        if at + 12 > len(media):
            raise ValueError("cut off")
        (n,), kind = struct.unpack(">I", media[at : at + 4]), media[at + 4 : at + 8]
        data, crc = media[at + 8 : at + 8 + n], media[at + 8 + n : at + 12 + n]
        if len(data) != n or len(crc) != 4 or struct.unpack(">I", crc)[0] != zlib.crc32(data, zlib.crc32(kind)):
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            *size, depth, colour, method, filters, interlace = struct.unpack(">IIBBBBB", data)
            if (depth, colour, method, filters, interlace) != (8, 0, 0, 0, 0):
                raise ValueError("not plain 8-bit greyscale")
        elif kind == b"IDAT":
            body.append(data)
        elif kind == b"IEND":
            ended = True
            break
        elif not kind[0] & 32:
            raise ValueError(f"unknown critical chunk {kind!r}")
        at += 12 + n
    if not size or not ended:
        raise ValueError("cut off")
    try:
        rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    except zlib.error as e:
        raise ValueError("zlib stream") from e
    if len(rows) != size[1] * (size[0] + 1):
        raise ValueError("number of samples")
    return unfiltered(rows.reshape(size[1], size[0] + 1))


def _cosines(n: int, k: int) -> np.ndarray:
    return np.cos(np.pi / n * np.outer(np.arange(k), np.arange(n) + 0.5))


_COS = _cosines(GRID, LOW)


def cosine_hash(samples: np.ndarray) -> str:
    """64 bits in hexadecimal: which low frequencies of a GRID x GRID reduction exceed their median."""

    def shrink(x: np.ndarray) -> np.ndarray:
        """Means over GRID runs of rows; a short input repeats rows."""
        n = len(x)
        if n <= GRID:
            return x[np.arange(GRID) * n // GRID].astype(np.float64)
        cut = np.arange(GRID) * n // GRID
        return np.add.reduceat(x, cut, axis=0, dtype=np.float64) / np.diff(np.append(cut, n))[:, None]

    grid = shrink(shrink(samples).T).T
    low = np.round(_COS @ grid @ _COS.T, 6)  # frequencies that are not there are zeros, whatever the order of additions
    return np.packbits((low > np.median(low)).ravel()).tobytes().hex()


def with_media(df: DataFrame, text: str = "text", width: int = WIDTH, level: int = 1) -> DataFrame:
    """``df`` with a binary column ``media``: its text's bytes, filled up to whole rows, as a PNG."""

    @F.pandas_udf("binary")
    def encode(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: encode_png(padded((t or "").encode()), width, level))

    return df.withColumn("media", encode(F.col(text)))


def padded(data: bytes, width: int = WIDTH) -> bytes:
    """``data`` with bytes 255 up to a positive multiple of ``width``."""
    return data + bytes([FILL]) * (max(1, -(-len(data) // width)) * width - len(data))


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


@F.pandas_udf(fields(FEATURES))
def read_back(media: pd.Series) -> pd.DataFrame:
    """What each stored PNG gives when it is read."""
    out = []
    for stored in media:
        samples = decode_png(stored)
        payload = samples.tobytes()
        out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), cosine_hash(samples)))
    trim()
    return pd.DataFrame(out, columns=[c.split()[0] for c in FEATURES.split(", ")])


def features(df: DataFrame, text: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, and the features of its stored PNG."""
    stored = with_media(df.select("doc_id", text), text)
    seen = stored.select("doc_id", F.octet_length(F.coalesce(text, F.lit(""))).cast("long").alias("n_bytes"), read_back("media").alias("m"))
    return seen.select("doc_id", "n_bytes", "m.*")
