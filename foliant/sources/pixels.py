"""Grey pictures and their 16x16 average hashes, without an imaging library on the workers."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.paths import under

_SIDE = 16
#: x and y of the first pixel and the steps of the seven passes of an interlaced PNG.
_ADAM7 = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def grey(rgb: np.ndarray) -> np.ndarray:
    """Luma of red, green and blue bytes in the last axis, rounded as imaging libraries do."""
    r, g, b = (rgb[..., i].astype(np.uint32) for i in range(3))
    return ((r * 19595 + g * 38470 + b * 7471 + 0x8000) >> 16).astype(np.uint8)


def _weights(n: int, to: int = _SIDE) -> np.ndarray:
    """n x `to` weights of the triangle filter, widened when it shrinks, in 22-bit fixed point."""
    scale = n / to
    support = max(scale, 1.0)
    out = np.zeros((n, to))
    for i in range(to):
        centre = (i + 0.5) * scale
        lo, hi = max(0, int(centre - support + 0.5)), min(n, int(centre + support + 0.5))
        k = np.maximum(0, 1 - np.abs((np.arange(lo, hi) - centre + 0.5) / support))
        out[lo:hi, i] = np.floor(k / k.sum() * (1 << 22) + 0.5)
    return out


def resized(g: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bytes (height x width) brought to another size by the triangle filter, across first, each step rounded to bytes; as doubles."""
    shrink = lambda x: np.clip((x + (1 << 21)) // (1 << 22), 0, 255)  # noqa: E731  (sums stay below 2**53, so they are exact)
    across = _weights(g.shape[1], width)
    rows = np.concatenate([shrink(g[a : a + 512].astype(np.float64) @ across) for a in range(0, len(g), 512)])
    return shrink(_weights(g.shape[0], height).T @ rows)


def average_hash(g: np.ndarray) -> bytes:
    """256-bit average hash of grey bytes (height x width), shrunk to 16x16."""
    small = resized(g, _SIDE, _SIDE).ravel()
    return np.packbits(small >= small.sum() / _SIDE**2).tobytes()


#: Means and deviations of red, green and blue by which pixels are normalised, and how much larger than the crop the shorter side is made.
MEANS, DEVIATIONS, MARGIN = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225), 1.14


def model_input(rgb: np.ndarray, size: int = 224) -> np.ndarray:
    """Floats (3 x size x size) that a model takes of bytes (height x width x 3): the shorter side resized to size * MARGIN, the centre cut out, scaled to 0..1 and normalised."""
    h, w = rgb.shape[:2]
    short = int(size * MARGIN)
    to = (short, int(short * w / h)) if h <= w else (int(short * h / w), short)
    top, left = (round((n - size) / 2) for n in to)
    planes = [resized(rgb[..., c], *to)[top : top + size, left : left + size] for c in range(3)]
    return np.stack([(p / 255 - m) / d for p, m, d in zip(planes, MEANS, DEVIATIONS)]).astype(np.float32)


def _unfilter(raw: np.ndarray, kinds: np.ndarray, step: int) -> np.ndarray:
    """Bytes of PNG lines without their filters. Diagonals are worked on at once, as a pixel needs those left of and above it."""
    h, w = raw.shape[0], raw.shape[1] // step
    raw = raw.reshape(h, w, step)
    out = np.zeros((h + 1, w + 1, step), np.int16)
    if kinds.max(initial=0) > 4:
        raise ValueError("damaged PNG line")
    for t in range(h + w - 1):
        y = np.arange(max(0, t - w + 1), min(h, t + 1))
        x = t - y
        a, b, c, k = out[y + 1, x], out[y, x + 1], out[y, x], kinds[y, None]
        pa, pb, pc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
        paeth = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))
        guess = np.choose(k, [np.int16(0), a, b, (a + b) >> 1, paeth])
        out[y + 1, x + 1] = (raw[y, x] + guess) & 255
    return out[1:, 1:].astype(np.uint8).reshape(h, -1)


def png_grey(data: bytes) -> np.ndarray:
    """Grey bytes (height x width) of a PNG of any colour type, depth and interlacing; transparency is left aside."""
    at, palette, pixels = 8, None, []
    while at + 12 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            width, height, depth, colour, _, _, laced = struct.unpack(">IIBBBBB", body[:13])
        elif kind == b"PLTE":
            palette = grey(np.frombuffer(body, np.uint8).reshape(-1, 3))
        elif kind == b"IDAT":
            pixels.append(body)
        elif kind == b"IEND":
            break
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(pixels)), np.uint8)
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    out, at = np.zeros((height, width), np.uint8), 0
    for x0, y0, dx, dy in _ADAM7 if laced else ((0, 0, 1, 1),):
        w, h = -(-(width - x0) // dx), -(-(height - y0) // dy)
        if w <= 0 or h <= 0:
            continue
        line = -(-w * channels * depth // 8)
        part = raw[at : at + h * (line + 1)]
        if len(part) < h * (line + 1):
            raise ValueError("PNG has too few pixels")
        part = part.reshape(h, line + 1)
        at += part.size
        x = _unfilter(part[:, 1:], part[:, 0], max(1, channels * depth // 8))
        if depth < 8:
            bits = np.unpackbits(x, axis=1).reshape(h, -1, depth)
            x = (bits << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(2, dtype=np.uint8)[:, :w]
            x = x if colour == 3 else x * np.uint8(255 // (2**depth - 1))
        elif depth == 16:
            x = x[:, ::2]
        x = x.reshape(h, w, channels)
        out[y0::dy, x0::dx] = palette[x[..., 0]] if colour == 3 else grey(x) if channels > 2 else x[..., 0]
    return out


def hash_of(data: bytes) -> bytes | None:
    """Average hash of a picture: of a PNG, and of other formats where the worker has Pillow; else null."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return average_hash(png_grey(data))
    try:
        import io

        from PIL import Image
    except ImportError:
        return None
    with Image.open(io.BytesIO(data)) as im:
        return average_hash(np.asarray(im.convert("L")))


def with_hashes(df: DataFrame, root: str, path: str = "path", ahash: str = "ahash") -> DataFrame:
    """df with the hashes that are still null filled by Spark's image source, whose decoder (of JPEG among others) needs nothing on the workers."""
    pictures = df.sparkSession.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "true").load(root)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for h, w, n, data in zip(pdf["height"], pdf["width"], pdf["n"], pdf["data"]):
                x = np.frombuffer(bytes(data), np.uint8).reshape(h, w, n)
                out.append(average_hash(x[..., 0] if n == 1 else grey(x[..., 2::-1])))  # blue comes first
            yield pd.DataFrame({"origin": pdf["origin"], "_hash": pd.Series(out, dtype=object)})

    origin = F.url_decode(F.replace("image.origin", F.lit("+"), F.lit("%2B")))
    rel = under(origin, root).alias("origin")
    found = pictures.select(rel, "image.height", "image.width", F.col("image.nChannels").alias("n"), "image.data")
    found = found.join(df.filter(F.col(ahash).isNull()).select(F.col(path).alias("_open")), F.col("origin") == F.col("_open"), "left_semi")
    found = found.mapInPandas(run, "origin string, _hash binary")
    return df.join(found, F.col(path) == F.col("origin"), "left").withColumn(ahash, F.coalesce(ahash, "_hash")).drop("origin", "_hash")
