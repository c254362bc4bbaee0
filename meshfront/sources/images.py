"""Maps as colored pixels and PNG files."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshfront.functions.physics import normalized
from meshfront.operators.raster import color_limits, pixel_counts

#: Color scales by a few anchors, red, green and blue in 0..1, evenly spaced; colors between them are interpolated.
SCALES = {
    "night": ((0.05, 0.05, 0.25), (0.10, 0.40, 0.50), (0.30, 0.70, 0.40), (0.95, 0.90, 0.30)),
    "ember": ((0.05, 0.00, 0.10), (0.55, 0.05, 0.35), (0.95, 0.45, 0.10), (1.00, 0.95, 0.75)),
    "split": ((0.15, 0.25, 0.65), (0.60, 0.80, 0.95), (1.00, 1.00, 0.80), (0.95, 0.55, 0.35), (0.65, 0.05, 0.15)),
}


def _channel(unit: Column, anchors: list[float]) -> Column:
    steps = len(anchors) - 1
    at = F.least(F.floor(unit * steps), F.lit(steps - 1))
    table = F.array(*map(F.lit, anchors))
    low, high = F.get(table, at.cast("int")), F.get(table, (at + 1).cast("int"))
    return low + (high - low) * (unit * steps - at)


def colored(raster: DataFrame, scale: str = "night", low: float | None = None, high: float | None = None, log: bool = False, stretch: float = 1.0, bad=(0.0, 0.0, 0.0, 0.0)) -> DataFrame:
    """``(iy, ix, r, g, b, a)``. The limits (of log10 with ``log``) are the map's own by default; pixels without a finite value get ``bad``."""
    own = color_limits(raster, log) if low is None or high is None else None
    low, high = low if low is not None else (own or (0.0, 1.0))[0], high if high is not None else (own or (0.0, 1.0))[1]
    unit = normalized("value", low, high, log, stretch)
    channels = [*zip(*SCALES[scale], strict=True)]
    rgb = [F.coalesce(_channel(F.col("_unit"), list(c)), F.lit(bad[k])).alias(n) for k, (n, c) in enumerate(zip("rgb", channels, strict=True))]
    return raster.withColumn("_unit", unit).select("iy", "ix", *rgb, F.when(F.col("_unit").isNull(), bad[3]).otherwise(1.0).alias("a"))


def save_png(path: str, colors: DataFrame, bins, bad=(0.0, 0.0, 0.0, 0.0)) -> str:
    """An RGBA file, row 0 at the bottom. The map's size, not the data's, bounds what the driver gets."""
    ny, nx = pixel_counts(bins)
    image = np.broadcast_to(np.array(bad), (ny, nx, 4)).copy()
    t = colors.select("iy", "ix", "r", "g", "b", "a").toArrow()
    image[t["iy"].to_numpy(), t["ix"].to_numpy()] = np.stack([t[c].to_numpy() for c in "rgba"], axis=1)
    pixels = np.rint(image[::-1] * 255).astype(np.uint8)
    rows = np.concatenate([np.zeros((ny, 1), np.uint8), pixels.reshape(ny, nx * 4)], axis=1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", nx, ny, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b""))
    return path
