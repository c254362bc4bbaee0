"""Colors and PNG files of maps."""

import struct
import zlib

import pytest

from meshfront.sources.images import SCALES, colored, save_png


def test_png(spark, tmp_path):
    raster = spark.createDataFrame([(0, 0, 1.0), (0, 1, 10.0), (1, 1, 100.0), (1, 0, -5.0)], "iy int, ix int, value double")
    colors = colored(raster, "ember", log=True)
    rows = {(r.iy, r.ix): tuple(r)[2:] for r in colors.collect()}
    anchors = SCALES["ember"]
    assert rows[0, 0] == pytest.approx((*anchors[0], 1)) and rows[1, 1] == pytest.approx((*anchors[-1], 1)) and rows[1, 0] == (0, 0, 0, 0)
    assert rows[0, 1] == pytest.approx((*((a + b) / 2 for a, b in zip(anchors[1], anchors[2], strict=True)), 1))
    data = open(save_png(str(tmp_path / "m.png"), colors, (2, 3)), "rb").read()
    assert struct.unpack(">II", data[16:24]) == (3, 2)
    body = zlib.decompress(data[41 : 41 + struct.unpack(">I", data[33:37])[0]])
    pixels = [body[1 + 13 * k : 13 * (k + 1)] for k in range(2)]
    assert pixels[1][:3] == bytes(round(255 * c) for c in anchors[0]) and pixels[0][8:] == bytes(4)
