"""Images as rows of colour and texture features: Spark reads and decodes the files, a small numpy function
in the tasks takes the features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Mean and deviation of each channel, in this order.
COLOUR = tuple(f"{c}_{k}" for space in ("RGB", "HSV", "Lab") for k in ("mean", "sd") for c in space)
TEXTURE = ("glcm_contrast", "glcm_homogeneity", "glcm_energy", "glcm_correlation")

#: Linear sRGB to XYZ (D65), and the white point.
TO_XYZ = np.array([[0.4124564, 0.3575761, 0.1804375], [0.2126729, 0.7151522, 0.0721750], [0.0193339, 0.1191920, 0.9503041]])
WHITE = np.array([0.95047, 1.0, 1.08883])
#: Weights of red, green and blue in a grey value.
GREY = np.array([0.2125, 0.7154, 0.0721])


def crop(image: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """The part between shares (left, top, right, bottom) of the image; a box without area is the whole."""
    h, w = image.shape[:2]
    left, right = sorted(int(round(min(1.0, max(0.0, v)) * w)) for v in (box[0], box[2]))
    top, bottom = sorted(int(round(min(1.0, max(0.0, v)) * h)) for v in (box[1], box[3]))
    return image[top:bottom, left:right] if right > left and bottom > top else image


def to_hsv(rgb: np.ndarray) -> np.ndarray:
    """Hue, saturation and value, all in [0, 1]; grey has hue 0."""
    top = rgb.max(-1)
    span = top - rgb.min(-1)
    some = np.where(span > 1e-12, span, 1.0)
    r, g, b = np.moveaxis(rgb, -1, 0)
    sextant = np.select([b == top, g == top], [4 + (r - g) / some, 2 + (b - r) / some], (g - b) / some)
    hue = np.where(span > 1e-12, sextant / 6 % 1.0, 0.0)
    return np.stack([hue, np.where(top > 1e-12, span / np.where(top > 1e-12, top, 1.0), 0.0), top], -1)


def to_lab(rgb: np.ndarray) -> np.ndarray:
    linear = np.where(rgb <= 0.04045, rgb / 12.92, ((rgb + 0.055) / 1.055) ** 2.4)
    t = linear @ TO_XYZ.T / WHITE
    edge = 6 / 29
    f = np.where(t > edge**3, np.cbrt(t), t / (3 * edge**2) + 4 / 29)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], -1)


def colour_features(image: np.ndarray) -> np.ndarray:
    """The values of COLOUR of a height x width x 3 array of bytes; red, green and blue in 0 to 255."""
    rgb = image.astype(float) / 255
    out = []
    for values, scale in ((rgb, 255.0), (to_hsv(rgb), 1.0), (to_lab(rgb), 1.0)):
        flat = values.reshape(-1, 3) * scale
        out += [*flat.mean(0), *flat.std(0)]
    return np.array(out)


def texture_features(image: np.ndarray) -> np.ndarray:
    """Contrast, homogeneity, energy and correlation of the symmetric co-occurrence of grey values side by
    side. A flat image has correlation 1."""
    grey = np.round((image.astype(float) / 255) @ GREY * 255).astype(np.int64).clip(0, 255)
    pairs = np.zeros((256, 256))
    np.add.at(pairs, (grey[:, :-1].ravel(), grey[:, 1:].ravel()), 1)
    p = pairs + pairs.T
    p /= max(p.sum(), 1)
    i, j = np.indices(p.shape)
    mi, mj = (p * i).sum(), (p * j).sum()
    si, sj = np.sqrt((p * (i - mi) ** 2).sum()), np.sqrt((p * (j - mj) ** 2).sum())
    correlation = ((p * (i - mi) * (j - mj)).sum() / (si * sj)) if si > 1e-15 and sj > 1e-15 else 1.0
    return np.array([(p * (i - j) ** 2).sum(), (p / (1 + (i - j) ** 2)).sum(), np.sqrt((p**2).sum()), correlation])


def read_images(spark: SparkSession, folder: str, box: tuple[float, float, float, float] = (0, 0, 1, 1), texture: bool = False) -> DataFrame:
    """path, label (the file's folder), x (features), prototype: a row per image that can be decoded. Images
    have no concentration and no group; results from them are marked as of a prototype."""
    files = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(folder)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for h, w, n, data in zip(*(b.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True):
                raw = np.frombuffer(data, np.uint8).reshape(h, w, n)
                # the source keeps blue, green, red; one channel is grey
                image = crop(np.repeat(raw, 3, 2) if n == 1 else raw[:, :, 2::-1], box)
                x = colour_features(image)
                out.append(np.concatenate([x, texture_features(image)]) if texture else x)
            yield pa.record_batch([b.column(0), pa.array(out, pa.list_(pa.float64()))], ["path", "x"])

    flat = files.select(*(F.col(f"image.{c}").alias(c) for c in ("origin", "height", "width", "nChannels", "data")))
    got = flat.mapInArrow(features, "path string, x array<double>")
    return got.select("path", F.element_at(F.split("path", "/"), -2).alias("label"), "x", F.lit(True).alias("prototype"))

