"""Feature vectors of pictures, by which those that look alike are found."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pixels along a side, bins of a histogram, pixels of the largest picture, endings that are looked at, weights of the luminance.
SIDE, BINS, MOST_PIXELS = 12, 16, 40_000_000
ENDINGS = ("jpg", "jpeg", "png", "webp")
LUMINANCE = np.array([0.2126, 0.7152, 0.0722])

_SCHEMA = pa.schema([("path", pa.string()), ("status", pa.string()), ("features", pa.list_(pa.float64()))])


@cache
def _kernel(size: int) -> np.ndarray:
    """Weights that take ``size`` pixels to ``SIDE``: a Lanczos window of three lobes, as wide as the picture is shrunk."""
    scale = size / SIDE
    wide = max(scale, 1.0)
    x = (np.arange(size) + 0.5 - (np.arange(SIDE)[:, None] + 0.5) * scale) / wide
    w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
    return w / w.sum(1, keepdims=True)


def _over_white(pixels: np.ndarray) -> np.ndarray:
    """Red, green and blue over a white ground; ``pixels`` as grey, BGR or BGRA."""
    if pixels.shape[2] == 1:
        return np.repeat(pixels, 3, axis=2).astype(np.float64)
    colour = pixels[:, :, 2::-1].astype(np.float64)
    if pixels.shape[2] == 3:
        return colour
    alpha = pixels[:, :, 3:4] / 255.0
    return np.floor(colour * alpha + 255 * (1 - alpha) + 0.5)


def features(pixels: np.ndarray) -> np.ndarray:
    """A unit vector: the colours of ``SIDE`` x ``SIDE`` pixels from -1 to 1, and histograms of red, green, blue and luminance."""
    rows, columns = _kernel(pixels.shape[0]), _kernel(pixels.shape[1])
    small = np.einsum("ih,hwc,jw->ijc", rows, _over_white(pixels), columns, optimize=True)
    small = np.clip(np.floor(small + 0.5), 0, 255).reshape(-1, 3)
    light = np.floor(small @ LUMINANCE + 0.5)
    counts = [np.bincount(np.minimum(c // BINS, BINS - 1).astype(int), minlength=BINS) / SIDE**2 for c in (*small.T, light)]
    made = np.concatenate([(small / 127.5 - 1).ravel(), *counts])
    return made / np.sqrt((made * made).sum())


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(len(batch)):  # one at a time, as each may be large
            path, h, w, n, data = (batch.column(c)[i].as_py() for c in ("origin", "height", "width", "nChannels", "data"))
            status, made = "UNREADABLE", None
            if h is not None and h > 0 and w > 0:
                status = "TOO_LARGE" if h * w > MOST_PIXELS else "OK"
                if status == "OK":
                    made = features(np.frombuffer(data, np.uint8).reshape(h, w, n)).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([status], pa.string()), pa.array([made], pa.list_(pa.float64()))], schema=_SCHEMA)


def image_features(spark: SparkSession, path: str) -> DataFrame:
    """``path, status, features`` of every picture in a folder and below it; other files are left out, and so are empty ones, which Spark never reads.

    Spark decodes JPEG and PNG files; what it can't decode, WebP files with it,
    is UNREADABLE and has no features, and pictures of more than ``MOST_PIXELS``
    are TOO_LARGE.  A camera's note on which side is up isn't followed.
    """
    glob = "*.{" + ",".join(x for e in ENDINGS for x in (e, e.upper())) + "}"
    raw = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return raw.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").mapInArrow(_vectors, "path string, status string, features array<double>")


def alike(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """For a stated few of the pictures, the ``k`` others of the greatest cosine: ``query, path, score``, ties by path."""
    from pyspark.sql import Window

    from tessera.functions import vector

    asked = queries.where("status = 'OK'").select(F.col("path").alias("query"), F.col("features").alias("q"))
    known = vectors.where("status = 'OK'").select("path", "features")
    pairs = known.join(asked, F.col("path") != F.col("query")).select("query", "path", vector.cosine(F.col("q"), F.col("features")).alias("score"))
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "path"))
    return pairs.withColumn("rank", best).where(F.col("rank") <= k).drop("rank")
