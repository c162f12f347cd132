"""Image files as frames, through Spark's image source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def gray_levels(data: bytes, height: int, width: int, channels: int) -> list[int]:
    """Levels row by row of pixels stored as blue, green, red (and alpha), or as gray already; halves up."""
    pixels = np.frombuffer(data, np.uint8).reshape(height * width, channels)
    if channels == 1:
        return pixels[:, 0].astype(int).tolist()
    b, g, r = (pixels[:, k].astype(float) for k in range(3))
    return np.floor(0.299 * r + 0.587 * g + 0.114 * b + 0.5).astype(int).tolist()


def _frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        gray = [gray_levels(d, h, w, c) for d, h, w, c in zip(pdf["data"], pdf["height"], pdf["width"], pdf["nChannels"])]
        yield pd.DataFrame({"origin": pdf["origin"], "width": pdf["width"], "height": pdf["height"], "gray": gray})


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """origin, width, height, gray of the images under path; files that are no images are left out."""
    images = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    return images.where(F.col("height") > 0).select("origin", "height", "width", "nChannels", "data").mapInPandas(_frames, "origin string, width int, height int, gray array<int>")
