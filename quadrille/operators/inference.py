"""Detections from images by a predictor that is passed in."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.sources.files import stem

SCHEMA = "tile_name string, prediction_index int, confidence double, x_min double, y_min double, x_max double, y_max double"
Predictor = Callable[[bytes], Iterable[tuple[float, float, float, float, float]]]


def predicted(images: DataFrame, load: Callable[[], Predictor], *, least: float = 0.1) -> DataFrame:
    """A row a box of each image (path, content) whose confidence reaches least, numbered by falling confidence.

    load makes the predictor once a task; it takes an image's bytes and gives (confidence, x0, y0, x1, y1). Images
    without boxes give no row.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predictor = load()
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for frame in frames:
            rows = []
            for name, content in zip(frame["name"], frame["content"], strict=True):
                found = sorted((b for b in predictor(bytes(content)) if b[0] >= least), key=lambda b: (-b[0], *b[1:]))
                rows += [(name, i, *b) for i, b in enumerate(found)]
            yield pd.DataFrame(rows, columns=names)

    return images.select(stem(F.col("path")).alias("name"), "content").mapInPandas(run, SCHEMA)
