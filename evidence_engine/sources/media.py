"""Media probing and decoding, if OpenCV is installed; else frame tables are taken as they are."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def opencv():
    try:
        import cv2
    except ImportError as e:
        raise RuntimeError("decoding media needs OpenCV; give a table of frames instead") from e
    return cv2


def video_info(files: DataFrame) -> DataFrame:
    """files(video_id, path) -> with duration, fps, frame_count, width, height; unreadable files raise."""

    def run(batches):
        cv2 = opencv()
        for pdf in batches:
            out = []
            for video_id, path in zip(pdf["video_id"], pdf["path"], strict=True):
                c = cv2.VideoCapture(path)
                fps, n = c.get(cv2.CAP_PROP_FPS), c.get(cv2.CAP_PROP_FRAME_COUNT)
                if fps <= 0 or n <= 0:
                    raise ValueError(f"{path} can't be read")
                out.append((video_id, path, n / fps, fps, int(n), int(c.get(cv2.CAP_PROP_FRAME_WIDTH)), int(c.get(cv2.CAP_PROP_FRAME_HEIGHT))))
                c.release()
            yield pd.DataFrame(out, columns=["video_id", "path", "duration", "fps", "frame_count", "width", "height"])

    return files.select("video_id", "path").mapInPandas(run, "video_id string, path string, duration double, fps double, frame_count long, width int, height int")


def dct_hash(gray: DataFrame, pixels: str = "pixels") -> DataFrame:
    """gray(..., pixels: 1,024 doubles, 32 by 32) with phash: the signs of the 64 lowest cosine terms against the median of
    those below the first row."""
    import math

    n = 32
    basis = [[math.sqrt((1 if k == 0 else 2) / n) * math.cos(math.pi * (2 * x + 1) * k / (2 * n)) for x in range(n)] for k in range(8)]

    @F.pandas_udf("long")
    def run(batch: pd.Series) -> pd.Series:
        import numpy as np

        c = np.array(basis)
        out = []
        for p in batch:
            low = c @ np.asarray(p, dtype=float).reshape(n, n) @ c.T
            bits = (low > np.median(low[1:])).ravel()
            value = int("".join("1" if b else "0" for b in bits), 2)
            out.append(value - (1 << 64) if value >= 1 << 63 else value)
        return pd.Series(out)

    return gray.withColumn("phash", run(pixels))
