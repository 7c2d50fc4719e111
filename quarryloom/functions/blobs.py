"""Vectors as little-endian float32 bytes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def from_blob(blob: Column) -> Column:
    """array<float> of a blob; null if its length isn't a multiple of 4."""

    @F.pandas_udf("array<float>")
    def decode(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4"))

    return decode(blob)


def to_blob(vector: Column) -> Column:
    @F.pandas_udf("binary")
    def encode(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return encode(vector)
