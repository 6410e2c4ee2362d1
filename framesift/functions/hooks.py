"""Places where user models plug in: detectors, scorers, row transforms, aggregates."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Model = Callable[[pd.DataFrame], pd.DataFrame]


def detector_stage(frames: DataFrame, load: Callable[[], Model], schema: str | T.StructType) -> DataFrame:
    """Frames in, box rows out.  ``load`` runs once per task; the model then sees Arrow batches."""

    def detect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            yield model(batch)

    return frames.mapInPandas(detect, schema)


def score_column(df: DataFrame, inputs: Sequence[str], scorer: Callable[..., pd.Series], name: str = "score") -> DataFrame:
    """A vectorised scorer over some columns as a new double column."""
    return df.withColumn(name, F.pandas_udf(scorer, T.DoubleType())(*inputs))


def transformed(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Row transforms applied one after the other; they stay one plan."""
    for step in steps:
        df = df.transform(step)
    return df
