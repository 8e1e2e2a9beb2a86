"""Batch prediction with a callable of the user."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Fixed value: texts per call.
BATCH_SIZE = 8


def predict_batches(
    df: DataFrame,
    make_model: Callable[[], Callable[[list[str]], list[str]]],
    row_id: str = "pair_id",
    text: str = "source",
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """(row_id, prediction). The model is built once per task and called with small batches."""
    id_type = df.schema[row_id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for batch in batches:
            for start in range(0, len(batch), batch_size):
                part = batch.iloc[start : start + batch_size]
                yield pd.DataFrame(
                    {row_id: part[row_id], "prediction": model(part[text].tolist())}
                )

    return df.select(row_id, text).mapInPandas(run, f"{row_id} {id_type}, prediction string")
