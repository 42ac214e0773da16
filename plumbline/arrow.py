"""Row-local Python steps over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def add_columns(df: DataFrame, fields: dict[str, tuple[T.DataType, pa.DataType]], worker: Callable[[], Callable[[pa.RecordBatch], list]], rows: int = 1000) -> DataFrame:
    """``df`` with the columns of ``fields``, made from slices of Arrow batches in tasks.

    ``worker`` is called once a task and gives a function from a slice to the new columns' values. All other columns
    pass through as they are, so ids of 64 bits stay exact, beside null ones too; new names replace old ones.
    """
    kept = df.drop(*fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = worker()
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                part = batch.slice(i, rows)
                made = [values if isinstance(values, pa.Array) else pa.array(values, kind) for values, (_, kind) in zip(step(part), fields.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *fields])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *(T.StructField(name, kind) for name, (kind, _) in fields.items())]))
