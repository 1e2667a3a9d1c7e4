"""UDFs that hold a few rows at a time, whatever the size of Spark's batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def sliced(make: Callable, kind: T.DataType, rows: int = 64):
    """A UDF of one column: ``make`` of each value, nulls too. Python has at most ``rows`` values and their results as objects."""
    arrow = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for whole in batches:
            for at in range(0, len(whole), rows):
                yield pa.array([make(v) for v in whole.slice(at, rows).to_pylist()], arrow)

    return run
