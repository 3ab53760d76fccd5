"""Arrow batches through Python: one helper and a bounded memo."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def map_batches(df: DataFrame, make: Callable[[], Callable[[dict], dict]], schema: str | StructType) -> DataFrame:
    """``make()`` runs once in each task and returns a function from columns to columns (dicts of lists).

    Rows keep their batch; the function may return fewer or more rows than it got.
    """
    out = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for b in batches:
            for s in range(0, b.num_rows, 512):
                part = b.slice(s, 512)
                yield pa.RecordBatch.from_pydict(each({n: _values(part.column(n)) for n in part.schema.names}), schema=arrow)

    return df.mapInArrow(run, out)


def _values(column: pa.Array) -> list:
    """Python values; arrays of whole numbers come as numpy arrays, without a Python object for each number."""
    if pa.types.is_list(column.type) and pa.types.is_integer(column.type.value_type) and not column.null_count:
        flat = column.flatten()
        if not flat.null_count:
            ends = column.value_lengths().to_numpy(zero_copy_only=False).cumsum()
            return np.split(flat.to_numpy(), ends[:-1]) if len(ends) else []
    return column.to_pylist()


class Memo(dict):
    """Values by key, computed when missing; emptied at ``most`` entries, so memory is bounded whatever the keys are."""

    def __init__(self, compute: Callable, most: int = 600_000, longest: int = 256):
        super().__init__()
        self.compute, self.most, self.longest = compute, most, longest

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value
