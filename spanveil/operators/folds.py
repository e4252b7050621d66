"""Ordered folds over groups as a stream: rows sorted in their partition pass by one at a time.

Only the state of the group at hand is in memory, however many rows it has, and
many small groups share one Python call. A group is serial, as its fold is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spanveil.shipping import ship


def fold(df: DataFrame, keys: list[str], order: list[Column], start: Callable[[], Any], step: Callable[[Any, dict], Iterable[dict]], schema: T.StructType, finish: Callable[[Any, dict], Iterable[dict]] | None = None) -> DataFrame:
    """The rows that ``step(state, row)`` gives for each row of ``df``, group by group in order; ``start()`` makes a group's state.

    ``finish(state, keys)`` may give more rows at a group's end. Null keys are
    equal to each other. Rows are dicts.
    """
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        key, state = None, None
        end = lambda: finish(state, dict(zip(keys, key, strict=True))) if finish and key is not None else ()
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                here = tuple(row[k] for k in keys)
                if here != key:
                    out += end()
                    key, state = here, start()
                out += step(state, row)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if last := list(end()):
            yield pa.RecordBatch.from_pylist(last, schema=arrow)

    together = df.repartition(*(F.col(k) for k in keys)).sortWithinPartitions(*(F.col(k) for k in keys), *order)
    return together.mapInArrow(run, schema)
