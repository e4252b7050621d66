"""Row-wise operators that see a text and hand every other column through."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import bounded_batches


def with_text(df: DataFrame, fn: Callable[[pa.Array], list[pa.Array]], fields: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(row, got): ``row`` is a struct of the kept columns, ``got`` a struct of ``fields`` made from the text column.

    ``fn`` gets one Arrow batch of texts and returns a column for each field.
    Columns of any name and type pass through untouched in ``row``.
    """
    bounded_batches(df.sparkSession)
    keep = df.columns if keep is None else keep
    got = T._parse_datatype_string(f"struct<{fields}>")
    names = got.fieldNames()
    inside = text in keep and df.schema[text].dataType == T.StringType()  # then the text is sent once
    at = keep.index(text) if inside else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = fn(batch.column("row").field(at) if inside else batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.StructArray.from_arrays(cols, names)], ["row", "got"])

    row = F.struct(*(F.col(f"`{c}`") for c in keep)) if keep else F.struct(F.lit(0).alias("_"))
    src = df.select(row.alias("row"), *(() if inside else (F.col(f"`{text}`").cast("string").alias("text"),)))
    schema = T.StructType([src.schema["row"], T.StructField("got", got)])
    return src.mapInArrow(run, schema)
