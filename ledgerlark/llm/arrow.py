"""Adding columns to a table from whole Arrow batches in Python."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def with_columns_from(df: DataFrame, fields: T.StructType, make: Callable[[], Callable[[pa.RecordBatch], dict[str, list | pa.Array]]]) -> DataFrame:
    """``df`` with ``fields`` added; columns of those names (in any case) are replaced.

    ``make`` runs once a task and returns the function that turns a batch into the new columns.
    """
    taken = {f.name.lower() for f in fields}
    old = [f for f in df.schema if f.name.lower() not in taken]
    schema = T.StructType([*old, *fields])
    types = {f.name: f.type for f in to_arrow_schema(T.StructType(list(fields)))}
    # inside, columns go by their place: a name may hold dots or anything else
    places, columns = [i for i, f in enumerate(df.schema) if f.name.lower() not in taken], df.columns
    plain = T.StructType([T.StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            new = step(batch.rename_columns(columns))
            arrays = [batch.column(i) for i in places]
            arrays += [new[n] if isinstance(new[n], pa.Array) else pa.array(new[n], types[n]) for n in types]
            yield pa.RecordBatch.from_arrays(arrays, names=plain.names)

    return df.toDF(*[f"c{i}" for i in range(len(columns))]).mapInArrow(run, plain).toDF(*schema.names)


def quoted(names: list[str]) -> list[str]:
    """Column names as select() takes them, whatever they hold."""
    return [f"`{n.replace('`', '``')}`" for n in names]


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null is empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], text: int, *others: int, raw: bool = False, size: int = 20) -> Iterator[tuple]:
    """Of about 2 ** ``size`` bytes of texts at a time: the first column, the texts (null is empty; bytes if ``raw``), other columns by place."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) >> size, prepend=0)).tolist()
        for a, b in zip([0, *cuts], [*cuts, len(sizes)], strict=True):
            if a < b:
                part = batch.slice(a, b - a)
                texts = part.column(text).cast(pa.binary()) if raw else part.column(text)
                yield (part.column(0), [t or (b"" if raw else "") for t in texts.to_pylist()], *(part.column(c) for c in others))
