"""Arrow batch helpers: lists in, lists out, without pandas in between."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def map_lists(df: DataFrame, fn: Callable[[Iterator[dict[str, list]]], Iterable[dict[str, list]]], schema: str | StructType) -> DataFrame:
    """mapInArrow with every batch as a dict of Python lists; fn sees the batches of one partition in order."""
    struct = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    assert isinstance(struct, StructType)
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in fn(b.to_pydict() for b in batches):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, struct)


def map_rows(df: DataFrame, fn: Callable[..., Iterable[tuple]], schema: str, rows: int = 20_000) -> DataFrame:
    """fn(*columns of one row) gives any number of output tuples; output batches stay bounded."""
    names = [x.name for x in _parse_datatype_string(schema)]
    cols = df.columns

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        out: list[tuple] = []
        for b in batches:
            for row in zip(*(b[c] for c in cols)):
                out.extend(fn(*row))
                if len(out) >= rows:
                    yield dict(zip(names, zip(*out)))
                    out = []
        if out:
            yield dict(zip(names, zip(*out)))

    return map_lists(df, run, schema)
