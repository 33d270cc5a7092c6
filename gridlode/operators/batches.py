"""Small groups in Python, many in one Arrow batch: a group costs what its rows cost, no pandas frame of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def listed(df: DataFrame, keys: list[str], columns: list[str], name: str) -> DataFrame:
    """(keys…, name): the rows of each group as an array of structs; groups are small."""
    return df.groupBy(*keys).agg(F.collect_list(F.struct(*columns)).alias(name))


def tuples_of(column: pa.Array) -> list[list[tuple]]:
    """The lists of structs of an Arrow column as lists of tuples; null is empty."""
    flat = column.flatten()  # rows of null lists are no part of it
    rows = list(zip(*[flat.field(i).to_pylist() for i in range(flat.type.num_fields)], strict=True))
    out, at = [], 0
    for n in column.value_lengths().to_pylist():
        out.append(rows[at : at + (n or 0)])
        at += n or 0
    return out


def map_groups(groups: DataFrame, keys: list[str], lists: list[str], run: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """The keys and what ``run(lists…)`` returns for each row of (keys…, lists…): tuples of the columns of ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    whole = StructType([groups.schema[k] for k in keys] + list(StructType.fromDDL(schema).fields))
    arrow = to_arrow_schema(whole)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            names = [part.column(k).to_pylist() for k in keys]
            out = [(*key, *row) for key, *rows in zip(zip(*names, strict=True), *[tuples_of(part.column(c)) for c in lists], strict=True) for row in run(*rows)]
            for k in range(0, len(out), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[k : k + 50_000], strict=True), arrow, strict=True)], schema=arrow)

    return groups.select(*keys, *lists).mapInArrow(batches, whole)
