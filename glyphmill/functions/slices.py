"""Arrow functions that take a batch in slices.

A batch has as many rows as Spark puts into it, whatever they weigh. As Python objects its values take
several times the memory that they have in Arrow, so only a slice of them is ever made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType
from pyspark.sql.types import DataType

MOST = 1 << 20


def slices(columns: tuple[pa.Array, ...], most: int = MOST) -> Iterator[tuple[pa.Array, ...]]:
    """The columns in parts of up to ``most`` bytes or of one row, all rows in order."""
    n = len(columns[0])
    if n > 1 and sum(c.nbytes for c in columns) > most:
        yield from slices(tuple(c[: n // 2] for c in columns), most)
        yield from slices(tuple(c[n // 2 :] for c in columns), most)
    elif n:
        yield columns


def values(column: pa.Array) -> list[Any]:
    """As ``to_pylist``, which makes a scalar of each nested value on its way; here each field is one list."""
    if pa.types.is_list(column.type):
        flat, out, at = values(column.flatten()), [], 0
        for n in column.value_lengths().to_pylist():
            out.append(None if n is None else flat[at : at + n])
            at += n or 0
        return out
    if pa.types.is_struct(column.type) and column.type.num_fields:
        names, there = [f.name for f in column.type], column.is_valid().to_pylist()
        rows = zip(*map(values, column.flatten()), strict=True)
        return [dict(zip(names, row, strict=True)) if known else None for row, known in zip(rows, there, strict=True)]
    return column.to_pylist()


def by_slices(function: Callable[..., pa.Array], kind: DataType) -> Any:
    """An Arrow function that gives its results slice by slice, so that no batch of them is held either."""

    def run(batches: Iterator[Any]) -> Iterator[pa.Array]:
        for batch in batches:
            for part in slices(batch if isinstance(batch, tuple) else (batch,)):
                yield function(*part)

    return F.arrow_udf(run, kind, ArrowUDFType.SCALAR_ITER)


def in_slices(function: Callable[[pa.Array], pa.Array], kind: DataType, arrow: pa.DataType) -> Any:
    """The same for small results, given at once: several such functions share one worker."""
    return F.arrow_udf(lambda values: pa.concat_arrays([pa.array([], arrow), *(function(*part) for part in slices((values,)))]), kind)
