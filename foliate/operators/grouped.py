"""Grouped maps in Python without a frame, a message or a batch of its own for each group: the cost follows the rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, wraps

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows and characters that leave Python together.
ROWS, SIZE = 10_000, 4_000_000


def fold(*names: str):
    """Makes a function from a group's columns (name: list) to rows of these names also take a pandas frame and give one."""

    def wrap(core: Callable[..., list[tuple]]):
        @wraps(core)
        def over(rows: pd.DataFrame, **options) -> pd.DataFrame:
            return pd.DataFrame(core(rows.astype(object).where(rows.notna(), None).to_dict("list"), **options), columns=list(names))

        over.core = core
        return over

    return wrap


def values(column: pa.Array) -> list:
    if column.null_count or pa.types.is_nested(column.type) or pa.types.is_temporal(column.type):
        return column.to_pylist()
    return column.to_numpy(zero_copy_only=False).tolist()


def pieces(batch: pa.RecordBatch, size: int = SIZE) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about that many bytes, so that a part of it only is held as Python objects."""
    rows = max(1, batch.num_rows * size // max(size, batch.nbytes))
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[dict[str, list]]:
    """The columns of each run of rows of equal keys, whatever the batches' bounds; one group is held besides a piece of a batch."""
    held: dict[str, list] | None = None
    last = None
    for batch in batches:
        for b in pieces(batch):
            columns = {name: values(b.column(k)) for k, name in enumerate(b.schema.names)}
            begin = 0
            for k, key in enumerate(zip(*(columns[c] for c in keys))):
                if key != last:
                    if k > begin:
                        own = {c: v[begin:k] for c, v in columns.items()}
                        yield own if held is None else {c: held[c] + v for c, v in own.items()}
                        held = None
                    elif held is not None:
                        yield held
                        held = None
                    begin, last = k, key
            own = {c: v[begin:] for c, v in columns.items()}
            if held is None:
                held = own
            else:
                for c, v in own.items():
                    held[c] += v
    if held is not None and next(iter(held.values())):
        yield held


def written(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded numbers of rows and characters."""
    wide = [k for k, t in enumerate(schema.types) if pa.types.is_string(t) or pa.types.is_large_string(t) or pa.types.is_binary(t)]
    held, size = [], 0
    for row in rows:
        held.append(row)
        for k in wide:
            size += len(row[k] or "")
        if len(held) >= ROWS or size >= SIZE:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _mapped(batches: Iterator[pa.RecordBatch], f, keys: tuple[str, ...], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    core = getattr(f, "core", f)
    return written((row for own in groups(batches, keys) for row in core(own)), schema)


def by_keys(rows: DataFrame, f: Callable[[dict[str, list]], list[tuple]], schema: str | StructType, *keys: str, order: tuple[str, ...] = ()) -> DataFrame:
    """f over each group of equal keys, sorted by order, as a table of that schema. Rows are exchanged by the first key; a task holds one group."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)
    return rows.repartition(keys[0]).sortWithinPartitions(*keys, *order).mapInArrow(partial(_mapped, f=f, keys=keys, schema=arrow), kind)


def _streamed(batches: Iterator[pa.RecordBatch], f, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    rows = (row for batch in batches for b in pieces(batch) for row in zip(*(values(c) for c in b.columns)))
    return written(f(rows), schema)


def by_rows(rows: DataFrame, f: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str | StructType, *keys: str, order: tuple[str, ...] = ()) -> DataFrame:
    """f over the rows of a partition, as tuples sorted by keys and order; rows of the first key are together. What a task holds is up to f."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return rows.repartition(keys[0]).sortWithinPartitions(*keys, *order).mapInArrow(partial(_streamed, f=f, schema=to_arrow_schema(kind)), kind)
