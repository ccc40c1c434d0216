"""Order-dependent folds that window functions can't express.

Rows are hash-partitioned by key, sorted within partitions and streamed through a Python generator, a batch at a
time: the state is one key's, never a collected group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def fold(
    df: DataFrame, keys: list[str], order: list[str], start: Callable[[], object], step: Callable[[object, dict], tuple[object, dict]], add: str, reads: list[str]
) -> DataFrame:
    """df with the columns of add (DDL): step(state, row) -> (state, values), from start() at each new key.

    Of a row only the keys and the columns in reads become Python values; the others stay in their Arrow arrays.
    """
    names = [part.split()[0] for part in add.split(",")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", " + add

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            values: dict[str, list] = {n: [] for n in names}
            columns = [batch.column(c).to_pylist() for c in reads]
            for key, *own in zip(zip(*(batch.column(k).to_pylist() for k in keys), strict=True), *columns, strict=True):
                row = dict(zip(reads, own, strict=True))
                if key != at:
                    at, state = key, start()
                state, new = step(state, row)
                for n in names:
                    values[n].append(new[n])
            types = {"long": pa.int64(), "bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
            arrays = [pa.array(values[n], types[part.split()[1]]) for n, part in zip(names, add.split(","), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, *names])

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def greedy_batches(df: DataFrame, keys: list[str], order: list[str], size: str, limit: int, name: str = "batch") -> DataFrame:
    """Numbers batches: one closes with the record that takes it to limit bytes or beyond."""

    def step(state, row):
        number, filled = state
        total = filled + row[size]
        return ((number + 1, 0) if total >= limit else (number, total)), {name: number}

    return fold(df, keys, order, lambda: (0, 0), step, f"{name} long", [size])


def rolled_segments(batches: DataFrame, keys: list[str], order: list[str], size: str, limit: int) -> DataFrame:
    """Segment of each batch and its offset there: a segment is sealed after the batch that takes it to limit."""

    def step(state, row):
        segment, offset = state
        after = offset + row[size]
        return ((segment + 1, 0) if after >= limit else (segment, after)), {"segment": segment, "segment_offset": offset}

    return fold(batches, keys, order, lambda: (0, 0), step, "segment long,segment_offset long", [size])
