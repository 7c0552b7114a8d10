"""Sequential state within keys, where windows can't express it: sorted partitions are read once, row by row."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def equal_keys(a: tuple, b: tuple) -> bool:
    """Whether two keys are one as grouping sees it: null equals null, NaN equals NaN."""
    return all(x == y or (x != x and y != y) for x, y in zip(a, b))


def scan_by_key(df: DataFrame, by: list[str], order: list[str], start: Callable[[tuple], list], step: Callable[[list, tuple], Iterable[tuple]], result: str, finish: Callable[[list], Iterable[tuple]] | None = None) -> DataFrame:
    """Rows of ``result`` that ``step(state, row)`` makes of each key's rows in order, and ``finish(state)`` at its end.

    A row is a tuple in the order of ``df``'s columns, with values as Arrow has them: a null stays None and a long
    stays exact. ``start(row)`` makes the state of a key from its first row. One key's state is in memory at a time.
    """
    place = [df.columns.index(c) for c in by]
    schema = to_arrow_schema(T._parse_datatype_string(result))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda rows: pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)
        key, state = None, None
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                own = tuple(row[i] for i in place)
                if key is None or not equal_keys(key, own):
                    if key is not None and finish:
                        out += finish(state)
                    key, state = own, start(row)
                out += step(state, row)
            yield made(out)
        if key is not None and finish:
            yield made(finish(state))

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(scan, result)
