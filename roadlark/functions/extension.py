"""Where users bring their own code: mergeable accumulators and row expansions, both over Arrow or pandas batches.

Estimators are brought to ``operators.models.out_of_fold`` as a callable of a seed.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.scans import equal_keys


class Accumulator(Protocol):
    """A state that rows are added to, that another's state is merged into, and that ends as one row."""

    def add(self, rows: pd.DataFrame) -> None: ...

    def merge(self, other: Accumulator) -> None: ...

    def finish(self) -> dict: ...


#: Bytes of rows that a task gathers, so that a key's rows are added together.
GATHER_BYTES = 32 << 20


def _gathered(batches: Iterator[pa.RecordBatch], size: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Batches put together, until they hold ``size`` bytes or ``rows`` rows."""
    held, count, used = [], 0, 0
    for batch in batches:
        held.append(batch)
        count, used = count + batch.num_rows, used + batch.nbytes
        if count and (used >= size or count >= rows):
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, count, used = [], 0, 0
    if count:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def accumulate(df: DataFrame, key: str, make: Callable[[], Accumulator], result: str, most: int = 100_000) -> DataFrame:
    """One row of ``result`` (a schema that begins with the key) for each key.

    Each task accumulates its own rows, gathered up to ``GATHER_BYTES``, at most ``most`` rows and about as many keys at a time, so only states are shuffled; a key's states,
    one for each task and flush, are merged one after another. Null is a key; keys of any size stay exact, and the
    key column of the rows that ``add`` gets holds the key itself.
    """

    kind = dict(df.dtypes)[key]
    held = T._parse_datatype_string(f"__key {kind}, __state binary")
    arrow, names = to_arrow_schema(held), [f.name for f in T._parse_datatype_string(result).fields]
    made = to_arrow_schema(T._parse_datatype_string(result))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict = {}

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in states.values()], arrow[0].type), pa.array([pickle.dumps(s) for _, s in states.values()], pa.binary())], schema=arrow)
            states.clear()
            return batch

        for rows in _gathered(batches, GATHER_BYTES, most):
            at = rows.schema.names.index(key)
            coded = rows.column(at).dictionary_encode(null_encoding="encode")
            which, keys = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
            own = np.empty(len(keys), object)
            own[:] = keys
            order = np.argsort(which, kind="stable")
            pdf = rows.to_pandas().take(order)
            pdf[key] = pd.Series(own[which[order]], index=pdf.index, dtype=object)
            ends = np.cumsum(np.bincount(which, minlength=len(keys)))
            for k, s, e in zip(keys, [0, *ends], ends):
                if s == e:
                    continue
                name = ("nan",) if k != k else k  # NaN is one key, as null is
                if name not in states:
                    states[name] = (k, make())
                states[name][1].add(pdf.iloc[s:e])
            if len(states) > most:
                yield out()
        yield out()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        rows = lambda found: pa.RecordBatch.from_pylist([{names[0]: k, **s.finish()} for k, s in found], made)
        for batch in batches:
            out = []
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                other = pickle.loads(raw)
                if state is None:
                    now, state = k, other
                elif equal_keys((k,), (now,)):
                    state.merge(other)
                else:
                    out.append((now, state))
                    now, state = k, other
            yield rows(out)
        if state is not None:
            yield rows([(now, state)])

    states = df.mapInArrow(partial, f"__key {kind}, __state binary")
    return states.repartition("__key").sortWithinPartitions("__key").mapInArrow(merged, result)


def expand(df: DataFrame, rows_of: Callable[[pd.DataFrame], Iterable[pd.DataFrame]], result: str) -> DataFrame:
    """Rows that a function makes of each batch, many or none of one."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield from rows_of(pdf)

    return df.mapInPandas(scan, result)
