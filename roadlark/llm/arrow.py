"""Arrow batch helpers for the operators that work in Python."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash


class Words(dict):
    """Word -> 64-bit hash, remembered; forgets all when it has ``most`` entries."""

    def __init__(self, most: int = 1 << 20):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null gives the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def in_pieces(texts: list[bytes], most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Index ranges whose texts have ``most`` bytes together, or are one longer text."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def with_columns(batch: pa.RecordBatch, keep: list[str], made: dict[str, pa.Array]) -> pa.RecordBatch:
    """The kept columns of a batch and the made ones."""
    names = batch.schema.names
    arrays = [batch.column(names.index(c)) for c in keep] + list(made.values())
    return pa.RecordBatch.from_arrays(arrays, names=[*keep, *made])
