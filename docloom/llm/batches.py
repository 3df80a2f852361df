"""Arrow batches for the operators that run in Python workers.

Spark bounds a batch it sends by bytes (spark.sql.execution.arrow.maxBytesPerBatch,
64 MB unless the session says otherwise); the work on it is done in parts bounded
by rows and bytes, so no setting of the session is changed here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

ROWS = 512
BYTES = 4_000_000


#: Keys that a Recent holds before the older ones may go.
RECENT = 65_536


class Recent(dict):
    """Values by key, made where they are missing. A worker serves all stages of a
    job, so what one stage keeps takes memory from the others: at most twice
    RECENT keys stay, those that are asked again and again among them."""

    def __init__(self) -> None:
        self.older: dict = {}

    def make(self, key):
        raise NotImplementedError

    def __missing__(self, key):
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= RECENT:
            self.older = dict(self)
            self.clear()
        self[key] = found
        return found


def parts(batches: Iterator[pa.RecordBatch], rows: int = ROWS, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most `rows` rows and about `size` bytes, one
    row at least. Parts share the memory of their batch."""
    for batch in batches:
        todo = [batch]
        while todo:
            part = todo.pop()
            if part.num_rows > 1 and (part.num_rows > rows or part.nbytes > size):
                half = min(rows, part.num_rows // 2) if part.num_rows > 2 * rows else part.num_rows // 2
                todo += [part.slice(half), part.slice(0, half)]
            elif part.num_rows:
                yield part


def map_rows(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, rows: int = ROWS) -> DataFrame:
    """f over df in parts of at most `rows` rows and BYTES bytes, so that long
    texts do not add up in a worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return map(f, parts(batches, rows))

    return df.mapInArrow(run, schema)


def strings(batch: pa.RecordBatch, name: str) -> list[str | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()
