"""Row functions in Arrow batches that hold the Python objects of few rows at a time.

Spark sends ten thousand rows a batch, whatever their bytes. As Arrow they are compact; as Python objects, dictionaries
above all, they are not. So a batch is read in slices, and each slice's results go back before the next is read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: A slice has at most so many rows, and so many bytes if it has more than one.
ROWS, BYTES = 256, 1 << 20


def slices(columns: list[pa.Array], rows: int = ROWS, most: int = BYTES) -> Iterator[list[pa.Array]]:
    """The columns of a batch, cut; a slice of too many bytes is halved."""
    cuts = [(at, min(rows, len(columns[0]) - at)) for at in range(0, len(columns[0]), rows)][::-1]
    while cuts:
        at, n = cuts.pop()
        found = [c.slice(at, n) for c in columns]
        if n > 1 and sum(c.nbytes for c in found) > most:
            cuts += [(at + n // 2, n - n // 2), (at, n // 2)]
        else:
            yield found


def by_row(kind: T.DataType) -> Callable:
    """Decorator: a function of one row's values becomes an Arrow-batched one."""

    def wrap(f: Callable):
        def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            own = to_arrow_type(kind)
            for batch in batches:
                columns = list(batch) if isinstance(batch, tuple) else [batch]
                if not len(columns[0]):
                    yield pa.array([], own)
                for part in slices(columns):
                    yield pa.array([f(*row) for row in zip(*(c.to_pylist() for c in part), strict=True)], own)

        if f.__code__.co_argcount == 1:

            def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
                return run(batches)

            return F.arrow_udf(one, kind)

        def several(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            return run(batches)

        return F.arrow_udf(several, kind)

    return wrap
