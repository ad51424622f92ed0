"""Small helpers for functions over Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql.types import StructType

#: Bytes of a slice at most, unless one row alone has more.
SIZE = 8 << 20


#: Caches that a worker keeps from task to task, by the operator that fills them.
HELD: dict[str, list] = {}


def _trim() -> None:
    """Give unused memory back to the system: that of Arrow and, where the C library can, that of all else."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batches: Iterable[pa.RecordBatch], rows: int, size: int = SIZE, owner: str = "") -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows and about ``size`` bytes, so that what a worker derives of them stays small.

    A row of more bytes is a slice of its own. Workers live on for other tasks, so unused memory goes
    back to the system at both ends, and caches of other operators than ``owner`` are emptied.
    """
    for cache in [c for name, caches in HELD.items() if name != owner for c in caches]:
        cache.forget()
    _trim()
    try:
        for batch in batches:
            todo = [batch.slice(at, rows) for at in range(0, batch.num_rows, rows)][::-1]
            while todo:
                part = todo.pop()
                half = part.num_rows // 2
                if half and part.nbytes > size:
                    todo += [part.slice(half), part.slice(0, half)]
                else:
                    yield part
    finally:
        _trim()


def batched(rows: int, f: Callable[[pa.RecordBatch], pa.RecordBatch], owner: str = ""):
    """A function for ``mapInArrow`` that applies ``f`` to slices of at most ``rows`` rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, rows, owner=owner):
            out = f(part)
            if out.num_rows:
                yield out

    return run


def with_fields(schema: StructType, **kinds) -> StructType:
    """A new schema: the fields of ``schema``, then the named ones."""
    out = StructType(list(schema.fields))
    for name, kind in kinds.items():
        out = out.add(name, kind)
    return out


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """``names`` for working columns, lengthened until they clash with none of ``columns`` (case does not count)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
