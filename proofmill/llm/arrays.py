"""Array columns: running results in linear time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values that are added up together.
CHUNK = 64


def running(values: Column, op, zero: int) -> Column:
    """Running results of an associative ``op`` over an array of bigint, in chunks, so that work stays in proportion to its size."""
    last = lambda a: F.get(a, F.size(a) - 1)
    grown = lambda a, x: F.concat(a, F.array(op(F.coalesce(last(a), F.lit(zero).cast("bigint")), x)))
    none = F.array().cast("array<bigint>")
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / CHUNK).cast("int")), lambda c: F.aggregate(F.slice(values, c * CHUNK + 1, F.lit(CHUNK)), none, grown))
    bases = F.aggregate(chunks, F.array(F.lit(zero).cast("bigint")), lambda a, c: grown(a, last(c)))
    both = F.flatten(F.zip_with(chunks, F.slice(bases, F.lit(1), F.size(chunks)), lambda c, base: F.transform(c, lambda x: op(base, x))))
    return F.when(F.size(values) > 0, both).otherwise(none)
