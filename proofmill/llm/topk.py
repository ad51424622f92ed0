"""Exact top-k search with an impact-ordered index, score at a time.

Components are quantised to integers. A block of the index holds, for each impact (the absolute
value, of larger ones the leading four bits), a segment of postings: by dimension, the rows with
such a component and its value. Queries add up whole segments, highest impact first. What later
segments can still add is bounded, so a query stops once the bound proves that only few rows can be
members, fewer than it costs to go on; those are rescored exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofmill.llm.arrow import slices

#: Queries that are scored at a time.
BATCH = 256
#: Blocks of queries that a task takes to one block of the index.
TOGETHER = 64


def quantised(vectors: DataFrame, scale: float = 64.0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id`` and ``v`` (array of int: floor of ``scale`` times each component, in double).

    Rows with a null key, a null vector, or a null or non-finite component are left out. Repeated
    keys stay. Scaled components must lie within 31 bits.
    """
    x = F.col(vector)
    fine = F.col(key).isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(fine).select(F.col(key).cast("bigint").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("int")).alias("v"))


def _packed(rows: DataFrame, block_rows: int) -> tuple[DataFrame, int]:
    """Rows in blocks of about ``block_rows``, one packed row each; the number of blocks."""
    blocks = max(1, -(-rows.count() // block_rows))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id", kind="stable")
        width = max(map(len, group["v"]), default=0)
        values = np.zeros((len(group), width), dtype=np.int32)
        for i, v in enumerate(group["v"]):
            values[i, : len(v)] = v
        return pd.DataFrame({"block": [group["block"].iloc[0]], "width": [width], "ids": [group["vec_id"].to_numpy(np.int64).tobytes()], "values": [values.tobytes()]})

    keyed = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    return keyed.groupBy("block").applyInPandas(pack, "block int, width int, ids binary, values binary"), blocks


def impacts(values: np.ndarray) -> np.ndarray:
    """Quantised impact of each component: its absolute value, of values from 16 on the leading four bits."""
    size = np.abs(values.astype(np.int64))
    low = np.maximum(0, np.frexp(size.astype(np.float64))[1] - 4)
    return size >> low << low


class ImpactIndex:
    """One block: segments of postings by descending impact, and after each of them what is left of every row."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, exact: type):
        self.ids, self.values = ids, values.astype(exact)
        self.asked = self.early = 0  # queries, and those that a proof stopped before the last segment
        impact = impacts(values)
        dims, rows = np.nonzero(impact.T)
        impact, value = impact[rows, dims], self.values[rows, dims]
        order = np.lexsort((rows, dims, -impact))
        dims, rows, impact, value = dims[order], rows[order], impact[order], value[order]
        starts = np.flatnonzero(np.concatenate([[True], impact[1:] != impact[:-1]])) if len(impact) else np.zeros(0, int)
        rest = np.bincount(rows, value.astype(np.float64) ** 2, minlength=len(ids))
        self.segments = []
        for at, end in zip(starts.tolist(), np.append(starts[1:], len(impact)).tolist(), strict=False):
            rest = rest - np.bincount(rows[at:end], value[at:end].astype(np.float64) ** 2, minlength=len(ids))
            cuts = np.flatnonzero(np.diff(dims[at:end])) + 1
            postings = [(int(dims[at + c]), r, v[:, None]) for c, r, v in zip([0, *cuts.tolist()], np.split(rows[at:end], cuts), np.split(value[at:end], cuts), strict=True)]
            below = int(np.abs(value[end:]).max(initial=0))
            self.segments.append((postings, below, np.sqrt(np.maximum(rest, 0)) * (1 + 1e-9), len(impact) - end))

    def search(self, own: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each query its (at most) k best of this block: positions in ``own``, ids, scores. Rows with the query's id are its own."""
        found = []
        n, width = self.values.shape
        want = k + int(np.unique(self.ids, return_counts=True)[1].max(initial=1))  # the query's own rows may be among the best
        norms, sums = np.sqrt((queries.astype(np.float64) ** 2).sum(1)) * (1 + 1e-9), np.abs(queries).sum(1, dtype=np.float64)
        active, scores = np.arange(len(queries)), np.zeros((n, len(queries)), dtype=self.values.dtype)
        self.asked += len(queries)
        tested = n * width
        for postings, below, rest, left in self.segments:
            weights = np.ascontiguousarray(queries[active].T)
            for dim, rows, value in postings:
                scores[rows] += value * weights[dim]
            if left > tested // 2 or not left or want >= n:
                continue  # the proof is attempted whenever half of the postings since the last time are done
            tested = left
            slack = np.minimum(np.outer(rest, norms[active]), below * sums[active])
            least = np.partition(scores - slack, n - want, axis=0)[n - want]
            possible = scores + slack >= least
            done = possible.sum(0) * width <= left
            for col in np.flatnonzero(done):
                found.append(self._exact(np.flatnonzero(possible[:, col]), active[col], own, queries, k))
            self.early += int(done.sum())
            active, scores = active[~done], scores[:, ~done]
            if not len(active):
                break
        for col, row in enumerate(active.tolist()):  # all postings are added up: scores are exact
            at = np.argpartition(-scores[:, col], want - 1)[:want] if want < n else np.arange(n)
            at = np.flatnonzero(scores[:, col] >= scores[at, col].min()) if len(at) else at
            found.append(self._exact(at, row, own, queries, k))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 3

    def _exact(self, at: np.ndarray, row: int, own: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = at[self.ids[at] != own[row]]
        exact = (self.values[at] @ queries[row]).astype(np.int64)
        best = np.lexsort((self.ids[at], -exact))[:k]
        return np.full(len(best), row), self.ids[at][best], exact[best]


def _values(row: dict, width: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], dtype=np.int64)
    values = np.frombuffer(row["values"], dtype=np.int32).reshape(len(ids), -1)
    return ids, np.pad(values, ((0, 0), (0, width - values.shape[1])))


def search(queries: DataFrame, vectors: DataFrame, k: int = 20, block_rows: int = 8192, query_rows: int = 1024) -> DataFrame:
    """The ``k`` highest inner products of each query: ``query_id``, ``rank``, ``vec_id``, ``score``.

    Both frames come from ``quantised``. Ties go to the smaller id; a query's own id is no
    candidate; vectors of different lengths count as filled with zeros. Each block of queries meets
    each block of the index once and keeps k rows of a query. A task takes many blocks of queries to
    one of the index, whose segments are made once for them.
    """
    index, blocks = _packed(vectors, block_rows)
    asked, groups = _packed(queries, query_rows)
    turns = -(-groups // TOGETHER)
    left = index.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    right = asked.select(F.pmod("block", F.lit(turns)).alias("turn"), F.struct("width", "ids", "values").alias("asked")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    both = left.join(right, ["block", "turn"])

    def run(batches):
        held, block = None, None
        for batch in slices(batches, 1):
            for row in batch.to_pylist():
                width = max(row["width"], row["asked"]["width"])
                (ids, values), (own, wanted) = _values(row, width), _values(row["asked"], width)
                size = float(np.abs(values.astype(np.int64)).max(initial=0)) * float(np.abs(wanted.astype(np.int64)).max(initial=0)) * max(1, width)
                exact = np.float32 if size < 2**23 else np.float64 if size < 2**52 else np.int64
                if held != (row["block"], width, exact):
                    held, block = (row["block"], width, exact), ImpactIndex(ids, values, exact)
                for at in range(0, len(own), BATCH):
                    q, v, s = block.search(own[at : at + BATCH], wanted[at : at + BATCH].astype(exact), k)
                    yield pa.RecordBatch.from_arrays([pa.array(own[at : at + BATCH][q.astype(np.int64)]), pa.array(v), pa.array(s)], names=["query_id", "vec_id", "score"])

    found = both.mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
