"""Hard negatives by Four-Russians scoring.

Components are integers. A candidate's components lie as bit planes: of eight dimensions, plane j is
one byte, the j-th bits of their values in two's complement. An anchor has for each eight dimensions
a table of all 256 subset sums of its values there. A plane byte looks up what it adds, and planes
are added up from the highest to the lowest with a shift in between, the sign plane negative. The
sums are the inner products themselves, so all comparisons are exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofmill.llm.arrow import slices
from proofmill.tables import Scratch

#: Candidates of a block, anchors of a chunk.
BLOCK_ROWS, CHUNK_ROWS = 8192, 512
#: Groups of labels whose rows share blocks; a group of many rows is dealt to several blocks.
GROUPS = 64
#: Chunks that a task takes to one block.
TOGETHER = 64
#: Anchors and candidates that are scored at a time.
ANCHORS, TILE = 128, 512


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes of rows of integers in two's complement: bytes (plane from the lowest, group of eight dimensions, row)."""
    n, width = values.shape
    bits = max(int(values.max(initial=0)).bit_length(), int(-values.min(initial=0) - 1).bit_length() if values.min(initial=0) < 0 else 0) + 1
    padded = np.pad(values, ((0, 0), (0, -width % 8)))
    return np.stack([np.packbits(((padded >> j) & 1).astype(np.uint8), axis=1, bitorder="little").T for j in range(bits)])


def tables(anchors: np.ndarray, kind: type) -> np.ndarray:
    """Subset sums of each eight dimensions: (group, byte, anchor)."""
    n, width = anchors.shape
    padded = np.pad(anchors, ((0, 0), (0, -width % 8))).astype(kind).reshape(n, -1, 8)
    out = np.zeros((padded.shape[1], 256, n), dtype=kind)
    for i in range(8):  # a subset with the i-th dimension as its highest is one without it, and that dimension
        out[:, 1 << i : 2 << i] = out[:, : 1 << i] + padded[:, :, i].T[:, None, :]
    return out


def scores(planes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Inner products (candidate, anchor): shift and add what each plane byte looks up."""
    bits, groups, n = planes.shape
    out = np.zeros((n, tables.shape[2]), dtype=tables.dtype)
    got = np.empty((TILE, tables.shape[2]), dtype=tables.dtype)
    for at in range(0, n, TILE):
        tile = planes[:, :, at : at + TILE]
        sums, one = out[at : at + TILE], got[: tile.shape[2]]
        for j in reversed(range(bits)):
            sums <<= 1
            for g in range(groups):
                np.take(tables[g], tile[j, g], axis=0, out=one, mode="clip")
                if j == bits - 1:
                    sums -= one
                else:
                    sums += one
    return out


def best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, place) of the ``k`` highest allowed scores of each anchor (a row each), the first of equal ones first."""
    least = np.iinfo(scores.dtype).min
    held = np.where(allowed, scores, least)
    rows, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    live = np.arange(len(held))
    for _ in range(min(k, held.shape[1])):
        at = held[live].argmax(1) if len(live) < len(held) else held.argmax(1)
        fine = held[live, at] > least
        live, at = live[fine], at[fine]
        if not len(live):
            break
        rows.append(live)
        places.append(at)
        held[live, at] = least
    return np.concatenate(rows), np.concatenate(places)


def quantised(vectors: DataFrame, scale: float = 256.0, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``vec_id, label, v`` (array of int: floor of ``scale`` times each component, in double).

    Rows with a null key, label or vector, or a null or non-finite component are left out; repeated
    rows stay. Scaled components must lie within 31 bits, an error else.
    """
    x = F.col(vector)
    fine = F.col(key).isNotNull() & F.col(label).isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = lambda c: F.floor(c.cast("double") * scale)
    checked = F.transform(x, lambda c: F.when(F.abs(whole(c)) < 2**31, whole(c)).otherwise(F.raise_error(F.lit("a scaled component has more than 31 bits")).cast("bigint")).cast("int"))
    return vectors.where(fine).select(F.col(key).cast("bigint").alias("vec_id"), F.col(label).cast("bigint").alias("label"), checked.alias("v"))


def _packed(rows: DataFrame, most: int, scratch: Scratch) -> DataFrame:
    """Rows in blocks of about ``most``, a packed row each: ``grp, part, width, ids, labels, values``, and ``anchors, limits`` of rows that have them.

    A block has rows of one group of labels; a group of many rows has several blocks. Rows are dealt
    to them by their place, so repeated ids and labels spread, and written once, so blocks hold.
    """
    more = [c for c in ("anchor", "limits") if c in rows.columns]
    keyed = scratch.cut(rows.withColumns({"grp": F.pmod(F.xxhash64("label"), F.lit(GROUPS)).cast("int"), "at": F.xxhash64(F.monotonically_increasing_id())}))
    parts = keyed.groupBy("grp").agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
    dealt = keyed.join(F.broadcast(parts), "grp").withColumn("part", F.pmod("at", "parts").cast("int"))  # GROUPS rows at most

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id", kind="stable")
        width = max(map(len, group["v"]), default=0)
        values = np.zeros((len(group), width), dtype=np.int32)
        for i, v in enumerate(group["v"]):
            values[i, : len(v)] = v
        out = {"grp": group["grp"].iloc[0], "part": group["part"].iloc[0], "width": width, "values": values.tobytes()}
        out |= {name: np.concatenate([np.atleast_1d(x) for x in group[c]]).astype(np.int64).tobytes() for name, c in (("ids", "vec_id"), ("labels", "label"), *((f"{c.removesuffix('s')}s", c) for c in more))}
        return pd.DataFrame({k: [v] for k, v in out.items()})

    fields = "grp int, part int, width int, values binary, ids binary, labels binary" + "".join(f", {c.removesuffix('s')}s binary" for c in more)
    return scratch.cut(dealt.groupBy("grp", "part").applyInPandas(pack, fields))


def _met(blocks: DataFrame, chunks: DataFrame, same: bool) -> DataFrame:
    """Blocks with chunks of anchors: those of the same group of labels, or all.

    Each chunk goes to its blocks by name; a task takes up to TOGETHER chunks to one block.
    """
    turns = max(1, -(-chunks.count() // TOGETHER))
    left = blocks.select("*", F.struct("grp", "part").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn"))
    right = chunks.select("grp", F.pmod(F.xxhash64("grp", "part"), F.lit(turns)).cast("int").alias("turn"), F.struct(*chunks.columns).alias("asked"))
    # the blocks' names as arrays: 8 bytes for a block
    names = F.broadcast(blocks.groupBy(*["grp"] * same).agg(F.collect_list(F.struct("grp", "part")).alias("every")))
    right = right.join(names, "grp") if same else right.join(names)
    return left.join(right.select("turn", "asked", F.explode("every").alias("block")), ["block", "turn"])


def _floor(n: str, m: int) -> Column:
    """The whole number at or below n / m."""
    return F.expr(f"({n} - pmod({n}, {m}L)) div {m}L")


def mine(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, low: tuple[int, int] = (1, 2), high: tuple[int, int] = (19, 20), block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Both frames come from ``quantised``. An anchor's positives are the ``positives`` rows of its label
    of highest inner product; its negatives for each are the ``negatives`` highest rows of other
    labels whose score is at least ``low`` and at most ``high`` times the positive's (fractions).
    Ties go to the smaller id. Rows with an anchor's id are neither. Repeated rows count each; equal
    rows of one anchor (id, label and vector) are one anchor. Vectors of different lengths count as
    filled with zeros. Blocks of anchors meet blocks of rows and keep a few rows of each anchor.
    """
    scratch = Scratch()
    tasks = 4 * vectors.sparkSession.sparkContext.defaultParallelism
    vectors = scratch.cut(vectors)
    blocks = _packed(vectors, min(block_rows, max(TILE, vectors.count() // tasks)), scratch)
    asked = scratch.cut(anchors.distinct().withColumn("anchor", F.xxhash64("vec_id", "label", "v")))

    def read(row: dict, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, labels = (np.frombuffer(row[c], dtype=np.int64) for c in ("ids", "labels"))
        values = np.frombuffer(row["values"], dtype=np.int32).reshape(len(ids), -1)
        return ids, labels, np.pad(values, ((0, 0), (0, width - values.shape[1]))).astype(np.int64)

    def scored(batches, same: bool):
        """For each block, chunk and some anchors of it: the rows' ids; the anchors' ids, hashes and limits; who may be chosen; scores by anchor."""
        held = None
        for batch in slices(batches, 1):
            for row in batch.to_pylist():
                chunk = row["asked"]
                width = max(row["width"], chunk["width"])
                if held != (row["block"], width):
                    ids, labels, values = read(row, width)
                    held, bits, size = (row["block"], width), planes(values), int(np.abs(values).max(initial=0))
                own, classes, wanted = read(chunk, width)
                if not same and (labels[0] == labels).all() and (labels[0] == classes).all():
                    continue
                bound = 4 * size * int(np.abs(wanted).sum(1).max(initial=0))
                if bound >= 2**62:
                    raise OverflowError("inner products have more than 60 bits")
                names = np.frombuffer(chunk["anchors"], dtype=np.int64)
                limits = np.zeros((len(own), 0)) if same else np.frombuffer(chunk["limits"], dtype=np.int64).reshape(len(own), -1)
                for at in range(0, len(own), ANCHORS):
                    some = slice(at, at + ANCHORS)
                    s = scores(bits, tables(wanted[some], np.int32 if bound < 2**31 else np.int64)).T
                    yield ids, own[some], names[some], limits[some], ((labels == classes[some, None]) == same) & (ids != own[some, None]), np.ascontiguousarray(s)

    def near(batches):
        for ids, own, names, _, allowed, s in scored(batches, True):
            row, place = best(s, allowed, positives)
            yield pa.RecordBatch.from_arrays([pa.array(names[row]), pa.array(own[row]), pa.array(ids[place]), pa.array(s[row, place].astype(np.int64))], names=["anchor", "anchor_id", "vec_id", "score"])

    found = _met(blocks, _packed(asked, chunk_rows, scratch), True).mapInArrow(near, "anchor long, anchor_id long, vec_id long, score long")
    first = Window.partitionBy("anchor", "anchor_id").orderBy(F.desc("score"), "vec_id")
    top = scratch.cut(found.withColumn("place", F.row_number().over(first).cast("bigint")).where(F.col("place") <= positives))
    bounds = F.array(-_floor(f"(-score * {low[0]}L)", low[1]), _floor(f"(score * {high[0]}L)", high[1]))
    limits = top.groupBy(F.col("anchor").alias("a"), F.col("anchor_id").alias("i")).agg(F.array_sort(F.collect_list(F.struct("place", bounds.alias("b")))).alias("b"))
    # a window for each positive; those of missing positives are empty
    limits = limits.select("a", "i", F.flatten(F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda p: F.coalesce(F.get("b", p)["b"], F.array(F.lit(1).cast("bigint"), F.lit(0).cast("bigint"))))).alias("limits"))
    ready = asked.join(limits, (F.col("anchor") == F.col("a")) & (F.col("vec_id") == F.col("i"))).drop("a", "i")

    def far(batches):
        for ids, own, names, limits, allowed, s in scored(batches, False):
            for p in range(positives):
                lo, hi = limits[:, 2 * p, None], limits[:, 2 * p + 1, None]
                row, place = best(s, allowed & (s >= lo) & (s <= hi), negatives)
                yield pa.RecordBatch.from_arrays([pa.array(names[row]), pa.array(own[row]), pa.array(np.full(len(row), p + 1)), pa.array(ids[place]), pa.array(s[row, place].astype(np.int64))], names=["anchor", "anchor_id", "place", "negative_id", "negative_score"])

    worse = _met(blocks, _packed(ready, chunk_rows, scratch), False).mapInArrow(far, "anchor long, anchor_id long, place long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor", "anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = worse.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    chosen = top.select("anchor", "anchor_id", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return ranked.join(chosen, ["anchor", "anchor_id", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
