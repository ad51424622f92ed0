"""Packing of token sequences: first-fit decreasing in randomised groups of pieces.

Documents are cut into pieces of at most one sequence. Pieces go to groups by a hash of their key,
start and place in the table. So every group is a random part of the corpus with nearly the same mix
of lengths, also where one key holds many rows, and groups pack independently.
In a group, a tournament tree over the bins' free room finds the first bin that fits a piece.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from proofmill.llm.arrow import slices
from proofmill.llm.bpe import OWNER, load
from proofmill.tables import cut

#: The sequence ids of a group start at its number times this.
STRIDE = 1 << 32
#: Rows and bytes of text that a worker takes at a time; the more, the fewer words it looks up again and the more memory it needs.
ROWS, SIZE = 1000, 2 << 20
#: Names a row of the cut table: its partition and position.
ROW = "_row"


def pieces(docs: DataFrame, path: str, pattern: str, length: int, end: int, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Each document's ids, then ``end``, cut into pieces of at most ``length`` ids.

    Columns: ``key``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, and ``ids_le`` if asked
    for. A null or empty text is one piece that holds only ``end``. Repeated keys stay separate rows.
    """
    rows = docs.select(F.col(key).cast("bigint").alias(key), F.col(text).alias("text"))
    names = [key, "start", "length", "ids_crc32", "doc_tokens", *(["ids_le"] if with_ids else [])]
    schema = StructType([StructField(n, BinaryType() if n == "ids_le" else LongType()) for n in names])
    tail = np.array([end], dtype="<u4").tobytes()

    def run(batches):
        bpe = load(path, pattern)
        for batch in slices(batches, ROWS, SIZE, OWNER):
            out = [[] for _ in names]
            every, bounds = bpe.encode_all(batch.column(1))
            for doc, a, b in zip(batch.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                ids = every[a:b].tobytes() + tail
                for at in range(0, len(ids), 4 * length):
                    part = ids[at : at + 4 * length]
                    for column, value in zip(out, (doc, at // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4, part), strict=False):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids_le" else pa.int64()) for n, c in zip(names, out, strict=True)], names=names)

    return rows.mapInArrow(run, schema)


def first_fit_decreasing(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """For each length (at most ``room``) its bin and its offset there; longer ones first, ties as given.

    Leaves of the tournament tree are bins, inner nodes the most free room below them. As every
    piece of over half the room opens its own bin, leaves suffice for one bin a piece.
    """
    n = len(lengths)
    bins, offsets = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    leaves = 1 << max(0, n - 1).bit_length()
    most = [room] * (2 * leaves)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need, node = int(lengths[i]), 1
        while node < leaves:
            node *= 2
            if most[node] < need:
                node += 1
        bins[i], offsets[i] = node - leaves, room - most[node]
        most[node] -= need
        while node > 1:
            node //= 2
            best = max(most[2 * node], most[2 * node + 1])
            if most[node] == best:
                break
            most[node] = best
    return bins, offsets


def pack(parts: DataFrame, length: int, group_rows: int = 8192, key: str = "doc_id", salt: tuple[str, ...] = ()) -> DataFrame:
    """``parts`` with ``sequence_id`` and ``offset``: no sequence holds more than ``length`` ids.

    ``parts`` should be a written table (see ``cut``): it is counted once to set the number of
    groups, so that each has about ``group_rows`` pieces. Pieces of full length need no company:
    they fill sequences of their own and skip the tree. The group of a piece depends on ``salt``, the
    columns of ``parts`` that say which row it is, and on ``key`` and start. Where keys are null or
    repeat, only a salt that differs between their rows keeps groups near ``group_rows``.
    """
    count = parts.count()
    groups = max(1, round(count / group_rows))
    keyed = parts.withColumn("group", F.pmod(F.xxhash64(key, "start", *salt, F.lit("pack")), F.lit(groups))).drop(*salt)
    schema = StructType([*(f for f in parts.schema.fields if f.name not in salt), StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([key, "start", "ids_crc32"], kind="stable", ignore_index=True)
        lengths = rows["length"].to_numpy()
        full, n = lengths == length, int((lengths == length).sum())
        bins, offsets = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
        bins[full] = np.arange(n)
        if n < len(rows):
            bins[~full], offsets[~full] = first_fit_decreasing(lengths[~full], length)
            bins[~full] += n
        rows["sequence_id"], rows["offset"] = rows["group"] * STRIDE + bins, offsets
        return rows.drop(columns="group")

    return keyed.groupBy("group").applyInPandas(run, schema)


def pack_documents(docs: DataFrame, path: str, pattern: str, length: int = 1024, end: int = 0, group_rows: int = 8192, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Cut and pack whole documents; returns the pieces with their places.

    Ids of a packed sequence are those of its pieces by offset; ``pieces(with_ids=True)`` has them.
    Sequences are padded to ``length`` by whoever writes them, unless full to a power of two.
    """
    parts = pieces(docs, path, pattern, length, end, key, text).withColumn(ROW, F.monotonically_increasing_id())
    return pack(cut(parts), length, group_rows, key, (ROW,))
