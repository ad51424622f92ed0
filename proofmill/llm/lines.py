"""Line dedup: lines that stand in several documents stay in one of them.

Two Bloom filters, of keys that a document has and of keys that a second one has, are made in one
pass without a shuffle of keys. Only keys in the second filter, the suspected repeats, are counted
exactly, which also tells the document that keeps them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.llm.arrow import slices, unused, with_fields
from proofmill.tables import Scratch, cut

#: What is stripped from both ends of a line.
BLANK = " \t\n\x0b\x0c\r"
#: Documents of a slice.
ROWS = 2000
#: Log2 of the least and most bits of a filter (32 MB), bits wanted for each key, and bytes of text that have one key.
BITS, EACH, TEXT = (20, 28), 12, 64
#: Odd multipliers, one for each bit that a key sets.
CELLS = [(0x9E3779B97F4A7C15 * (2 * i + 1) + 4 * i) % 2**64 | 1 for i in range(4)]
#: Log2 of the bits of a filter that travel together.
PART = 16
#: Tasks of the first pass for each core: what they send of the filters is bounded, however many files there are.
TASKS = 4
#: Repeated keys that are sent to all workers at most (24 bytes each); more are joined.
SMALL = 1_000_000

_KEY = np.dtype([("lo", "<u8"), ("hi", "<u8")])


class Lines:
    """The lines of some texts: ``of`` says whose each is, ``at`` which have a key of ``least`` code points, ``keys`` their 128-bit digests."""

    def __init__(self, texts: pa.Array, least: int):
        split = pc.split_pattern(pc.fill_null(texts, ""), "\n")
        self.lines = split.flatten()
        self.count = pc.list_value_length(split).to_numpy().astype(np.int64)
        self.of = np.repeat(np.arange(len(texts)), self.count)
        keys = pc.ascii_lower(pc.ascii_trim(self.lines, characters=BLANK))
        long = pc.greater_equal(pc.utf8_length(keys), least)
        self.at = np.flatnonzero(long.to_numpy(zero_copy_only=False))
        digests = b"".join(map(xxhash.xxh3_128_digest, keys.filter(long).cast(pa.binary()).to_pylist()))
        self.keys = np.frombuffer(digests, dtype=_KEY)

    def once(self) -> np.ndarray:
        """Places (in ``keys``) of the first line of each key of each text."""
        if not len(self.keys):
            return np.zeros(0, dtype=np.int64)
        order = np.lexsort((self.keys["hi"], self.keys["lo"], self.of[self.at]))
        of, keys = self.of[self.at][order], self.keys[order]
        new = np.concatenate([[True], (of[1:] != of[:-1]) | (keys[1:] != keys[:-1])])
        return np.sort(order[new])


class Filter:
    """A Bloom filter of 2**``bits`` bits in which each key sets ``cells`` bits."""

    def __init__(self, bits: int, cells: int, table: np.ndarray | None = None):
        self.bits, self.cells = bits, cells
        self.table = np.zeros(1 << bits - 3, dtype=np.uint8) if table is None else table

    def places(self, keys: np.ndarray) -> list[np.ndarray]:
        return [(keys * np.uint64(c)) >> np.uint64(64 - self.bits) for c in CELLS[: self.cells]]

    def holds(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), dtype=bool)
        for at in self.places(keys):
            out &= (self.table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
        return out

    def add(self, keys: np.ndarray) -> None:
        for at in self.places(keys):
            np.bitwise_or.at(self.table, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))


def _folded(part: bytes | None) -> bytes | None:
    """A part of a filter: null if empty, its set places if they are few, else its bytes."""
    table = np.frombuffer(part, dtype=np.uint8)
    if not table.any():
        return None
    places = np.flatnonzero(np.unpackbits(table, bitorder="little"))
    return places.astype("<u2").tobytes() if 2 * len(places) < len(table) else part


def _unfolded(part: bytes | None) -> np.ndarray:
    size = 1 << PART - 3
    if part is None:
        return np.zeros(size, dtype=np.uint8)
    if len(part) == size:
        return np.frombuffer(part, dtype=np.uint8)
    flags = np.zeros(1 << PART, dtype=np.uint8)
    flags[np.frombuffer(part, dtype="<u2")] = 1
    return np.packbits(flags, bitorder="little")


def _twice(docs: DataFrame, least: int) -> Filter:
    """The filter of keys that two documents or more may have. ``docs`` has ``text``.

    Each task fills both filters for its documents. Two tasks' filters of single sightings may name
    a common key where both have all its bits, so parts are merged part by part: what any task saw
    twice, and what two tasks saw. More bits than a key set can only add suspects, never lose one.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    wanted = max(1, size // TEXT)
    bits = min(max((EACH * wanted).bit_length(), BITS[0]), BITS[1])
    cells = min(max(round(0.7 * 2**bits / wanted), 1), len(CELLS))
    tasks = TASKS * spark.sparkContext.defaultParallelism

    def see(batches):
        once, twice = Filter(bits, cells), Filter(bits, cells)
        for batch in slices(batches, ROWS):
            lines = Lines(batch.column(0), least)
            keys, n = np.unique(lines.keys["lo"][lines.once()], return_counts=True)
            twice.add(keys[(n > 1) | once.holds(keys)])
            once.add(keys)
        step = 1 << PART - 3
        parts = [(i // step, _folded(once.table[i : i + step].tobytes()), _folded(twice.table[i : i + step].tobytes())) for i in range(0, len(once.table), step)]
        parts = [p for p in parts if p[1] is not None]
        for i in range(0, len(parts), 512):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*parts[i : i + 512], strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["part", "once", "twice"])

    def merge(batches):
        part, once, twice = None, None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([_folded(twice.tobytes())], pa.binary())], names=["part", "twice"])

        for batch in batches:
            for p, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if p != part:
                    if part is not None:
                        yield done()
                    part, once, twice = p, np.zeros(1 << PART - 3, dtype=np.uint8), np.zeros(1 << PART - 3, dtype=np.uint8)
                a = _unfolded(a)
                twice |= _unfolded(b) | once & a
                once |= a
        if part is not None:
            yield done()

    sent = docs.select("text").coalesce(tasks).mapInArrow(see, "part int, once binary, twice binary")
    merged = sent.repartition("part").sortWithinPartitions("part").mapInArrow(merge, "part int, twice binary").where(F.col("twice").isNotNull())
    table = np.zeros((1 << bits - PART, 1 << PART - 3), dtype=np.uint8)
    for part, twice in merged.toLocalIterator():  # 2**BITS[1] bits in all at most
        table[part] = _unfolded(bytes(twice))
    return Filter(bits, cells, table.ravel())


def _suspects(docs: DataFrame, shared, bits: int, cells: int, least: int) -> DataFrame:
    """``lo, hi, doc``: a row for each document and key of it that the second filter has."""

    def run(batches):
        twice = Filter(bits, cells, shared.value)
        for batch in slices(batches, ROWS):
            lines = Lines(batch.column(1), least)
            at = lines.once()
            at = at[twice.holds(lines.keys["lo"][at])]
            doc = batch.column(0).take(pa.array(lines.of[lines.at[at]]))
            yield pa.RecordBatch.from_arrays([pa.array(lines.keys[c][at].view(np.int64) if len(at) else np.zeros(0, np.int64)) for c in ("lo", "hi")] + [doc], names=["lo", "hi", "doc"])

    return docs.mapInArrow(run, "lo long, hi long, doc long")


class _Keepers:
    """Repeated keys with the document that keeps each, looked up by arrays."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray, keeper: np.ndarray, known: np.ndarray):
        order = np.lexsort((hi, lo))
        self.lo, self.hi, self.keeper, self.known = (a[order] for a in (lo, hi, keeper, known))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 if it has none. Of keys with one low half, all are looked at."""
        if not len(self.lo):
            return np.full(len(keys), -1)
        at, out = np.searchsorted(self.lo, keys["lo"]), np.full(len(keys), -1)
        open_ = np.arange(len(keys))
        while len(open_):
            inside = at[open_] < len(self.lo)
            open_ = open_[inside]
            open_ = open_[self.lo[at[open_]] == keys["lo"][open_]]
            same = self.hi[at[open_]] == keys["hi"][open_]
            out[open_[same]] = at[open_[same]]
            open_ = open_[~same]
            at[open_] += 1
        return out


def drop_lines(docs: DataFrame, least: int = 40, found: int = 5, key: str = "doc_id", text: str = "text", small: int = SMALL) -> DataFrame:
    """``docs`` with ``n_lines, n_dropped, kept``: the text without lines that other documents keep.

    A text is split at ``\\n``; null is one empty line. A line's key is the line without blanks
    (``BLANK``) at both ends, A to Z in lower case. Keys of ``least`` code points or more that
    ``found`` rows or more have lose all their lines but those of the largest ``key``: all lines of
    all rows of that key stay. A null key is smaller than any other. Rows of equal keys count each.
    Columns of ``docs`` named like the three new ones are replaced. Keys are told apart by 128-bit digests.
    """
    new = ["n_lines", "n_dropped", "kept"]
    taken = [c for c in docs.columns if c.lower() not in new]
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).cast("string").alias("text"))
    twice = _twice(rows, least)
    suspects = _suspects(rows, sc.broadcast(twice.table), twice.bits, twice.cells, least)
    scratch = Scratch()
    repeated = scratch.cut(suspects.groupBy("lo", "hi").agg(F.count("*").alias("n"), F.max("doc").alias("keeper")).where(F.col("n") >= found).drop("n"))
    doc, body, lost = unused(taken, "doc", "body", "lost")
    whole = docs.select(*taken, F.col(key).cast("bigint").alias(doc), F.col(text).cast("string").alias(body))
    few = repeated.count() <= small
    if few:
        held = repeated.toArrow()
        column = lambda c: held.column(c).combine_chunks()
        keeper = column("keeper")
        shared = sc.broadcast(_Keepers(*(column(c).to_numpy().view(np.uint64) for c in ("lo", "hi")), pc.fill_null(keeper, 0).to_numpy(), keeper.is_valid().to_numpy(zero_copy_only=False)))
        scratch.clear()
        whole = whole.withColumn(lost, F.lit(None).cast("array<struct<lo:bigint,hi:bigint>>"))
    else:
        gone = suspects.join(repeated, ["lo", "hi"]).where(~F.col("doc").eqNullSafe(F.col("keeper")))
        gone = cut(gone.groupBy("doc").agg(F.collect_set(F.struct("lo", "hi")).alias(lost)))
        scratch.clear()
        whole = whole.join(gone.withColumnRenamed("doc", doc + "_"), F.col(doc).eqNullSafe(F.col(doc + "_")), "left").drop(doc + "_")

    def apply(batches):
        keepers = shared.value if few else None
        for batch in slices(batches, ROWS):
            column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            lines = Lines(column(body), least)
            of = lines.of[lines.at]
            if few:
                place = keepers.find(lines.keys)
                hit = np.flatnonzero(place >= 0)
                own = column(doc)
                at = place[hit]
                known, keeper = keepers.known[at], keepers.keeper[at]
                mine, valid = pc.fill_null(own, 0).to_numpy()[of[hit]], own.is_valid().to_numpy(zero_copy_only=False)[of[hit]]
                hit = hit[(known != valid) | (known & (keeper != mine))]
            else:
                wanted = [None if v is None else {(x["lo"], x["hi"]) for x in v} for v in column(lost).to_pylist()]
                pairs = zip(of.tolist(), lines.keys["lo"].view(np.int64).tolist(), lines.keys["hi"].view(np.int64).tolist(), strict=True)
                hit = np.array([i for i, (d, lo, hi) in enumerate(pairs) if wanted[d] and (lo, hi) in wanted[d]], dtype=np.int64)
            dropped = np.zeros(len(lines.of), dtype=bool)
            dropped[lines.at[hit]] = True
            n = np.bincount(lines.of, dropped, minlength=batch.num_rows).astype(np.int64)
            kept = pc.fill_null(column(body), "").to_pylist()
            ends = np.cumsum(lines.count)
            for d in np.flatnonzero(n):
                own = slice(ends[d] - lines.count[d], ends[d])
                kept[d] = "\n".join(lines.lines[own].filter(pa.array(~dropped[own])).to_pylist())
            yield pa.RecordBatch.from_arrays([*map(column, taken), pa.array(lines.count), pa.array(n), pa.array(kept, pa.string())], names=[*taken, *new])

    return whole.mapInArrow(apply, with_fields(docs.select(*taken).schema, n_lines="long", n_dropped="long", kept="string"))
