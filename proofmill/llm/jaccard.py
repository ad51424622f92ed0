"""N-gram Jaccard join: near-duplicate documents by shared word shingles, without loss.

Documents with equal shingle sets are one class. Rows of the document by n-gram incidence are
ordered by rarity; only the first columns of a row can decide whether a partner exists, so the
sparse product runs over those. It adds up shared columns for each pair of classes, block by block
of columns, and drops pairs whose count stays below what their sizes ask for. Columns that very
many classes share would make too many pairs: their classes are compared with the pivots of their
columns first. Only what then still lies apart is multiplied, in blocks of bounded bytes that share
a column and a band of sizes, and only where sizes and places in the rows allow a link at all.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofmill.llm.arrow import slices
from proofmill.llm.components import components
from proofmill.tables import Scratch, cut

#: Odd 64-bit multipliers of the places in a shingle.
PLACES = [np.uint64((0x9E3779B97F4A7C15 * (2 * i + 3) + 4 * i) % 2**64 | 1) for i in range(64)]
SHIFTS = (np.uint64(31), np.uint64(29))
#: Counters of the rarity sketch and the counters that one row of it holds.
SLOTS, SLICE = 1 << 20, 1 << 16
#: Columns with more classes than this go by pivots; pivots that a class is compared with.
WIDE, PIVOTS = 32, 8
#: Words whose hashes a worker keeps, and rows that it takes at a time.
KEPT, ROWS = 150_000, 500
#: Sizes of a band differ by this factor at most; bytes of one side of a block at most, unless one class alone has more.
BAND, BLOCK = 1.05, 4 << 20
#: Sides up to this many rows (of ids only) are broadcast; larger ones are shuffled.
SMALL = 1_000_000


class _Words(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KEPT:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


def shingles(text: str | None, words: _Words, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles of a whole text; a shorter text is one shingle, an empty one has none.

    Capitals A-Z count as small letters; words end at spaces and the characters 9 to 13.
    """
    if not text:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.array(list(map(words.__getitem__, text.encode("utf-8", "surrogatepass").lower().split())), dtype=np.uint64)
    n = min(size, len(hashes))
    if not n:
        return hashes
    total = hashes[: len(hashes) - n + 1] * PLACES[0] + np.uint64(n)
    for k in range(1, n):
        total += hashes[k : len(hashes) - n + 1 + k] * PLACES[k]
    total ^= total >> SHIFTS[0]
    total *= PLACES[1]
    total ^= total >> SHIFTS[1]
    return np.unique(total)


def _small(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if it is a written table of few rows."""
    return F.broadcast(df) if df.count() <= SMALL else df


def _least(n: np.ndarray | int, percent: int):
    """The fewest columns that a set of n shares with any partner."""
    return -(-percent * n // 100)


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """One pass: a row for each document (set size and fingerprint), and rows of the rarity sketch of each task."""
    names = ["doc_id", "text_hash", "n_shingles", "fp", "slice", "counts"]

    def run(batches):
        words, counts = _Words(), np.zeros(SLOTS, dtype=np.int64)
        for batch in slices(batches, ROWS):
            own, sizes, marks, places = [batch.column(0), batch.column(2)], [], [], [np.zeros(0, np.int64)]
            for text in batch.column(1).to_pylist():
                s = shingles(text, words, size)
                places.append((s >> np.uint64(44)).astype(np.int64))
                sizes.append(len(s))
                marks.append(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64) if len(s) else None)
            np.add.at(counts, *np.unique(np.concatenate(places), return_counts=True))
            none = pa.nulls(len(sizes), pa.int32())
            yield pa.RecordBatch.from_arrays([*own, pa.array(sizes, pa.int64()), pa.array(marks, pa.int64()), none, pa.nulls(len(sizes), pa.binary())], names=names)
        parts = SLOTS // SLICE
        packed = [np.minimum(c, 65535).astype("<u2").tobytes() for c in np.split(counts, parts)]
        empty = pa.nulls(parts, pa.int64())
        yield pa.RecordBatch.from_arrays([empty, empty, empty, empty, pa.array(range(parts), pa.int32()), pa.array(packed, pa.binary())], names=names)

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, "doc_id long, text_hash long, n_shingles long, fp long, slice int, counts binary")


def _sketch(sets: DataFrame) -> np.ndarray:
    """Sums of all tasks' counters: an array of fixed size, whatever the input."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(SLICE, dtype=np.int64)
        for c in rows["counts"]:
            total += np.frombuffer(c, dtype=rows["kind"].iloc[0])
        return pd.DataFrame({"slice": [rows["slice"].iloc[0]], "kind": ["<i8"], "counts": [total.tobytes()]})

    rows = sets.where(F.col("slice").isNotNull()).select("slice", F.lit("<u2").alias("kind"), "counts", F.pmod(F.spark_partition_id(), F.lit(1024)).alias("salt"))
    schema = "slice int, kind string, counts binary"
    total = rows.groupBy("slice", "salt").applyInPandas(add, schema).groupBy("slice").applyInPandas(add, schema)
    out = np.zeros(SLOTS, dtype=np.int64)
    for r in total.collect():
        out[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["counts"], dtype="<i8")
    return np.minimum(out, 2**31 - 1).astype(np.int32)


def _first_columns(docs: DataFrame, sketch, size: int, percent: int) -> DataFrame:
    """The rarest columns of each row: as many as any partner must share one of.

    ``behind`` counts the columns of the row from this one on.
    """

    def run(batches):
        words, rarity = _Words(), sketch.value
        for batch in slices(batches, ROWS):
            grams, marks, sizes = [], [], []
            for text in batch.column(0).to_pylist():
                s = shingles(text, words, size)
                if len(s):
                    first = len(s) - _least(len(s), percent) + 1
                    grams.append(s[np.lexsort((s, rarity[(s >> np.uint64(44)).astype(np.int64)]))[:first]])
                    marks.append(xxhash.xxh3_64_intdigest(s.tobytes()))
                    sizes.append(len(s))
            count = [len(g) for g in grams]
            behind = np.concatenate([np.zeros(0, np.int32), *(np.arange(n, n - c, -1, dtype=np.int32) for n, c in zip(sizes, count, strict=True))])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *grams]).view(np.int64)), pa.array(np.repeat(np.array(marks, dtype=np.uint64), count).view(np.int64)), pa.array(np.repeat(np.array(sizes, dtype=np.int32), count)), pa.array(behind)], names=["gram", "fp", "n", "behind"])

    return docs.select("text").mapInArrow(run, "gram long, fp long, n int, behind int")


def _fits(a: str, b: str, percent: int):
    """Sizes that two sets of the asked similarity can have."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with ``shared`` (exact overlap) and both sizes."""

    def run(batches):
        for batch in slices(batches, ROWS):
            rows = [np.frombuffer(x, dtype=np.uint64) for c in (2, 3) for x in batch.column(c).to_pylist()]
            n = batch.num_rows
            shared = [len(np.intersect1d(rows[i], rows[n + i], assume_unique=True)) for i in range(n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared, pa.int64()), pa.array(map(len, rows[:n]), pa.int64()), pa.array(map(len, rows[n:]), pa.int64())], names=["a", "b", "shared", "na", "nb"])

    second = sets.select(F.col("fp").alias("b"), F.col("members").alias("mb")).join(_small(pairs), "b")
    both = second.join(sets.select(F.col("fp").alias("a"), F.col("members").alias("ma")), "a").select("a", "b", "ma", "mb")
    return both.mapInArrow(run, "a long, b long, shared long, na long, nb long")


def _linked(percent: int):
    return F.col("shared") * 100 >= (F.col("na") + F.col("nb") - F.col("shared")) * percent


def _needed(a: str, b: str, percent: int):
    """The fewest columns that two linked sets of those sizes share."""
    return F.ceil((F.col(a) + F.col(b)) * percent / (100 + percent) - 1e-9)


def join(docs: DataFrame, size: int = 5, percent: int = 75, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_shingles``, ``component_id``, ``text_hash``, ``class_id`` for each document.

    Two documents link if 100 * |intersection| >= ``percent`` * |union| of their shingle sets;
    ``component_id`` is the smallest key reachable by links, itself included. Null and empty texts
    have no shingles and link with nothing; rows of a null key keep a null component. Repeated rows
    stay. Sets are compared by 64-bit hashes of shingles and named by a 64-bit fingerprint.
    ``text_hash`` (xxhash64 of the text) tells rows of a repeated or null key apart, and ``class_id``
    is equal for rows that links connect, whatever their keys; null for texts without shingles.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    sets = cut(_sets(rows, size))
    sketch = spark.sparkContext.broadcast(_sketch(sets))
    members = sets.where(F.col("slice").isNull()).select("doc_id", "text_hash", "n_shingles", "fp")

    scratch = Scratch()
    # columns that rows of two classes or more have among their first
    posted = _first_columns(rows, sketch, size, percent).repartition("gram")
    # all columns are asked for on both sides, so that they read the same exchange
    shared = posted.groupBy("gram").agg(F.min("fp").alias("low"), F.max("fp").alias("high"), F.min("n").alias("least"), F.min("behind").alias("few")).where("low <> high and least > 0 and few > 0").select("gram")
    live = scratch.cut(posted.join(shared, "gram").distinct())
    widths = live.groupBy("gram").agg((F.count("*") > WIDE).alias("wide"))
    live_w = live.join(widths, "gram")
    wide = scratch.cut(live_w.where("wide").drop("wide"))
    heavy = wide.groupBy("fp").agg(F.count("*").alias("heavy"))
    slim = live_w.where(~F.col("wide")).drop("wide").join(heavy, "fp", "left").withColumn("heavy", F.coalesce("heavy", F.lit(0)))

    # the sparse product: shared columns of each pair of classes, held against what the sizes ask for
    left, right = (slim.select("gram", F.col("fp").alias(x), F.col("n").alias(f"n{x}"), F.col("heavy").alias(f"h{x}")) for x in "ab")
    product = left.join(right, "gram").where(F.col("a") < F.col("b")).where(_fits("na", "nb", percent)).groupBy("a", "b", "na", "nb", "ha", "hb").agg(F.count("*").alias("count"))
    rest = lambda x: F.floor(F.col(x) * percent / 100)  # columns behind the first ones, at most
    product = scratch.cut(product.where(F.col("count") + F.least("ha", "hb") + F.greatest(rest("na"), rest("nb")) >= _needed("na", "nb", percent)).select("a", "b", "count"))

    # the pivot of a wide column is its class of most wide columns; a class meets the pivots of most of its columns
    pivots = scratch.cut(wide.join(heavy, "fp").groupBy("gram").agg(F.max(F.struct("heavy", F.col("fp").alias("pivot"), F.col("n").alias("np"))).alias("p")).select("gram", "p.pivot", "p.np"))
    met = wide.join(_small(pivots), "gram").where(F.col("fp") != F.col("pivot")).where(_fits("n", "np", percent)).groupBy("fp", "pivot").agg(F.count("*").alias("k"))
    order = Window.partitionBy("fp").orderBy(F.desc("k"), "pivot")
    starred = scratch.cut(met.withColumn("place", F.row_number().over(order)).where(F.col("place") <= PIVOTS).select(F.col("pivot").alias("a"), F.col("fp").alias("b")))

    # each class with its best partner and the pivots first; then only what still lies apart
    either = product.select("a", "b", "count").union(product.select(F.col("b").alias("a"), F.col("a").alias("b"), "count"))
    best = either.groupBy("a").agg(F.max_by("b", F.struct("count", "b")).alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    ends = product.select("a", "b").union(starred)
    asked = scratch.cut(ends.select(F.col("a").alias("fp")).union(ends.select("b")).union(wide.select("fp")).distinct())
    holders = sets.where(F.col("fp").isNotNull()).groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("keyless"), "doc_id", "text_hash")).alias("h"))
    holders = scratch.cut(holders.join(asked, "fp").select("fp", F.col("h.doc_id").alias("holder"), F.col("h.text_hash").alias("hash")))

    def gather(batches):
        words = _Words()
        for batch in slices(batches, ROWS):
            found = [shingles(t, words, size) for t in batch.column(1).to_pylist()]
            marks = [np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64) for s in found]
            right = np.array(marks, dtype=np.int64) == batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.array(marks, dtype=np.int64)[right]), pa.array([s.tobytes() for s, ok in zip(found, right, strict=True) if ok], pa.binary())], names=["fp", "members"])

    held = rows.join(_small(holders), F.col("doc_id").eqNullSafe(F.col("holder")) & (F.xxhash64("text") == F.col("hash"))).select("fp", "text")
    incidence = scratch.cut(held.mapInArrow(gather, "fp long, members binary").dropDuplicates(["fp"]))
    first = scratch.cut(_verified(scratch.cut(best.union(starred.select(F.least("a", "b"), F.greatest("a", "b"))).distinct()), incidence))
    near = scratch.held(components(first.where(_linked(percent))))

    # what is left: pairs of the product across components, and classes of a wide column across components
    label = near.select(F.col("id").alias("fp"), "component")
    apart = product.select("a", "b").join(label.select(F.col("fp").alias("a"), F.col("component").alias("ca")), "a", "left").join(label.select(F.col("fp").alias("b"), F.col("component").alias("cb")), "b", "left")
    apart = apart.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b").join(first.select("a", "b"), ["a", "b"], "left_anti")
    second = _verified(scratch.cut(apart), incidence)
    placed = scratch.cut(wide.join(label, "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    edges = first.where(_linked(percent)).select("a", "b").union(second.where(_linked(percent)).select("a", "b")).union(_across(placed, incidence, percent, scratch))
    final = scratch.held(components(edges))

    classes = members.where(F.col("fp").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("low"))
    classes = classes.join(final.select(F.col("id").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    classes = scratch.cut(classes)
    lows = scratch.cut(classes.groupBy("component").agg(F.min("low").alias("component_id")))
    named = cut(classes.join(_small(lows), "component").select("fp", "component", "component_id"))
    scratch.clear()
    out = members.join(_small(named), "fp", "left")
    return out.select(F.col("doc_id").alias(key), "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"), "text_hash", F.col("component").alias("class_id"))


def _bands(placed: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Classes by column, band of sizes and side, without bands of a single component.

    Let g be the first column that two linked classes share. All they share stands from g on, and
    sizes say how much that must be. So the smaller class stands on the "index" side of the band of
    its size if enough of its columns are left, and the larger one on the "probe" side of all bands
    of sizes that it can still link with.
    """
    band = lambda n: F.floor(F.log(n.cast("double")) / math.log(BAND)).cast("int")
    n, behind = F.col("n"), F.col("behind")
    columns = ["gram", "fp", "n", "behind", "component"]
    index = placed.where(behind >= _needed("n", "n", percent)).select(*columns, band(n).alias("band"), F.lit(True).alias("index"))
    low, high = F.ceil(n * percent / 100), F.least(n, F.floor(behind * (100 + percent) / percent + 1e-9) - n)
    probe = placed.where(low <= high).select(*columns, F.explode(F.sequence(band(F.greatest(low, F.lit(1))), band(high))).alias("band"), F.lit(False).alias("index"))
    both = index.unionByName(probe)
    # of each band: its components' extremes, and the component that most of its index has
    kinds = both.groupBy("gram", "band").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.bool_or("index").alias("i"), F.bool_or(~F.col("index")).alias("p")).where("c1 <> c2 and i and p")
    main = index.groupBy("gram", "band", "component").agg(F.count("*").alias("k")).groupBy("gram", "band").agg(F.max_by("component", F.struct("k", "component")).alias("main"))
    open_ = scratch.cut(kinds.join(main, ["gram", "band"]).select("gram", "band", "main"))
    return both.join(_small(open_), ["gram", "band"])


def _across(placed: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links between components of classes that share a wide column, at least one for each class and component it links to.

    In each band (see ``_bands``) index classes outside the main component meet all probes, those of
    the main component only probes outside it. A task multiplies the incidence of two blocks of
    bounded bytes and adds up overlaps.
    """
    sides = scratch.cut(_bands(placed, percent, scratch))
    minor = F.col("component") != F.col("main")
    # kind 0: minor index classes and all probes; kind 1: the main component's index classes and minor probes
    kinds = F.when(F.col("index"), F.array(F.when(minor, 0).otherwise(1))).otherwise(F.when(minor, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    dealt = sides.withColumn("kind", F.explode(kinds))
    parts = dealt.groupBy("gram", "band", "kind").agg(*[F.ceil(F.sum(F.when(F.col("index") == F.lit(side), F.col("n").cast("bigint") * 8)) / BLOCK).cast("int").alias(name) for name, side in (("ni", True), ("np", False))]).where("ni > 0 and np > 0")
    dealt = dealt.join(_small(scratch.cut(parts)), ["gram", "band", "kind"]).withColumn("part", F.pmod(F.xxhash64("fp", "gram"), F.when(F.col("index"), F.col("ni")).otherwise(F.col("np"))).cast("int"))
    rows = dealt.join(sets, "fp").select("gram", "band", "kind", "index", "part", F.when(F.col("index"), F.col("np")).otherwise(F.col("ni")).alias("over"), "fp", "component", "members")

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        join = lambda c: group[c].to_numpy(np.int64).tobytes()
        size = group["members"].map(len).to_numpy(np.int64) // 8
        return pd.DataFrame({c: [group[c].iloc[0]] for c in ("gram", "band", "kind", "index", "part", "over")} | {"fps": [join("fp")], "components": [join("component")], "sizes": [size.tobytes()], "members": [b"".join(group["members"])]})

    packed = rows.groupBy("gram", "band", "kind", "index", "part", "over").applyInPandas(pack, "gram long, band int, kind int, index boolean, part int, over int, fps binary, components binary, sizes binary, members binary")
    packed = packed.select("gram", "band", "kind", "index", "part", F.explode(F.sequence(F.lit(0), F.col("over") - 1)).alias("other"), F.struct("fps", "components", "sizes", "members").alias("x"))
    left = packed.where("index").select("gram", "band", "kind", F.col("part").alias("i"), F.col("other").alias("j"), F.col("x").alias("a"))
    right = packed.where("not index").select("gram", "band", "kind", F.col("part").alias("j"), F.col("other").alias("i"), F.col("x").alias("b"))

    def multiply(batches):
        for batch in slices(batches, 1):
            for row in batch.to_pylist():
                (fa, ca, sa), (fb, cb, sb) = ([np.frombuffer(row[x][c], dtype=np.int64) for c in ("fps", "components", "sizes")] for x in "ab")
                a, b = (np.frombuffer(row[x]["members"], dtype=np.uint64) for x in "ab")
                columns = np.unique(a)
                place = np.searchsorted(columns, b)
                hit = columns[np.minimum(place, len(columns) - 1)] == b
                place = np.where(hit, place, len(columns))
                starts, out = np.cumsum(sb) - sb, []
                for k, (at, n) in enumerate(zip((np.cumsum(sa) - sa).tolist(), sa.tolist(), strict=True)):
                    mark = np.zeros(len(columns) + 1, dtype=np.int32)
                    mark[np.searchsorted(columns, a[at : at + n])] = 1
                    shared = np.add.reduceat(mark[place], starts)
                    near = (shared * 100 >= (n + sb - shared) * percent) & (cb != ca[k])
                    _, first = np.unique(cb[near], return_index=True)
                    out += [(fa[k], x) for x in fb[near][first].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], names=["a", "b"])

    return left.join(right, ["gram", "band", "kind", "i", "j"]).select("a", "b").mapInArrow(multiply, "a long, b long")
