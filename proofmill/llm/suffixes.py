"""Suffix-array dedup: removes every byte that lies in a string of 100 bytes which also starts earlier.

Suffixes are dealt out by content: the smallest hash among the 32-byte strings of a 100-byte window
is the same wherever the window stands, so equal windows meet under one hash, each with the few
bytes around it. There, their suffixes are ordered to a depth of 100 bytes: deep-shallow, by a
multikey quicksort over words to a shallow depth, then by blind tries for groups that still agree.
Only windows whose hash occurs more than once travel. A Bloom filter of those hashes decides that
where they are few enough for one of fixed size (its false positives cost work, never results);
where they are more, a join does.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.llm.arrays import running
from proofmill.llm.arrow import slices, unused, with_fields
from proofmill.tables import Scratch, cut

#: Bytes of a repeated string, and of the strings whose hashes choose where it is compared.
LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM + 1
#: Bytes that the multikey quicksort orders before blind tries take over.
SHALLOW = 64
#: Groups with more contexts than this are sorted in parts first; what is left of each part is merged by digest.
HOT = 20_000
#: Most contexts that are sorted together, unless one group has more.
CHUNK = 10_000
#: Log2 of the least and most bits of the Bloom filter (32 MB), bits for each hash, its odd multipliers, and bytes of one row of it.
BITS, EACH, CELLS, SLICE = (20, 28), 12, [(0xC2B2AE3D27D4EB4F * (2 * i + 3) + 2 * i) % 2**64 | 1 for i in range(3)], 1 << 16
#: Rows (runs, if a row lists them) of a side that is broadcast; larger ones are shuffled.
SMALL = 1_000_000
#: Rows that a worker takes at a time.
ROWS = 500
FACTORS = [np.uint64(pow(0x9E3779B97F4A7C15, 1 << j, 2**64)) for j in range(5)]


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that share their smallest 32-byte hash: the hash, its place, first and last window start.

    Of equal hashes in a window the leftmost counts. A text shorter than a window has none.
    """
    if len(data) < LENGTH:
        return (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 3
    h = data.astype(np.uint64) + np.uint64(1)
    for j, factor in enumerate(FACTORS):
        h = h[: len(h) - (1 << j)] * factor + h[1 << j :]
    h ^= h >> np.uint64(29)
    h *= np.uint64(CELLS[0])
    h ^= h >> np.uint64(32)
    at, width = np.arange(len(h), dtype=np.int32), 1
    while width < SPAN:
        step = min(width, SPAN - width)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(h[left] <= h[right], left, right)
        width += step
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    place = at[first].astype(np.int64)
    return h[place], place, first, np.concatenate([first[1:], [len(at)]]) - 1


def blind_order(strings: list[bytes]) -> list[list[int]]:
    """Indices of strings of one length in order of content, equal ones together (as given), by a blind trie.

    Inner nodes know a depth and branch on one byte there. A string goes down by its bytes at those
    depths alone, is compared with one leaf of the place it comes to, and is put in where they first
    differ; reading the branches in order of their bytes gives the strings in order.
    """
    root: list | int = 0
    leaves = {0: [0]}
    for i in range(1, len(strings)):
        s = strings[i]
        node = root
        while isinstance(node, list):
            node = node[1].get(s[node[0]]) if s[node[0]] in node[1] else next(iter(node[1].values()))
        t = strings[node]
        if s == t:
            leaves[node].append(i)
            continue
        leaves[i] = [i]
        lo, hi = 0, len(s)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if s[:mid] == t[:mid] else (lo, mid - 1)
        above, node = None, root
        while isinstance(node, list) and node[0] < lo:
            above, node = node, node[1][s[node[0]]]
        if isinstance(node, list) and node[0] == lo:
            node[1][s[lo]] = i
        else:
            new = [lo, {t[lo]: node, s[lo]: i}]
            if above is None:
                root = new
            else:
                above[1][s[above[0]]] = new
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if isinstance(node, list):
            todo += [child for _, child in sorted(node[1].items(), reverse=True)]
        else:
            out.append(leaves[node])
    return out


def multikey_quicksort(words: np.ndarray, place: np.ndarray, label: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of strings by label, then by their first ``depth`` bytes (a multiple of 8); the bucket of each place of that order.

    ``words[i]`` are the 8 bytes from place i on, as big-endian numbers. All open buckets are parted at once: by
    the median of three of their words into smaller, equal and larger ones, of which the equal go
    on with the next word. Strings that agree in all of it share a bucket, in the order given.
    """
    order = np.argsort(label, kind="stable")
    begins = np.concatenate([[True], label[order][1:] != label[order][:-1]]) if len(order) else np.zeros(0, bool)
    at = np.zeros(len(order), dtype=np.int64)
    while True:
        starts = np.flatnonzero(begins)
        sizes = np.diff(np.append(starts, len(order)))
        open_ = (sizes > 1) & (at[starts] < depth)
        starts, sizes = starts[open_], sizes[open_]
        if not len(starts):
            return order, np.cumsum(begins) - 1
        first = np.cumsum(sizes) - sizes  # of each open bucket among the open places
        bucket = np.repeat(np.arange(len(sizes)), sizes)
        places = np.arange(len(bucket)) - first[bucket] + starts[bucket]
        mine = order[places]
        key = words[place[mine] + at[places]]
        a, b, c = key[first], key[first + sizes // 2], key[first + sizes - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[bucket]
        side = (key >= pivot).astype(np.int8) + (key > pivot)
        target, behind = np.zeros(len(bucket), dtype=np.int64), starts.copy()
        for k in range(3):
            here = side == k
            rank = np.cumsum(here)
            before = rank[first] - here[first]
            target[here] = (behind[bucket] + rank - 1 - before[bucket])[here]
            count = np.add.reduceat(here, first, dtype=np.int64)
            begins[behind[count > 0]] = True
            behind += count
        order[target] = mine
        step = at[places] + 8 * (side == 1)
        at[target] = step


def window_order(group: np.ndarray, start: np.ndarray, count: np.ndarray, rel: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the windows of many groups, and for each place of it whether the window equals the one before.

    Context k has ``count[k]`` windows from ``data[start[k]]`` on, its anchor ``rel[k]`` bytes behind
    the first; contexts are given in the order that counts as earlier. Equal windows are in one group
    and have their anchor at the same place, so those two deal out the first buckets; windows alone
    in theirs are left out. Equal windows stay in the order given.
    """
    context = np.repeat(np.arange(len(count)), count)
    step = np.arange(len(context)) - np.repeat(np.cumsum(count) - count, count)
    place, label = start[context] + step, group[context] * SPAN + rel[context] - step
    _, label, sizes = np.unique(label, return_inverse=True, return_counts=True)
    live = np.flatnonzero(sizes[label] > 1)
    words = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    values = np.ascontiguousarray(words).view(">u8").ravel().astype(np.uint64)
    order, bucket = multikey_quicksort(values, place[live], label[live], SHALLOW)
    order = live[order]
    equal = np.zeros(len(order), dtype=bool)
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(order) else np.zeros(0, int)
    sizes = np.diff(np.append(starts, len(order)))
    raw = data.tobytes()
    for at, size in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
        own = order[at : at + size].copy()
        strings = [raw[p + SHALLOW : p + LENGTH] for p in place[own].tolist()]
        if size == 2:
            equal[at + 1] = strings[0] == strings[1]
            if strings[1] < strings[0]:
                order[at : at + 2] = own[::-1]
            continue
        leaves = blind_order(strings)
        order[at : at + size] = own[[i for leaf in leaves for i in leaf]]
        equal[at : at + size] = [k > 0 for leaf in leaves for k in range(len(leaf))]
    return order, equal


def first_windows(group: np.ndarray, start: np.ndarray, count: np.ndarray, rel: np.ndarray, data: np.ndarray) -> np.ndarray:
    """For each window, as given to ``window_order``, whether an equal one comes before it."""
    order, equal = window_order(group, start, count, rel, data)
    later = np.zeros(int(count.sum()), dtype=bool)
    later[order[equal]] = True
    return later


def _mask(hashes: np.ndarray, bits: int, cell: int) -> np.ndarray:
    return (hashes * np.uint64(cell)) >> np.uint64(64 - bits)


def _small(df: DataFrame, weight: str = "1") -> DataFrame:
    """``df``, to be broadcast if it is a written table of few rows (or of little ``weight`` in all)."""
    return F.broadcast(df) if (df.agg(F.sum(F.expr(weight))).first()[0] or 0) <= SMALL else df


def _bloom(repeated: DataFrame) -> tuple[np.ndarray, int]:
    """Bit array of all repeated hashes, its size by their number; the caller bounds that by ``BITS``."""
    bits = max(BITS[0], (EACH * repeated.count()).bit_length())

    def fill(batches):
        own = np.zeros(1 << (bits - 3), dtype=np.uint8)
        for batch in batches:
            hashes = batch.column(0).to_numpy().view(np.uint64)
            for cell in CELLS:
                at = _mask(hashes, bits, cell)
                np.bitwise_or.at(own, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        for i, part in enumerate(np.split(own, max(1, len(own) // SLICE))):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([part.tobytes()], pa.binary())], names=["slice", "part"])

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(SLICE, dtype=np.uint8)
        for part in rows["part"]:
            total |= np.frombuffer(part, dtype=np.uint8)
        return pd.DataFrame({"slice": [rows["slice"].iloc[0]], "part": [total.tobytes()]})

    parts = repeated.mapInArrow(fill, "slice long, part binary").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(1024)))
    parts = parts.groupBy("slice", "salt").applyInPandas(merge, "slice long, part binary").groupBy("slice").applyInPandas(merge, "slice long, part binary")
    out = np.zeros(1 << (bits - 3), dtype=np.uint8)
    for r in parts.collect():
        out[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["part"], dtype=np.uint8)
    return out, bits


def _hashes(docs: DataFrame) -> DataFrame:
    """Hashes of all runs with their number in each batch."""

    def run(batches):
        for batch in slices(batches, ROWS):
            found = [anchors(np.frombuffer(t.encode("utf-8", "surrogatepass"), dtype=np.uint8))[0] for t in batch.column(0).to_pylist()]
            values, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts)], names=["hash", "n"])

    return docs.select("text").mapInArrow(run, "hash long, n long")


CONTEXT = "hash long, doc long, mark long, lo int, windows int, rel int, bytes binary"


def _starts(docs: DataFrame) -> DataFrame:
    """The different hashes of each document's runs, with a number for the document."""

    def run(batches):
        for batch in slices(batches, ROWS):
            found = [np.unique(anchors(np.frombuffer(t.encode("utf-8", "surrogatepass"), dtype=np.uint8))[0]) for t in batch.column(1).to_pylist()]
            count = [len(h) for h in found]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), count))], names=["hash", "row"])

    return docs.select(_row().alias("row"), "text").mapInArrow(run, "hash long, row long")


def _row():
    """A number for a document; two may share one, which only lets more of their windows travel."""
    return F.xxhash64("doc", "mark")


def _contexts(docs: DataFrame, repeated: DataFrame, scratch: Scratch) -> DataFrame:
    """Runs of windows whose hash may be repeated, with the bytes of their windows.

    Of equal contexts in a batch only the earliest keeps its bytes: the others are wholly repeated.
    Few repeated hashes go to the workers as a Bloom filter of at most 2**BITS[1] bits; more are
    joined with the documents' hashes, and each document gets the list of its own.
    """
    filtered = repeated.count() * EACH < 1 << BITS[1]
    table, bits = _bloom(repeated) if filtered else (None, 0)
    shared = docs.sparkSession.sparkContext.broadcast(table) if filtered else None
    if filtered:
        docs = docs.select("doc", "mark", "text", F.lit(None).cast("array<bigint>").alias("wanted"))
    else:
        lists = scratch.cut(_starts(docs).join(repeated, "hash").groupBy("row").agg(F.collect_set("hash").alias("wanted")))
        docs = docs.withColumn("row", _row()).join(lists, "row").select("doc", "mark", "text", "wanted")

    def chosen(h: np.ndarray, wanted) -> np.ndarray:
        if wanted is not None:
            return np.isin(h, np.array(wanted, dtype=np.int64).view(np.uint64))
        maybe, table = np.ones(len(h), dtype=bool), shared.value
        for cell in CELLS:
            at = _mask(h, bits, cell)
            maybe &= (table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
        return maybe

    def run(batches):
        for batch in slices(batches, 4 * ROWS):
            rows = sorted({r[:2]: r for r in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)}.values(), key=lambda r: r[:2])
            out, seen = [[] for _ in range(7)], set()
            for doc, mark, text, wanted in rows:
                raw = text.encode("utf-8", "surrogatepass")
                h, place, lo, hi = anchors(np.frombuffer(raw, dtype=np.uint8))
                maybe = chosen(h, wanted)
                for x, p, a, b in zip(h[maybe].view(np.int64).tolist(), place[maybe].tolist(), lo[maybe].tolist(), hi[maybe].tolist(), strict=True):
                    own = raw[a : b + LENGTH]
                    key = (x, p - a, own)
                    for column, value in zip(out, (x, doc, mark, a, b - a + 1, p - a, None if key in seen else own), strict=True):
                        column.append(value)
                    seen.add(key)
            kinds = [pa.int64()] * 3 + [pa.int32()] * 3 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["hash", "doc", "mark", "lo", "windows", "rel", "bytes"])

    return docs.mapInArrow(run, CONTEXT)


def _compare(rows: pd.DataFrame) -> pa.RecordBatch:
    """Runs of windows (first and last start) of the given whole groups that stand earlier too."""
    rows = rows.sort_values(["hash", "doc", "mark", "lo"], ignore_index=True).drop_duplicates(["hash", "doc", "mark", "lo"], ignore_index=True)
    rows = rows[rows.duplicated("hash", keep=False)].reset_index(drop=True)
    same = rows.duplicated(["hash", "rel", "bytes"])
    whole, rows = rows[same], rows[~same].reset_index(drop=True)
    rows = rows[rows.duplicated("hash", keep=False)].reset_index(drop=True)
    data = np.frombuffer(b"".join(rows["bytes"]), dtype=np.uint8)
    sizes = rows["bytes"].map(len).to_numpy(np.int64)
    count = rows["windows"].to_numpy(np.int64)
    later = first_windows(pd.factorize(rows["hash"])[0].astype(np.int64), np.cumsum(sizes) - sizes, count, rows["rel"].to_numpy(np.int64), data)
    context = np.repeat(np.arange(len(count)), count)
    start = rows["lo"].to_numpy(np.int64)[context] + np.arange(len(context)) - np.repeat(np.cumsum(count) - count, count)
    at = np.flatnonzero(later)
    breaks = (np.diff(at) != 1) | (np.diff(context[at]) != 0)
    first, last = at[np.concatenate([[True], breaks])] if len(at) else at, at[np.concatenate([breaks, [True]])] if len(at) else at
    parts = [pa.array(np.concatenate([whole[c].to_numpy(np.int64), rows[c].to_numpy(np.int64)[context[first]]])) for c in ("doc", "mark")]
    low = np.concatenate([whole["lo"].to_numpy(np.int64), start[first]])
    high = np.concatenate([whole["lo"].to_numpy(np.int64) + whole["windows"].to_numpy(np.int64) - 1, start[last]])
    return pa.RecordBatch.from_arrays([*parts, pa.array(low), pa.array(high)], names=["doc", "mark", "low", "high"])


RUNS = "doc long, mark long, low long, high long"


def _sorted_runs(contexts: DataFrame) -> DataFrame:
    """Repeated windows of groups of bounded size, group by group."""

    def run(batches):
        held: pd.DataFrame | None = None
        for batch in batches:
            rows = batch.to_pandas()
            rows = rows if held is None else pd.concat([held, rows], ignore_index=True)
            open_ = rows["hash"].to_numpy() == rows["hash"].iloc[-1] if len(rows) else np.zeros(0, bool)
            if len(rows) - open_.sum() >= CHUNK:
                yield _compare(rows[~open_])
                rows = rows[open_]
            held = rows
        if held is not None and len(held):
            yield _compare(held)

    return contexts.repartition("hash").sortWithinPartitions("hash").mapInArrow(run, RUNS)


def _parted_runs(contexts: DataFrame, scratch: Scratch) -> DataFrame:
    """Repeated windows of very large groups: sorted in parts as they come, then the first windows of all parts by digest.

    A window that is not the first in its part is repeated. The first ones travel as 128-bit digests
    without bytes; of each digest all but the earliest are repeated, too.
    """

    def run(batches):
        for batch in slices(batches, CHUNK):
            rows = batch.to_pandas().sort_values(["hash", "doc", "mark", "lo"], ignore_index=True).drop_duplicates(["hash", "doc", "mark", "lo"], ignore_index=True)
            sizes, count = rows["bytes"].map(len).to_numpy(np.int64), rows["windows"].to_numpy(np.int64)
            start = np.cumsum(sizes) - sizes
            raw = b"".join(rows["bytes"])
            later = first_windows(pd.factorize(rows["hash"])[0].astype(np.int64), start, count, rows["rel"].to_numpy(np.int64), np.frombuffer(raw, dtype=np.uint8))
            context = np.repeat(np.arange(len(count)), count)
            step = np.arange(len(context)) - np.repeat(np.cumsum(count) - count, count)
            digests = [(0, 0) if gone else divmod(xxhash.xxh3_128_intdigest(raw[p : p + LENGTH]), 1 << 64) for p, gone in zip((start[context] + step).tolist(), later.tolist(), strict=True)]
            x, y = (pa.array(np.array([d[i] for d in digests], dtype=np.uint64).view(np.int64), mask=later) for i in (0, 1))
            low = rows["lo"].to_numpy(np.int64)[context] + step
            yield pa.RecordBatch.from_arrays([x, y, pa.array(rows["doc"].to_numpy(np.int64)[context]), pa.array(rows["mark"].to_numpy(np.int64)[context]), pa.array(low)], names=["x", "y", "doc", "mark", "low"])

    each = scratch.cut(contexts.mapInArrow(run, "x long, y long, doc long, mark long, low long"))
    place = F.struct("doc", "mark", "low")
    first = scratch.cut(each.where("x is not null").groupBy("x", "y").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    merged = each.where("x is not null").join(_small(first), ["x", "y"]).where(place > F.col("first"))
    return each.where("x is null").unionByName(merged.drop("first")).select("doc", "mark", "low", F.col("low").alias("high"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", whole: str | None = None) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (binary: remaining bytes joined).

    Texts are UTF-8 bytes, null counts as empty; matches never cross documents. A byte goes if a
    string of 100 bytes over it also starts earlier: in a document of smaller key, or before in its
    own. Of equal keys the one of smaller text hash comes first, a null key before all; rows equal in
    key and text are one document, and each gets its result. Columns of the new names are replaced.
    ``whole`` names a further column: the remaining bytes as text, without the rests of characters
    that lost a byte, and null for a null text.
    """
    new = ["n_bytes", "n_removed", "n_spans", "kept", *([whole] if whole else [])]
    base = docs.drop(*(c for c in new if c != text))
    body = F.coalesce(F.col(text), F.lit(""))
    lowest = F.lit(-(2**63)).cast("bigint")
    order = {"doc": F.coalesce(F.col(key).cast("bigint"), lowest), "mark": F.xxhash64(body)}
    rows = base.select(*[c.alias(n) for n, c in order.items()], body.alias("text"))

    # documents equal to an earlier one are wholly repeated and repeat nothing that is not earlier
    digest = F.struct(F.sha2("text", 256).alias("sha"), F.octet_length("text").alias("size"))
    scratch = Scratch()
    marked = scratch.cut(rows.where(F.octet_length("text") >= LENGTH).select("doc", "mark", digest.alias("digest")).distinct())
    earliest = marked.groupBy("digest").agg(F.min(F.struct("doc", "mark")).alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = scratch.cut(marked.join(earliest, "digest").where(F.struct("doc", "mark") > F.col("first")).select("doc", "mark"))
    first = rows.where(F.octet_length("text") >= LENGTH).join(_small(copies), ["doc", "mark"], "left_anti")

    repeated = scratch.cut(_hashes(first).groupBy("hash").agg(F.sum("n").alias("n")).where("n > 1").select("hash"))
    contexts = scratch.cut(_contexts(first, repeated, scratch))
    shipped = contexts.where(F.col("bytes").isNotNull())
    hot = scratch.cut(shipped.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("hash"))
    resolved = contexts.where(F.col("bytes").isNull()).select("doc", "mark", F.col("lo").cast("bigint").alias("low"), (F.col("lo") + F.col("windows") - 1).cast("bigint").alias("high"))
    runs = resolved.union(_sorted_runs(shipped.join(_small(hot), "hash", "left_anti"))).union(_parted_runs(shipped.join(_small(hot), "hash", "left_semi"), scratch))
    spans = runs.groupBy("doc", "mark").agg(F.array_sort(F.collect_list(F.struct("low", "high"))).alias("runs"))
    everything = F.array(F.struct(F.lit(0).cast("bigint").alias("low"), F.lit(2**40).alias("high")))
    doc, mark, found = unused(base.columns, "doc", "mark", "runs")
    spans = cut(spans.select("doc", "mark", "runs", running(F.transform("runs", lambda r: r["high"]), F.greatest, 0).alias("highs")).select("doc", "mark", _merged("runs", "highs").alias("runs")).union(copies.select("doc", "mark", everything)).toDF(doc, mark, found))
    scratch.clear()

    joined = base.join(_small(spans, f"size({found})"), (order["doc"] == F.col(doc)) & (order["mark"] == F.col(mark)), "left").drop(doc, mark)
    names = [c for c in base.columns if c not in new]

    def strip(batches):
        for batch in slices(batches, ROWS):
            out = [[] for _ in new]
            column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            for t, runs in zip(column(text).to_pylist(), column(found).to_pylist(), strict=True):
                raw = (t or "").encode("utf-8", "surrogatepass")
                keep, at, removed, n = [], 0, 0, 0
                for run in runs or ():
                    low, high = run["low"], min(len(raw), run["high"] + LENGTH)
                    n += low > at or not n
                    keep.append(raw[at:low])
                    removed += max(0, high - max(at, low))
                    at = max(at, high)
                kept = b"".join([*keep, raw[at:]])
                for values, value in zip(out, (len(raw), removed, n, kept, None if t is None else kept.decode("utf-8", "ignore") if removed else t), strict=False):
                    values.append(value)
            kinds = [pa.int64()] * 3 + [pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([*map(column, names), *(pa.array(c, k) for c, k in zip(out, kinds, strict=False))], names=[*names, *new])

    fields = dict(zip(new, ["long"] * 3 + ["binary", "string"], strict=False))
    return joined.mapInArrow(strip, with_fields(joined.select(*names).schema, **fields))


def _merged(runs: str, highs: str):
    """Sorted runs of window starts, those whose bytes overlap or touch as one; ``highs``: the largest end up to each."""
    first = F.filter(runs, lambda r, i: (i == 0) | (r["low"] > F.get(F.col(highs), i - 1) + LENGTH))
    last = F.filter(highs, lambda h, i: (i == F.size(runs) - 1) | (F.get(F.col(runs), i + 1)["low"] > h + LENGTH))
    return F.zip_with(first, last, lambda r, h: F.struct(r["low"].alias("low"), h.alias("high")))
