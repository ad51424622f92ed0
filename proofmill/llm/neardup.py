"""Near-duplicate vectors: hierarchical navigable small-world graphs, one for each shard.

A shard holds a bounded number of vectors of one label. Every vector asks every shard of its label.
A sample of the queries of each shard pair is held against brute force, a vector's match with itself
left out; while the recall of links (of nearest vectors where links are rare) is too low, the beam is
widened for all. Links count only if the cosine in double precision reaches the
threshold. Tasks return counts and spanning forests of the links they found, not all pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.llm.arrow import slices
from proofmill.llm.components import components
from proofmill.tables import cut, drop

#: Queries that walk the graph together, and nodes that each of them expands at a time.
BATCH, STEP = 256, 4
#: Audited labels that are broadcast at most; more are shuffled.
SMALL = 1_000_000
#: Shards whose vectors one task takes to a graph.
TOGETHER = 16


def _pick(points: np.ndarray, base: np.ndarray, cand: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
    """For each row up to ``m`` of its candidates (-1: none), spread out: one that is nearer to a chosen one than to the base waits.

    Rows left free by that are filled with the nearest of those that waited.
    """
    order = np.argsort(-sims, axis=1, kind="stable")
    cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
    n, c = cand.shape
    vectors = points[np.maximum(cand, 0)]
    between = np.einsum("ncd,ned->nce", vectors, vectors, optimize=True)
    valid = cand >= 0
    taken, waits = np.zeros((n, c), bool), np.zeros((n, c), bool)
    for j in range(c):
        near = (taken[:, :j] & (between[:, j, :j] > sims[:, j, None])).any(1)
        ok = valid[:, j] & (taken.sum(1) < m)
        taken[:, j], waits[:, j] = ok & ~near, ok & near
    spare = m - taken.sum(1)
    taken |= waits & (np.cumsum(waits, 1) <= spare[:, None])
    out = np.full((n, m), -1, dtype=np.int32)
    rows, cols = np.nonzero(taken)
    out[rows, (np.cumsum(taken, 1) - 1)[rows, cols]] = cand[rows, cols]
    return out


class Graph:
    """A navigable small-world graph of unit vectors; nodes of higher levels come first."""

    def __init__(self, points: np.ndarray, levels: list[int], lists: list[np.ndarray]):
        self.points, self.sizes, self.lists = points, levels, lists

    @classmethod
    def build(cls, points: np.ndarray, m: int = 12, beam: int = 48) -> Graph:
        """Insert nodes in batches: each finds its neighbours among the nodes before it and its own batch."""
        n = len(points)
        sizes = [n]
        while sizes[-1] > 4 * m:
            sizes.append(sizes[-1] // m)
        graph = cls(points, sizes, [np.full((size, m if level else 2 * m), -1, dtype=np.int32) for level, size in enumerate(sizes)])
        at = min(n, sizes[-1])
        graph._link(0, at, None, m)
        while at < n:
            end = min(n, at + min(BATCH, at), min(s for s in sizes if s > at))
            graph._link(at, end, beam, m)
            at = end
        return graph

    def _link(self, start: int, end: int, beam: int | None, m: int) -> None:
        mine = np.arange(start, end, dtype=np.int32)
        own = self.points[start:end] @ self.points[start:end].T
        np.fill_diagonal(own, -np.inf)
        mates = np.tile(mine, (len(mine), 1))
        np.fill_diagonal(mates, -1)
        top = max(level for level, size in enumerate(self.sizes) if size >= end)
        entry = None
        for level in range(len(self.lists) - 1, -1, -1):
            cand, sims = mates, own
            if start:
                found = self.walk(self.points[start:end], level, beam if level <= top else 1, entry, start)
                entry = found[0][:, :1]
                if level > top:
                    continue
                k = min(2 * m, mates.shape[1])
                some = np.argpartition(-own, k - 1, axis=1)[:, :k] if k else np.zeros((len(mine), 0), int)
                cand = np.concatenate([found[0], np.take_along_axis(mates, some, 1)], 1)
                sims = np.concatenate([found[1], np.take_along_axis(own, some, 1)], 1)
            elif level > top:
                continue
            chosen = _pick(self.points, mine, cand, np.where(cand < 0, -np.inf, sims), self.lists[level].shape[1] // (1 if level else 2))
            lists = self.lists[level]
            lists[start:end, : chosen.shape[1]] = chosen
            self._back(level, mine, chosen)

    def _back(self, level: int, mine: np.ndarray, chosen: np.ndarray) -> None:
        """Edges back from the chosen nodes; those with too many choose anew."""
        lists = self.lists[level]
        rows, cols = np.nonzero(chosen >= 0)
        to, frm = chosen[rows, cols], mine[rows]
        order = np.argsort(to, kind="stable")
        to, frm = to[order], frm[order]
        nodes, first, count = np.unique(to, return_index=True, return_counts=True)
        width = lists.shape[1]
        new = np.full((len(nodes), int(count.max(initial=0))), -1, dtype=np.int32)
        new[np.repeat(np.arange(len(nodes)), count), np.arange(len(to)) - np.repeat(first, count)] = frm
        for at in range(0, len(nodes), BATCH):
            part, add = nodes[at : at + BATCH], new[at : at + BATCH]
            add = np.where((add[:, :, None] == lists[part][:, None, :]).any(2), -1, add)
            both = np.concatenate([lists[part], add], 1)
            sims = np.where(both < 0, -np.inf, np.einsum("ncd,nd->nc", self.points[np.maximum(both, 0)], self.points[part]))
            full = (both >= 0).sum(1) > width
            keep = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable")[:, :width], 1)
            if full.any():
                keep[full] = _pick(self.points, part[full], both[full], sims[full], width)
            lists[part] = keep

    def walk(self, queries: np.ndarray, level: int, beam: int, entry: np.ndarray | None, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first walks of one level over nodes before ``limit``: up to ``beam`` nodes a query (-1: none) and their cosines, best first."""
        n, lists = len(queries), self.lists[level]
        size = min(len(lists), limit)
        seen = np.zeros((n, size), bool)
        ids = np.full((n, beam), -1, dtype=np.int32)
        sims = np.full((n, beam), -np.inf, dtype=np.float32)
        ids[:, 0] = 0 if entry is None else entry[:, 0]
        sims[:, 0] = np.einsum("nd,nd->n", self.points[ids[:, 0]], queries)
        seen[np.arange(n), ids[:, 0]] = True
        open_ = ids >= 0
        live = np.arange(n)
        while len(live):
            rank = np.where(open_[live], sims[live], -np.inf)
            step = min(STEP, beam)
            best = np.argpartition(-rank, step - 1, axis=1)[:, :step]
            nodes = np.where(np.take_along_axis(rank, best, 1) > -np.inf, np.take_along_axis(ids[live], best, 1), -1)
            going = (nodes >= 0).any(1)
            live, best, nodes = live[going], best[going], nodes[going]
            if not len(live):
                break
            open_[live[:, None], best] = False
            near = np.where(nodes[:, :, None] >= 0, lists[np.maximum(nodes, 0)], -1).reshape(len(live), -1)
            near[near >= size] = -1
            near = np.sort(near, axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            rows = np.arange(len(live))[:, None]
            near[seen[live][rows, np.maximum(near, 0)] & (near >= 0)] = -1
            r, c = np.nonzero(near >= 0)
            seen[live[r], near[r, c]] = True
            far = np.full(near.shape, -np.inf, dtype=np.float32)
            far[r, c] = np.einsum("nd,nd->n", self.points[near[r, c]], queries[live[r]])
            all_ids, all_sims = np.concatenate([ids[live], near], 1), np.concatenate([sims[live], far], 1)
            all_open = np.concatenate([open_[live], near >= 0], 1)
            top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids[live], sims[live], open_[live] = (np.take_along_axis(x, top, 1) for x in (all_ids, all_sims, all_open))
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest nodes found from the top level down."""
        entry = None
        for level in range(len(self.lists) - 1, 0, -1):
            entry = self.walk(queries, level, 4, entry, len(self.points))[0][:, :1]
        return self.walk(queries, 0, min(beam, len(self.points)), entry, len(self.points))


class Audit:
    """What brute force says of a sample of the queries: their links, and the cosine of their nearest node.

    A query's own node (``own``, -1: none) counts as neither. The sample grows until ``linked`` of
    its queries have links, or to ``most`` queries.
    """

    def __init__(self, points: np.ndarray, queries: np.ndarray, least: float, own: np.ndarray, audit: int, linked: int = 64, most: int = 1024):
        n, count, rows, nodes, best = len(points), 0, [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0)]
        spread = np.unique(np.linspace(0, len(queries) - 1, min(most, len(queries))).astype(int))
        spread = np.concatenate([spread[i :: -(-len(spread) // audit)] for i in range(-(-len(spread) // audit))])
        for at in range(0, len(spread), audit):
            some = spread[at : at + audit]
            cosines = queries[some] @ points.T
            mine = np.nonzero(own[some] >= 0)[0]
            cosines[mine, own[some[mine]]] = -np.inf
            r, c = np.nonzero(cosines >= least)
            rows.append(r + at)
            nodes.append(c)
            best.append(cosines.max(1, initial=-np.inf))
            count += len(np.unique(r))
            if count >= linked:
                break
        self.n, self.linked, self.best = n, linked // 2, np.concatenate(best)
        self.sample = spread[: len(self.best)]
        self.own = own[self.sample]
        self.rows, self.links = np.concatenate(rows), np.concatenate(rows) * n + np.concatenate(nodes)

    def passes(self, ids: np.ndarray, sims: np.ndarray, slack: float, recall: float) -> bool:
        """Whether walks of the sample found the share ``recall`` of all links, and of a linked query's on average.

        Where fewer than half of ``linked`` queries count, so many walks must have found a nearest
        node, too. Queries whose whole beam is linked are left out, as they get a wider one.
        ``asked`` and ``found`` then say how many links (and nearest nodes) that were, and how many were found.
        """
        narrow = ~(sims[:, -1] >= slack)
        r, c = np.nonzero((sims >= slack) & (ids >= 0))
        asked = narrow[self.rows]
        rows, hit = self.rows[asked], np.isin(self.links[asked], r * self.n + ids[r, c])
        total = np.bincount(rows, minlength=len(narrow))
        found = np.bincount(rows, hit, minlength=len(narrow))
        some = total > 0
        self.asked, self.found = len(rows), int(hit.sum())
        if hit.sum() < recall * len(rows) or (found[some] / total[some]).sum() < recall * some.sum():
            return False
        if some.sum() >= self.linked:
            return True
        other = np.where((ids >= 0) & (ids != self.own[:, None]), sims, -np.inf).max(1)
        nearest = (other >= self.best - 1e-5)[narrow]
        self.asked, self.found = self.asked + len(nearest), self.found + int(nearest.sum())
        return nearest.sum() >= recall * len(nearest)


def links(graph: Graph, points: np.ndarray, queries: np.ndarray, least: float, beam: int = 32, audit: int = 64, recall: float = 0.98, own: np.ndarray | None = None, report: list | None = None):
    """Yield (query rows, node rows) of all links found, batch by batch.

    Brute force over at least ``audit`` queries says which links there are, see ``Audit``. While the
    walks find a smaller share of them than ``recall``, the beam doubles. A query whose whole beam is
    linked also gets a wider one, and a query that would need half the shard is compared with all of
    it. ``points`` and ``queries`` are unit vectors in double precision; ``own`` is each query's own
    node (-1: none), by default that of its place if the queries are the points. ``report`` gets
    what the audit asked for and what the walks found of it, unless all is compared in full.
    """
    n = len(points)
    slack = np.float32(least - 1e-5)
    flat = points.astype(np.float32)
    if own is None:
        own = np.arange(n) if queries is points else np.full(len(queries), -1)
    held = Audit(points, queries, least, own, audit) if beam < n // 2 else None
    while beam < n // 2:
        ids, sims = graph.search(queries[held.sample].astype(np.float32), beam)
        if held.passes(ids, sims, slack, recall):
            break
        beam *= 2
    if report is not None and beam < n // 2:
        report.append((held.asked, held.found))
    for at in range(0, len(queries), BATCH):
        todo, wide = np.arange(at, min(len(queries), at + BATCH)), beam
        while len(todo):
            if wide >= n // 2:
                for some in np.array_split(todo, -(-len(todo) // 64)):
                    rows, nodes = np.nonzero(queries[some].astype(np.float32) @ flat.T >= slack)
                    rows = some[rows]
                    exact = np.einsum("nd,nd->n", queries[rows], points[nodes]) >= least
                    yield rows[exact], nodes[exact]
                break
            ids, sims = graph.search(queries[todo].astype(np.float32), wide)
            full = sims[:, -1] >= slack
            r, c = np.nonzero((sims >= slack) & (ids >= 0) & ~full[:, None])
            rows, nodes = todo[r], ids[r, c]
            exact = np.einsum("nd,nd->n", queries[rows], points[nodes]) >= least
            yield rows[exact], nodes[exact]
            todo, wide = todo[full], wide * 4


class Forest:
    """Union-find over numbered nodes, smaller number as root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            higher = self.up[self.up]
            if (higher == self.up).all():
                return self.up
            self.up = higher

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            roots = self.roots()
            a, b = roots[a], roots[b]
            open_ = a != b
            a, b = np.maximum(a, b)[open_], np.minimum(a, b)[open_]
            np.minimum.at(self.up, a, b)


def near_duplicates(vectors: DataFrame, least: float = 0.98, shard_rows: int = 16384, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``key``, ``n_links``, ``component_id``, ``kept``, ``recall`` for every row of ``vectors``.

    Vectors of equal, non-null label with a cosine of ``least`` or more are linked. Equal vectors of
    a label are one class and are compared once. Vectors that are null, zero or hold null or
    non-finite components, have no label or no key, link with nothing. Vectors of different lengths
    never link. Rows of one key are vectors of their own: each has its own links and component, which
    is named by the smallest key in it, and ``kept`` says whether the row has that key. Recall of links is audited for each pair of shards, see ``links``; ``recall`` is the
    share that the walks found of all links (nearest vectors where links are rare) that the audits of
    the label asked for, null where no walk was audited: small shards are compared in full.
    """
    x = F.col(vector)
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(label).alias("label"), F.transform(x, lambda c: c.cast("double")).alias("x"))
    fine = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("x", lambda c: c != 0)
    usable = rows.where(fine).withColumns({"label": F.struct("label", F.size("x").alias("width")), "mark": F.xxhash64("x")})
    classes = cut(usable.groupBy("label", "mark", "x").agg(F.min("id").alias("first"), F.count("*").alias("copies")).withColumn("rep", F.monotonically_increasing_id()))
    counts = classes.groupBy("label").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))
    dealt = classes.join(counts, "label").withColumn("shard", F.pmod(F.xxhash64("rep"), F.col("shards")).cast("int"))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(order=pd.util.hash_array(group["rep"].to_numpy(np.int64))).sort_values("order", kind="stable")
        x = np.stack(group["x"].to_numpy())
        x = x / np.abs(x).max(1, keepdims=True)
        x = x / np.sqrt((x * x).sum(1, keepdims=True))
        graph = Graph.build(x.astype(np.float32))
        pack = lambda a: a.tobytes()
        return pd.DataFrame({"lab": [group["lab"].iloc[0]], "shards": [group["shards"].iloc[0]], "shard": [group["shard"].iloc[0]], "ids": [pack(group["rep"].to_numpy(np.int64))], "copies": [pack(group["copies"].to_numpy(np.int64))], "points": [pack(x)], "graph": [pack(np.concatenate([a.ravel() for a in graph.lists]))], "sizes": [pack(np.array([a.shape for a in graph.lists], dtype=np.int64))]})

    packed = dealt.select(F.to_json("label").alias("lab"), "shards", "shard", "rep", "copies", "x").groupBy("lab", "shards", "shard").applyInPandas(build, "lab string, shards int, shard int, ids binary, copies binary, points binary, graph binary, sizes binary")
    packed = cut(packed)
    # a graph stays with a task while the vectors of many shards stream past
    all_shards = F.explode(F.sequence(F.lit(0), F.col("shards") - 1))
    turns = F.ceil(F.col("shards") / TOGETHER).cast("int")
    nodes = packed.select("lab", F.col("shard").alias("j"), F.struct("ids", "copies", "points", "graph", "sizes").alias("nodes"), F.explode(F.sequence(F.lit(0), turns - 1)).alias("turn"))
    asks = packed.select("lab", F.pmod("shard", turns).alias("turn"), F.struct("ids", "points").alias("asks"), all_shards.alias("j"))

    def search(batches):
        held = None
        for batch in slices(batches, 1):
            for row in batch.to_pylist():
                read = lambda name, kind, of="nodes": np.frombuffer(row[of][name], dtype=kind)  # noqa: B023, E731
                if held != (row["lab"], row["j"]):
                    held, ids, copies = (row["lab"], row["j"]), read("ids", np.int64), read("copies", np.int64)
                    points, shapes = read("points", float).reshape(len(ids), -1), read("sizes", np.int64).reshape(-1, 2)
                    lists = [a.reshape(s) for a, s in zip(np.split(read("graph", np.int32), np.cumsum(shapes.prod(1))[:-1]), shapes, strict=True)]
                    graph = Graph(points.astype(np.float32), [int(s[0]) for s in shapes], lists)
                own = read("ids", np.int64, "asks")
                queries = read("points", float, "asks").reshape(len(own), -1)
                names, place = np.unique(np.concatenate([ids, own]), return_inverse=True)
                count, forest = np.zeros(len(own), dtype=np.int64), Forest(len(names))
                order = np.argsort(ids)
                at = order[np.minimum(np.searchsorted(ids, own, sorter=order), len(ids) - 1)]
                report: list[tuple[int, int]] = []
                for q, v in links(graph, points, queries, least, own=np.where(ids[at] == own, at, -1), report=report):
                    other = own[q] != ids[v]
                    q, v = q[other], v[other]
                    np.add.at(count, q, copies[v])
                    forest.join(place[len(ids) + q], place[v])
                root = names[forest.roots()]
                joined = names != root
                for a, n, b in ((own, count, root[place[len(ids) :]]), (names[joined], np.zeros(joined.sum(), dtype=np.int64), root[joined])):
                    none = pa.nulls(len(a), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(n), pa.array(b), pa.nulls(len(a), pa.string()), none, none], names=fields)
                none = pa.nulls(len(report), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, none, pa.array([row["lab"]] * len(report), pa.string()), *(pa.array([r[i] for r in report], pa.int64()) for i in (0, 1))], names=fields)

    fields = ["rep", "links", "root", "lab", "asked", "found"]
    every = cut(nodes.join(asks, ["lab", "j", "turn"]).drop("turn").mapInArrow(search, "rep long, links long, root long, lab string, asked long, found long"))
    drop(packed)
    audits = every.where(F.col("lab").isNotNull()).groupBy("lab").agg((F.sum("found") / F.sum("asked")).alias("recall"))
    audits = F.broadcast(audits) if audits.count() <= SMALL else audits
    found = every.where(F.col("rep").isNotNull())
    linked = components(found, "rep", "root")
    totals = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = classes.select("rep", "first").join(linked, F.col("rep") == F.col("id"))
    named = named.join(named.groupBy("component").agg(F.min("first").alias("least")), "component").select(F.col("rep").alias("linked"), "least")
    per_class = classes.join(totals, "rep").join(named, F.col("rep") == F.col("linked"), "left").select("label", "mark", "x", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.coalesce("least", "first").alias("component_id"))
    per_class = per_class.join(audits, F.to_json("label") == F.col("lab"), "left").drop("lab")
    member = usable.join(per_class, ["label", "mark", "x"]).select("id", "n_links", "component_id", "recall")
    alone = rows.where(~fine).select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), F.lit(None).cast("double").alias("recall"))
    return member.unionByName(alone).select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"), "recall")
