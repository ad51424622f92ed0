import numpy as np

from proofmill.llm import neardup
from proofmill.llm.components import components


def find(pairs, ids):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(300, 400)] + [(7, 7), (8, 9), (9, 8), (9, 10), (160, 90)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    ids = {i for e in edges for i in e}
    assert got == {i: r for i, r in find(edges, ids).items() if i != 7}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_recall_of_graph_links():
    r = np.random.default_rng(3)
    x = r.normal(size=(3000, 32))
    x[1000:2000] = x[:1000] + r.normal(0, 0.12, (1000, 32))
    x[2000:2400] = x[0] + r.normal(0, 0.05, (400, 32))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    graph = neardup.Graph.build(x.astype(np.float32))
    truth = x @ x.T >= 0.98
    got = np.zeros_like(truth)
    for q, v in neardup.links(graph, x, x, 0.98):
        assert not got[q, v].any()
        got[q, v] = True
    assert not (got & ~truth).any() and got.sum() >= 0.97 * truth.sum()


def test_frames_against_brute_force(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(240, 16)).astype(np.float32)
    x[50:90] = x[10:50] + r.normal(0, 0.04, (40, 16))
    x[100:110] = x[0]
    label = [i % 3 for i in range(240)]
    rows = [(i, [float(c) for c in v], y, 1) for i, (v, y) in enumerate(zip(x, label))]
    odd = [(900, None, 0, 1), (901, [0.0] * 16, 0, 1), (902, [None] + [1.0] * 15, 0, 1), (903, [float("nan")] * 16, 0, 1), (904, [float(c) for c in x[0]], None, 1), (905, [1.0], 0, 1), (None, [1.0], 0, 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int, rep int")
    y = x.astype(float)
    y /= np.sqrt((y * y).sum(1, keepdims=True))
    pairs = [(i, j) for i in range(240) for j in range(240) if i != j and label[i] == label[j] and y[i] @ y[j] >= 0.98]
    want = find(pairs, range(240))
    for rows_ in (16384, 30):
        got = {g["vec_id"]: g for g in neardup.near_duplicates(df, shard_rows=rows_).collect()}
        assert len(got) == 247
        assert {i: got[i]["component_id"] for i in range(240)} == want
        assert all(got[i]["n_links"] == sum(a == i for a, _ in pairs) for i in range(240))
        assert all(got[i]["n_links"] == 0 and got[i]["kept"] and got[i]["component_id"] == i for i in (900, 901, 902, 903, 904, 905)) and got[None]["kept"]
    assert neardup.near_duplicates(df.limit(0)).count() == 0


class Blind(neardup.Graph):
    """Walks that find nothing but a query's own vector until the beam is wide."""

    def search(self, queries, beam):
        ids, sims = super().search(queries, beam)
        if beam < 128:
            lost = sims < 0.99999
            return np.where(lost, -1, ids), np.where(lost, np.float32(-np.inf), sims)
        return ids, sims


def rare_pairs(n=3000, pairs=15):
    """Unit vectors of which few, standing together, are near copies of others that stand together."""
    r = np.random.default_rng(5)
    x = r.normal(size=(n, 32))
    x[1010 : 1010 + pairs] = x[10 : 10 + pairs] + r.normal(0, 0.05, (pairs, 32))
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def pairs_found(graph, points, queries):
    return {(int(a), int(b)) for q, v in neardup.links(graph, points, queries, 0.98) for a, b in zip(q, v)}


def test_audit_does_not_count_a_vectors_match_with_itself():
    x = rare_pairs()
    built = neardup.Graph.build(x.astype(np.float32))
    want = {(a, b) for a, b in zip(*np.nonzero(x @ x.T >= 0.98)) if a != b}
    assert len(want) == 30
    for graph in (built, Blind(built.points, built.sizes, built.lists)):
        got = {(a, b) for a, b in pairs_found(graph, x, x) if a != b}
        assert got <= want and len(got) >= 0.97 * len(want)


def test_audit_of_two_shards_does_not_pass_without_links():
    x = rare_pairs()
    nodes, queries = x[:1000], x[1000:]
    built = neardup.Graph.build(nodes.astype(np.float32))
    want = set(zip(*np.nonzero(queries @ nodes.T >= 0.98)))
    assert len(want) == 15
    got = pairs_found(Blind(built.points, built.sizes, built.lists), nodes, queries)
    assert got <= want and len(got) >= 0.97 * len(want)


def test_recall_is_returned_and_holds_against_brute_force(spark):
    x = rare_pairs(1500, 60)
    r = np.random.default_rng(6)
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(x)] + [(2000 + i, [float(c) for c in r.normal(size=32)], 1) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = (x @ x.T >= 0.98).sum() - len(x)
    got = neardup.near_duplicates(df, shard_rows=600).collect()
    share = sum(g["n_links"] for g in got if g["vec_id"] < 2000) / want
    assert want >= 100 and 0.97 <= share <= 1
    assert all(0.9 <= g["recall"] <= 1 for g in got if g["vec_id"] < 2000)
    assert all(g["recall"] is None for g in got if g["vec_id"] >= 2000)  # compared in full


def test_rows_of_one_key_are_vectors_of_their_own(spark):
    """Few keys under many vectors and labels, one of them under a third of all rows."""
    r = np.random.default_rng(8)
    base = r.normal(size=(40, 8))
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (1, [0.3, 0.9], 1), (2, [1.0, 0.01], 0), (3, [0.01, 1.0], 0), (4, [0.3, 0.91], 1), (1, [1.0, 0.0], 0)]
    rows += [(7 if i % 3 else 10 + i % 5, (base[i % 40] + r.normal(0, 0.03, 8)).tolist(), i % 2) for i in range(240)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    unit = [np.array(v) / np.linalg.norm(v) for _, v, _ in rows]
    linked = [(a, b) for a in range(len(rows)) for b in range(a) if rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98]
    low = [x[0] for x in rows]
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            least = min(low[a], low[b])
            changed |= low[a] != least or low[b] != least
            low[a] = low[b] = least
    links = [sum(i in pair for pair in linked) for i in range(len(rows))]
    want = sorted((i, links[k], low[k], low[k] == i) for k, (i, _, _) in enumerate(rows))
    for shard_rows in (16384, 30):
        got = neardup.near_duplicates(df, shard_rows=shard_rows)
        assert sorted((g["vec_id"], g["n_links"], g["component_id"], g["kept"]) for g in got.collect()) == want
    assert len(linked) > 300
