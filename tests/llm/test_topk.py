import numpy as np
import pytest

from proofmill.llm import queries, topk


def brute(ids, values, wanted, k):
    out = []
    for q in wanted:
        at = [i for i in range(len(ids)) if ids[i] != ids[q]]
        s = {i: int(values[i] @ values[q]) for i in at}
        out += [(int(ids[q]), r + 1, int(ids[i]), s[i]) for r, i in enumerate(sorted(at, key=lambda i: (-s[i], ids[i]))[:k])]
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_block_against_brute_force(seed):
    r = np.random.default_rng(seed)
    values = r.normal(0, 9, (700, 24)).astype(np.int32) if seed else np.zeros((50, 3), np.int32)
    values[10:14] = values[9]
    ids = np.arange(len(values), dtype=np.int64)
    index = topk.ImpactIndex(ids, values, np.float32)
    q, v, s = index.search(ids[:40], values[:40].astype(np.float32), 5)
    assert sorted(zip(q.tolist(), v.tolist(), s.tolist())) == sorted((a, c, d) for a, _, c, d in brute(ids, values, range(40), 5))


@pytest.mark.parametrize("heavy, least", [(False, 0.0), (True, 0.9)])
def test_queries_stop_on_proof(heavy, least):
    """Where few components carry most of a vector, nearly all queries stop before the last segment."""
    r = np.random.default_rng(3)
    values = r.normal(0, 9, (4000, 32))
    values = (values**3 / 100 if heavy else values).astype(np.int32)
    ids = np.arange(len(values), dtype=np.int64)
    index = topk.ImpactIndex(ids, values, np.float64)
    q, v, s = index.search(ids[:60], values[:60].astype(np.float64), 5)
    assert sorted(zip(q.tolist(), v.tolist(), s.tolist())) == sorted((a, c, d) for a, _, c, d in brute(ids, values.astype(np.int64), range(60), 5))
    assert index.asked == 60 and index.early >= least * 60
    postings = sum(len(rows) for p, *_ in index.segments for _, rows, _ in p)
    assert postings == np.count_nonzero(values) and [x[3] for x in index.segments] == sorted((x[3] for x in index.segments), reverse=True)


def test_frames_against_brute_force(spark, tmp_path):
    r = np.random.default_rng(1)
    x = r.normal(0, 0.2, (300, 8)).astype(np.float32)
    x[5], x[6], x[7] = x[4], x[4], 0
    rows = [(i, [float(c) for c in v], 1, 2) for i, v in enumerate(x)]
    odd = [(1000, None, 1, 2), (1001, [1.0, None], 1, 2), (1002, [float("nan")] * 8, 1, 2), (1003, [float("inf")] * 8, 1, 2), (None, [0.1] * 8, 1, 2)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int, score int")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    want = brute(np.arange(300), np.floor(64 * x.astype(np.float64)).astype(np.int64), range(0, 300, 20), 20)
    assert sorted(map(tuple, queries.op3_exact_topk(spark, str(tmp_path)).collect())) == want
    v = topk.quantised(df)
    assert sorted(map(tuple, topk.search(v.where("vec_id % 20 = 0"), v, block_rows=64, query_rows=4).collect())) == want
    assert topk.search(v.limit(0), v).count() == 0
    ragged = topk.quantised(spark.createDataFrame([(0, [1.0, 1.0]), (1, [2.0]), (2, [])], "vec_id long, embedding array<double>"))
    assert sorted(map(tuple, topk.search(ragged, ragged, 1).collect())) == [(0, 1, 1, 8192), (1, 1, 0, 8192), (2, 1, 0, 0)]


def test_repeated_ids_are_vectors_of_their_own(spark):
    """One id under a third of all rows: each row is a candidate, none for a query of its own id."""
    r = np.random.default_rng(7)
    x = r.normal(0, 0.5, (120, 6))
    ids = [5 if i % 3 == 0 else i for i in range(120)]
    rows = [(ids[i], [float(c) for c in x[i]]) for i in range(120)] + [(40, [0.0] * 6), (40, [0.0] * 6)]
    v = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    values = np.floor(64 * np.array([c for _, c in rows])).astype(np.int64)
    every = np.array([i for i, _ in rows])
    for blocks in (8192, 16):
        got = sorted(tuple(g) for g in topk.search(v.where("vec_id = 40").limit(1), v, 10, block_rows=blocks).collect())
        q = int(np.flatnonzero(every == 40)[0])
        first = v.where("vec_id = 40").limit(1).first()["v"]
        q = int(np.flatnonzero((every == 40) & (values == np.array(first)).all(1))[0])
        scored = sorted((-int(values[i] @ values[q]), int(every[i])) for i in range(len(every)) if every[i] != 40)[:10]
        assert got == [(40, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
