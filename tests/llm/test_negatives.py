from collections import defaultdict

import numpy as np
import pytest

from proofmill.llm import negatives

DDL = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("seed, size, kind", [(0, 5, np.int32), (1, 300, np.int32), (2, 2**20, np.int64), (3, 0, np.int32)])
def test_scores_are_inner_products(seed, size, kind):
    r = np.random.default_rng(seed)
    a, b = r.integers(-size, size + 1, (1100, 13)), r.integers(-size, size + 1, (37, 13))
    got = negatives.scores(negatives.planes(a), negatives.tables(b, kind))
    assert got.dtype == kind and (got == a @ b.T).all()


def test_sums_of_all_subsets():
    t = negatives.tables(np.array([[1, 2, 4, 8, 16, 32, 64, 128, 5]]), np.int64)
    assert t[0, :, 0].tolist() == list(range(256)) and t[1, :, 0].tolist() == [0, 5] * 128


def brute(rows, anchors, positives=5, negatives_=3):
    """Rows are (id, label, integers)."""
    out = []
    for a, la, va in anchors:
        scored = [(-int(np.dot(va, v)), i, l) for i, l, v in rows if i != a]
        top = sorted((s, i) for s, i, l in scored if l == la)[:positives]
        for s, p in top:
            p_score = -s
            window = sorted((t, i) for t, i, l in scored if l != la and 50 * p_score <= -100 * t <= 95 * p_score)[:negatives_]
            out += [(a, p, r + 1, i, p_score, -t) for r, (t, i) in enumerate(window)]
    return sorted(out)


def floored(rows):
    return [(i, l, np.floor(256 * np.array(v)).astype(np.int64)) for i, v, l in rows]


def test_against_brute_force_with_a_hot_label_and_ties(spark):
    r = np.random.default_rng(5)
    x = np.round(r.normal(0.3, 0.3, (400, 10)), 2)
    x[20:60] = x[20]  # equal vectors: ties
    rows = [(i, x[i].tolist(), 0 if i % 3 else i % 7) for i in range(400)]
    v = negatives.quantised(spark.createDataFrame(rows, DDL).repartition(5))
    want = brute(floored(rows), [x for x in floored(rows) if x[0] % 25 == 0])
    assert len(want) > 100
    for blocks, chunks in ((8192, 512), (40, 3)):
        got = negatives.mine(v, v.where("vec_id % 25 = 0"), block_rows=blocks, chunk_rows=chunks)
        assert sorted(map(tuple, got.collect())) == want


def test_rows_that_take_no_part_and_small_tables(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None, 1), (2, [1.0, None], 1), (3, [nan, 1.0], 1), (4, [inf, 1.0], 1), (5, [1.0, 1.0], None), (None, [1.0, 1.0], 1)]
    few = [(0, [1.0, 1.0], 1), (50, [1.0, 0.5], 1), (7, [0.75, 0.5], 2), (8, [0.25], 2), (9, [], 2)]
    v = negatives.quantised(spark.createDataFrame(odd + few, DDL))
    assert sorted(r["vec_id"] for r in v.collect()) == [0, 7, 8, 9, 50]
    padded = [(i, l, np.pad(x, (0, 2 - len(x)))) for i, l, x in floored(few)]
    got = negatives.mine(v, v.where("vec_id % 50 = 0"))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == brute(padded, [x for x in padded if x[0] % 50 == 0]) != []
    assert negatives.mine(v.limit(0), v.limit(0)).count() == 0
    assert negatives.mine(v, v.limit(0)).count() == 0


def test_negative_scores_and_zero(spark):
    """A positive below zero has an empty window; one of zero takes scores of zero."""
    rows = [(0, [1.0, 0.0], 1), (1, [-1.0, 0.0], 1), (2, [0.0, 1.0], 1), (3, [0.0, -1.0], 2), (4, [-0.75, 0.0], 2)]
    v = negatives.quantised(spark.createDataFrame(rows, DDL))
    got = sorted(map(tuple, negatives.mine(v, v.where("vec_id = 0")).collect()))
    assert got == brute(floored(rows), floored(rows)[:1]) == [(0, 2, 1, 3, 0, 0)]


def test_repeated_rows_count_each(spark):
    rows = [(0, [1.0], 1), (1, [1.0], 1), (1, [1.0], 1), (2, [0.75], 2), (2, [0.75], 2)]
    v = negatives.quantised(spark.createDataFrame(rows, DDL))
    got = negatives.mine(v, v.where("vec_id = 0")).collect()
    counts = defaultdict(int)
    for g in got:
        counts[g["positive_id"], g["rank"], g["negative_id"]] += 1
    assert counts == {(1, 1, 2): 2, (1, 2, 2): 2}


def test_components_too_large_end_the_job(spark):
    v = negatives.quantised(spark.createDataFrame([(0, [1e30], 1)], DDL))
    with pytest.raises(Exception, match="31 bits"):
        v.collect()
