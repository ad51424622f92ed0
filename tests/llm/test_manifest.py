import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from proofmill.llm import manifest as m

DDL = "doc_id long, source string, lang string, n_chars long, text string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def path(tree, at):
    """Siblings before and after, level by level."""
    out = []
    for level in tree[:-1]:
        run = level[at // 16 * 16 : at // 16 * 16 + 16]
        out.append(("".join(run[: at % 16]), "".join(run[at % 16 + 1 :])))
        at //= 16
    return out


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    less = lambda r: (r[0] is not None, r[0] or 0, leaf(r))
    trees = {s: levels([leaf(r) for r in sorted(groups[s], key=less)]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for i, s in enumerate(names):
        for at, r in enumerate(sorted(groups[s], key=less)):
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], path(trees[s], at) + path(top, i)))
    return sorted(out, key=str)


def got(df, **more):
    return sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], [tuple(s) for s in r["steps"]]) for r in m.manifest(df, **more).collect()), key=str)


@pytest.mark.parametrize("sizes", [[1], [2], [16], [17], [1, 16, 17, 255], [256], [257, 3], [700, 1, 40]])
def test_trees_against_brute_force(spark, sizes):
    r = random.Random(len(sizes))
    rows = [(100 * i + s, f"s{s}", r.choice(["en", None]), i, r.choice([None, "", "Étext " * 3, f"t{i}"])) for s, n in enumerate(sizes) for i in range(n)]
    r.shuffle(rows)
    assert got(spark.createDataFrame(rows, DDL).repartition(5)) == brute(rows)


def test_many_sources_and_deep_trees(spark):
    """A tree of three stored levels beside 300 sources, which are a tree of two stored levels themselves."""
    rows = [(i, "hot", None, i, "x") for i in range(256 * 17)] + [(i, f"é{i}", "en", 0, None) for i in range(300)]
    df = spark.createDataFrame(rows, DDL)
    assert got(df.repartition(6)) == brute(rows)


def test_nulls_and_repeated_rows(spark):
    rows = [(None, None, None, None, None)] * 3 + [(5, None, "en", 1, "a"), (5, None, "en", 1, "a"), (5, None, "en", 2, "b"), (None, "", "", 0, ""), (1, "-", "x", 1, "y"), (2, "=", "x", 1, "y")]
    assert got(spark.createDataFrame(rows, DDL)) == brute(rows)


def test_empty_table_and_other_columns(spark):
    df = spark.createDataFrame([(1, "s", "en", 3, "abc", "t", 7)], DDL + ", tree string, pos int")
    assert m.manifest(df.limit(0)).count() == 0
    (row,) = m.manifest(df).collect()
    assert row["leaf"] == row["subroot"] == row["root"] == leaf((1, "s", "en", 3, "abc")) and row["steps"] == []


def test_a_changed_row_does_not_verify(spark):
    rows = [(i, f"s{i % 3}", "en", i, t) for i, t in enumerate(["ABC", "abc", None, ""] * 30)]
    out = m.manifest(spark.createDataFrame(rows, DDL), tampered={"text": F.lower("text")}, where=F.col("doc_id") < 60)
    out = out.select("doc_id", "leaf", "tampered_leaf", (m.fold(F.coalesce("tampered_leaf", "leaf"), F.col("steps")) == F.col("root")).alias("ok"))
    for r in out.collect():
        text = rows[r["doc_id"]][4]
        assert (r["tampered_leaf"] is not None) == (r["doc_id"] < 60) and r["ok"] == (r["doc_id"] >= 60 or text != "ABC")


def test_only_every_second_level_is_stored(spark):
    from proofmill.tables import Scratch

    nodes = spark.createDataFrame([("=a", i, sha(str(i))) for i in range(5000)], "tree string, key long, digest string")
    trees = m.grow(m.numbered(nodes, ["key"], Scratch()), ["key"], Scratch())
    assert [x.agg(F.sum(F.size("nodes"))).first()[0] for x in trees.levels] == [5000, 20]
    assert max(r["n"] for r in trees.levels[0].select(F.size("nodes").alias("n")).collect()) == m.BLOCK
    assert trees.roots.first()["digest"] == levels([sha(str(i)) for i in range(5000)])[-1][0]
