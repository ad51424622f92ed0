import random
import re

import pytest
from pyspark.sql import functions as F

from proofmill.llm import jaccard
from tests.llm.test_neardup import find


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    prose = lambda n: r.choices(vocabulary, k=n)
    common = prose(30)
    texts = []
    for _ in range(60):
        base = prose(r.randint(3, 120))
        texts.append(base)
        for _ in range(r.choice([0, 0, 1, 4])):
            copy = list(base)
            for _ in range(r.randint(0, 3)):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            texts.append(copy)
    hot = prose(150)
    for i in range(120):  # a large group of near copies at many distances, with some that only share its words
        copy = list(hot)
        for _ in range(r.randint(0, 14)):
            copy[r.randrange(len(copy))] = f"x{r.randrange(30)}"
        texts.append(copy)
    texts += [common + prose(r.randint(0, 12)) for _ in range(60)]
    out = [" ".join(t) for t in texts]
    return out + ["", None, "one", "ONE", "one two", "a b c\td\x0be", "É a b c d", "é a b c d", " \t ", "a b c d e", "A B C D E"] + [out[3]] * 5


@pytest.mark.parametrize("seed, wide, block", [(1, 32, 4 << 20), (2, 2, 4000)])
def test_components_against_brute_force(spark, seed, wide, block, monkeypatch):
    """Also with nearly all columns counted as wide, and blocks of a few classes."""
    monkeypatch.setattr(jaccard, "WIDE", wide)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    texts = corpus(seed)
    docs = spark.createDataFrame([(i + 10, t, 1) for i, t in enumerate(texts)] + [(None, "one", 2)], "doc_id long, text string, n int").repartition(5)
    got = {r["doc_id"]: r for r in jaccard.join(docs).collect()}
    sets = [plain(t) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    want = find(pairs, range(len(sets)))
    assert {i: got[i + 10]["n_shingles"] for i in range(len(sets))} == {i: len(s) for i, s in enumerate(sets)}
    assert {i: got[i + 10]["component_id"] - 10 for i in range(len(sets))} == want
    assert got[None]["component_id"] is None


def test_empty_table(spark):
    assert jaccard.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_line_shared_by_thousands_of_texts_stays_far_from_all_pairs(spark, monkeypatch):
    r = random.Random(5)
    line = [f"c{i}" for i in range(15)]
    texts = [line + [f"u{i}-{k}" for k in range(i % 5 + 2)] for i in range(2000)]
    texts += [[*t[:14], f"v{i}", *t[15:]] for i, t in enumerate(texts[:300])] + [[f"p{k}" for k in range(60)][r.randrange(8) :] for _ in range(50)]
    work, bands = [], jaccard._bands

    def counted(*a):
        out = bands(*a)
        sides = out.groupBy("gram", "band").agg(F.count(F.when(F.col("index"), 1)).alias("i"), F.count(F.when(~F.col("index"), 1)).alias("p"))
        work.append(sides.agg(F.sum(F.col("i") * F.col("p"))).first()[0] or 0)
        return out

    monkeypatch.setattr(jaccard, "_bands", counted)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join(docs).collect()}
    sets = [plain(" ".join(t)) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if min(len(sets[i]), len(sets[j])) * 100 >= 75 * max(len(sets[i]), len(sets[j])) and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    assert got == find(pairs, range(len(sets)))
    assert len(work) == 1 and work[0] < 20 * len(texts)


def test_rows_of_repeated_and_null_keys_are_told_apart(spark):
    text = "a b c d e f g h i j k l"
    docs = spark.createDataFrame([(1, text), (2, text), (2, "other words that share nothing with it at all"), (None, text), (None, text), (3, text * 20_000)], "doc_id long, text string")
    rows = jaccard.join(docs).collect()
    same = {r["class_id"] for r in rows if r["text_hash"] == next(x["text_hash"] for x in rows if x["doc_id"] == 1)}
    assert len(rows) == 6 and len(same) == 1 and None not in same
    assert sorted((r["doc_id"], r["component_id"]) for r in rows if r["doc_id"]) == [(1, 1), (2, 1), (2, 2), (3, 3)]
