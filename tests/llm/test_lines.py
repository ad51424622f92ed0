import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from proofmill.llm import lines

DDL = "doc_id long, text string"


def brute(rows, least, found):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(lines.BLANK))
    holders = defaultdict(list)
    for d, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            holders[k].append(d)
    less = lambda d: -(2**63) if d is None else d
    keeper = {k: max(v, key=less) for k, v in holders.items() if len(k) >= least and len(v) >= found}
    out = []
    for d, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if key(x) not in keeper or keeper[key(x)] == d]
        out.append((d, t, len(own), len(own) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def texts(seed, n=120):
    r = random.Random(seed)
    pool = ["".join(r.choices("abcdefgh ÉÀß漢", k=r.randint(5, 60))) for _ in range(60)]
    dress = lambda x: r.choice(["", " ", "\t"]) + (x.upper() if x.isascii() and r.random() < 0.2 else x) + r.choice(["", "\r", " \x0b"])
    rows = [(i, "\n".join(dress(r.choice(pool[: 60 if i % 3 else 5])) for _ in range(r.randint(0, 12)))) for i in range(n)]
    return rows + [(500, None), (501, ""), (502, "\n\n"), (503, " \n" + "x" * 39 + "\n" + "x" * 40), (504, "\n".join(["y" * 45] * 9))]


@pytest.mark.parametrize("small", [1_000_000, 0])
def test_against_brute_force(spark, small):
    rows = texts(1)
    rows += [(600 + i, "\n".join(["Y" * 45, f"own {i}", "y" * 45 + "\r"])) for i in range(5)]
    want = brute(rows, 40, 5)
    assert sum(r[3] for r in want) > 100
    got = lines.drop_lines(spark.createDataFrame(rows, DDL).repartition(7), small=small)
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped", "kept"]
    assert sorted(map(tuple, got.collect()), key=str) == want


@pytest.mark.parametrize("small", [1_000_000, 0])
def test_null_and_repeated_ids_and_other_columns(spark, small):
    line = "z" * 50
    rows = [(None, line), (None, line), (3, line), (3, line + "\nmore"), (2, line), (2, None)]
    df = spark.createDataFrame([(d, t, 9, "x") for d, t in rows], "doc_id long, text string, lo int, lost string")
    got = lines.drop_lines(df, small=small)
    assert sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"], r["kept"]) for r in got.collect()), key=str) == brute(rows, 40, 5)
    assert {(r["lo"], r["lost"]) for r in got.collect()} == {(9, "x")}
    assert lines.drop_lines(df.limit(0), small=small).count() == 0


def test_columns_of_the_new_names_are_replaced(spark):
    df = spark.createDataFrame([(1, "a\nb", "old", 7)], "doc_id long, text string, kept string, n_lines int")
    assert lines.drop_lines(df).collect()[0].asDict() == {"doc_id": 1, "text": "a\nb", "n_lines": 2, "n_dropped": 0, "kept": "a\nb"}


def test_a_very_long_text_and_a_line_in_all_documents(spark):
    common = "License: " + "w" * 60
    rows = [(i, f"{common}\nown {i}") for i in range(400)] + [(1000, "\n".join(f"line {i} " + "q" * 60 for i in range(60_000)) + "\n" + common)]
    got = {r["doc_id"]: (r["n_dropped"], r["kept"]) for r in lines.drop_lines(spark.createDataFrame(rows, DDL).repartition(6)).collect()}
    assert got[1000] == (0, rows[-1][1]) and all(got[i] == (1, f"own {i}") for i in range(400))


def test_filters_lose_no_repeat_even_when_full(spark, monkeypatch):
    """With filters of far too few bits all keys are suspects, and the result stays exact."""
    monkeypatch.setattr(lines, "BITS", (16, 16))
    rows = texts(4, 800)
    got = lines.drop_lines(spark.createDataFrame(rows, DDL).repartition(9))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 40, 5)


def test_only_suspects_travel(spark):
    r = random.Random(2)
    rows = [(i, "\n".join("".join(r.choices("abcdefghij", k=60)) for _ in range(30))) for i in range(300)] + [(1000 + i, "s" * 60) for i in range(5)]
    df = spark.createDataFrame(rows, DDL).repartition(4).withColumnRenamed("doc_id", "doc")
    twice = lines._twice(df, 40)
    sent = lines._suspects(df.select("doc", "text"), spark.sparkContext.broadcast(twice.table), twice.bits, twice.cells, 40)
    assert 5 <= sent.count() <= 15


def test_filter_has_what_was_added():
    r = np.random.default_rng(0)
    keys = r.integers(0, 2**64, 5000, dtype=np.uint64)
    f = lines.Filter(20, 3)
    f.add(keys)
    assert f.holds(keys).all() and f.holds(r.integers(0, 2**64, 5000, dtype=np.uint64)).mean() < 0.02
    part = f.table[: 1 << 13].tobytes()
    assert lines._unfolded(lines._folded(part)).tobytes() == part and lines._folded(bytes(1 << 13)) is None


def test_keys_of_lines():
    got = lines.Lines(pa.array([" \tABC\x0bdé\r", None, "x\ny"]), 1)
    assert got.count.tolist() == [1, 1, 2] and got.of.tolist() == [0, 1, 2, 2] and got.at.tolist() == [0, 2, 3]
    assert got.keys[0] == lines.Lines(pa.array(["abc\x0bdé"]), 1).keys[0] != lines.Lines(pa.array(["abc\x0bdÉ"]), 1).keys[0]
