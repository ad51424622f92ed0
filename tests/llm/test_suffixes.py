import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from proofmill.llm import suffixes


@given(st.lists(st.text("ab", min_size=6, max_size=6), min_size=1, max_size=30))
def test_blind_trie_orders_strings(texts):
    strings = [t.encode() for t in texts]
    leaves = suffixes.blind_order(strings)
    assert [i for leaf in leaves for i in leaf] == sorted(range(len(strings)), key=lambda i: strings[i])
    assert len(leaves) == len(set(strings))


@given(st.lists(st.tuples(st.integers(0, 2), st.text("ab", min_size=16, max_size=16)), max_size=60))
def test_multikey_quicksort_orders_strings(rows):
    data = "".join(t for _, t in rows).encode() + b"\0" * 8
    words = np.array([int.from_bytes(data[i : i + 8], "big") for i in range(len(data) - 7)], dtype=np.uint64)
    order, bucket = suffixes.multikey_quicksort(words, np.arange(len(rows)) * 16, np.array([g for g, _ in rows], dtype=np.int64), 16)
    assert order.tolist() == sorted(range(len(rows)), key=lambda i: rows[i])
    same = [rows[a] == rows[b] for a, b in zip(order[:-1], order[1:], strict=True)]
    assert same == (bucket[1:] == bucket[:-1]).tolist()


def plain(docs):
    """(key, n_bytes, n_removed, n_spans, kept) of documents in order."""
    seen, out = set(), []
    for key, text in docs:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            s = raw[i : i + 100]
            if s in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(s)
        spans = sum(1 for i in range(len(raw)) if gone[i] and (not i or not gone[i - 1]))
        out.append((key, len(raw), sum(gone), spans, bytes(b for b, g in zip(raw, gone) if not g)))
    return out


def corpus(seed):
    r = random.Random(seed)
    prose = lambda n: "".join(r.choices("abc deé", k=n))
    passages = [prose(n) for n in (60, 99, 100, 101, 130, 400)]
    texts = []
    for _ in range(60):
        texts.append(prose(r.randint(0, 300)) + "".join(r.choice(passages) + prose(r.choice([0, 1, 5, 40])) for _ in range(r.randint(0, 3))))
    base = prose(900)
    for _ in range(40):
        copy = list(base)
        for _ in range(r.randint(0, 6)):
            copy[r.randrange(900)] = r.choice("XYZ")
        texts.append("".join(copy))
    return texts + ["", None, "a" * 99, "a" * 100, "a" * 5000, "ab" * 900, texts[5], texts[5], base * 3, "\U0001f600" * 90]


@pytest.mark.parametrize("seed, hot, bits", [(1, 20_000, 28), (2, 8, 28), (3, 30, 3)])
def test_against_brute_force(spark, seed, hot, bits, monkeypatch):
    """Sorted groups, groups in parts, and lists of hashes where the Bloom filter would be too large."""
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "BITS", (20, bits))
    texts = corpus(seed)
    rows = list(enumerate(texts, 7))
    docs = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, n_bytes int").repartition(6)
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffixes.dedup(docs).collect())
    assert got == plain(rows)


def test_null_keys_and_repeated_rows(spark):
    text = "".join(random.Random(3).choices("abcdefgh", k=300))
    docs = spark.createDataFrame([(2, text), (2, text), (None, text[:150]), (9, text + "z")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in suffixes.dedup(docs).collect())
    assert got == [(0, 0), (2, 150), (2, 150), (9, 300)]
    assert suffixes.dedup(docs.limit(0)).count() == 0


def test_clashing_columns_and_whole_characters(spark):
    text = "é" * 40 + "".join(random.Random(4).choices("abcdefgh", k=200))
    docs = spark.createDataFrame([(1, text, 7, "x", 1, b"k"), (2, "z" + text[1:] + "é", 8, "y", 2, b"k"), (3, None, 9, "z", 3, b"k")], "doc_id long, text string, runs int, doc string, s_mark int, kept binary")
    got = {r["doc_id"]: r for r in suffixes.dedup(docs, whole="rest").collect()}
    assert [(got[i]["runs"], got[i]["doc"], got[i]["s_mark"]) for i in (1, 2, 3)] == [(7, "x", 1), (8, "y", 2), (9, "z", 3)]
    assert got[1]["rest"] == text and got[2]["rest"] == "zé" and got[3]["rest"] is None
