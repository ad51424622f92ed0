import zlib

import numpy as np
import public_tokenizers as P
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from proofmill.llm import packing

JSON = P.path("byte_bpe_50k.json")


@given(st.lists(st.integers(1, 50), max_size=60))
def test_tree_places_as_plain_first_fit_decreasing(lengths):
    bins, offsets = packing.first_fit_decreasing(np.array(lengths, dtype=np.int64), 50)
    free: list[int] = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        k = next((k for k, x in enumerate(free) if x >= lengths[i]), len(free))
        if k == len(free):
            free.append(50)
        assert (bins[i], offsets[i]) == (k, 50 - free[k])
        free[k] -= lengths[i]


def test_every_id_lies_in_one_piece(spark):
    texts = ["", None, "same text"] + ["same text " * n for n in (1, 3, 500, 900)] + ["x y z " * 40] * 9
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)] + [(3, "again", 0), (None, "no key", 0)], "doc_id long, text string, offset int")
    rows = packing.pack_documents(docs, JSON, P.PATTERN, length=64, group_rows=20).collect()
    t = Tokenizer.from_file(JSON)
    bins: dict = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for x in bins.values():
        x.sort()
        assert x[0][0] == 0 and sum(n for _, n in x) <= 64
        assert all(a + n == b for (a, n), (b, _) in zip(x, x[1:]))
    for i, text in enumerate(texts):
        if i == 3:
            continue
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        mine = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        assert sum(r["length"] for r in mine) == len(ids) == mine[0]["doc_tokens"]
        assert all(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in mine)
    used = sum(r["length"] for r in rows)
    assert used > 0.8 * 64 * len(bins)
    assert packing.pack_documents(docs.limit(0), JSON, P.PATTERN).count() == 0


def test_null_and_repeated_keys_spread_over_groups(spark):
    docs = spark.createDataFrame([(None if i % 3 else 7, f"text {i}") for i in range(3000)], "doc_id long, text string")
    rows = packing.pack_documents(docs, JSON, P.PATTERN, length=64, group_rows=100).collect()
    sizes = np.bincount([r["sequence_id"] // packing.STRIDE for r in rows], minlength=30)
    assert len(rows) == 3000 and len(sizes) == 30 and sizes.max() < 200 and sizes.min() > 40


def test_full_pieces_skip_the_tree(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "same text " * 200) for i in range(20)], "doc_id long, text string")
    parts = packing.cut(packing.pieces(docs, JSON, P.PATTERN, 64, 0))
    full = parts.where("length = 64")
    plain = packing.first_fit_decreasing

    def short_only(lengths, room):
        assert (lengths < room).all()
        return plain(lengths, room)

    monkeypatch.setattr(packing, "first_fit_decreasing", short_only)
    for some in (parts, full):
        rows = packing.pack(some, 64).collect()
        places = {(r["sequence_id"], r["offset"] + i) for r in rows for i in range(r["length"])}
        assert len(places) == sum(r["length"] for r in rows)
