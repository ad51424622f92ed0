import base64
import hashlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from proofmill.llm import bpe

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
TEXTS = ["", "a", "  ", "a  b", "a   b", "a \n\n b", "a\n \nb", "  x", "don't we'll", "héé ñ 你好 \U0001f600‍", "x" * 5000, "1 2  3\t\t4", "a\x1c b", "<|endoftext|> z", "İ   \u0085 ̀a", "tab\t end "]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(x):
    return np.frombuffer(x, "<u4").tolist()


@pytest.mark.parametrize("text", TEXTS)
def test_ids_of_both_vocabulary_files(reference, text):
    own = bpe.load(RANKS, P.PATTERN)
    assert ids(own.encode(text)) == reference.encode_ordinary(text)
    assert own.decode(own.encode(text)) == text.encode()
    assert ids(bpe.load(JSON, P.PATTERN).encode(text)) == Tokenizer.from_file(JSON).encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t'sa1.é"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_ids_of_any_text(text):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))} if not hasattr(bpe, "_ref") else None
    if ranks:
        bpe._ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = bpe.load(RANKS, P.PATTERN)
    assert ids(own.encode(text)) == bpe._ref.encode_ordinary(text)
    assert own.decode(own.encode(text)) == text.encode()


def test_frames_with_nulls_and_offsets(spark):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(99, None, 2), (None, "null key", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded int")
    out = bpe.decode(bpe.encode(docs, RANKS, P.PATTERN, offsets=True), RANKS, P.PATTERN).withColumn("again", bpe.text_of()).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r["again"] == (r["text"] or "") and len(r["offsets"]) == len(r["ids_le"]) // 4
    (smile,) = [r for r in out if r["text"] and "\U0001f600" in r["text"]]
    assert smile["offsets"] == sorted(smile["offsets"]) and max(smile["offsets"]) < len(smile["text"])
    assert bpe.encode(docs.limit(0), RANKS, P.PATTERN).count() == 0
    assert hashlib.sha256(out[0]["ids_le"]).hexdigest()


def test_caches_turn_over_and_are_emptied_by_other_operators(monkeypatch):
    import pyarrow as pa

    from proofmill.llm import arrow

    monkeypatch.setattr(bpe, "CACHE", (3, 3))
    own = bpe.ByteBpe(JSON, P.PATTERN)
    texts = [f"word{i % 5} and{i} more" for i in range(40)]
    want = [Tokenizer.from_file(JSON).encode(t, add_special_tokens=False).ids for t in texts]
    assert [ids(own.encode(t)) for t in texts] == want and len(own.matches) <= 3 and len(own.chunks.older) <= 3
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10] * 10 + ["b" * 100])], names=["t"])
    assert [x.num_rows for x in arrow.slices([batch], 4, 50, bpe.OWNER)] and own.chunks
    parts = list(arrow.slices([batch], 4, 50))
    assert not own.chunks and not own.matches and not own.matches.older
    assert sum(x.num_rows for x in parts) == 11 and max(x.num_rows for x in parts) <= 4 and parts[-1].num_rows == 1


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.sampled_from(TEXTS), st.text(st.one_of(st.sampled_from(" \n\t'sa1.é"), st.characters(exclude_categories=["Cs"])), max_size=40)), max_size=8), st.integers(0, 3), st.booleans())
def test_texts_together_as_one_by_one(texts, skip, large):
    own = bpe.load(JSON, P.PATTERN)
    found, bounds = own.encode_all(pa.array(texts, pa.large_string() if large else pa.string())[skip:])
    assert [found[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [own.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts[skip:]]


def test_a_word_of_many_texts_is_looked_up_once(spark):
    from proofmill.llm import packing

    class Counting(dict):
        asked = 0

        def __getitem__(self, text):
            Counting.asked += 1
            return self.kept[text]

    own = bpe.load(JSON, P.PATTERN)
    caches = {n: getattr(own, n) for n in ("chunks", "matches", "together") if hasattr(own, n)}
    try:
        for name, cache in caches.items():
            counting = Counting()
            counting.kept = cache
            setattr(own, name, counting)
        batch = pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array(["first word and, then more.\nWords"] * 500)], names=["doc_id", "text"])

        class Docs:
            def select(self, *columns):
                return self

            def mapInArrow(self, run, schema):
                return list(run([batch]))

        (out,) = packing.pieces(Docs(), JSON, P.PATTERN, 1024, 0)
    finally:
        for name, cache in caches.items():
            setattr(own, name, cache)
    n = len(Tokenizer.from_file(JSON).encode("first word and, then more.\nWords", add_special_tokens=False).ids) + 1
    assert out.column("length").to_pylist() == [n] * 500 and Counting.asked < 500 + 20
