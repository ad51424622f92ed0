"""Byte-level BPE with the tokenizers library over Arrow batches.

Byte-level BPE maps each of the 256 bytes to a printable character and merges those characters.
Texts are split by a pattern; each match is encoded on its own, so its ids can be kept and reused.
Ids are packed as little-endian unsigned 32-bit integers (``ids_le``). Decoding reverses the byte
table: an id gives bytes, which may be part of a character, so characters are decoded only after
all bytes of a text are joined.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from proofmill.llm.arrow import HELD, batched, with_fields

#: A space between two other characters that are no white space: no match of the pattern holds both sides.
SPLIT = re.compile(r"(?<!\s) (?!\s)")
#: Entries of a generation of the caches of chunks and of matches; a worker keeps two generations of each, some 120 MB in all, until it works for another operator.
CACHE = (200_000, 100_000)
#: The same for matches of texts that are encoded together; they fill this cache instead of those two.
TOGETHER = 200_000
OWNER = "bpe"
#: Matches and chunks longer than this are encoded each time, so the caches stay small.
LONGEST = 64


class _Irregular(Exception):
    """White space beside a space: the text must be split with more care."""


@lru_cache(1)
def byte_alphabet() -> list[str]:
    """The character of each byte: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    own = [b for b in range(256) if chr(b).isprintable() and b not in (32, 160, 173)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def _merges(ranks: dict[bytes, int]) -> Iterator[tuple[bytes, bytes]]:
    """For each token of two or more bytes the pair that makes it, in order of rank."""
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: (ranks.get(parts[i] + parts[i + 1], 1 << 30), i))
            if ranks.get(parts[best] + parts[best + 1], 1 << 30) >= rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        if len(parts) == 2:
            yield parts[0], parts[1]


class _Kept(dict):
    """Packed ids of texts, made by ``make`` as they come; packed on little-endian machines.

    A full generation becomes the older one, and what is asked for again moves to the new one.
    """

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, text: str) -> bytes:
        ids = self.older.get(text)
        ids = self.make(text) if ids is None else ids
        if len(text) <= LONGEST:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[text] = ids
        return ids

    def forget(self) -> None:
        self.older = {}
        self.clear()


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _listed(table: dict[int, bytes]) -> list[bytes]:
    return [table.get(i, b"") for i in range(max(table, default=-1) + 1)]


class ByteBpe:
    """Encoder and byte table of one vocabulary; made once in each worker process by ``load``."""

    def __init__(self, path: str, pattern: str):
        self.pattern = regex.compile(pattern)
        if path.endswith(".json"):
            self.tokenizer = Tokenizer.from_file(path)
            vocab = {k: v for k, v in self.tokenizer.get_vocab(with_added_tokens=False).items()}
            byte_of = {c: bytes([b]) for b, c in enumerate(byte_alphabet())}
            table = {v: b"".join(map(byte_of.__getitem__, k)) for k, v in vocab.items() if all(c in byte_of for c in k)}
            self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
            table |= {i: t.content.encode() for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        else:
            ranks = _ranks(path)
            chars = byte_alphabet()
            name = lambda token: "".join(map(chars.__getitem__, token))
            self.tokenizer = Tokenizer(models.BPE(vocab={name(k): v for k, v in ranks.items()}, merges=[(name(a), name(b)) for a, b in _merges(ranks)]))
            self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            table, self.added = {v: k for k, v in ranks.items()}, []
        self.table = _listed(table)
        self.sizes = np.array([len(x) for x in self.table], dtype=np.int64)
        # the bytes of a text as Latin-1 characters, to the characters that stand for them
        self.alphabet = str.maketrans({chr(b): c for b, c in enumerate(byte_alphabet())})
        self.model = self.tokenizer.model
        self.chunks = _Kept(self._chunk, CACHE[0])
        self.matches = _Kept(self._match, CACHE[1])
        self.together = _Kept(self._match, TOGETHER)
        HELD.setdefault(OWNER, []).extend((self.chunks, self.matches, self.together))

    def _encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _match(self, match: str) -> bytes:
        """Ids of one match of the pattern: the model alone, without another split."""
        return array("I", [t.id for t in self.model.tokenize(match.encode().decode("latin-1").translate(self.alphabet))]).tobytes()

    def _chunk(self, word: str) -> bytes:
        """Ids of a space and a word behind it."""
        if word.isalpha():
            return self._match(" " + word)
        if not word or word[0].isspace() or word[-1].isspace():
            raise _Irregular
        return self._matches(" " + word)

    def _matches(self, part: str) -> bytes:
        return b"".join(map(self.matches.__getitem__, self.pattern.findall(part)))

    def encode(self, text: str) -> bytes:
        """Packed ids of a whole text."""
        if any(t in text for t in self.added):
            return self._encode(text)
        first, *words = text.split(" ")
        try:
            if first[-1:].isspace() or not first and words:
                raise _Irregular
            return self._matches(first) + b"".join(map(self.chunks.__getitem__, words))
        except _Irregular:
            first, *words = SPLIT.split(text)
            return self._matches(first) + b"".join([self._matches(" " + w) for w in words])

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts one after another, and where each text's begin (one more than texts); null counts as empty.

        A word behind a space that comes again, in any of the texts, is split and looked up once. Texts that
        need more care (white space beside a space, an added token) are encoded one by one.
        """
        if not len(texts):
            return np.zeros(0, dtype="<u4"), np.zeros(1, dtype=np.int64)
        texts = pc.fill_null(texts, "")
        split = pc.split_pattern(texts, " ")
        at = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
        words = split.flatten().dictionary_encode()
        word, known = words.indices.to_numpy(), words.dictionary.to_numpy(zero_copy_only=False).tolist()
        first = word[at[:-1]]
        odd = np.logical_or.reduceat(np.array([not w or w[0].isspace() or w[-1].isspace() for w in known])[word], at[:-1])
        for t in self.added:
            odd |= pc.match_substring(texts, t).to_numpy(zero_copy_only=False)
        behind = np.repeat(~odd, np.diff(at))
        behind[at[:-1]] = False
        asked = np.zeros(len(known), dtype=bool)
        asked[word[behind]] = True
        alpha = np.array(list(map(str.isalpha, known)))
        # runs of ids: a match each, several a word, then the first word of each text (or all of an odd one), at last an empty run
        one, more = np.flatnonzero(asked & alpha), np.flatnonzero(asked & ~alpha)
        found = self.pattern.findall("".join([" " + known[i] for i in more.tolist()]))
        ids = list(map(self.together.__getitem__, [" " + known[i] for i in one.tolist()] + found))
        for i, (o, k) in enumerate(zip(odd.tolist(), first.tolist(), strict=True)):
            ids.append(self.encode(texts[i].as_py()) if o else b"".join(map(self.together.__getitem__, self.pattern.findall(known[k]))))
        heads = len(one) + len(more) + np.arange(len(texts))
        empty = len(one) + len(more) + len(texts)
        run = np.concatenate([np.arange(len(one)), len(one) - 1 + np.cumsum([m[0] == " " for m in found], dtype=np.int64), heads])
        sizes = np.bincount(run, np.array(list(map(len, ids))) // 4, empty + 1).astype(np.int64)
        run_of = np.full(len(known), empty)
        run_of[one], run_of[more] = np.arange(len(one)), len(one) + np.arange(len(more))
        place = np.where(behind, run_of[word], empty)
        place[at[:-1]] = heads
        n = sizes[place]
        ends = np.cumsum(n)
        source = np.repeat((np.cumsum(sizes) - sizes)[place] - ends + n, n) + np.arange(ends[-1])
        return np.frombuffer(b"".join(ids), dtype="<u4")[source], np.concatenate([[0], ends])[at]

    def decode(self, ids_le: bytes) -> bytes:
        """Bytes of packed ids; an id that the table lacks is an error."""
        return decoded(self.table, ids_le)

    def offsets(self, ids_le: bytes) -> list[int]:
        """For each id the character in which it starts: a character split between ids counts for each of them."""
        ids = np.frombuffer(ids_le, dtype="<u4")
        data = np.frombuffer(self.decode(ids_le), dtype=np.uint8)
        chars = np.cumsum((data & 0xC0) != 0x80) - 1
        starts = np.cumsum(self.sizes[ids]) - self.sizes[ids]
        return chars[starts].tolist() if len(ids) else []


def decoded(table: list[bytes], ids_le: bytes) -> bytes:
    """Bytes of packed ids by a table of each id's bytes."""
    return b"".join(map(table.__getitem__, np.frombuffer(ids_le, dtype="<u4").tolist()))


@lru_cache(2)
def load(path: str, pattern: str) -> ByteBpe:
    """The encoder of a vocabulary file: tiktoken ranks, or the JSON of the tokenizers library; a worker keeps the last two."""
    return ByteBpe(path, pattern)


@lru_cache(1)
def byte_table(path: str, pattern: str) -> list[bytes]:
    """The bytes of each id, for decoding alone: tiktoken ranks say them without an encoder."""
    return ByteBpe(path, pattern).table if path.endswith(".json") else _listed({v: k for k, v in _ranks(path).items()})


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", offsets: bool = False, rows: int = 500) -> DataFrame:
    """``docs`` with ``ids_le`` (binary: packed ids of the whole text), and ``offsets`` if asked for.

    ``offsets`` has the index of the character in which each id starts. A null text counts as
    empty and has no ids. Special tokens are never added. Columns of those names are replaced.
    """
    kept = docs.drop("ids_le", "offsets")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(path, pattern)
        ids = [bpe.encode(t or "") for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
        more = [pa.array(list(map(bpe.offsets, ids)), pa.list_(pa.int64()))] if offsets else []
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary()), *more], names=[*batch.schema.names, "ids_le", *["offsets"][: len(more)]])

    return kept.mapInArrow(batched(rows, run, OWNER), with_fields(kept.schema, ids_le="binary", **({"offsets": ArrayType(LongType())} if offsets else {})))


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids_le", rows: int = 500) -> DataFrame:
    """``encoded`` with ``decoded`` (binary: the bytes of all ids joined); null ids give null.

    ``text_of("decoded")`` makes characters of them.
    """
    kept = encoded.drop("decoded")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        table = byte_table(path, pattern)
        out = [None if x is None else decoded(table, x) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])

    return kept.mapInArrow(batched(rows, run, OWNER), with_fields(kept.schema, decoded="binary"))


def n_tokens(ids: str = "ids_le") -> Column:
    """The number of packed ids."""
    return (F.octet_length(ids) / 4).cast("bigint")


def text_of(decoded: str = "decoded") -> Column:
    """Decoded bytes as text: whole characters, even where they were split between ids."""
    return F.decode(F.col(decoded), "UTF-8")
