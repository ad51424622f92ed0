"""Language identification with bit-sliced Bloom filters of character n-grams.

Each cell of the filter holds one bit for each language, in as many words as that takes. The AND of an n-gram's cells is a bitmask
of all languages whose training text holds that n-gram. A document's score for a language is the
share of its n-grams with that bit, corrected for the false positives of that language's filter.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofmill.llm.arrow import slices, unused, with_fields
from proofmill.tables import cut

UNDETERMINED = "und"
#: Characters of an n-gram.
GRAM = 4
#: Odd 64-bit multipliers: one for each place of an n-gram, one for each cell.
PLACES = [(0x9E3779B97F4A7C15 * (2 * i + 1) + 2 * i) % 2**64 | 1 for i in range(1, GRAM + 1)]
CELLS = [(0xC2B2AE3D27D4EB4F * (2 * i + 1) + 2 * i) % 2**64 | 1 for i in range(1, 4)]
#: Characters that are hashed at a time.
CHUNK = 1 << 20
#: Rows that a worker takes at a time.
ROWS = 500
#: Rows of the sample's hashes that are broadcast at most; more are shuffled.
SMALL = 1_000_000


@lru_cache(1)
def _plain() -> np.ndarray:
    """For each character below 65536: itself if it is a letter, else a space."""
    return np.array([c if chr(c).isalpha() else 32 for c in range(1 << 16)], dtype=np.uint32)


def _letters(text: str) -> np.ndarray:
    """Lower-case letters of a text, each run of other characters as one space, with a space at both ends."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    high = codes >> 16 > 0
    plain = _plain()[np.where(high, 32, codes)]
    if high.any():
        plain[high] = [c if chr(c).isalpha() else 32 for c in codes[high].tolist()]
    space = plain == 32
    return plain[~(space & np.concatenate([[False], space[:-1]]))]


def grams(codes: np.ndarray) -> np.ndarray:
    """64-bit hashes of all n-grams; a shorter text counts as padded with spaces."""
    if len(codes) < GRAM:
        codes = np.concatenate([codes, np.full(GRAM - len(codes), 32, np.uint32)])
    wide = codes.astype(np.uint64)
    n = len(wide) - GRAM + 1
    total = wide[:n] * np.uint64(PLACES[0])
    for i in range(1, GRAM):
        total += wide[i : i + n] * np.uint64(PLACES[i])
    return total ^ (total >> np.uint64(29))


def _cell(hashes: np.ndarray, cell: int, bits: int) -> np.ndarray:
    return (hashes * np.uint64(cell)) >> np.uint64(64 - bits)


def _kept(seen: list[np.ndarray], least: int) -> np.ndarray:
    """The n-grams that occur ``least`` times, or as often as any does."""
    values, counts = np.unique(np.concatenate(seen), return_counts=True) if seen else (np.zeros(0, np.uint64), np.zeros(0, int))
    return values[counts >= min(least, counts.max(initial=1))]


class LanguageFilters:
    """The filters of all learned languages, as many as there are: 64 to a word of each cell.

    ``bits``: log2 of the number of cells. ``least``: how often an n-gram must occur in the sample of
    a language, so that names and foreign passages stay out.
    """

    def __init__(self, texts: dict[str, list[str]], bits: int = 18, least: int = 3):
        kept = {lang: _kept([grams(_letters(t)) for t in ts], least) for lang, ts in texts.items()}
        self._fill({lang: np.concatenate([_cell(values, cell, bits) for cell in CELLS]) for lang, values in kept.items()}, bits)

    @classmethod
    def of_cells(cls, cells: dict[str, np.ndarray], bits: int = 18) -> LanguageFilters:
        """The filters whose set cells are known."""
        model = cls.__new__(cls)
        model._fill(cells, bits)
        return model

    def _fill(self, cells: dict[str, np.ndarray], bits: int) -> None:
        self.langs, self.bits = sorted(cells), bits
        kind = next((k for k in (np.uint8, np.uint16, np.uint32) if len(self.langs) <= np.dtype(k).itemsize * 8), np.uint64)
        self.width = np.dtype(kind).itemsize * 8
        self.cells = np.zeros((max(1, -(-len(self.langs) // self.width)), 1 << bits), dtype=kind)
        self.false = np.zeros(len(self.langs))
        for k, lang in enumerate(self.langs):
            word, bit = self.cells[k // self.width], kind(k % self.width)
            word[cells[lang]] |= kind(1) << bit
            self.false[k] = min(0.99, float(((word >> bit) & kind(1)).mean()) ** len(CELLS))

    def counts(self, text: str) -> tuple[np.ndarray, int]:
        """For each language the n-grams of the text that its filter holds; the number of n-grams."""
        codes, total, n = _letters(text), np.zeros(len(self.langs)), 0
        for at in range(0, max(1, len(codes) - GRAM + 1), CHUNK):
            hashes = grams(codes[at : at + CHUNK + GRAM - 1])
            places = [_cell(hashes, cell, self.bits) for cell in CELLS]
            for w, word in enumerate(self.cells):
                mask = word[places[0]]
                for place in places[1:]:
                    mask &= word[place]
                held = np.bincount(mask, minlength=1 << min(8, len(self.langs))) if len(self.langs) <= 8 else None
                for k in range(min(self.width, len(self.langs) - w * self.width)):
                    total[w * self.width + k] += held[(np.arange(len(held)) >> k) & 1 == 1].sum() if held is not None else ((mask >> mask.dtype.type(k)) & mask.dtype.type(1)).sum()
            n += len(hashes)
        return total, n

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and its score: the corrected share of n-grams, times its lead over the next language."""
        if not self.langs or not text or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0
        held, n = self.counts(text)
        share = np.clip((held / n - self.false) / (1 - self.false), 0, 1)
        best = int(share.argmax())
        rest = float(np.delete(share, best).max(initial=0.0))
        return self.langs[best], float(share[best] / (share[best] + rest)) if share[best] > 0 else 0.0


def sample(docs: DataFrame, text: str = "text", lang: str = "lang", per_language: int = 300, key: str = "doc_id", salt: int = 32) -> DataFrame:
    """``lang, text`` of ``per_language`` different rows of each language, or of all if there are fewer.

    Rows are chosen by a hash of ``key`` and ``text``, so the sample is the same at every run, and
    null or repeated keys are as good as others. Rows equal in both count once. Ranks are taken of
    hashes only, in salted parts first. Rows with null text or language are left out.
    """
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(key, text).alias("h"))
    early, late = Window.partitionBy("lang", "part").orderBy("h"), Window.partitionBy("lang").orderBy("h")
    ranked = rows.select("lang", "h").distinct().withColumn("part", F.pmod("h", F.lit(salt)))
    some = ranked.withColumn("n", F.row_number().over(early)).where(F.col("n") <= per_language)
    chosen = cut(some.withColumn("n", F.row_number().over(late)).where(F.col("n") <= per_language).select("lang", "h"))
    chosen = F.broadcast(chosen) if chosen.count() <= SMALL else chosen
    return rows.join(chosen, ["lang", "h"]).groupBy("lang", "h").agg(F.first("text").alias("text")).select("lang", "text")


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", per_language: int = 300, key: str = "doc_id", bits: int = 18, least: int = 3) -> LanguageFilters:
    """Learn the filters from ``per_language`` rows of each language (the documented bound, see ``sample``).

    N-grams are counted on Spark; the driver gets a bitmap of ``2**bits`` bits for each language.
    """

    def split(batches):
        for batch in slices(batches, ROWS):
            for name, t in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                codes = _letters(t)
                for at in range(0, max(1, len(codes) - GRAM + 1), CHUNK):
                    values, counts = np.unique(grams(codes[at : at + CHUNK + GRAM - 1]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(values), pa.string()), pa.array(values.view(np.int64)), pa.array(counts, pa.int64())], names=["lang", "gram", "n"])

    def place(batches):
        for batch in batches:
            hashes, names = batch.column(1).to_numpy().view(np.uint64), batch.column(0)
            for cell in CELLS:
                yield pa.RecordBatch.from_arrays([names, pa.array(_cell(hashes, cell, bits).astype(np.int32))], names=["lang", "cell"])

    def bitmap(rows: pd.DataFrame) -> pd.DataFrame:
        held = np.zeros(1 << bits, dtype=bool)
        held[rows["cell"].to_numpy()] = True
        return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "held": [np.packbits(held).tobytes()]})

    counted = cut(sample(docs, text, lang, per_language, key).mapInArrow(split, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    most = counted.groupBy("lang").agg(F.least(F.max("n"), F.lit(least)).alias("least"))
    kept = counted.join(most, "lang").where(F.col("n") >= F.col("least")).select("lang", "gram")
    maps = kept.mapInArrow(place, "lang string, cell int").distinct().groupBy("lang").applyInPandas(bitmap, "lang string, held binary").collect()
    return LanguageFilters.of_cells({r["lang"]: np.nonzero(np.unpackbits(np.frombuffer(r["held"], np.uint8)))[0] for r in maps}, bits)


def identify(docs: DataFrame, model: LanguageFilters, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1), from whole texts.

    A text that is null or has no letter gets ``und`` and 0, as does every text if no language was
    learned. Columns of those names are replaced; all other columns and all rows stay.
    """
    kept = docs.drop("lang_pred", "score")

    def run(batches):
        for batch in slices(batches, ROWS):
            found = [model.predict(t) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return kept.mapInArrow(run, with_fields(kept.schema, lang_pred="string", score="double"))


def select_identified(docs: DataFrame, model: LanguageFilters, text: str = "text") -> DataFrame:
    """The rows of ``docs`` in a learned language, with their own columns only, also those named as ``identify`` names its own."""
    own = [c for c in docs.columns if c in ("lang_pred", "score")]
    held = dict(zip(own, unused(docs.columns, *(f"own_{c}" for c in own)), strict=True))
    found = identify(docs.withColumnsRenamed(held), model, text).where(F.col("lang_pred") != UNDETERMINED)
    return found.drop("lang_pred", "score").withColumnsRenamed({v: k for k, v in held.items()}).select(*docs.columns)
