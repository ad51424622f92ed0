"""From raw documents to packed training sequences: five stages, each one operator of the library.

Stages return the columns of their input, whatever else it has, and nothing for an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.llm import jaccard, language, packing, secrets, suffixes
from proofmill.llm.arrow import unused
from proofmill.tables import cut, table

#: No stage has an equivalent in SQL: a learned language filter, transitive links, byte spans, redaction, packing.
ORACLE_SQL = None
#: Rows of ids that are broadcast at most; more are shuffled.
SMALL = 1_000_000


def _columns(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*docs.columns)


def _with_text(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, the number of characters counted anew."""
    return _columns(df.withColumn("n_chars", F.char_length("text").cast("bigint")) if "n_chars" in docs.columns else df, docs)


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those whose text is null or has no letter go.

    The filters are learned from the labelled rows of the input. A document stays if any language
    is found for it, whatever its label says. Repeated rows are judged alike; an empty table stays empty.
    """
    model = language.fit(docs)
    if not model.langs:  # nothing to learn from: only texts without letters go
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return language.select_identified(docs, model)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by shared shingles: that of the smallest doc_id, a null one last; others stay as they are.

    Rows are told apart by doc_id and text: of a repeated doc_id each text is judged on its own. Of
    rows equal in both, one stays, as its text is a copy. Texts without words are in no group and all stay.
    """
    key, text, n = unused(docs.columns, "row_key", "row_hash", "row_n")
    rows = cut(jaccard.join(docs).where("class_id is not null").groupBy("class_id", "doc_id", "text_hash").agg(F.count("*").alias(n)))
    first = cut(rows.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("first"), F.sum(n).alias("all")).where(F.col("all") > 1))
    first = F.broadcast(first) if first.count() <= SMALL else first
    judged = rows.join(first, "class_id").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash")))
    judged = cut(judged.where(~F.col("stays") | (F.col(n) > 1)).select(F.col("doc_id").alias(key), F.col("text_hash").alias(text), "stays"))
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(text))

    def side(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= SMALL else df

    # repeated rows of the one that stays: any one of them, so that only one is left
    twins = judged.where("stays")
    one = docs.join(side(twins), same).groupBy(key, text).agg(F.first(F.struct(*docs.columns)).alias("one")).select("one.*")
    return docs.join(side(judged), same, "left_anti").select(*docs.columns).unionByName(one)


def stripped(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of repeated 100-byte strings; a character that lost a byte goes whole. No document goes."""
    (rest,) = unused([*docs.columns, "n_bytes", "n_removed", "n_spans", "kept"], "rest")
    own = [c for c in docs.columns if c in ("n_bytes", "n_removed", "n_spans", "kept")]
    held = dict(zip(own, unused([*docs.columns, rest], *(f"own_{c}" for c in own)), strict=True))
    out = suffixes.dedup(docs.withColumnsRenamed(held), whole=rest)
    return _with_text(out.drop(*own).withColumnsRenamed({v: k for k, v in held.items()}).withColumn("text", F.col(rest)), docs)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their secrets masked. No document goes; a null text stays null."""
    return _with_text(secrets.redact(docs), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most 1024 tokens; repeated rows are packed each."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("language_id", identified), ("ngram_jaccard", deduplicated), ("suffix_dedup", stripped), ("secret_scan", redacted), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = cut(docs) if i + 1 < len(STAGES) else docs
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
