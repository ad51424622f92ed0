import zlib

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_language import SYLLABLES, prose
from tests.llm.test_suffixes import plain


def test_stages_take_effect_and_keep_clean_documents(spark, tmp_path):
    rows = [(i, prose(lang, 50, i), lang, "s", 0) for i, lang in enumerate(list(SYLLABLES) * 30)]
    rows.append((200, rows[0][1], "xx", "s", 0))
    rows.append((201, rows[1][1].rsplit(" ", 1)[0] + " other", "yy", "s", 0))
    rows += [(202, None, None, "s", 0), (203, "12 - 34", "xx", "s", 0), (204, prose("zz", 30, 1) + " token = 'abcdefghijkl0'", "zz", "s", 0)]
    rows.append((205, prose("xx", 40, 77) + " " + rows[6][1][:150] + " " + prose("xx", 40, 78), "xx", "s", 0))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        seen.append({r["doc_id"]: r for r in docs.collect()})
    ids = [set(s) for s in seen]
    assert ids[0] == {r[0] for r in rows} - {202, 203}
    assert ids[1] == ids[0] - {200, 201} and ids[2] == ids[3] == ids[4] == ids[1]
    want = {k: b.decode("utf-8", "ignore") for k, _, _, _, b in plain([(i, seen[1][i]["text"]) for i in sorted(ids[1])])}
    assert {i: r["text"] for i, r in seen[2].items()} == want and len(want[205]) < len(seen[1][205]["text"]) - 140
    assert "[SECRET]" in seen[3][204]["text"] and seen[3][5]["text"] == rows[5][1] and seen[3][5]["n_chars"] == len(rows[5][1])
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in whole} == ids[1]
    for r in whole:
        ids_ = np.array([*t.encode(seen[3][r["doc_id"]]["text"], add_special_tokens=False).ids, 0], dtype="<u4")
        assert r["ids_crc32"] == zlib.crc32(ids_[r["start"] : r["start"] + r["length"]].tobytes())


def test_repeated_and_null_keys_clashing_columns_and_empty_tables(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, 0.5, 1), (2, text, 0.5, 2), (2, "quite another text of its own with many words", 0.5, 3), (None, text, 0.5, 4), (None, "no key but words of its own here too", 0.5, 5), (5, "", 0.5, 6), (5, "", 0.5, 7), (1, text, 0.5, 8), (6, None, 0.5, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, row_key int")
    got = sorted((r["row_key"] for r in corpus_pipeline.deduplicated(spark, docs, "").collect()))
    assert got in ([1, 3, 5, 6, 7, 9], [3, 5, 6, 7, 8, 9])
    learned = docs.withColumns({"lang": F.lit("en"), "spans": F.lit(1), "runs": F.lit(2), "kept": F.lit(3)})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, learned, "")
        assert out.columns == learned.columns and out.where("score <> 0.5 or spans <> 1 or runs <> 2 or kept <> 3").count() == 0
        assert stage(spark, learned.limit(0), "").count() == 0
    assert corpus_pipeline.packed(spark, learned.limit(0), "").count() == 0
    assert corpus_pipeline.packed(spark, learned, "").count() == len(rows)
