import random

from proofmill.llm import language

SYLLABLES = {"xx": "ka lo mi ter nu sha".split(), "yy": "ößen ach ung ver schi tz".split(), "zz": "qué lla ñor ci dad os".split()}


def prose(lang, n, seed):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choices(SYLLABLES[lang], k=r.randint(1, 3))) for _ in range(n))


def test_held_out_accuracy_and_odd_texts(spark):
    rows = [(i, prose(lang, 60, i), lang) for i, lang in enumerate(list(SYLLABLES) * 40)]
    docs = spark.createDataFrame([*rows, (900, None, "xx"), (901, "", None), (902, "12 !?", "yy")], "doc_id long, text string, lang string")
    model = language.fit(docs.where("doc_id % 2 = 0 or doc_id > 800"))
    assert model.langs == ["xx", "yy", "zz"] and max(model.false) < 0.05
    odd = [(1000, None, "xx", 1), (1001, "", "xx", 2), (1002, "42 -- !", "yy", 3), (None, prose("zz", 5, 9), None, 4), (1003, prose("yy", 400_000, 3), "yy", 5)]
    got = {r["doc_id"]: r for r in language.identify(spark.createDataFrame([(*r, 0) for r in rows] + odd, "doc_id long, text string, lang string, score int"), model).collect()}
    assert sum(got[i]["lang_pred"] == lang for i, _, lang in rows) == len(rows)
    assert [(got[i]["lang_pred"], got[i]["score"]) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert got[None]["lang_pred"] == "zz" and got[1003]["lang_pred"] == "yy"
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_no_training_rows(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert [r["lang_pred"] for r in language.identify(docs, model).collect()] == ["und"]
    assert language.identify(docs.limit(0), model).count() == 0


def test_more_languages_than_bits_in_a_word(spark):
    letters = [chr(0x4E00 + i) for i in range(700)]
    text = lambda k, seed: " ".join("".join(random.Random(f"{k} {seed} {j}").choices(letters[5 * k : 5 * k + 5], k=4)) for j in range(60))
    docs = spark.createDataFrame([(k * 10 + i, text(k, i), f"l{k:03}") for k in range(140) for i in range(4)], "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert len(model.langs) == 140 and model.cells.shape[0] == 3
    held = spark.createDataFrame([(k, text(k, 99)) for k in range(140)], "doc_id long, text string")
    assert all(r["lang_pred"] == f"l{r['doc_id']:03}" for r in language.identify(held, model).collect())


def test_sample_is_bounded_for_null_and_repeated_keys(spark):
    rows = [(None, prose("xx", 20, i), "xx") for i in range(400)] + [(7, prose("yy", 20, i), "yy") for i in range(400)]
    rows += [(1, "same " * 9, "zz")] * 50 + [(2, prose("zz", 20, 1), "zz"), (3, None, "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [(r["lang"], r["text"]) for r in language.sample(docs, per_language=30).collect()]
    assert {lang: sum(x == lang for x, _ in got) for lang in SYLLABLES} == {"xx": 30, "yy": 30, "zz": 2} and len(set(got)) == 62
    model = language.fit(docs, per_language=30)
    plain = language.LanguageFilters({lang: [t for x, t in got if x == lang] for lang in SYLLABLES})
    assert model.langs == plain.langs and (model.cells == plain.cells).all() and (model.false == plain.false).all()


def test_fit_collects_no_texts(spark, monkeypatch):
    docs = spark.createDataFrame([(None, prose(lang, 20, i), lang) for lang in SYLLABLES for i in range(40)], "doc_id long, text string, lang string")
    plain, seen = type(docs).collect, []
    monkeypatch.setattr(type(docs), "collect", lambda df: seen.append(df.columns) or plain(df))
    assert language.fit(docs, per_language=10).langs == list(SYLLABLES)
    assert seen and all("text" not in columns for columns in seen)
