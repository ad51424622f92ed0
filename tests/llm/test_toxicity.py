import random

from proofmill.llm import toxicity


def test_held_out_accuracy_and_odd_texts(spark):
    r = random.Random(5)
    words = ["".join(r.choices("abdegilmnoprstu", k=r.randint(2, 7))) for _ in range(300)]
    bad = ["zonkhead", "grubface", "krempeling", "krempelung"]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 5 == 0
        text = r.choices(words, k=r.randint(5, 80))
        if toxic:
            for _ in range(r.randint(1, 4)):
                text.insert(r.randrange(len(text)), r.choice(bad))
        rows.append((i, " ".join(text), 0.5))
        labels.append((i, int(toxic)))
    rows += [(2000, None, 0.5), (2001, "", 0.5), (None, "no key", 0.5), (2002, "you krempelfoo " + "word " * 50_000, 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words double")
    marks = spark.createDataFrame([*labels, (5, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs.where("doc_id % 3 > 0"), marks.where("doc_id % 3 > 0"), trees=5)
    assert model.words.keys() & set(bad) and any(s.startswith("krem") for s in model.stems)
    got = {x["doc_id"]: x["score"] for x in toxicity.score(docs, model).collect()}
    held = [(i, y) for i, y in labels if i % 3 == 0]
    assert sum((got[i] >= 0.3) == bool(y) for i, y in held) >= 0.97 * len(held)
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values()) and got[2001] == got[2000] < 0.3
    one = toxicity.fit(docs, marks.where("toxic = 0"))
    assert {x["score"] for x in toxicity.score(docs, one).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).count() == 0
    odd = docs.where("doc_id < 3").selectExpr("doc_id", "text", "words", *(f"7 AS {c}" for c in ("features", "raw", "probability", "rawPrediction", "prediction", "hits", "own_0", "score")))
    again = toxicity.score(odd.union(odd), model)
    assert sorted(again.columns) == sorted(set(odd.columns) - {"text"}) and again.where("features = 7 and raw = 7 and prediction = 7 and hits = 7 and own_0 = 7 and words = 0.5").count() == 6
    assert {(r["doc_id"], r["score"]) for r in again.collect()} == {(i, got[i]) for i in range(3)}


def test_a_repeated_key_brings_one_row_to_the_sample(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(i, "zonk you" if i % 2 else "fine") for i in range(2, 60)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(1, 60)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks, trees=2)
    assert "zonk" in model.words and "text" not in model.words
