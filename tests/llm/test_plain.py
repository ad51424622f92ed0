"""The learned queries against plain re-computations: every count, filter cell, feature and calibrated score."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from proofmill.llm import language, queries, toxicity

M = 2**64


def _write(spark, folder, rows, labels):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def _words(r, letters, n=150):
    return ["".join(r.choices(letters, k=r.randint(2, 9))) for _ in range(n)]


def _grams(text):
    letters = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in f" {text.lower()} "))
    letters = letters.ljust(4)
    return [letters[i : i + 4] for i in range(len(letters) - 3)]


def _hash(gram):
    total = sum(ord(c) * p for c, p in zip(gram, language.PLACES, strict=True)) % M
    return total ^ (total >> 29)


def _cells(value, bits=18):
    return [(value * c % M) >> (64 - bits) for c in language.CELLS]


def test_op9_against_plain_filters(spark, tmp_path):
    r = random.Random(4)
    pools = {"aa": _words(r, "abcdefghi"), "bb": _words(r, "efghijklmn"), "cç": _words(r, "àçéîñopq漢")}
    rows = []
    for i in range(150):
        lang = ["aa", "bb", "cç"][i % 3]
        text = " ".join(r.choices(pools[lang], k=r.randint(1, 30)) + r.choices(pools["aa"], k=r.randint(0, 3)))
        rows.append((i, r.choice([text, text.upper(), text.replace(" ", ", 12 ")]), lang if i % 7 else None, "s", 1))
    rows += [(900, None, "aa", "s", 0), (901, "12 !", "bb", "s", 4), (902, "a", None, "s", 1), (903, "zzzz yyyy", "aa", None, 9), (904, " ".join(r.choices(pools["bb"], k=20_000)), None, "s", 1)]
    _write(spark, tmp_path, rows, [(0, 1, 0)])
    held = {d: zlib.crc32(str(d).encode()) % 3 == 1 for d, *_ in rows}
    filters = {}
    for lang in pools:
        seen = {}
        for d, t, own, *_ in rows:
            if own == lang and t is not None and not held[d]:
                for g in map(_hash, _grams(t)):  # n-grams of one hash are one
                    seen[g] = seen.get(g, 0) + 1
        least = min(3, max(seen.values()))
        filters[lang] = {(i, c) for g, n in seen.items() if n >= least for i, c in enumerate(_cells(g))}
    # one array of cells serves all three hashes
    cells = {lang: {c for _, c in f} for lang, f in filters.items()}
    false = {lang: min(0.99, (len(c) / 2**18) ** 3) for lang, c in cells.items()}
    got = {x["doc_id"]: x for x in queries.op9_language_id(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for d, t, *_ in rows:
        x = got[d]
        assert x["held_out"] == held[d]
        if not t or not any(map(str.isalpha, t)):
            assert (x["lang_pred"], x["score"]) == ("und", 0.0)
            continue
        grams = _grams(t)
        share = {}
        for lang in sorted(cells):
            hits = sum(all(c in cells[lang] for c in _cells(_hash(g))) for g in grams) if len(grams) < 5000 else None
            if hits is None:
                known = {g: all(c in cells[lang] for c in _cells(_hash(g))) for g in set(grams)}
                hits = sum(known[g] for g in grams)
            share[lang] = min(1.0, max(0.0, (hits / len(grams) - false[lang]) / (1 - false[lang])))
        best = max(sorted(share), key=lambda k: share[k])
        rest = max(v for k, v in share.items() if k != best)
        assert x["lang_pred"] == best and math.isclose(x["score"], share[best] / (share[best] + rest) if share[best] else 0.0, abs_tol=1e-12)


def _plain_features(text, words, stems):
    low = text.lower()
    tokens = re.findall(r"[^\W\d_]+", low)

    def weight(w):
        if words.get(w):
            return words[w], True
        return max([stems.get(w[:n], 0.0) for n in (4, 5, 6) if len(w) >= n], default=0.0), False

    found = [weight(w) for w in tokens]
    hits = [i for i, (v, _) in enumerate(found) if v]
    second = [i for i, w in enumerate(tokens) if w in toxicity.SECOND]
    n, letters = max(1, len(tokens)), max(1, sum(map(len, tokens)))
    by_stem = sum(not found[i][1] for i in hits)
    disguised = [m[0] for m in re.finditer(toxicity.DISGUISED, low)]
    undone = [w.translate(str.maketrans("013457@$", "oieastas")) for w in disguised]
    return [math.log1p(len(tokens)), len(hits), len(hits) / n, sum(found[i][0] for i in hits), by_stem, by_stem / n, sum(any(abs(i - j) <= 5 for j in second) for i in hits), len(second) / n,
            sum(bool(re.match("[A-ZÀ-ÖØ-Þ]", c)) for c in text) / letters, (len(text) - letters) / max(1, len(text)), len(re.findall(r"[!?]{2,}", text)) / n, len(disguised) / n, sum(weight(w)[0] > 0 for w in undone), len(re.findall(toxicity.SPACED, low)) / n]


@pytest.fixture(scope="module")
def toxic(spark, tmp_path_factory):
    folder, r = tmp_path_factory.mktemp("toxic"), random.Random(9)
    plain, bad = _words(r, "abcdefghiklm", 200), ["grubnok", "skarvelt", "skarvelts", "dromphule", "vexlarton"]
    rows, labels = [], []
    for i in range(400):
        mean = i % 4 == 0
        text = r.choices(plain, k=r.randint(1, 40))
        if mean:
            for _ in range(r.randint(1, 3)):
                text.insert(r.randint(0, len(text)), r.choice([*bad, "gr0bnok", "YOU", "d r o m p"]))
        text = " ".join(text) + r.choice(["", "!!", "?", "..."])
        rows.append((i, text.upper() if i % 17 == 0 else text, "xx", "s", len(text)))
        if i % 5:
            labels.append((i, 1, int(mean) if i % 13 else int(not mean)))
    rows += [(1000, None, None, None, None), (1001, "", "xx", "s", 0), (1002, " ".join(r.choices(plain + bad, k=60_000)), "xx", "s", 1)]
    _write(spark, folder, rows, labels)
    return str(folder), rows, labels


def test_op6_lexicon_features_and_calibrated_scores_against_plain_ones(spark, toxic):
    folder, rows, labels = toxic
    held = {d: zlib.crc32(str(d).encode()) % 4 == 2 for d, *_ in rows}
    docs, marks = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    known = queries.remainder(4) != 2
    model = toxicity.fit(docs.where(known), marks.select("doc_id", "toxic").where(known))
    # the lexicon: document counts of words and beginnings in the two thirds that are not for calibration
    learned = {d: y for d, _, y in labels if not held[d]}
    part = {x["key"]: x["later"] for x in spark.createDataFrame([(d,) for d in learned], "key long").selectExpr("key", "pmod(xxhash64(key, 'calibrate'), 3) = 0 AS later").collect()}
    counts, size = {}, [0, 0]
    for d, t, *_ in rows:
        if d in learned and not part[d]:
            words = set(re.findall(r"[^\W\d_]+", (t or "").lower()))
            size[learned[d]] += 1
            for term in words | {w[:n] + "*" for w in words for n in (4, 5, 6) if len(w) >= n}:
                counts.setdefault(term, [0, 0])[learned[d]] += 1
    weights = {t: math.log((b + 0.5) / (size[1] + 1)) - math.log((a + 0.5) / (size[0] + 1)) for t, (a, b) in counts.items() if b >= 4}
    strong = {t: w for t, w in weights.items() if w >= 3.0}
    assert strong and model.words == pytest.approx({t: w for t, w in strong.items() if t[-1] != "*"}) and model.stems == pytest.approx({t[:-1]: w for t, w in strong.items() if t[-1] == "*"})
    # features by plain loops, trees asked one vector at a time, calibration by interpolation
    edges, values = np.array(model.calibration.boundaries), np.array(model.calibration.predictions)
    got = {x["doc_id"]: x for x in queries.op6_toxicity(spark, folder).collect()}
    assert got.keys() == held.keys()
    for d, t, *_ in rows[::3] + rows[-3:]:
        raw = model.trees.predictProbability(Vectors.dense(_plain_features(t or "", model.words, model.stems)))[1]
        want = float(np.clip(np.interp(raw, edges, values), 0, 1))
        assert got[d]["held_out"] == held[d] and math.isclose(got[d]["score"], want, abs_tol=1e-9) and got[d]["predicted"] == int(want >= 0.3)
    mean = {y: np.mean([got[d]["score"] for d, _, v in labels if v == y and held[d]]) for y in (0, 1)}
    assert mean[1] > mean[0] + 0.3


def test_op6_scores_do_not_depend_on_other_columns(spark, toxic, tmp_path):
    folder, rows, labels = toxic
    _write(spark, tmp_path, [(d, t, f"l{d}", f"s{d}", 7) for d, t, *_ in rows], labels)
    a, b = ({x["doc_id"]: x["score"] for x in queries.op6_toxicity(spark, f).collect()} for f in (folder, str(tmp_path)))
    assert a == pytest.approx(b)
