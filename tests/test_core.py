"""Hand-computed cases, golden strings and properties of the core operators."""

import hashlib
import json
import math
import os
import uuid

import pytest
from pyspark.sql import functions as F

from proofmill import schemas, vocab
from proofmill.functions import classify, code, ids, tails
from proofmill.operators import attempts as att
from proofmill.operators import constraints, records, sampling, training
from proofmill.plans import describe, hypothesis
from proofmill.sources import jsonl
from proofmill.streaming import feeds


def test_uuid5_and_seed_equal_the_standard_library(spark):
    texts = ["", "x = 1", "é\n你好", "a" * 999]
    rows = spark.createDataFrame([(t,) for t in texts], "c string").select("c", ids.example_id(F.col("c")).alias("i"), ids.dataset_id({"b": F.col("c"), "a": F.lit(None).cast("int")}).alias("d"))
    for r in rows.withColumn("s", ids.seed_of(F.col("i"))).collect():
        want = uuid.uuid5(uuid.UUID(ids.EXAMPLE), hashlib.sha256(r["c"].encode()).hexdigest())
        assert (r["i"], r["s"]) == (str(want), want.int % (2**31 - 1))
        text = json.dumps({"a": None, "b": r["c"]}, sort_keys=True, separators=(",", ":"))
        assert r["d"] == str(uuid.uuid5(uuid.UUID(ids.DATASET), hashlib.sha256(text.encode()).hexdigest()))


def test_eval_spec_id_has_spaces_and_nested_metadata(spark):
    row = spark.range(1).select(ids.eval_spec_id({"ops": F.array(F.lit("a"), F.lit("b")), "form_metadata": F.lit('{"scale": 0.125}')}).alias("i")).first()
    text = json.dumps({"form_metadata": {"scale": 0.125}, "ops": ["a", "b"]}, sort_keys=True)
    assert row["i"] == str(uuid.uuid5(uuid.UUID(ids.EVAL_SPEC), text))


GOOD = "import torch\ndef f(x):\n    y = torch.relu(x)\n    return torch.tanh(y)\n"


def test_train_guard():
    assert code.train_reason(GOOD) is None
    assert code.train_reason("x = (").startswith("syntax@")
    assert "flow@" in code.train_reason(GOOD.replace("    y", "    if x:\n        pass\n    y"))
    assert "call:torch.rand" in code.train_reason(GOOD.replace("torch.relu(x)", "torch.rand(3)"))
    assert "method:to" in code.train_reason(GOOD.replace("torch.relu(x)", "x.to('cpu')"))
    assert "result@" in code.train_reason(GOOD.replace("return torch.tanh(y)", "return x, y"))
    assert "no_argument" in code.train_reason("import torch\ndef f():\n    return 1\n")
    assert code.train_reason("import torch as t\ndef f(x):\n    return x\n") == "import"


def test_spec_guard_and_operations():
    ops = ["torch.relu", "torch.tanh"]
    reason = lambda text, given=ops, n=1: code.spec_reason(text, "chain_2_unary", given, n)
    assert code.operations(GOOD) == ops and reason(GOOD) is None and code.operations("x = (") is None
    assert code.operations("import torch\ndef f(x):\n    return torch.add(torch.exp(x), x.view(-1))\n") == ["torch.exp", "torch.add"]
    assert reason(GOOD, ops[::-1]) == "order:torch.relu,torch.tanh" and reason(GOOD, n=2) == "inputs:1/2@2"
    assert reason(GOOD.replace("torch.relu(x)", "x + x")) == "operator:Add@3" and reason(GOOD.replace("relu(x)", "relu(-x)")) == "sign:USub@3"
    assert reason(GOOD.replace("relu(x)", "relu(x, -1)")) is None
    assert reason(GOOD.replace("import torch", "import os")) == "import:os@1" and reason(GOOD.replace("import torch", "import torch as t")) == "import:torch=t@1"
    assert reason(GOOD.replace("import torch\n", "")) == "no_import" and reason("import torch\n") == "no_function" and reason("x = (").startswith("syntax@")
    assert reason(GOOD + "y = 1\n") == "module:Assign@5" and reason(GOOD + GOOD[13:]) == "module:FunctionDef@5"
    assert reason(GOOD.replace("(x):", "(x=1):")) == "signature@2" and reason(GOOD.replace("(x):", "(x, *y):")) == "signature@2"
    for inner, want in (("torch.rand(3)", "call:torch.rand@3"), ("torch.sort(x)", "unlisted:torch.sort@3"), ("x.to(1)", "method:to@3"), ("x.foo()", "unlisted:foo@3"), ("f(x)(x)", "callee:Call@3"), ("[x for x in y]", "expression:ListComp@3")):
        assert reason(GOOD.replace("torch.relu(x)", inner)) == want
    assert reason(GOOD.replace("torch.relu(x)", "torch.tanh(torch.relu(x))")) == "count:3/2"


def test_answers_and_preflight_reasons(spark):
    texts = ["a ```py\n x\n``` ```python\ny```", "```python\n \n```", 'no: { "error" : "why" }', '{"error": "a\\q"}', "none", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", classify.parse_response(F.col("t")).alias("r")).orderBy("i").collect()
    assert [tuple(r["r"]) for r in rows] == [("code", "x", None), ("parse_error", None, "empty_fence"), ("unrealizable", None, "why"), ("parse_error", None, "bad_error_json"), ("parse_error", None, "nothing_found"), ("parse_error", None, "nothing_found")]
    cases = [(True, None, None, 1.0, 1.0), (True, "e", None, 1.0, 1.0), (False, None, 0.5, 1.0, 1.0), (False, None, None, None, 1.0), (True, None, None, 1.0, None)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, ok boolean, e string, m double, x double, y double")
    got = df.select("i", classify.preflight_verdict(F.col("ok"), F.col("e"), F.col("m"), F.col("m"), F.col("m"), F.col("x"), F.col("y")).alias("v")).orderBy("i").collect()
    assert [tuple(r["v"]) for r in got] == [(True, None), (False, "harness:e"), (False, "apart:5.000e-01/5.000e-01/0.50"), (False, "failed"), (False, "no_timings")]


def test_canonical_hash_ignores_names_only():
    other = GOOD.replace("def f(x)", "def g(v0)").replace("(x)", "(v0)").replace("y", "zz")
    assert code.canonical_hash(GOOD) == code.canonical_hash(other) != code.canonical_hash(GOOD.replace("relu", "exp"))
    assert code.canonical_hash("x = (") == hashlib.sha256(b"x = (").hexdigest()


def test_jit_functions_and_diff():
    source = "import triton\n@triton.jit\ndef a(x):\n    pass\n@triton.jit(debug=1)\ndef b(x):\n    pass\ndef c():\n    pass\n"
    assert [n for n, _ in code.jit_functions(source)] == ["a", "b"] and code.jit_functions("triton (") == []
    assert code.unified_diff(None, "a") is None and code.unified_diff("a", "a") == "" and "+b" in code.unified_diff("a", "b")


def test_tails_and_textbook_values():
    assert math.isclose(tails.chi2_tail(3.841459, 1), 0.05, rel_tol=1e-5) and math.isclose(tails.chi2_tail(9.487729, 4), 0.05, rel_tol=1e-5)
    assert tails.binomial_two_sided(0, 0) == 1 and tails.binomial_two_sided(1, 4) == 0.625
    w, p = tails.shapiro_wilk([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert math.isclose(w, 0.78881, abs_tol=1e-5) and math.isclose(p, 0.006704, abs_tol=1e-5)
    assert tails.shapiro_wilk([1.0, 1.0, 1.0]) == (None, None)
    assert math.isclose(tails.signed_rank_tail(0, 5, False, 0), 0.0625)


def test_wilson_and_holm(spark):
    low, high = describe.wilson(F.col("k"), F.col("n"))
    rows = spark.createDataFrame([(0, 0), (0, 10), (10, 10), (5, 10)], "k int, n int").select(low.alias("l"), high.alias("h")).collect()
    assert tuple(rows[0]) == (0.0, 0.0) and rows[1]["l"] == 0.0 and rows[2]["h"] == 1.0
    assert math.isclose(rows[3]["l"], 0.2366, abs_tol=1e-4) and math.isclose(rows[3]["h"], 0.7634, abs_tol=1e-4)
    tests = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)], "name string, p_value double")
    got = {r["name"]: r for r in hypothesis.holm(tests).collect()}
    assert [round(got[x]["p_holm"], 6) for x in "abc"] == [0.03, 0.06, 0.06] and got["d"]["p_holm"] is None and got["a"]["reject_holm"]


def test_describe_of_few_values(spark):
    rows = spark.createDataFrame([("a", 2.0, 0), ("b", 1.0, 0), ("b", 3.0, 0), ("c", 9.0, None)], "g string, x double, final_winning_attempt_n int")
    got = {r["g"]: r for r in describe.measure_summary(rows, {"m": F.col("x")}, ["g"]).collect()}
    assert got["a"]["std"] == 0.0 and got["a"]["q1"] == got["a"]["max"] == 2.0 and got["b"]["median"] == 2.0 and got["b"]["q1"] == 1.5 and got["b"]["iqr"] == 1.0 and "c" not in got
    assert describe.measure_summary(rows.limit(0), {"m": F.col("x")}, ["g"]).count() == 0


def test_quantiles_of_groups_of_any_size(spark):
    """A group of a third of all rows, few values that repeat often, null and tiny groups; no range holds a large group."""
    import numpy as np

    r = np.random.default_rng(4)
    data = {"big": r.normal(size=20_000), "ties": np.round(r.normal(size=9000)), None: r.normal(size=501), "one": np.array([3.0]), "two": np.array([1.0, 2.0])}
    df = spark.createDataFrame([(g, float(v)) for g, vs in data.items() for v in vs] + [("one", None), ("none", None)], "g string, v double").repartition(5)
    shares = {"lo": 0.0, "q": 0.25, "m": 0.5, "p": 0.99, "hi": 1.0}
    got = {x["g"]: x for x in describe.quantiles(df, "v", ["g"], shares).collect()}
    assert got.keys() == data.keys()
    for g, vs in data.items():
        for name, share in shares.items():
            assert math.isclose(got[g][name], np.quantile(vs, share), rel_tol=1e-12, abs_tol=1e-12)
    whole = describe.quantiles(df, "v", [], {"m": 0.5}).first()["m"]
    assert math.isclose(whole, np.median(np.concatenate(list(data.values()))))
    dealt = describe.placed(df, "v", ["g"])
    assert {x["g"]: (x["n"], x["last"]) for x in dealt.groupBy("g").agg(F.max("n").alias("n"), F.max(F.col("before") + F.col("count")).alias("last")).collect()} == {g: (len(v), len(v)) for g, v in data.items()}
    flagged = describe.outliers(df, ["g"], "v").where("is_outlier").groupBy("g").count().collect()
    for x in flagged:
        vs = data[x["g"]]
        q1, q3 = np.quantile(vs, [0.25, 0.75])
        assert x["count"] == ((vs < q1 - 1.5 * (q3 - q1)) | (vs > q3 + 1.5 * (q3 - q1))).sum()


def _labels(spark, table):
    rows = [(i * 10 + j, lab, f"ex{i}", "easy", "compiled_correct_slow" if v else "runtime_fail", 0 if v else None, float(v or 0) or None) for i, vs in enumerate(table) for j, (lab, v) in enumerate(zip("abc", vs))]
    return spark.createDataFrame(rows, "seq int, model_label string, example_id string, tier string, final_outcome string, final_winning_attempt_n int, speedup_vs_inductor double")


def test_mcnemar_takes_the_exact_test_below_25(spark):
    for discordant in (24, 25):
        rows = _labels(spark, [(1.0, None, 1.0)] * discordant + [(1.0, 1.0, 1.0)] * 5)
        r = hypothesis.mcnemar(hypothesis.pass_map(rows), hypothesis.default_contrasts(spark, ["a", "b"])).first()
        assert (r["n10"], r["n11"], r["exact"]) == (discordant, 5, discordant < 25)
        want = 2 / 2**24 if discordant < 25 else tails.chi2_tail(24 * 24 / 25, 1)
        assert math.isclose(r["p_value"], want, rel_tol=1e-9)


def test_exact_mcnemar_is_not_run_on_many_discordant_examples(spark, monkeypatch):
    def checked(k, n):
        assert n < 25, "its time grows with the cube of n"
        return tails.binomial_two_sided(int(k), int(n))

    monkeypatch.setattr(tails, "binomial_p", tails._vector(checked))
    a, b, c = 1, 2, 4
    patterns = spark.createDataFrame([(a, a | b, 60000), (b, a | b, 60100), (a | b, a | b, 9), (a, a | c, 3), (c, a | c, 1)], "passed long, present long, n long")
    got = {r["name"]: r for r in hypothesis.mcnemar_of(patterns, list("abc"), hypothesis.default_contrasts(spark, list("abc"))).collect()}
    many, few = got["b vs a"], got["c vs a"]
    assert (many["n_common"], many["n10"], many["n01"], many["exact"]) == (120109, 60000, 60100, False)
    assert math.isclose(many["p_value"], tails.chi2_tail(99 * 99 / 120100, 1), rel_tol=1e-9)
    assert (few["n10"], few["n01"], few["exact"], few["p_value"]) == (3, 1, True, 0.625)


def test_planned_contrasts_of_many_examples(spark, monkeypatch):
    def checked(k, n):
        assert n < 25, "its time grows with the cube of n"
        return tails.binomial_two_sided(int(k), int(n))

    monkeypatch.setattr(tails, "binomial_p", tails._vector(checked))
    a, b, c, d = 1, 2, 4, 8
    discordant = {"b vs a": (b, 69120, 66600), "c vs a": (c, 74520, 66960), "d vs a": (d, 9, 2)}
    counts = [(one, a | bit, n) for bit, n10, n01 in discordant.values() for one, n in ((a, n10), (bit, n01), (a | bit, 1000))]
    patterns = spark.createDataFrame(counts, "passed long, present long, n long")
    got = {r["name"]: r for r in hypothesis.contrasts_of(patterns, list("abcd"), hypothesis.default_contrasts(spark, [*"abcd", "x"])).collect()}
    chi2 = lambda n10, n01: tails.chi2_tail((n10 - n01 - 1) ** 2 / (n10 + n01), 1)
    want = {"c vs a": chi2(74520, 66960), "b vs a": chi2(69120, 66600), "d vs a": tails.binomial_two_sided(2, 11)}
    for i, (name, p) in enumerate(want.items()):  # both chi-squared tails lie below what one minus a sum can tell from zero
        assert math.isclose(got[name]["p_value"], p, rel_tol=1e-9) and math.isclose(got[name]["holm_threshold"], 0.05 / (3 - i))
        assert math.isclose(got[name]["p_holm"], (3 - i) * p, rel_tol=1e-9) and got[name]["exact"] == (name == "d vs a")
    assert got["x vs a"]["missing"] and got["x vs a"]["p_value"] is None


def test_report_of_many_discordant_examples_equals_its_tests(spark, monkeypatch):
    import random

    def checked(k, n):
        assert n < 25, "its time grows with the cube of n"
        return tails.binomial_two_sided(int(k), int(n))

    monkeypatch.setattr(tails, "binomial_p", tails._vector(checked))
    r = random.Random(3)
    rows = []
    for seq in range(2400):  # several rows of most examples, also of a label that is not asked for; a last row is often no win
        won, speed = r.random() < 0.6, round(r.lognormvariate(0, 1), 2)
        rows.append((seq, r.choice("abcd"), f"ex{r.randrange(200)}", r.choice(["easy", "hard"]), r.choice(["compiled_correct_slow", "compiled_correct_parity"]) if won else r.choice(["runtime_fail", "compile_fail", None]), 0 if won else None, speed if won and r.random() < 0.9 else None))
    df = spark.createDataFrame(rows, "seq int, model_label string, example_id string, tier string, final_outcome string, final_winning_attempt_n int, speedup_vs_inductor double")
    labels, tables = list("abc"), hypothesis.compare(df, list("abc"))
    contrasts = hypothesis.default_contrasts(spark, labels)
    assert all(x["n10"] + x["n01"] >= 25 and not x["exact"] for x in tables["contrasts"].collect())
    last, won = {}, {}
    for row in rows:
        last[row[1], row[2]] = row
        if row[5] is not None and row[6] is not None:
            won[row[1], row[2]] = row[6]
    assert any(last[k][6] != v for k, v in won.items())
    passed = {k: row[4].startswith("compiled_correct") for k, row in last.items() if row[4] is not None}
    for x in tables["contrasts"].collect():
        pairs = [(v, passed[x["label_b"], e]) for (lab, e), v in passed.items() if lab == "a" and (x["label_b"], e) in passed]
        assert (x["n_common"], x["n10"], x["n01"]) == (len(pairs), pairs.count((True, False)), pairs.count((False, True)))
    assert {x["model_label"]: x["n"] for x in tables["shapiro"].collect()} == {lab: sum(k[0] == lab for k in won) for lab in "abcd"}
    assert {(x["model_label"], x["final_outcome"]): x["n"] for x in tables["outcomes"].where("tier = '__all__'").collect()} == {k: n for k in {(v[1], v[4]) for v in last.values()} if (n := sum((v[1], v[4]) == k for v in last.values()))}
    alone = {"contrasts": hypothesis.planned_contrasts(df, contrasts), "shapiro": hypothesis.shapiro(df), "wilcoxon": hypothesis.wilcoxon_contrasts(df, contrasts), "mde": hypothesis.mde_table(records.last_per_key(df, ["model_label", "example_id"]))}
    plain = lambda t: sorted(str([round(v, 9) if isinstance(v, float) else v for v in x]) for x in t.collect())
    for name, t in alone.items():
        assert plain(tables[name].select(*t.columns)) == plain(t), name


def test_degenerate_and_skipped_tests(spark):
    same = _labels(spark, [(1.0, 1.0, 1.0)] * 4)
    r = hypothesis.cochran_q(same, list("abc")).first()
    assert (r["statistic"], r["p_value"]) == (0.0, 1.0) and "degenerate" in r["skipped_reason"]
    assert hypothesis.cochran_q(same, ["a", "x"]).first()["skipped_reason"].startswith("empty")
    assert hypothesis.friedman(_labels(spark, [(1.0, 2.0, 3.0)] * 29), list("abc")).first()["statistic"] is None
    r = hypothesis.friedman(_labels(spark, [(1.0, 2.0, 3.0)] * 30), list("abc")).first()
    assert math.isclose(r["statistic"], 60.0) and r["n"] == 30
    skipped = {x["name"]: x["skipped_reason"] for x in hypothesis.wilcoxon_contrasts(_labels(spark, [(1.0, 1.0, i + 1.0) for i in range(6)]), hypothesis.default_contrasts(spark, list("abc"))).collect()}
    assert skipped == {"b vs a": "all pairs identical", "c vs a": None}


def test_shuffle_gives_every_row_its_place(spark):
    keys = [*range(700), 5, 5, None]
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i int")
    got = records.shuffle_places(rows, "7", "k").collect()
    assert sorted(r["place"] for r in got) == list(range(1, len(keys) + 1)) and sorted(r["i"] for r in got) == list(range(len(keys)))
    want = [None, *sorted((k for k in keys if k is not None), key=lambda k: (hashlib.sha256(f"7{k}".encode()).hexdigest(), k))]
    assert [r["k"] for r in sorted(got, key=lambda r: r["place"])] == want


def test_bootstrap_median_takes_all_values(spark):
    import numpy as np

    r = np.random.default_rng(8)
    data = {"a": r.lognormal(size=20001), "b": np.round(r.normal(size=8000), 1), "c": np.array([3.0]), "d": np.array([1.0, 4.0, 2.0, 9.0]), None: np.array([2.0, 5.0])}
    rows = spark.createDataFrame([(g, float(v)) for g, vs in data.items() for v in vs] + [("a", None)], "g string, v double")
    got = {x["g"]: x for x in describe.bootstrap_median(rows, "g", "v").collect()}
    assert {g: (x["n"], x["median"]) for g, x in got.items()} == {g: (len(v), np.median(v)) for g, v in data.items()}
    assert all(x["lo"] <= x["median"] <= x["hi"] for x in got.values())
    assert (got["c"]["lo"], got["c"]["hi"], got["d"]["lo"], got["d"]["hi"]) == (3.0, 3.0, 1.0, 9.0)
    want = np.quantile([np.median(r.choice(data["a"], 20001)) for _ in range(1000)], [0.025, 0.975])
    assert 0.85 < (got["a"]["hi"] - got["a"]["lo"]) / (want[1] - want[0]) < 1.15


def test_shapiro_takes_all_values(spark, monkeypatch):
    import random

    r = random.Random(5)
    data = {"three": [1.0, 2.0, 9.0], "four": [1.0, 2.0, 2.5, 9.0], "five": [3.0, 1.0, 2.0, 2.0, 8.0], "six": [1.0, 2.0, 4.0, 4.0, 5.0, 40.0], "ten": [r.gauss(5, 1) for _ in range(10)], "ties": [float(r.randint(1, 9)) for _ in range(700)], "many": [r.gauss(50, 3) for _ in range(6000)], "two": [1.0, 2.0], "same": [2.0] * 30}
    rows = [(i, k, f"ex{i}", 0, v) for k, vs in data.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "seq int, model_label string, example_id string, final_winning_attempt_n int, speedup_vs_inductor double")
    for piece in (1 << 20, 7):
        monkeypatch.setattr(hypothesis, "PIECE", piece)
        got = {x["model_label"]: x for x in hypothesis.shapiro(df).collect()}
        for k, vs in data.items():
            w, p = tails.shapiro_wilk(vs)
            x = got[k]
            assert (x["n"], x["beyond_range"]) == (len(vs), len(vs) > 5000)
            assert (x["statistic"], x["p_value"]) == (None, None) if w is None else math.isclose(x["statistic"], w, rel_tol=1e-9) and math.isclose(x["p_value"], p, rel_tol=1e-5, abs_tol=1e-12), k


def test_average_ranks_across_ranges(spark):
    import random

    r = random.Random(2)
    data = [("g" if i % 3 else "h", r.choice([i * 0.5, 7.0, 9.0])) for i in range(400)]
    got = {(x["g"], x["v"]): x["rank"] for x in hypothesis.average_ranks(spark.createDataFrame(data, "g string, v double"), "v", ["g"]).collect()}
    for g in "gh":
        values = sorted(v for k, v in data if k == g)
        for v in set(values):
            at = [i + 1 for i, x in enumerate(values) if x == v]
            assert got[g, v] == sum(at) / len(at)


def test_element_comparison_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    cases = {1: ("default_fp32", [(1.0, 1.0), (2.0, 2.0)]), 2: ("default_fp32", [(nan, 1.0), (1.0, 1.0)]), 3: ("default_fp32", [(1.0, nan), (1.0, 1.0)]), 4: ("default_fp32", [(1.0, inf)]), 5: ("exact_integer", [(1.0, 1.0), (2.0, 3.0)]), 6: ("masked_logits", [(-inf, -inf), (1.0, 1.0)]), 7: ("masked_logits", [(-inf, inf), (1.0, 1.0)]), 8: ("default_fp32", [(1.1, 1.0)])}
    rows = [(t, i, c, r, p) for t, (p, xs) in cases.items() for i, (c, r) in enumerate(xs)]
    got = {r["task_id"]: r for r in att.compare_elements(spark.createDataFrame(rows, "task_id int, idx int, candidate double, reference double, policy string"), vocab.tolerance_table(spark)).collect()}
    assert {t: r["passed"] for t, r in got.items()} == {1: True, 2: False, 3: True, 4: True, 5: False, 6: True, 7: False, 8: False}
    assert got[2]["max_abs_diff"] == 1e38 and got[2]["pct_elements_exceeding_tol"] == 50 and got[3]["max_abs_diff"] == 1e38
    assert got[6]["max_abs_diff"] == 0 and got[7]["n_elements_exceeding_tol"] == 1 and got[5]["n_elements_exceeding_tol"] == 1


def test_eval_outcome_thresholds(spark):
    rows = spark.createDataFrame([(1.1,), (1.0999,), (1.0,), (0.99,), (None,)], "s double").select(att.eval_outcome(F.lit("success"), F.lit(None).cast("string"), F.lit("passed"), F.col("s")).alias("o")).collect()
    assert [r["o"].rpartition("_")[2] for r in rows] == ["inductor", "parity", "parity", "slow", "fail"]


def test_quotas_and_split_sizes(spark):
    got = {r["op_category"]: r["n"] for r in sampling.scaled_quotas(sampling.quota_table(spark), 7).collect()}
    assert sum(got.values()) == 7 and got["matmul"] == 1
    specs, report = sampling.sample_specs(spark.createDataFrame([], schemas.OBSERVATION), 60, "1")
    specs = specs.cache()
    assert specs.count() == specs.select("spec_id").distinct().count() == 60 and not [r for r in report.collect() if r["capped"]]
    rows = spark.createDataFrame([(str(i), "a" if i % 4 else None) for i in range(101)], "dataset_id string, op_category string")
    split = training.validation_split(rows, 0.1, "s").collect()
    assert len([r for r in split if r["op_category"] == "a"]) == 8 and len(split) == 11
    assert {r["dataset_id"] for r in training.validation_split(rows.repartition(7), 0.1, "s").collect()} == {r["dataset_id"] for r in split}


def test_constraints_name_what_is_broken(spark):
    a = lambda n, ok, status, err=None: (n, None, None, "c", ("success" if ok else "failed", None if ok else "e"), err, (status, "p") if status else None, *[None] * 5, None)
    source = ("x", "c", "o", [[1]], ["float32"], 1, "matmul", "p")
    rows = [("1", "x", source, [a(0, True, "passed")], "compiled_correct"), ("2", "x", source, [a(1, True, "passed")], "compiled_correct"), ("3", "x", source, [a(0, True, None)], "runtime_fail"), ("4", "y", source, [a(0, False, None)], "numeric_fail"), ("5", "x", source, [], "compile_fail")]
    got = {r["dataset_id"]: r["v"] for r in spark.createDataFrame(rows, schemas.DATASET).select("dataset_id", constraints.violations(constraints.dataset_row()).alias("v")).collect()}
    assert got == {"1": [], "2": ["attempt_numbers"], "3": ["attempt_result"], "4": ["final_outcome", "example_id"], "5": ["has_attempts"]}
    corpus = spark.createDataFrame([("a", "matmul", "c", [[1]], ["float32", "int8"], 1, "zzz", "d", "eval", "o", None)], schemas.CORPUS)
    checks = {"same_length": constraints.same_length(), "split_difficulty": constraints.split_difficulty(), **constraints.vocabulary()}
    assert corpus.select(constraints.violations(checks)).first()[0] == ["same_length", "split_difficulty", "tolerance_policy"]


def test_sources_and_sinks(spark, tmp_path):
    slim = {"example_id": "a", "op_category": "matmul", "pytorch_code": "c", "input_shapes": [[1]], "input_dtypes": ["int8"], "rng_seed": 1, "tolerance_policy": "default_fp32"}
    p = tmp_path / "x.jsonl"
    p.write_text("\n".join([json.dumps(slim), json.dumps(slim | {"example_id": "b", "input_dtypes": []}), '{"example_id": "c", "dataset_id": "z", oops']))
    checks = {"same_length": constraints.same_length()}
    good, bad = jsonl.read_tolerant(spark, str(p), schemas.SLIM, checks)
    assert [r["example_id"] for r in good.collect()] == ["a"] and sorted(r["error_type"] for r in bad.collect()) == ["constraint", "malformed"]
    assert jsonl.read_lenient(spark, str(p), schemas.SLIM).count() == 2
    with pytest.raises(Exception):  # noqa: B017
        jsonl.read_strict(spark, str(p), schemas.SLIM).collect()
    q = tmp_path / "y.jsonl"
    q.write_text(json.dumps(slim | {"input_dtypes": []}))
    with pytest.raises(Exception, match="same_length"):
        jsonl.read_strict(spark, str(q), schemas.SLIM, checks).collect()
    assert jsonl.read_strict(spark, str(tmp_path / "none"), schemas.SLIM).count() == 0
    rows, out = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", None)], "dataset_id string, v string"), str(tmp_path / "out")
    assert jsonl.append(rows, out).count() == 2 and jsonl.append(rows, out).count() == 0
    with pytest.raises(ValueError):
        jsonl.append(rows, out, on_duplicate="raise")
    assert jsonl.append(rows, out, on_duplicate="append").count() == 3 and spark.read.json(out).count() == 5
    root = tmp_path / "labels"
    for label in "ab":
        (root / label).mkdir(parents=True)
        (root / label / "eval_rows.jsonl").write_text('{"example_id": "1"}\n')
    assert sorted(r["model_label"] for r in jsonl.read_labels(spark, str(root), "example_id string").collect()) == ["a", "b"]
    (tmp_path / "m.txt").write_text("# no\n\n a b\nc\n")
    assert sorted(r["entry"] for r in jsonl.read_manifest(spark, str(tmp_path / "m.txt")).collect()) == ["a", "c"]
    for d in ("src", "src/tests"):
        (tmp_path / d).mkdir(exist_ok=True)
        (tmp_path / d / "k.py").write_text("import triton\n")
    assert jsonl.read_sources(spark, str(tmp_path / "src")).count() == 1
    jsonl.write_training(rows, str(tmp_path / "t"))
    assert '{"dataset_id":"2","v":null}' in [r["value"] for r in spark.read.text(str(tmp_path / "t")).collect()]


def test_merge_is_idempotent(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), ("x", 3)], "dataset_id string, seq int")
    kept, lost = records.merge([a, a])
    again, _ = records.merge([kept.drop("src_ord")])
    assert sorted(r["dataset_id"] for r in again.collect()) == ["x", "y"] and lost.count() == 4


def test_allowed_categories_and_symptoms(spark):
    with pytest.raises(ValueError, match="invalid op categories: nope"):
        records.allowed_categories(["matmul,nope"])
    with pytest.raises(ValueError):
        records.allowed_categories([" , "])
    row = spark.createDataFrame([("grid must be a tuple",), ("",), ("return a tensor",), ("X",)], "t string").select(classify.failure_symptom(F.col("t")).alias("s")).collect()
    assert [r["s"] for r in row] == ["launch_signature_mismatch", None, "invalid_output_type", "python_runtime_error"]


@pytest.mark.parametrize("parts", [1, 3])
def test_streams_equal_batches_however_files_are_split(spark, tmp_path, parts):
    rows = [{"dataset_id": str(i % 40), "attempt_n": i // 40, "compile_status": "success", "correctness_status": "passed" if i % 7 == 0 else None, "ts": f"2024-01-01T00:{i // 40:02d}:00"} for i in range(200)]
    folder = tmp_path / "feed"
    folder.mkdir()
    size = 200 // parts + 1
    for k in range(parts):
        lines = [json.dumps(r) for r in rows[k * size : (k + 1) * size]]
        file = folder / f"{k}.json"
        file.write_text("\n".join(lines + ["{broken"] * (k == 0)))
        os.utime(file, (1_700_000_000 + k, 1_700_000_000 + k))  # a feed reads files by age
    ddl = "dataset_id string, attempt_n int, compile_status string, correctness_status string, ts timestamp"
    feeds.ingest(spark, str(folder), ddl, {"numbered": F.col("attempt_n") < 4}, str(tmp_path / "out")).awaitTermination()
    assert [x.count() for x in feeds.ingested(spark, str(tmp_path / "out"), ddl)] == [160, 41]
    stream = feeds.read_feed(spark, str(folder), ddl, 1).where("_corrupt_record is null")
    folded = {r["dataset_id"]: (r["n_attempts"], r["final_outcome"]) for r in feeds.drain(feeds.fold_attempts(stream)).collect()}
    want = {}
    for i in range(40):
        n = next((k for k in range(3) if (i + 40 * k) % 7 == 0), None)
        want[str(i)] = (3, "runtime_fail") if n is None else (n + 1, "compiled_correct")
    assert folded == want


def test_ranks_of_hot_and_null_keys(spark):
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else "hot", {"m": i}) for i in range(300)], "seq long, example_id string, extra map<string,int>")
    got = {r["example_id"]: (r["seq"], r["variants"]) for r in records.collapse_variants(rows).collect()}
    assert got == {None: (0, 99), "hot": (1, 199)}
    kept, lost = records.merge([rows, rows], "example_id")
    assert {(r["example_id"], r["seq"], r["src_ord"]) for r in kept.collect()} == {(None, 0, 0), ("hot", 1, 0)}
    assert lost.count() == 598


def test_patterns_give_what_matrix_and_pairs_give(spark):
    import random

    r = random.Random(1)
    rows = [(i * 10 + j + 1000 * k, lab, f"ex{i}", "easy", "compiled_correct_slow" if r.random() < 0.6 else "runtime_fail", None, None) for i in range(120) for j, lab in enumerate("abcd") for k in range(2) if r.random() < 0.8]
    df = spark.createDataFrame(rows, "seq int, model_label string, example_id string, tier string, final_outcome string, final_winning_attempt_n int, speedup_vs_inductor double").repartition(5)
    labels = ["d", "a", "c"]
    last = {}
    for seq, lab, ex, _, outcome, *_ in sorted(rows):
        last[lab, ex] = int(outcome != "runtime_fail")
    got = {(x["passed"], x["present"]): x["n"] for x in hypothesis.pass_patterns(df, labels).collect()}
    want = {}
    for i in range(120):
        at = [last.get((lab, f"ex{i}")) for lab in labels]
        if f"ex{i}" in {ex for _, ex in last}:
            key = (sum(1 << j for j, v in enumerate(at) if v), sum(1 << j for j, v in enumerate(at) if v is not None))
            want[key] = want.get(key, 0) + 1
    assert got == want
    contrasts = hypothesis.default_contrasts(spark, labels)
    both = [sorted(map(tuple, x.select("name", "n_common", "n11", "n10", "n01", "n00", "p_value").collect())) for x in (hypothesis.mcnemar(hypothesis.pass_map(df), contrasts), hypothesis.mcnemar_of(hypothesis.pass_patterns(df, labels), labels, contrasts))]
    assert both[0] == both[1] and len(both[0]) == 2
    wide = hypothesis.matrix(hypothesis.pass_map(df), labels, "passed").collect()
    q = hypothesis.cochran_q(df, labels).first()
    g = [sum(x[lab] for x in wide) for lab in labels]
    l2 = sum(sum(x[lab] for lab in labels) ** 2 for x in wide)
    assert q["n"] == len(wide) and math.isclose(q["statistic"], 2 * (3 * sum(x * x for x in g) - sum(g) ** 2) / (3 * sum(g) - l2))
    with pytest.raises(ValueError, match="62"):
        hypothesis.pass_patterns(df, [str(i) for i in range(63)])


def test_a_kept_split_never_moves_a_member(spark, tmp_path):
    path = str(tmp_path / "split")
    rows = lambda n, skip=0: spark.createDataFrame([(str(i), "a" if i % 4 else None) for i in range(skip, n)] + [(None, "a")], "dataset_id string, op_category string")
    members = lambda df: {(r["dataset_id"], r["op_category"]) for r in df.collect()}
    first = members(training.kept_split(rows(200), path, 0.1, "s"))
    drawn = training.validation_split(rows(200).where("dataset_id IS NOT NULL"), 0.1, "s")
    assert first == {(r["dataset_id"], r["op_category"] or "unknown") for r in drawn.collect()} and len(first) == 20
    assert members(training.kept_split(rows(900), path, 0.1, "s", extend=False)) == first
    again = members(training.kept_split(rows(900).repartition(9), path, 0.1, "s"))
    assert first < again and sorted(sum(s == k for _, s in again) for k in ("a", "unknown")) == [23, 68]
    assert members(training.kept_split(rows(900), path, 0.1, "s")) == again  # nothing to add
    assert members(training.kept_split(rows(100), path, 0.1, "other")) == again  # fewer rows: none leaves
    assert len({d for d, _ in again}) == len(again)


def test_cap_reports_what_it_left_out(spark):
    rows = spark.createDataFrame([(str(i), i, "x" if i < 50 else None if i < 60 else "y") for i in range(70)], "example_id string, seq int, op_category string")
    have = spark.createDataFrame([(f"h{i}", "x") for i in range(7)] + [("h0", "x")], "example_id string, op_category string")
    kept = records.cap(rows.where("op_category IS NOT NULL"), have, 20)
    assert {r["op_category"]: tuple(r)[1:] for r in records.cap_skipped(rows, kept).collect()} == {"x": (50, 13, 37), "y": (10, 10, 0), None: (10, 0, 10)}


def test_what_is_ordered_in_one_task_is_bounded(spark, monkeypatch):
    tests = spark.createDataFrame([(str(i), i / 10) for i in range(5)], "name string, p_value double")
    monkeypatch.setattr(hypothesis, "MOST_TESTS", 4)
    monkeypatch.setattr(sampling, "MOST_CATEGORIES", 4)
    with pytest.raises(ValueError, match="5 tests"):
        hypothesis.holm(tests)
    with pytest.raises(ValueError, match="11 categories"):
        sampling.scaled_quotas(sampling.quota_table(spark), 7)
