"""Row constraints as boolean columns; true where a row keeps them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmill.functions import ids
from proofmill.vocab import AXES, COMPILE_STATUS, CORRECTNESS_STATUS, DATASET_OUTCOME, DTYPE, EVAL_OUTCOME, FAILURE_SYMPTOM, FORMS, JUDGE_CLASS, JUDGE_REPAIR_ACTION, JUDGE_ROOT_CAUSE, OP_CATEGORY, PASSING, SPLIT, TIER, TOLERANCE_POLICY


def violations(checks: dict[str, Column]) -> Column:
    """Names of the checks that a row breaks; a check that is null counts as broken."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()]))


def split_valid(rows: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that keep all checks, and the others with ``violations``."""
    marked = rows.withColumn("violations", violations(checks))
    return marked.where(F.size("violations") == 0).drop("violations"), marked.where(F.size("violations") > 0)


def _c(name: str) -> Column:
    return F.col(name)


def _either(a: Column, b: Column) -> Column:
    """Exactly one of two booleans."""
    return a != b


def same_length(shapes: str = "input_shapes", dtypes: str = "input_dtypes") -> Column:
    """V1: as many shapes as dtypes."""
    return F.size(shapes) == F.size(dtypes)


def split_difficulty() -> Column:
    """V2: evaluation rows have a difficulty, training rows have none."""
    return _either(_c("split") == "train", _c("difficulty").isNotNull())


def derived_id(fields: dict[str, Column], given: str = "dataset_id") -> tuple[Column, Column]:
    """V3: the id, filled in where null; whether a given one equals the derived one."""
    derived = ids.dataset_id(fields)
    return F.coalesce(_c(given), derived), _c(given).isNull() | (_c(given) == derived)


def vocabulary() -> dict[str, Column]:
    """V4: membership of the enumerated columns of a corpus row; null is allowed for difficulty alone."""
    return {
        "op_category": _c("op_category").isin(OP_CATEGORY),
        "input_dtypes": F.forall("input_dtypes", lambda d: d.isin(DTYPE)),
        "tolerance_policy": _c("tolerance_policy").isin(TOLERANCE_POLICY),
        "split": _c("split").isin(SPLIT),
        "difficulty": _c("difficulty").isNull() | _c("difficulty").isin(TIER),
    }


def axis_vocabulary() -> dict[str, Column]:
    """V4: membership of the six axes of an observation."""
    return {name: _c(name).isin(values) for name, values in AXES.items()}


def attempt_vocabulary(judged: bool = True) -> dict[str, Column]:
    """V4: membership of the enumerated fields of all attempts; only the compile status must be given. ``judged``: with symptom and judge labels."""
    optional = lambda value, values: value.isNull() | value.isin(values)
    labels = {"failure_symptom": FAILURE_SYMPTOM, "judge_classification": JUDGE_CLASS, "judge_root_cause": JUDGE_ROOT_CAUSE, "judge_repair_action": JUDGE_REPAIR_ACTION} if judged else {}
    checks = {
        "compile_status": F.forall("attempts", lambda a: F.coalesce(a["compile"]["status"].isin(COMPILE_STATUS), F.lit(False))),
        "correctness_status": F.forall("attempts", lambda a: optional(a["correctness"]["status"], CORRECTNESS_STATUS)),
    }
    member = lambda name, values: F.forall("attempts", lambda a: optional(a[name], values))
    return checks | {name: member(name, values) for name, values in labels.items()}


def outcome_vocabulary(evaluation: bool = False) -> dict[str, Column]:
    """V4: membership of the outcome of a dataset row, or of an evaluation result."""
    return {"final_outcome": _c("final_outcome").isin(EVAL_OUTCOME if evaluation else DATASET_OUTCOME)}


SLIM = ["example_id", "op_category", "pytorch_code", "input_shapes", "input_dtypes", "rng_seed", "tolerance_policy"]


def to_slim(rows: DataFrame) -> DataFrame:
    """V5: slim rows of training records from skeletons that have no difficulty; other rows are left out."""
    return rows.where((_c("split") == "train") & (_c("origin") == "synthetic/skeleton") & _c("difficulty").isNull()).select(*SLIM)


def to_full(rows: DataFrame) -> DataFrame:
    """V5: the reverse, with the derived identifier of the whole record."""
    full = rows.select(*SLIM, F.lit("train").alias("split"), F.lit("synthetic/skeleton").alias("origin"), F.lit(None).cast("string").alias("difficulty"))
    return full.withColumn("dataset_id", ids.dataset_id({c: _c(c) for c in full.columns}))


def compile_error_matches(status: Column, error: Column) -> Column:
    """V6: an error text if and only if the compilation failed."""
    return _either(status == "success", error.isNotNull())


def attempt_result(a: Column) -> Column:
    """V7: after a failed compilation no later result; after a good one either a comparison or a run error."""
    failed = a["compile"]["status"] == "failed"
    return F.when(failed, a["correctness"].isNull() & a["run_error"].isNull()).otherwise(_either(a["correctness"].isNotNull(), a["run_error"].isNotNull()))


def attempts_numbered(attempts: str = "attempts") -> Column:
    """V8: attempts are numbered by their place."""
    return F.forall(F.transform(attempts, lambda a, i: a["attempt_n"] == i), lambda ok: ok)


def outcome_of(attempts: str = "attempts") -> Column:
    """The outcome that nested attempts add up to (O1)."""
    some = lambda f: F.exists(attempts, f)
    passed = some(lambda a: F.coalesce(a["correctness"]["status"] == "passed", F.lit(False)))
    compared = some(lambda a: a["correctness"].isNotNull())
    compiled = some(lambda a: F.coalesce(a["compile"]["status"] == "success", F.lit(False)))
    return F.when(passed, "compiled_correct").when(compared, "numeric_fail").when(compiled, "runtime_fail").otherwise("compile_fail")


def dataset_row() -> dict[str, Column]:
    """V6 to V10 of a dataset row."""
    each = lambda f: F.forall("attempts", f)
    return {
        "has_attempts": F.size("attempts") >= 1,
        "compile_error": each(lambda a: compile_error_matches(a["compile"]["status"], a["compile"]["error"])),
        "attempt_result": each(attempt_result),
        "attempt_numbers": attempts_numbered(),
        "final_outcome": _c("final_outcome") == outcome_of(),
        "policy": each(lambda a: a["correctness"].isNull() | (a["correctness"]["tolerance_policy_used"] == _c("source.tolerance_policy"))),
        "example_id": _c("source.example_id") == _c("example_id"),
    }


def eval_row() -> dict[str, Column]:
    """V8, V11 and V12 of an evaluation result."""
    each = lambda f: F.forall("attempts", f)
    won = _c("final_outcome").isin(PASSING)
    samples = ["triton_samples_ms", "eager_samples_ms", "inductor_samples_ms"]
    positive = ["triton_ms", "eager_ms", "inductor_ms", "speedup_vs_eager", "speedup_vs_inductor"]

    def bench(a: Column) -> Column:
        b, ok = a["benchmark"], F.lit(True)
        for name in samples:
            ok = ok & (F.size(b[name]) == 100)
        for name in positive:
            ok = ok & (b[name] > 0)
        return b.isNull() | ok

    def stats(a: Column) -> Column:
        ok = F.lit(True)
        for side in ("vs_eager", "vs_inductor"):
            s = a["correctness"][side]
            ok = ok & (s.isNull() | ((s["max_abs_diff"] >= 0) & (s["max_rel_diff"] >= 0) & (s["mean_abs_diff"] >= 0) & (s["n_elements_exceeding_tol"] >= 0) & s["pct_elements_exceeding_tol"].between(0, 100)))
        return a["correctness"].isNull() | ok

    return {
        "attempt_numbers": attempts_numbered(),
        "benchmark_needs_pass": each(lambda a: a["benchmark"].isNull() | F.coalesce(a["correctness"]["status"] == "passed", F.lit(False))),
        "winner": _either(won, _c("final_winning_attempt_n").isNull()),
        "benchmark_bounds": each(bench),
        "stats_bounds": each(stats),
        "ops": F.size("spec.ops") >= 2,
    }


def difficulty_is_tier() -> Column:
    """Difficulty of an evaluation record is the tier of its spec."""
    return _c("difficulty") == _c("spec.tier")


def judge_labels() -> Column:
    """No further labels for a correct attempt, all of them otherwise."""
    rest = [_c(c) for c in ("judge_root_cause", "judge_repair_action", "judge_fix_suggestion")]
    none, every = F.lit(True), F.lit(True)
    for c in rest:
        none, every = none & c.isNull(), every & c.isNotNull()
    return F.when(_c("judge_classification") == "compiled_correct", none).otherwise(every)


def no_extra_keys(line: Column, allowed: list[str]) -> Column:
    """A JSON object has no key but the allowed ones."""
    return F.size(F.array_except(F.json_object_keys(line), F.array(*map(F.lit, allowed)))) == 0


def spec_matches_form() -> Column:
    """Number of operations and inputs, and the metadata that the form asks for."""
    forms = F.create_map(*[x for k, v in FORMS.items() for x in (F.lit(k), F.struct(F.lit(len(v[2])).alias("ops"), F.lit(len(v[4][0])).alias("inputs"), F.array(*map(F.lit, v[3])).cast("array<string>").alias("keys")))])
    form = forms[_c("form")]
    return form.isNotNull() & (F.size("ops") == form["ops"]) & (F.size("input_shapes") == form["inputs"]) & (F.size(F.array_except(form["keys"], F.map_keys("form_metadata"))) == 0)
