"""Attempt sequences and numeric comparison results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofmill.functions.classify import failure_symptom
from proofmill.functions.code import diff_of

#: Stands for results that are not finite.
HUGE = 1e38


def compare_elements(pairs: DataFrame, tolerances: DataFrame, task: str = "task_id", candidate: str = "candidate", reference: str = "reference", policy: str = "policy", idx: str = "idx", salt: int = 16) -> DataFrame:
    """Five statistics and ``passed`` for each task from its elements (task, idx, candidate, reference, policy).

    A NaN candidate fails the task in every mode. Numeric mode: an element exceeds if |c - r| > atol
    + rtol |r|; a NaN or infinite reference alone does not. Exact mode: all elements equal. Inf-aware
    mode: both sides have the same infinities and no NaN, and the finite rest is compared and
    counted. What is not finite, or not compared for those reasons, is 1e38. Parts of a task are
    aggregated first, so a large task isn't one group.
    """
    c, r, inf = F.col(candidate), F.col(reference), float("inf")
    rows = pairs.join(F.broadcast(tolerances), policy)
    aware, exact = F.col("mode") == "inf_aware_numeric", F.col("mode") == "exact"
    apart = ((c == inf) != (r == inf)).cast("int") + ((c == -inf) != (r == -inf)).cast("int")
    odd = F.when(aware, F.least(apart, F.lit(1)) + (F.isnan(c) | F.isnan(r)).cast("int")).otherwise(0)
    used = ~(aware & ((F.abs(c) == inf) | (F.abs(r) == inf)))
    diff = F.when(used, F.abs(c - r))
    rel = diff / F.greatest(F.abs(r), F.lit(1e-8))
    # NaN compares as larger than any number here, so it is kept out of the comparison
    over = used & ~F.isnan(diff) & (diff > F.when(exact, 0.0).otherwise(F.col("atol") + F.col("rtol") * F.abs(r)))
    part = rows.withColumns({"_d": diff, "_r": rel, "_o": F.coalesce(over, F.lit(False)), "_nan": F.isnan(c), "_odd": odd, "_used": used, "_ne": ~(c == r) | F.isnan(c), "_part": F.pmod(F.xxhash64(idx), F.lit(salt))})
    some = part.groupBy(task, "mode", "_part").agg(F.max("_d").alias("d"), F.max("_r").alias("r"), F.sum("_d").alias("s"), F.count_if("_o").alias("o"), F.count_if("_nan").alias("nan"), F.sum("_odd").alias("odd"), F.count_if("_used").alias("n"), F.count("*").alias("every"), F.count_if("_ne").alias("ne"))
    whole = some.groupBy(task, "mode").agg(F.max("d").alias("d"), F.max("r").alias("r"), *[F.sum(x).alias(x) for x in ("s", "o", "nan", "odd", "n", "every", "ne")])
    broken = F.when(F.col("nan") > 0, F.col("nan")).when(F.col("odd") > 0, F.col("odd"))
    finite = lambda x: F.when(broken.isNotNull() | F.isnan(x) | (F.abs(x) == inf), HUGE).otherwise(F.coalesce(x, F.lit(0.0)))
    n = F.greatest(F.when(broken.isNotNull(), F.col("every")).otherwise(F.col("n")), F.lit(1))
    exceed = F.coalesce(broken, F.col("o"))
    passed = broken.isNull() & F.when(exact, F.col("ne") == 0).otherwise(F.col("o") == 0)
    return whole.select(task, finite(F.col("d")).alias("max_abs_diff"), finite(F.col("r")).alias("max_rel_diff"), finite(F.col("s") / n).alias("mean_abs_diff"), exceed.alias("n_elements_exceeding_tol"), (exceed * 100 / n).alias("pct_elements_exceeding_tol"), passed.alias("passed"))


def status_of(eager: Column, inductor: Column) -> Column:
    """T4: passed if and only if both comparisons are."""
    return F.when(eager & inductor, "passed").otherwise("failed")


def benchmark_summary(samples: DataFrame, key: str, sides: tuple[str, ...] = ("triton", "eager", "inductor")) -> DataFrame:
    """T5: medians, sample deviations and speedups from arrays ``<side>_samples_ms``."""
    long = samples.select(key, F.explode(F.arrays_zip(*[F.col(f"{s}_samples_ms").alias(s) for s in sides])).alias("x")).select(key, "x.*")
    out = long.groupBy(key).agg(*[f for s in sides for f in (F.percentile(s, F.lit(0.5)).alias(f"{s}_ms"), F.stddev_samp(s).alias(f"{s}_std_ms"))])
    return out.withColumns({f"speedup_vs_{s}": F.col(f"{s}_ms") / F.col(f"{sides[0]}_ms") for s in sides[1:]})


def outcomes(attempts: DataFrame, key: str = "dataset_id") -> DataFrame:
    """O1 over long attempts (compile_status, run_error, correctness_status): ``key, final_outcome, n_attempts``."""
    passed, compared, compiled = F.count_if(F.col("correctness_status") == "passed"), F.count("correctness_status"), F.count_if(F.col("compile_status") == "success")
    outcome = F.when(passed > 0, "compiled_correct").when(compared > 0, "numeric_fail").when(compiled > 0, "runtime_fail").otherwise("compile_fail")
    return attempts.groupBy(key).agg(outcome.alias("final_outcome"), F.count("*").alias("n_attempts"))


def attempt_passed(status: Column, eager: Column, inductor: Column) -> Column:
    """O2: passed, with both blocks of statistics there."""
    return F.coalesce((status == "passed") & eager.isNotNull() & inductor.isNotNull(), F.lit(False))


def run_error(eager: Column, inductor: Column, message: Column, default: str = "correctness stats missing") -> Column:
    """O3: null if both blocks exist, else the message, else a default text."""
    return F.when(eager.isNull() | inductor.isNull(), F.coalesce(message, F.lit(default)))


def compact_correctness(status: Column, used: Column, policy: Column) -> Column:
    """Status and policy used, that of the row where none is recorded; null without a status."""
    return F.when(status.isNotNull(), F.struct(status.alias("status"), F.coalesce(used, policy).alias("tolerance_policy_used")))


def symptom(compile_status: Column, compile_error: Column, correctness_status: Column, error: Column) -> Column:
    """Symptom of the compile text, else of the comparison, else of the runtime text; null for a pass."""
    compared = F.when(correctness_status == "failed", "numeric_mismatch")
    return F.when(compile_status == "failed", failure_symptom(compile_error)).when(correctness_status.isNotNull(), compared).otherwise(failure_symptom(error))


def truncate(attempts: DataFrame, key: str = "dataset_id", order: str = "attempt_n", limit: int = 3) -> DataFrame:
    """Attempts up to the first pass, at most ``limit``."""
    w = Window.partitionBy(key).orderBy(order)
    before = F.max((F.coalesce(F.col("correctness_status"), F.lit("")) == "passed").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    ranked = attempts.withColumns({"_before": F.coalesce(before, F.lit(0)), "_n": F.row_number().over(w)})
    return ranked.where((F.col("_before") == 0) & (F.col("_n") <= limit)).drop("_before", "_n")


def with_prior(attempts: DataFrame, key: str = "dataset_id", order: str = "attempt_n") -> DataFrame:
    """``prior_advice_applied`` and ``prior_code`` of the attempt before, and the patch from it."""
    w = Window.partitionBy(key).orderBy(order)
    rows = attempts.withColumns({"prior_advice_applied": F.lag("judge_fix_suggestion").over(w), "prior_code": F.lag("triton_code").over(w)})
    return rows.withColumn("patch_from_previous", diff_of("prior_code", "triton_code"))


def assemble(attempts: DataFrame, sources: DataFrame, key: str = "dataset_id", order: str = "attempt_n") -> DataFrame:
    """One row for each key: ``attempts`` in order and a ``source`` block."""
    rest = [c for c in attempts.columns if c not in (key, order)]
    nested = attempts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *rest))).alias("attempts"))
    return nested.join(sources.select(key, F.struct(*[c for c in sources.columns if c != key]).alias("source")), key)


def flatten(rows: DataFrame, key: str = "dataset_id") -> DataFrame:
    """One row for each attempt."""
    return rows.select(key, F.explode("attempts").alias("a")).select(key, "a.*")


#: Least speedups over the compiled baseline that count as faster and as parity.
FASTER, PARITY = 1.1, 1.0


def eval_outcome(compile_status: Column, error: Column, status: Column, speedup: Column) -> Column:
    """Outcome of one attempt; a pass without a benchmark counts as a runtime failure."""
    speed = F.when(speedup >= FASTER, "compiled_correct_faster_than_inductor").when(speedup >= PARITY, "compiled_correct_parity").otherwise("compiled_correct_slow")
    return F.when(compile_status == "failed", "compile_fail").when(error.isNotNull(), "runtime_fail").when(~F.coalesce(status == "passed", F.lit(False)), "correctness_failed").when(speedup.isNull(), "runtime_fail").otherwise(speed)


def winning_attempt(attempts: str = "attempts", winner: str = "final_winning_attempt_n") -> Column:
    """The winning attempt of a nested row, or null."""
    return F.get(attempts, F.col(winner))
