"""Training files from dataset rows: chat rows, preference pairs, validation split, prompts, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofmill.plans.describe import beside, quantiles
from proofmill.tables import cut, few


def _first(attempts: str, passed: bool) -> Column:
    ok = lambda a: F.coalesce(a["correctness"]["status"] == "passed", F.lit(False))
    return F.get(F.filter(attempts, lambda a: ok(a) if passed else ~ok(a)), F.lit(0))["triton_code"]


def shape_list(shapes: Column) -> Column:
    """Shapes as ``[2, 3], [4]``."""
    return F.array_join(F.transform(shapes, lambda s: F.concat(F.lit("["), F.array_join(s.cast("array<string>"), ", "), F.lit("]"))), ", ")


def generator_prompt(code: Column, shapes: Column, dtypes: Column, prior_code: Column | None = None, prior_advice: Column | None = None) -> Column:
    """user prompt of a generation request; earlier code and advice only if there are both."""
    # The texts of the prompt.
    prior = F.lit("")
    if prior_code is not None and prior_advice is not None:
        both = (F.coalesce(prior_code, F.lit("")) != "") & (F.coalesce(prior_advice, F.lit("")) != "")
        text = F.concat(F.lit("\nThe previous attempt produced this Triton code:\n```python\n"), prior_code, F.lit("\n```\n\nIt failed. Apply the following fix to that code, preserving the parts that were already correct — do not rewrite from scratch:\n"), prior_advice, F.lit("\n"))
        prior = F.when(both, text).otherwise("")
    return F.concat(F.lit("Translate the following PyTorch function to a Triton kernel.\n\nPyTorch function:\n"), code, F.lit("\n\nInput shapes: "), shape_list(shapes), F.lit("\nInput dtypes: "), F.array_join(dtypes, ", "), F.lit("\n"), prior, F.lit("\nOutput only the Python code.\n"))


def judge_attempts(attempts: str = "attempts") -> Column:
    """a block for each attempt, the last marked as current; lines only for what is there.

    Attempts have attempt_n, triton_code, compile_status, compile_error, run_error,
    correctness_status, max_abs_diff, pct_exceeding and fix_suggestion.
    """
    some = lambda c: F.coalesce(c, F.lit("")) != ""

    def block(a: Column, i: Column) -> Column:
        label = F.concat(F.lit("--- Attempt "), a["attempt_n"].cast("string"), F.when(i == F.size(attempts) - 1, " (current)").otherwise(""), F.lit(" ---"))
        compiled = F.concat(F.lit("Compile: "), a["compile_status"], F.when(some(a["compile_error"]), F.concat(F.lit(" — "), a["compile_error"])).otherwise(""))
        numbers = F.when((a["correctness_status"] == "failed") & a["max_abs_diff"].isNotNull(), F.format_string(" — max_abs_diff=%.4f, pct_exceeding=%.1f%%", a["max_abs_diff"], a["pct_exceeding"])).otherwise("")
        run = F.when(some(a["run_error"]), F.concat(F.lit("Run error: "), a["run_error"]))
        compared = F.when(a["correctness_status"].isNotNull(), F.concat(F.lit("Correctness: "), a["correctness_status"], numbers))
        fix = F.when(some(a["fix_suggestion"]), F.concat(F.lit("Fix suggested: "), a["fix_suggestion"]))
        return F.concat_ws("\n", label, F.concat(F.lit("Triton code:\n"), a["triton_code"]), compiled, run, compared, fix)

    return F.array_join(F.transform(attempts, block), "\n\n")


def _chosen(rows: DataFrame, val: DataFrame, validation: bool) -> DataFrame:
    """Rows inside or outside the validation ids."""
    held = val.select(F.col("example_id").alias("_val")).distinct()
    return rows.join(held, F.col("source.example_id") == F.col("_val"), "left_semi" if validation else "left_anti")


def sft(rows: DataFrame, val: DataFrame, system: str, validation: bool = False) -> DataFrame:
    """chat rows ``messages`` with the first passing code; rows without a pass are left out."""
    won = _chosen(rows, val, validation).withColumn("_code", _first("attempts", True)).where(F.col("_code").isNotNull())
    user = generator_prompt(F.col("source.pytorch_code"), F.col("source.input_shapes"), F.col("source.input_dtypes"))
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return won.select("dataset_id", F.array(message("system", F.lit(system)), message("user", user), message("assistant", F.col("_code"))).alias("messages"))


def dpo(rows: DataFrame, val: DataFrame, validation: bool = False) -> DataFrame:
    """``prompt, chosen, rejected``: first passing and earliest other code; both are needed."""
    user = generator_prompt(F.col("source.pytorch_code"), F.col("source.input_shapes"), F.col("source.input_dtypes"))
    both = _chosen(rows, val, validation).select("dataset_id", user.alias("prompt"), _first("attempts", True).alias("chosen"), _first("attempts", False).alias("rejected"))
    return both.where(F.col("chosen").isNotNull() & F.col("rejected").isNotNull())


def _sizes(rows: DataFrame, fraction: float, stratum: str) -> DataFrame:
    """Members that each stratum (``unknown`` for null) is to have: max(1, ceil(n * fraction))."""
    return rows.groupBy(F.coalesce(F.col(stratum), F.lit("unknown")).alias("_stratum")).agg(F.greatest(F.lit(1), F.ceil(F.count("*") * F.lit(fraction))).alias("_take"))


def _drawn(rows: DataFrame, sizes: DataFrame, seed: str, stratum: str, key: str, salt: int) -> DataFrame:
    """The first ``_take`` rows of each stratum in a seeded order.

    Strata are few and large: rows are ranked in salted parts first, of which each can hold at most
    that many of the chosen rows.
    """
    order = [F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256), F.col(key)]
    early, late = Window.partitionBy("_stratum", "_salt").orderBy(*order), Window.partitionBy("_stratum").orderBy(*order)
    kept = rows.withColumn("_stratum", F.coalesce(F.col(stratum), F.lit("unknown")))
    some = kept.join(sizes, "_stratum").withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(salt))).withColumn("_n", F.row_number().over(early)).where(F.col("_n") <= F.col("_take"))
    return some.withColumn("_n", F.row_number().over(late)).where(F.col("_n") <= F.col("_take")).drop("_n", "_take", "_salt", "_stratum")


def validation_split(rows: DataFrame, fraction: float, seed: str, stratum: str = "op_category", key: str = "dataset_id", salt: int = 64) -> DataFrame:
    """max(1, ceil(n * fraction)) rows of each stratum (``unknown`` for null) in a seeded order; see ``kept_split`` for one that lasts."""
    return _drawn(rows, few(_sizes(rows, fraction, stratum)), seed, stratum, key, salt)


def kept_split(rows: DataFrame, path: str, fraction: float, seed: str, stratum: str = "op_category", key: str = "dataset_id", extend: bool = True, salt: int = 64) -> DataFrame:
    """the split that ``path`` holds, ``key, stratum`` of each member.

    The first run draws it as ``validation_split`` does and writes it. Later runs read it and, with
    ``extend``, add members where a stratum has grown: as many as it lacks, in the seeded order among
    rows that are none. No member ever leaves or moves, whatever rows are given; null keys are no members.
    """
    spark = rows.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    known = rows.where(F.col(key).isNotNull()).dropDuplicates([key])
    name = F.coalesce(F.col(stratum), F.lit("unknown")).alias(stratum)
    if there and not extend:
        return spark.read.parquet(path)
    sizes = _sizes(known, fraction, stratum)
    if there:
        members = spark.read.parquet(path)
        have = members.groupBy(F.col(stratum).alias("_s")).agg(F.count("*").alias("_have"))
        sizes = sizes.join(have, F.col("_stratum") == F.col("_s"), "left").select("_stratum", (F.col("_take") - F.coalesce("_have", F.lit(0))).alias("_take")).where("_take > 0")
        known = known.join(members.select(key), key, "left_anti")
    more = cut(_drawn(known, few(sizes), seed, stratum, key, salt).select(key, name))
    more.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def failure_mix(pairs: DataFrame, kind: str = "kind") -> DataFrame:
    """``kind, n, share`` of the rejected side."""
    counts = pairs.groupBy(kind).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def length_audit(lengths: DataFrame, limits: DataFrame, side: str = "side", n: str = "n_tokens") -> DataFrame:
    """F8: ``side, rows, max, p99, over`` of token counts against a limit for each side; sides without a limit are left out."""
    known = lengths.join(few(limits), side)
    sums = known.groupBy(side).agg(F.count("*").alias("n_rows"), F.max(n).alias("max_tokens"), F.count_if(F.col(n) > F.col("token_limit")).alias("n_over"))
    return beside(sums, quantiles(known, n, [side], {"p99_tokens": 0.99}), [side]).select(side, "n_rows", "max_tokens", "p99_tokens", "n_over")
