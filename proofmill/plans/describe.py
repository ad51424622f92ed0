"""Descriptive statistics over evaluation results: one row for each (label, example), see ``operators.records.last_per_key``."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofmill.tables import cut, few
from proofmill.vocab import PASSING

Z = 1.96


def wilson(k: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """A3: score interval of k of n, within [0, 1]; (0, 0) for n = 0."""
    p, zz = k / n, z * z
    scale = 1 + zz / n
    centre = (p + zz / (2 * n)) / scale
    half = z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / scale
    low, high = F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)
    return F.when(n > 0, low).otherwise(0.0), F.when(n > 0, high).otherwise(0.0)


def wilson_difference(k1: Column, n1: Column, k2: Column, n2: Column, z: float = Z) -> tuple[Column, Column]:
    """A3: hybrid score interval of the difference of two proportions, within [-1, 1]."""
    (l1, h1), (l2, h2) = wilson(k1, n1, z), wilson(k2, n2, z)
    p1, p2 = F.when(n1 > 0, k1 / n1).otherwise(0.0), F.when(n2 > 0, k2 / n2).otherwise(0.0)
    low = p1 - p2 - F.sqrt((p1 - l1) * (p1 - l1) + (h2 - p2) * (h2 - p2))
    high = p1 - p2 + F.sqrt((h1 - p1) * (h1 - p1) + (p2 - l2) * (p2 - l2))
    return F.greatest(F.lit(-1.0), low), F.least(F.lit(1.0), high)


def describe(x: Column) -> list[Column]:
    """A4: aggregates n, min, mean, max, std of a series; std 0 for one value. ``quantiles`` has the rest."""
    std = F.when(F.count(x) > 0, F.coalesce(F.stddev_samp(x), F.lit(0.0)))
    return [F.count(x).alias("n"), F.min(x).alias("min"), F.avg(x).alias("mean"), F.max(x).alias("max"), std.alias("std")]


def report_bucket(outcome: Column) -> Column:
    """A1: the five report buckets of an outcome."""
    return F.when(outcome == "compiled_correct_faster_than_inductor", "correct_faster").when(outcome == "compiled_correct_parity", "correct_parity").when(outcome == "compiled_correct_slow", "correct_slow").when(outcome == "correctness_failed", "correctness_failed").otherwise("compile_or_runtime_fail")


def passed(outcome: str = "final_outcome") -> Column:
    """1 for a passing outcome, else 0."""
    return F.col(outcome).isin(PASSING).cast("int")


def outcome_distribution(rows: DataFrame) -> DataFrame:
    """A1: ``model_label, tier, final_outcome, bucket, n``; tier ``__all__`` has the totals."""
    both = rows.withColumn("bucket", report_bucket(F.col("final_outcome")))
    sets = both.groupingSets([["model_label", "final_outcome", "bucket"], ["model_label", "tier", "final_outcome", "bucket"]], "model_label", "tier", "final_outcome", "bucket")
    counts = sets.agg(F.grouping("tier").alias("all"), F.count("*").alias("n"))
    return counts.select("model_label", F.when(F.col("all") == 1, "__all__").otherwise(F.col("tier")).alias("tier"), "final_outcome", "bucket", "n")


def pass_rates(rows: DataFrame, by: str = "tier") -> DataFrame:
    """``model_label, by, k, n, rate, wilson_lo, wilson_hi``; ``__overall__`` has all rows of a label."""
    sums = rows.groupingSets([["model_label"], ["model_label", by]], "model_label", by).agg(F.grouping(by).alias("all"), F.sum(passed()).alias("k"), F.count("*").alias("n"))
    low, high = wilson(F.col("k"), F.col("n"))
    return sums.select("model_label", F.when(F.col("all") == 1, "__overall__").otherwise(F.col(by)).alias(by), "k", "n", (F.col("k") / F.col("n")).alias("rate"), low.alias("wilson_lo"), high.alias("wilson_hi"))


QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def measure_summary(rows: DataFrame, measures: dict[str, Column], by: list[str]) -> DataFrame:
    """Summaries of several measures of winners: ``by, measure, n, min, q1, median, mean, q3, max, iqr, std``."""
    won = rows.where(F.col("final_winning_attempt_n").isNotNull()).select(*by, *[c.cast("double").alias(k) for k, c in measures.items()])
    long = won.unpivot(by, list(measures), "measure", "x").where(F.col("x").isNotNull())
    keys = [*by, "measure"]
    both = beside(long.groupBy(*keys).agg(*describe(F.col("x"))), quantiles(long, "x", keys, QUARTILES), keys)
    return both.select(*keys, "n", "min", "q1", "median", "mean", "q3", "max", (F.col("q3") - F.col("q1")).alias("iqr"), "std")


def shares(rows: DataFrame, column: str, default: str | None = None, total: int | None = None) -> DataFrame:
    """``value, n, pct`` of a column, most frequent first; ``total`` replaces the rows as denominator."""
    value = F.col(column) if default is None else F.coalesce(column, F.lit(default))
    counts = rows.groupBy(value.alias("value")).agg(F.count("*").alias("n"))
    whole = F.sum("n").over(Window.partitionBy()) if total is None else F.lit(total)
    return counts.withColumn("pct", 100 * F.col("n") / whole).orderBy(F.desc("n"), "value")


def headline(rows: DataFrame) -> DataFrame:
    """A row for each label: n, k, rate with interval, median speedup of winners."""
    won = rows.where(F.col("final_winning_attempt_n").isNotNull() & F.col("speedup_vs_inductor").isNotNull())
    sums = rows.groupBy("model_label").agg(F.count("*").alias("n"), F.sum(passed()).alias("k"))
    sums = beside(sums, quantiles(won, "speedup_vs_inductor", ["model_label"], {"median_speedup": 0.5}), ["model_label"])
    low, high = wilson(F.col("k"), F.col("n"))
    return sums.withColumns({"rate": F.col("k") / F.col("n"), "wilson_lo": low, "wilson_hi": high})


def conditional(rows: DataFrame, outcome: str = "final_outcome", given: str = "tier") -> DataFrame:
    """Share of each outcome within each tier of a label."""
    counts = rows.groupBy("model_label", given, outcome).agg(F.count("*").alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("model_label", given)))


def cross_tab(rows: DataFrame, dims: list[str]) -> DataFrame:
    """Counts over the cube of ``dims``; ``*`` stands for all values."""
    cube = rows.cube(*dims).agg(F.count("*").alias("n"), *[F.grouping(d).alias(f"_{d}") for d in dims])
    return cube.select(*[F.when(F.col(f"_{d}") == 1, "*").otherwise(F.col(d)).alias(d) for d in dims], "n")


def beside(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """``left`` with the columns of ``right``, which has a row for each group at most; null groups match."""
    named = right.withColumnsRenamed({c: f"_k_{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same = same & left[c].eqNullSafe(named[f"_k_{c}"])
    return left.join(named, same, "left").drop(*[f"_k_{c}" for c in by])


def outliers(rows: DataFrame, by: list[str], x: str) -> DataFrame:
    """``rows`` with ``is_outlier``: outside 1.5 interquartile ranges of the group."""
    q = few(quantiles(rows, x, by, {"_q1": 0.25, "_q3": 0.75}))
    reach = 1.5 * (F.col("_q3") - F.col("_q1"))
    return beside(rows, q, by).withColumn("is_outlier", (F.col(x) < F.col("_q1") - reach) | (F.col(x) > F.col("_q3") + reach)).drop("_q1", "_q3")


def placed(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """``by, value, count, before, n``: each value of a group, how often it occurs, how many smaller ones the group has, and its size.

    Values are counted, dealt out by range, and numbered within each range; what lies in earlier
    ranges is added from their few totals. So no group, however large, meets in one task. Null
    values are left out; null groups are groups.
    """
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("_all"))
    counts = rows.where(F.col(value).isNotNull()).groupBy(group.alias("_g"), F.col(value).alias("_v")).agg(F.count("*").alias("count"))
    dealt = cut(counts.repartitionByRange("_g", "_v").withColumn("_range", F.spark_partition_id()))
    totals = dealt.groupBy("_g", "_range").agg(F.sum("count").alias("_t"))
    key = Window.partitionBy("_g")
    earlier = F.coalesce(F.sum("_t").over(key.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select("_g", "_range", earlier.alias("_before"), F.sum("_t").over(key).alias("n"))
    inside = F.coalesce(F.sum("count").over(Window.partitionBy("_g", "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = dealt.withColumn("_in", inside).join(offsets, ["_g", "_range"])  # no hint: with many groups the offsets grow with the rows
    return numbered.select(*[F.col(f"_g.{c}").alias(c) for c in by], F.col("_v").alias(value), "count", (F.col("_before") + F.col("_in")).alias("before"), "n")


def at_place(value: str, place: Column) -> Column:
    """Aggregate over ``placed``: the value at a place of its group, from 0."""
    return F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("count")), F.col(value)))


def quantiles(rows: DataFrame, value: str, by: list[str], shares: dict[str, float]) -> DataFrame:
    """A4: exact inclusive quantiles of each group: ``by`` and the names of ``shares``.

    Only the wanted places are looked up, and combined before the shuffle.
    """
    at = {k: (F.col("n") - 1) * F.lit(float(p)) for k, p in shares.items()}
    ends = placed(rows, value, by).groupBy(*by).agg(F.max("n").alias("n"), *[at_place(value, f(c)).alias(f"_{side}_{k}") for k, c in at.items() for side, f in (("lo", F.floor), ("hi", F.ceil))])
    mixed = lambda k, c: F.col(f"_lo_{k}") + (c - F.floor(c)) * (F.col(f"_hi_{k}") - F.col(f"_lo_{k}"))
    return ends.select(*by, *[mixed(k, c).alias(k) for k, c in at.items()])


def average_ranks(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """``by, value, count, rank``: average ranks of values within each group, see ``placed``."""
    return placed(rows, value, by).select(*by, value, "count", (F.col("before") + (F.col("count") + 1) / 2).alias("rank"))


def bootstrap_median(rows: DataFrame, by: str, x: str, replicates: int = 1000, alpha: float = 0.05, seed: int = 7) -> DataFrame:
    """``by, n, median, lo, hi``: the exact median and its percentile interval over resamples of all n values of a group.

    A resample of n values is n uniform draws, each of which takes the value at its share of the
    sorted values. So its middle values are those at the middle ones of n sorted uniforms, which are
    beta distributed: they are drawn as such, and only their ranks are looked up in the values.
    """
    group = F.coalesce(F.concat(F.lit("="), by), F.lit("-"))
    counts = cut(placed(rows.where(F.col(x).isNotNull()).select(group.alias("_g"), F.col(x).cast("double").alias("x")), "x", ["_g"]))
    sizes = counts.groupBy("_g").agg(F.max("n").alias("n"))

    def draw(batches):
        for batch in batches:
            for g, n in zip(batch["_g"], batch["n"].tolist(), strict=True):
                rng = np.random.default_rng([seed, zlib.crc32(g.encode())])
                low, high = (n + 1) // 2, n // 2 + 1
                u = rng.beta(low, n + 1 - low, replicates)
                v = u if high == low else 1 - (1 - u) * rng.random(replicates) ** (1 / (n - low))
                at = lambda share: np.clip(np.ceil(share * n).astype(np.int64), 1, n)  # noqa: B023, E731
                # replicate -1 is the median of the values themselves
                at_low, at_high = np.append(at(u), low), np.append(at(v), high)
                names = np.append(np.arange(replicates), -1)
                yield pd.DataFrame({"_g": g, "n": n, "replicate": np.tile(names, 2), "at": np.concatenate([at_low, at_high])})

    picks = cut(sizes.mapInPandas(draw, "_g string, n long, replicate long, at long"))
    bounds = picks.groupBy("_g").agg(F.min("at").alias("_lo"), F.max("at").alias("_hi"))
    near = counts.select("_g", "x", F.col("before").alias("_before"), "count").join(bounds, "_g").where((F.col("_before") < F.col("_hi")) & (F.col("_before") + F.col("count") >= F.col("_lo"))).drop("_lo", "_hi")
    taken = picks.join(near, "_g").where((F.col("at") > F.col("_before")) & (F.col("at") <= F.col("_before") + F.col("count")))
    medians = taken.groupBy("_g", "n", "replicate").agg(F.avg("x").alias("m"))
    own, drawn = F.when(F.col("replicate") < 0, F.col("m")), F.when(F.col("replicate") >= 0, F.col("m"))
    out = medians.groupBy("_g", "n").agg(F.max(own).alias("median"), F.percentile(drawn, F.lit(alpha / 2)).alias("lo"), F.percentile(drawn, F.lit(1 - alpha / 2)).alias("hi"))
    return out.select(F.when(F.col("_g") != "-", F.substring("_g", 2, 2147483647)).alias(by), "n", "median", "lo", "hi")


def stage_counts(rows: DataFrame, stage: str = "stage") -> DataFrame:
    """Rows by stage, accepted ones as ``accepted``, with their share."""
    counts = rows.groupBy(F.coalesce(stage, F.lit("accepted")).alias("stage")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def running_totals(rows: DataFrame, flags: dict[str, Column], order: list[str]) -> DataFrame:
    """``rows`` with ``n``, how many there are up to each in ``order``, and for each flag how many of those have it.

    Rows are dealt out by range and counted within each range; what earlier ranges hold is added from
    their totals, one row for each range. Of rows of equal order any may be first.
    """
    names = list(flags)
    dealt = rows.withColumns({f"_{k}": F.coalesce(c.cast("bigint"), F.lit(0).cast("bigint")) for k, c in flags.items()}).repartitionByRange(*order)
    dealt = cut(dealt.sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", 33)))
    sums = dealt.groupBy("_range").agg(F.count("*").alias("_t_n"), *[F.sum(f"_{k}").alias(f"_t_{k}") for k in names])
    earlier = Window.partitionBy().orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = sums.select("_range", *[F.coalesce(F.sum(f"_t_{k}").over(earlier), F.lit(0)).alias(f"_b_{k}") for k in ("n", *names)])
    inside = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    counted = dealt.withColumns({"_c_n": F.row_number().over(inside), **{f"_c_{k}": F.sum(f"_{k}").over(inside) for k in names}})
    return counted.join(F.broadcast(before), "_range").select(*rows.columns, *[(F.col(f"_b_{k}") + F.col(f"_c_{k}")).cast("bigint").alias(k) for k in ("n", *names)])


def dataset_summary(rows: DataFrame) -> DataFrame:
    """One row of totals for rows with ``attempts`` nested: rows, attempts, rows with a pass, repeated ids."""
    won = F.exists("attempts", lambda a: F.coalesce(a["correctness"]["status"] == "passed", F.lit(False)))
    per = rows.groupBy("dataset_id").agg(F.count("*").alias("n"), F.sum(F.size("attempts")).alias("a"), F.count_if(won).alias("w"))
    return per.agg(F.sum("n").alias("n_rows"), F.sum("a").alias("n_attempts"), F.sum("w").alias("n_with_pass"), F.count_if(F.col("n") > 1).alias("n_repeated_ids"))
