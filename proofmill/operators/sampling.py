"""Stratified sampling to quota and design grids. Draws follow seeded hashes, so they can be repeated anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofmill.functions import ids
from proofmill.tables import bounded, few
from proofmill.vocab import AXES, FORMS, OP_CATEGORY, QUOTAS, STOCK_SHAPES, form_dtypes


def _unit(*parts) -> Column:
    """A number in [0, 1) from a hash of the parts."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 30)) / (1 << 30)


def distributions(observations: DataFrame, axes: dict[str, list[str]] = AXES) -> DataFrame:
    """``op_category, axis, ord, value, share``: shares of known values, uniform where a category or axis has none."""
    spark = observations.sparkSession
    grid = spark.createDataFrame([(c, a, i, v) for c in OP_CATEGORY for a, vs in axes.items() for i, v in enumerate(vs)], "op_category string, axis string, ord int, value string")
    wide = observations.select("op_category", *[F.col(a).cast("string").alias(a) for a in axes])
    counts = wide.unpivot(["op_category"], list(axes), "axis", "value").groupBy("op_category", "axis", "value").agg(F.count("*").alias("n"))
    full = F.broadcast(grid).join(counts, ["op_category", "axis", "value"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.partitionBy("op_category", "axis")
    share = F.when(F.sum("n").over(w) == 0, 1 / F.count("*").over(w)).otherwise(F.col("n") / F.sum("n").over(w))
    return full.select("op_category", "axis", "ord", "value", share.alias("share"))


#: Categories that are ordered in one task at most.
MOST_CATEGORIES = 1_000_000


def scaled_quotas(quotas: DataFrame, total: int, category: str = "op_category", weight: str = "quota", order: str = "ord") -> DataFrame:
    """``category, ord, n``: ``total`` in proportion to the weights, whole numbers by largest remainder, ties in declared order; more than MOST_CATEGORIES are an error."""
    quotas = bounded(quotas, MOST_CATEGORIES, "categories")
    every = Window.partitionBy()
    raw = F.col(weight) * total / F.sum(weight).over(every)
    parts = quotas.select(category, order, raw.alias("raw")).withColumn("n", F.floor("raw"))
    rank = F.row_number().over(Window.orderBy(F.desc(F.col("raw") - F.col("n")), order))
    left = F.lit(total) - F.sum("n").over(every)
    return parts.withColumns({"rank": rank, "left": left}).select(category, order, (F.col("n") + (F.col("rank") <= F.col("left")).cast("int")).cast("bigint").alias("n"))


def quota_table(spark: SparkSession, allowed: list[str] | None = None) -> DataFrame:
    """The fixed quotas as a table, restricted to allowed categories."""
    return spark.createDataFrame([(c, i, q) for i, (c, q) in enumerate(QUOTAS.items()) if allowed is None or c in allowed], "op_category string, ord int, quota int")


def draw(rows: DataFrame, table: DataFrame, on: list[str], pivot: str, order: str = "ord", value: str = "value", weight: str = "share") -> DataFrame:
    """``rows`` with ``value``: the first whose cumulative weight reaches ``pivot`` (0 to 1) of the total; uniform if all weights are 0."""
    w = Window.partitionBy(*on)
    even = F.when(F.sum(weight).over(w) > 0, F.col(weight)).otherwise(1.0)
    steps = table.withColumn("_w", even).withColumn("_upto", F.sum("_w").over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_total", F.sum("_w").over(w))
    lists = few(steps.groupBy(*on).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("_upto").alias("u"), F.col("_total").alias("t"), F.col(value).alias("v")))).alias("_steps")))
    hit = F.filter("_steps", lambda s: F.col(pivot) * s["t"] <= s["u"])
    last = F.get("_steps", F.size("_steps") - 1)["v"]
    return rows.join(lists, on).withColumn(value, F.coalesce(F.get(hit, F.lit(0))["v"], last)).drop("_steps")


def input_count(fusion: Column, u: Column) -> Column:
    """Number of inputs of a fusion shape; one or two, by ``u``, where it leaves that open."""
    return F.when(fusion == "triplet", 3).when(fusion == "pair", 2).otherwise(1 + (u >= 0.5).cast("int"))


def broadcast_shape(base: Column, pattern: Column) -> Column:
    """The shape that broadcasts against ``base`` along a pattern."""
    dims = F.size(base)
    at = lambda keep: F.transform(base, lambda d, i: F.when(keep(i), d).otherwise(1))
    return F.when(dims == 1, F.array(F.lit(1))).when(pattern == "row", at(lambda i: i == dims - 1)).when(pattern == "col", at(lambda i: i == 0)).when(pattern == "batch", at(lambda i: i > 0)).when(pattern == "channel", at(lambda i: i == 1)).otherwise(base)


def input_dtypes(mix: Column, n: Column, u: Column) -> Column:
    """Dtypes of ``n`` inputs of a mix; mixed ones alternate from a side that ``u`` chooses, so both occur from two on."""
    pairs = {"mixed_fp32_fp16": ("float32", "float16"), "mixed_fp32_bf16": ("float32", "bfloat16"), "with_int8": ("int8", "float32")}
    same = F.when(mix == "fp16_only", "float16").when(mix == "bf16_only", "bfloat16").otherwise("float32")
    out = F.array_repeat(same, n)
    for name, (a, b) in pairs.items():
        places = F.transform(F.sequence(F.lit(0), n - 1), _alternating(a, b, u))
        out = F.when(mix == name, places).otherwise(out)
    return out


def _alternating(a: str, b: str, u: Column):
    return lambda i: F.when((i + (u >= 0.5).cast("int")) % 2 == 0, a).otherwise(b)


def sample_specs(observations: DataFrame, total: int, seed: str, allowed: list[str] | None = None, existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """E5: distinct skeleton specs to quota, and a report ``op_category, quota, n, capped`` of what was reached.

    Each category draws at most max(20 * quota, 100) times; specs that exist already don't count.
    """
    spark = observations.sparkSession
    quotas = scaled_quotas(quota_table(spark, allowed), total)
    tries = quotas.select("op_category", F.col("n").alias("quota"), F.explode(F.sequence(F.lit(1), F.greatest(F.col("n") * 20, F.lit(100)))).alias("try"))
    table = distributions(observations)
    for axis in AXES:
        one = table.where(F.col("axis") == axis).select("op_category", "ord", F.col("value").alias(axis), "share")
        tries = draw(tries.withColumn("_u", _unit(F.lit(seed), F.lit(axis), "op_category", "try")), one, ["op_category"], "_u", value=axis)
    stock = F.create_map(*[x for rank, shapes in STOCK_SHAPES.items() for x in (F.lit(rank), F.array(*[F.array(*map(F.lit, s)) for s in shapes]))])
    u = lambda name: _unit(F.lit(seed), F.lit(name), "op_category", "try")
    pick = lambda name: F.get(stock[F.col("shape_rank")], F.floor(u(name) * F.size(stock[F.col("shape_rank")])).cast("int"))
    n = input_count(F.col("fusion_shape"), u("count"))
    base = pick("base")
    more = lambda name: F.when(F.col("broadcast_pattern") == "none", pick(name)).otherwise(broadcast_shape(base, F.col("broadcast_pattern")))
    specs = tries.withColumns({"suggested_input_shapes": F.slice(F.array(base, more("second"), more("third")), F.lit(1), n), "suggested_input_dtypes": input_dtypes(F.col("dtype_mix"), n, u("dtype"))}).drop("_u")
    specs = specs.withColumn("spec_id", ids.skeleton_spec_id(F.col("op_category"), [F.col(a) for a in AXES], F.col("suggested_input_shapes"), F.col("suggested_input_dtypes")))
    specs = specs.withColumn("rng_seed", ids.seed_of(F.col("spec_id")))
    if existing is not None:
        specs = specs.join(existing.select("spec_id"), "spec_id", "left_anti")
    first = specs.groupBy("spec_id").agg(F.min_by(F.struct(*[c for c in specs.columns if c != "spec_id"]), "try").alias("s")).select("spec_id", "s.*")
    kept = first.withColumn("_n", F.row_number().over(Window.partitionBy("op_category").orderBy("try"))).where(F.col("_n") <= F.col("quota")).drop("_n", "try", "quota")
    reached = quotas.join(kept.groupBy("op_category").agg(F.count("*").alias("got")), "op_category", "left")
    return kept, reached.select("op_category", F.col("n").alias("quota"), F.coalesce("got", F.lit(0)).alias("n"), (F.coalesce("got", F.lit(0)) < F.col("n")).alias("capped"))


# The choices that each form's metadata has, as JSON texts.
def _metadata(form: str, shapes: list[list[int]]) -> list[dict[str, str]]:
    """Choices of a form's metadata for given shapes, JSON-valued."""
    first = shapes[0]
    dims = range(-len(first), 0)
    if form == "unary_then_reduction":
        return [{"reduce_dim": str(d), "keepdim": k} for d in dims for k in ("false", "true")]
    if form == "softmax_then_unary":
        return [{"softmax_dim": str(d)} for d in dims]
    if form == "attention_qkv":
        return [{"num_heads": str(first[1]), "causal": "false", "scale": repr(first[3] ** -0.5)}]
    if form == "embedding_then_norm":
        return [{"num_embeddings": str(shapes[1][0]), "norm_eps": "1e-05"}]
    if "normalized_shape" in FORMS[form][3]:
        return [{"normalized_shape": f"[{first[-1] if form == 'unary_then_norm' else shapes[1][0]}]", "norm_eps": "1e-05"}]
    return [{}]


def design_grid(spark: SparkSession, forms: list[str] | None = None) -> DataFrame:
    """All cells ``form, input_shapes, input_dtypes, form_metadata, ops, cell`` of shape by dtype by metadata by operations.

    Only the few shape and metadata choices are listed; Spark forms the product with dtypes and operation slots.
    """
    rows = [(f, s, m) for f in forms or FORMS for s in FORMS[f][4] for m in _metadata(f, s)]
    cells = spark.createDataFrame(rows, "form string, input_shapes array<array<int>>, form_metadata map<string,string>")
    dtypes = spark.createDataFrame([(f, d) for f in forms or FORMS for d in form_dtypes(f)], "form string, input_dtypes array<string>")
    slots = spark.createDataFrame([(f, [list(p) for p in FORMS[f][2]]) for f in forms or FORMS], "form string, slots array<array<string>>")
    cells = cells.join(F.broadcast(dtypes), "form").join(F.broadcast(slots), "form").withColumn("ops", F.array().cast("array<string>"))
    for i in range(max(len(v[2]) for v in FORMS.values())):
        pool = F.coalesce(F.get("slots", F.lit(i)), F.array(F.lit(None).cast("string")))
        cells = cells.withColumn("_op", F.explode(pool)).withColumn("ops", F.when(F.col("_op").isNull(), F.col("ops")).otherwise(F.concat("ops", F.array("_op")))).drop("_op")
    key = F.concat_ws("|", "form", F.to_json("input_shapes"), F.to_json("input_dtypes"), F.to_json("form_metadata"), F.array_join("ops", ","))
    return cells.drop("slots").withColumn("cell", F.sha2(key, 256))


def take_cells(grid: DataFrame, targets: DataFrame, seed: str, window: int = 1_000_000) -> DataFrame:
    """``n`` cells of each form of ``targets`` (form, ord, n) in a seeded order; a smaller grid is gone through again with new seeds.

    Seeds of form ``ord`` start at ``ord * window``, so forms never share one.
    """
    ranked = grid.withColumn("_k", F.row_number().over(Window.partitionBy("form").orderBy(F.sha2(F.concat(F.lit(seed), "cell"), 256))) - 1).withColumn("_size", F.count("*").over(Window.partitionBy("form")))
    sizes = ranked.select("form", "_size").distinct()
    wanted = targets.where("n > 0").join(sizes, "form").select("form", "ord", "_size", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i")).withColumn("_k", F.col("i") % F.col("_size")).drop("_size")
    return wanted.join(ranked, ["form", "_k"]).withColumn("rng_seed", (F.col("ord") * window + F.col("i")).cast("bigint")).drop("_k", "_size", "ord")


def output_shape(form: Column, shapes: Column, metadata: Column) -> Column:
    """Shape of a form's output."""
    first = F.get(shapes, F.lit(0))
    dim = metadata["reduce_dim"].cast("int")
    at = F.when(dim < 0, dim + F.size(first)).otherwise(dim)
    kept = F.transform(first, lambda d, i: F.when(i == at, 1).otherwise(d))
    dropped = F.filter(first, lambda d, i: i != at)
    wide = F.concat(F.slice(first, F.lit(1), F.size(first) - 1), F.array(F.get(F.get(shapes, F.lit(1)), F.lit(0))))
    looked_up = F.concat(first, F.array(F.get(F.get(shapes, F.lit(1)), F.lit(1))))
    reduced = F.when(metadata["keepdim"] == "true", kept).otherwise(dropped)
    return F.when(form == "unary_then_reduction", reduced).when(form.isin("fused_linear_norm_activation", "gated_mlp_swiglu"), wide).when(form == "embedding_then_norm", looked_up).otherwise(first)


def output_dtype(form: Column, dtypes: Column, ops: Column) -> Column:
    """Dtype of a form's output."""
    index = (form == "unary_then_reduction") & F.array_contains(ops, "torch.argmax")
    return F.when(index, "int64").when(form == "embedding_then_norm", F.get(dtypes, F.lit(1))).otherwise(F.get(dtypes, F.lit(0)))


def append_specs(existing: DataFrame, new: DataFrame) -> DataFrame:
    """New specs that don't exist yet, one for each id."""
    return new.dropDuplicates(["spec_id"]).join(existing.select("spec_id"), "spec_id", "left_anti")


def fulfilment(rows: DataFrame, quotas: DataFrame, by: str = "op_category", n: str = "n") -> DataFrame:
    """``by, quota, got, missing``."""
    got = rows.groupBy(by).agg(F.count("*").alias("got"))
    joined = quotas.select(by, F.col(n).cast("bigint").alias("quota")).join(got, by, "left").withColumn("got", F.coalesce("got", F.lit(0)))
    return joined.withColumn("missing", F.greatest(F.col("quota") - F.col("got"), F.lit(0).cast("bigint")))


def _list(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(values.cast("array<string>"), ", "), F.lit("]"))


def input_lines(shapes: str, dtypes: str) -> Column:
    """A line for each input: its number, shape and dtype."""
    both = F.arrays_zip(F.col(shapes).alias("s"), F.col(dtypes).alias("d"))
    return F.array_join(F.transform(both, lambda x, i: F.concat(F.lit("  - arg "), i.cast("string"), F.lit(": shape "), _list(x["s"]), F.lit(", dtype "), x["d"])), "\n")


def numbered_ops(ops: str = "ops") -> Column:
    """A numbered line for each operation."""
    return F.array_join(F.transform(ops, lambda op, i: F.concat((i + 1).cast("string"), F.lit(". "), op)), "\n")
