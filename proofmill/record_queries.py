"""Registered queries of sources, sinks and constraints over records that Spark derives from the given tables, and their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill import adapters as av
from proofmill import vocab
from proofmill.functions import ids
from proofmill.operators import attempts as att
from proofmill.operators import constraints
from proofmill.plans import describe
from proofmill.queries import _UUID5, query
from proofmill.sources import jsonl
from proofmill.streaming import feeds
from proofmill.tables import shared_dir, table

OBSERVATION = "seq bigint, op_category string, shape_rank string, broadcast_pattern string, origin string"
RANKS = vocab.AXES["shape_rank"]


def _folder(spark: SparkSession) -> str:
    """A new folder in shared storage."""
    return f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"


def _lines(spark: SparkSession, sf: str) -> str:
    """Observations as JSON lines: every seventh size is cut short, every fifth has a rank that is none."""
    rows = av.observations(spark, sf).join(table(spark, sf, "part").select(F.col("p_partkey").alias("seq"), "p_size"), "seq")
    rank = F.when(F.col("p_size") % 5 == 4, "5D").otherwise(F.col("shape_rank"))
    line = F.to_json(F.struct("seq", "op_category", rank.alias("shape_rank"), "broadcast_pattern", "origin"))
    path = _folder(spark)
    rows.select(F.when(F.col("p_size") % 7 == 0, F.substring(line, F.lit(1), F.char_length(line) - 4)).otherwise(line).alias("value")).write.text(path)
    return path


_KINDS = "CASE WHEN p_size % 7 = 0 THEN 'malformed' WHEN p_size % 5 = 4 THEN 'constraint' ELSE 'good' END"


# --- sources and sinks -----------------------------------------------------------------------------


@query("SELECT * FROM observations", av.OBSERVATION_SQL)
def s1_read_strict(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark)
    av.observations(spark, sf).write.json(path)
    return jsonl.read_strict(spark, path, OBSERVATION, {"rank": F.col("shape_rank").isin(RANKS)})


@query(f"SELECT kind, count(*) AS n, CAST(sum(CASE WHEN kind <> 'malformed' THEN seq ELSE 0 END) AS BIGINT) AS seqs FROM (SELECT p_partkey AS seq, {_KINDS} AS kind FROM part) GROUP BY 1")
def s2_read_tolerant(spark: SparkSession, sf: str) -> DataFrame:
    good, bad = jsonl.read_tolerant(spark, _lines(spark, sf), OBSERVATION, {"rank": F.col("shape_rank").isin(RANKS)}, ("seq",))
    both = good.select(F.lit("good").alias("kind"), "seq").unionByName(bad.select(F.col("error_type").alias("kind"), F.when(F.col("error_type") == "constraint", F.col("seq").cast("bigint")).alias("seq")))
    return both.groupBy("kind").agg(F.count("*").alias("n"), F.coalesce(F.sum("seq"), F.lit(0).cast("bigint")).alias("seqs"))


_NUMBERED = f"SELECT p_partkey AS seq, {_KINDS} AS kind, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS line_no, p_size FROM part"


@query(f"SELECT seq, kind AS error_type, line_no, concat('p_size=', CAST(p_size AS VARCHAR), ':', CAST(line_no AS VARCHAR), ': ', CASE kind WHEN 'malformed' THEN kind ELSE 'rank' END) AS message FROM ({_NUMBERED}) WHERE kind <> 'good'")
def s2_error_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A file for each size, its lines by key: every bad line is named by its place in its file, though files are read in small parts."""
    path, part = _folder(spark), table(spark, sf, "part")
    rank = F.when(F.col("p_size") % 5 == 4, "5D").otherwise("1D")
    line = F.to_json(F.struct(F.col("p_partkey").alias("seq"), rank.alias("shape_rank")))
    rows = part.select("p_size", "p_partkey", F.when(F.col("p_size") % 7 == 0, F.substring(line, F.lit(1), F.char_length(line) - 4)).otherwise(line).alias("value"))
    rows.repartition("p_size").sortWithinPartitions("p_size", "p_partkey").select("p_size", "value").write.partitionBy("p_size").text(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        _, bad = jsonl.read_tolerant(spark, path, "seq bigint, shape_rank string", {"rank": F.col("shape_rank").isin(RANKS)}, ("seq",))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    seq = F.regexp_extract("line", r'"seq":(\d+)', 1).cast("bigint").alias("seq")
    return bad.select(seq, "error_type", "line_no", F.regexp_replace("message", r"^.*/(p_size=\d+)/[^:]*", "$1").alias("message"))


@query("SELECT p_partkey AS seq, CASE WHEN p_size % 5 = 4 THEN '5D' ELSE concat(CAST(1 + p_size % 4 AS VARCHAR), 'D') END AS shape_rank FROM part WHERE p_size % 7 <> 0")
def s3_read_lenient(spark: SparkSession, sf: str) -> DataFrame:
    return jsonl.read_lenient(spark, _lines(spark, sf), OBSERVATION).select("seq", "shape_rank")


@query("SELECT p_partkey AS seq, p_size % 2 = 1 AS is_full, CASE WHEN p_size % 2 = 1 THEN p_brand END AS origin FROM part")
def s4_read_either(spark: SparkSession, sf: str) -> DataFrame:
    path, rows = _folder(spark), table(spark, sf, "part")
    rows.select(F.col("p_partkey").alias("seq"), F.when(F.col("p_size") % 2 == 1, F.col("p_brand")).alias("origin")).write.json(path)
    return jsonl.read_either(spark, path, "seq bigint", "seq bigint, origin string").select("seq", "is_full", "origin")


@query("SELECT model_label, seq, example_id, final_outcome FROM eval_rows", av.EVAL_SQL)
def s5_read_labels(spark: SparkSession, sf: str) -> DataFrame:
    root, rows = _folder(spark), av.eval_rows(spark, sf).select("model_label", "seq", "example_id", "final_outcome")
    for label in av.LABELS:  # the five labels are fixed: a folder each
        rows.where(F.col("model_label") == label).drop("model_label").write.json(f"{root}/{label}")
    return jsonl.read_labels(spark, root, "seq bigint, example_id string, final_outcome string", "part-*").select("model_label", "seq", "example_id", "final_outcome")


@query("SELECT p_partkey AS dataset_id, CASE WHEN p_size % 2 = 0 THEN 'old' ELSE 'new' END AS source FROM part")
def s6_append(spark: SparkSession, sf: str) -> DataFrame:
    path, rows = _folder(spark), table(spark, sf, "part").select(F.col("p_partkey").alias("dataset_id"), "p_size")
    rows.where("p_size % 2 = 0").select("dataset_id", F.lit("old").alias("source")).write.json(path)
    new = rows.select("dataset_id", F.lit("new").alias("source"))
    jsonl.append(new.unionByName(new), path)
    return spark.read.schema("dataset_id bigint, source string").json(path)


_STAGES = "CASE p_size % 3 WHEN 1 THEN 'parse' WHEN 2 THEN 'compile' END"


@query(f"SELECT coalesce(stage, 'accepted') AS stage, count(*) AS n, CAST(sum(p_partkey) AS BIGINT) AS keys FROM (SELECT *, {_STAGES} AS stage FROM part) GROUP BY 1")
def s7_routed_write(spark: SparkSession, sf: str) -> DataFrame:
    root, size = _folder(spark), F.col("p_size") % 3
    rows = table(spark, sf, "part").select("p_partkey", F.when(size == 1, "parse").when(size == 2, "compile").alias("stage"), F.lit("r").alias("reason"), F.lit("m").alias("message"))
    jsonl.routed_write(rows, f"{root}/accepted", f"{root}/rejected")
    ddl = "p_partkey bigint, stage string"
    both = spark.read.schema("p_partkey bigint").json(f"{root}/accepted").withColumn("stage", F.lit("accepted")).unionByName(spark.read.schema(ddl).json(f"{root}/rejected").select("p_partkey", "stage"))
    return both.groupBy("stage").agg(F.count("*").alias("n"), F.sum("p_partkey").alias("keys"))


@query("SELECT p_partkey, p_brand, p_size FROM part")
def s8_unwrap(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark)
    table(spark, sf, "part").select(F.col("p_name").alias("rationale"), F.struct("p_partkey", "p_brand", "p_size").alias("candidate")).write.json(path)
    return jsonl.unwrap(jsonl.read_strict(spark, path, "rationale string, candidate struct<p_partkey:bigint,p_brand:string,p_size:int>"))


@query("SELECT conv_id, count(*) AS n_messages, sha256(string_agg(role || chr(10) || coalesce(text, '<null>'), chr(10) ORDER BY turn)) AS messages_sha256 FROM conversations GROUP BY 1")
def s9_training_file(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark)
    turn = F.struct("turn", "role", F.col("text").alias("content"))
    jsonl.write_training(table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("messages")), path)
    back = jsonl.read_strict(spark, path, "conv_id bigint, messages array<struct<turn:bigint,role:string,content:string>>")
    joined = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("\n"), F.coalesce(m["content"], F.lit("<null>")))), "\n")
    return back.select("conv_id", F.size("messages").cast("bigint").alias("n_messages"), F.sha2(joined, 256).alias("messages_sha256"))


@query("SELECT concat('ex', CAST(p_partkey AS VARCHAR)) AS entry FROM part WHERE p_size % 3 = 0")
def s10_manifest(spark: SparkSession, sf: str) -> DataFrame:
    path, size = _folder(spark), F.col("p_size") % 3
    entry = F.concat(F.lit("  ex"), F.col("p_partkey").cast("string"), F.lit("\t"), F.col("p_name"))
    table(spark, sf, "part").select(F.when(size == 0, entry).when(size == 1, F.concat(F.lit(" # "), "p_name")).otherwise("   ").alias("value")).write.text(path)
    return jsonl.read_manifest(spark, path)


@query("SELECT seq, p_size FROM code WHERE p_size % 4 < 2", av.CODE_SQL)
def s11_source_files(spark: SparkSession, sf: str) -> DataFrame:
    root, rows = _folder(spark), av.code(spark, sf)
    marked = rows.select("p_size", F.concat(F.lit("# file "), F.col("seq").cast("string"), F.lit(" "), F.col("p_size").cast("string"), F.lit("\n"), F.col("pytorch_code")).alias("value"))
    for rest, folder in enumerate(("lib", "lib/deep", "tests", "lib/docs/more")):  # fixed: two folders that are searched, two that are not
        marked.where(F.col("p_size") % 4 == rest).select("value").write.text(f"{root}/{folder}")
    line = F.explode(F.split("text", "\n")).alias("line")
    found = jsonl.read_sources(spark, root, "part-*").select(line).where(F.col("line").startswith("# file "))
    part = F.split("line", " ")
    return found.select(part[2].cast("bigint").alias("seq"), part[3].cast("int").alias("p_size"))


# --- constraints -----------------------------------------------------------------------------------


def _part(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("seq"), "p_size", "p_brand")


@query("SELECT p_partkey AS seq, 1 + p_size % 3 = 1 + p_size % 2 AS ok FROM part")
def v1_same_length(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    rows = _part(spark, sf).withColumns({"input_shapes": F.array_repeat(F.array(F.lit(32)), (1 + size % 3).cast("int")), "input_dtypes": F.array_repeat(F.lit("float32"), (1 + size % 2).cast("int"))})
    return rows.select("seq", constraints.same_length().alias("ok"))


@query("SELECT p_partkey AS seq, (p_size % 2 = 0) <> (p_size % 3 <> 0) AS ok FROM part")
def v2_split_difficulty(spark: SparkSession, sf: str) -> DataFrame:
    rows = _part(spark, sf).withColumns({"split": F.when(F.col("p_size") % 2 == 0, "train").otherwise("eval"), "difficulty": F.when(F.col("p_size") % 3 != 0, "easy")})
    return rows.select("seq", constraints.split_difficulty().alias("ok"))


@query(
    f"""SELECT seq, CASE p_size % 3 WHEN 2 THEN 'other' ELSE derived END AS dataset_id, p_size % 3 <> 2 AS ok FROM (SELECT seq, p_size, {_UUID5} AS derived FROM (SELECT p_partkey AS seq, p_size, sha1(unhex('00000000000000000000000000000da7') || encode(sha256(
    '{{"brand":"' || p_brand || '","seq":' || CAST(p_partkey AS VARCHAR) || '}}'))) AS h FROM part))"""
)
def v3_derived_ids(spark: SparkSession, sf: str) -> DataFrame:
    fields = {"seq": F.col("seq"), "brand": F.col("p_brand")}
    given = F.when(F.col("p_size") % 3 == 1, ids.dataset_id(fields)).when(F.col("p_size") % 3 == 2, "other")
    found, ok = constraints.derived_id(fields)
    return _part(spark, sf).withColumn("dataset_id", given).select("seq", found.alias("dataset_id"), ok.alias("ok"))


@query(
    """SELECT p_partkey AS seq, CASE WHEN p_size % 5 = 0 THEN 'op_category,' ELSE '' END || CASE WHEN p_size % 4 = 1 THEN 'input_dtypes,' ELSE '' END || CASE WHEN p_size % 3 = 1 THEN 'tolerance_policy,' ELSE '' END
    || CASE WHEN p_size % 7 = 2 THEN 'split,' ELSE '' END || CASE WHEN p_size % 2 = 1 THEN 'difficulty,' ELSE '' END AS broken FROM part"""
)
def v4_corpus_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    rows = _part(spark, sf).withColumns({
        "op_category": F.when(size % 5 == 0, "none").otherwise("matmul"), "input_dtypes": F.array(F.lit("int8"), F.when(size % 4 == 1, "float8").otherwise("bool")),
        "tolerance_policy": F.when(size % 3 == 1, "loose").otherwise("default_fp32"), "split": F.when(size % 7 == 2, "test").otherwise("eval"), "difficulty": F.when(size % 2 == 1, "harder"),
    })
    return rows.select("seq", F.concat_ws("", F.transform(constraints.violations(constraints.vocabulary()), lambda v: F.concat(v, F.lit(",")))).alias("broken"))


@query(
    """SELECT p_partkey AS seq, CASE WHEN p_size % 5 = 0 THEN 'compile_status,' ELSE '' END || CASE WHEN p_size % 4 = 1 THEN 'correctness_status,' ELSE '' END || CASE WHEN p_size % 3 = 1 THEN 'failure_symptom,' ELSE '' END
    || CASE WHEN p_size % 7 = 2 THEN 'judge_classification,' ELSE '' END || CASE WHEN p_size % 2 = 1 THEN 'judge_root_cause,' ELSE '' END || CASE WHEN p_size % 11 = 3 THEN 'judge_repair_action,' ELSE '' END
    || CASE WHEN p_size % 3 = 2 THEN 'final_outcome,' ELSE '' END AS broken, p_size % 3 = 2 AS eval_ok FROM part"""
)
def v4_attempt_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    one = F.struct(
        F.struct(F.when(size % 5 != 0, "failed").alias("status")).alias("compile"), F.struct(F.when(size % 4 == 1, "skipped").when(size % 4 == 2, "passed").alias("status")).alias("correctness"),
        F.when(size % 3 == 1, "boredom").when(size % 3 == 2, "timeout").alias("failure_symptom"), F.when(size % 7 == 2, "none").otherwise("indexing_error").alias("judge_classification"),
        F.when(size % 2 == 1, "luck").otherwise("wrong_program_id_mapping").alias("judge_root_cause"), F.when(size % 11 == 3, "retry").otherwise("add_bounds_masking").alias("judge_repair_action"),
    )
    rows = _part(spark, sf).withColumns({"attempts": F.array(one), "final_outcome": F.when(size % 3 == 2, "compiled_correct_slow").otherwise("numeric_fail")})
    checks = constraints.attempt_vocabulary() | constraints.outcome_vocabulary()
    return rows.select("seq", F.concat_ws("", F.transform(constraints.violations(checks), lambda v: F.concat(v, F.lit(",")))).alias("broken"), constraints.outcome_vocabulary(True)["final_outcome"].alias("eval_ok"))


@query("SELECT concat('ex', CAST(p_partkey AS VARCHAR)) AS example_id, p_brand AS pytorch_code, 'train' AS split, 'synthetic/skeleton' AS origin, CAST(NULL AS VARCHAR) AS difficulty FROM part WHERE p_size % 2 = 0 AND p_size % 3 = 0 AND p_size % 5 <> 0")
def v5_slim_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    rows = _part(spark, sf).select(
        F.concat(F.lit("ex"), F.col("seq").cast("string")).alias("example_id"), F.lit("matmul").alias("op_category"), F.col("p_brand").alias("pytorch_code"), F.array(F.array(F.lit(8))).alias("input_shapes"), F.array(F.lit("int8")).alias("input_dtypes"), F.col("seq").alias("rng_seed"),
        F.lit("default_fp32").alias("tolerance_policy"), F.when(size % 2 == 0, "train").otherwise("eval").alias("split"), F.when(size % 3 == 0, "synthetic/skeleton").otherwise("web").alias("origin"), F.when(size % 5 == 0, "easy").alias("difficulty"),
    )
    return constraints.to_full(constraints.to_slim(rows)).select("example_id", "pytorch_code", "split", "origin", "difficulty")


def _attempt(spark: SparkSession, sf: str) -> DataFrame:
    """Attempts with faults: a second attempt always has a run error, a third one an error text."""
    a = av.attempts(spark, sf)
    error = F.when((F.col("compile_status") == "failed") | (F.col("attempt_n") == 2), "E")
    run = F.when(F.col("attempt_n") == 1, "E").otherwise(F.col("run_error"))
    return a.withColumn("a", F.struct("attempt_n", F.struct(F.col("compile_status").alias("status"), error.alias("error")).alias("compile"), run.alias("run_error"), F.when(F.col("correctness_status").isNotNull(), F.struct(F.col("correctness_status").alias("status"))).alias("correctness")))


@query("SELECT dataset_id, attempt_n, (compile_status = 'success') <> (compile_status = 'failed' OR attempt_n = 2) AS ok FROM attempts", av.ATTEMPT_SQL)
def v6_compile_errors(spark: SparkSession, sf: str) -> DataFrame:
    return _attempt(spark, sf).select("dataset_id", "attempt_n", constraints.compile_error_matches(F.col("a.compile.status"), F.col("a.compile.error")).alias("ok"))


@query(
    """SELECT dataset_id, attempt_n, CASE WHEN compile_status = 'failed' THEN correctness_status IS NULL AND run IS NULL ELSE (correctness_status IS NOT NULL) <> (run IS NOT NULL) END AS ok
    FROM (SELECT *, CASE WHEN attempt_n = 1 THEN 'E' ELSE run_error END AS run FROM attempts)""",
    av.ATTEMPT_SQL,
)
def v7_attempt_results(spark: SparkSession, sf: str) -> DataFrame:
    return _attempt(spark, sf).select("dataset_id", "attempt_n", constraints.attempt_result(F.col("a")).alias("ok"))


@query("SELECT dataset_id, bool_and(n = attempt_n) AS ok FROM (SELECT dataset_id, attempt_n, attempt_n + CASE WHEN CAST(dataset_id AS BIGINT) % 5 = 0 AND attempt_n > 0 THEN 1 ELSE 0 END AS n FROM attempts) GROUP BY 1", av.ATTEMPT_SQL)
def v8_attempt_numbers(spark: SparkSession, sf: str) -> DataFrame:
    late = (F.col("dataset_id").cast("bigint") % 5 == 0) & (F.col("attempt_n") > 0)
    rows = av.attempts(spark, sf).select("dataset_id", F.struct((F.col("attempt_n") + F.when(late, 1).otherwise(0)).alias("attempt_n")).alias("a"))
    return rows.groupBy("dataset_id").agg(F.array_sort(F.collect_list("a")).alias("attempts")).select("dataset_id", constraints.attempts_numbered().alias("ok"))


@query(
    """SELECT dataset_id, CAST(dataset_id AS BIGINT) % 3 <> 0 OR bool_and(correctness_status IS NULL) AS policy_ok, CAST(dataset_id AS BIGINT) % 4 <> 0 AS example_ok FROM attempts GROUP BY 1""",
    av.ATTEMPT_SQL,
)
def v10_policy_and_example(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("dataset_id").cast("bigint")
    source = F.struct(F.when(key % 4 == 0, "another").otherwise(F.col("source.example_id")).alias("example_id"), F.when(key % 3 == 0, "exact_integer").otherwise(F.col("source.tolerance_policy")).alias("tolerance_policy"))
    checks = constraints.dataset_row()
    return av.dataset_rows(spark, sf).withColumn("source", source).select("dataset_id", checks["policy"].alias("policy_ok"), checks["example_id"].alias("example_ok"))


@query(
    """SELECT seq, k >= 15 OR k % 2 = 0 AS needs_pass_ok, k % 3 <> 1 AND k <> 2 AS bounds_ok, k % 4 <> 0 AND k % 5 <> 0 AS stats_ok, k % 6 <> 0 AS ops_ok FROM eval_rows""",
    av.EVAL_SQL,
)
def v12_result_bounds(spark: SparkSession, sf: str) -> DataFrame:
    k, d = F.col("k"), lambda x: F.lit(float(x))
    samples = lambda n: F.array_repeat(d(1), F.when(n, 99).otherwise(100))
    bench = F.struct(d(1).alias("triton_ms"), F.when(k == 2, 0.0).otherwise(1.0).alias("eager_ms"), d(1).alias("inductor_ms"), d(2).alias("speedup_vs_eager"), d(2).alias("speedup_vs_inductor"), samples(k % 3 == 1).alias("triton_samples_ms"), samples(F.lit(False)).alias("eager_samples_ms"), samples(F.lit(False)).alias("inductor_samples_ms"))
    side = lambda bad, pct: F.struct(F.when(bad, -1.0).otherwise(0.0).alias("max_abs_diff"), d(0).alias("max_rel_diff"), d(0).alias("mean_abs_diff"), F.lit(0).cast("bigint").alias("n_elements_exceeding_tol"), pct.alias("pct_elements_exceeding_tol"))
    correct = F.struct(F.when((k >= 15) | (k % 2 == 0), "passed").otherwise("failed").alias("status"), side(k % 4 == 0, d(100)).alias("vs_eager"), side(F.lit(False), F.when(k % 5 == 0, 101.0).otherwise(50.0)).alias("vs_inductor"))
    rows = av.eval_rows(spark, sf).withColumns({"attempts": F.array(F.struct(F.lit(0).alias("attempt_n"), bench.alias("benchmark"), correct.alias("correctness"))), "spec": F.struct(F.array_repeat(F.lit("torch.relu"), F.when(k % 6 == 0, 1).otherwise(2)).alias("ops"))})
    checks = constraints.eval_row()
    return rows.select("seq", checks["benchmark_needs_pass"].alias("needs_pass_ok"), checks["benchmark_bounds"].alias("bounds_ok"), checks["stats_bounds"].alias("stats_ok"), checks["ops"].alias("ops_ok"))


@query("SELECT p_partkey AS seq, CASE WHEN p_size % 2 = 0 THEN p_size % 3 = 0 AND p_size % 5 = 0 ELSE p_size % 3 <> 0 AND p_size % 5 <> 0 END AS ok FROM part")
def v13_judge_labels(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    labels = {"judge_classification": F.when(size % 2 == 0, "compiled_correct").otherwise("other"), "judge_root_cause": F.when(size % 3 != 0, "unknown"), "judge_repair_action": F.when(size % 5 != 0, "unknown"), "judge_fix_suggestion": F.when(size % 5 != 0, "more")}
    return _part(spark, sf).withColumns(labels).select("seq", constraints.judge_labels().alias("ok"))


@query(
    """SELECT seq, coalesce(n_ops = ops AND n_in = inputs AND (NOT needs_keys OR has_keys), false) AS ok FROM (SELECT p_partkey AS seq, 2 + 2 * (p_size % 2) AS n_ops, 1 + 2 * (p_size % 3 // 2) AS n_in, p_size % 5 <> 0 AS has_keys,
    CASE p_size % 4 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 4 END AS ops, CASE p_size % 4 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 3 END AS inputs, p_size % 4 <> 0 AS needs_keys FROM part)"""
)
def v15_spec_forms(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    keys = [F.lit(x) for k in ("reduce_dim", "keepdim", "num_heads", "causal", "scale") for x in (k, "1")]
    form = F.when(size % 4 == 0, "chain_2_unary").when(size % 4 == 1, "unary_then_reduction").when(size % 4 == 2, "attention_qkv").otherwise("unheard_of")
    rows = _part(spark, sf).withColumns({
        "form": form, "ops": F.array_repeat(F.lit("torch.abs"), (2 + 2 * (size % 2)).cast("int")), "input_shapes": F.array_repeat(F.array(F.lit(32)), (1 + 2 * F.floor(size % 3 / 2)).cast("int")),
        "form_metadata": F.when(size % 5 != 0, F.create_map(*keys)).otherwise(F.create_map().cast("map<string,string>")),
    })
    return rows.select("seq", F.coalesce(constraints.spec_matches_form(), F.lit(False)).alias("ok"))


# --- attempts and streams --------------------------------------------------------------------------


@query(
    """SELECT dataset_id, attempt_n, CASE WHEN attempt_n = 0 THEN NULL WHEN code = before THEN '' ELSE concat('--- previous', chr(10), '+++ current', chr(10), '@@ -1 +1 @@', chr(10), '-', before, chr(10), '+', code, chr(10)) END AS patch_from_previous
    FROM (SELECT *, lag(code) OVER (PARTITION BY dataset_id ORDER BY attempt_n) AS before FROM (SELECT dataset_id, attempt_n, coalesce(correctness_status, compile_status) AS code FROM attempts))""",
    av.ATTEMPT_SQL,
)
def o8_patch_texts(spark: SparkSession, sf: str) -> DataFrame:
    code = F.concat(F.coalesce("correctness_status", "compile_status"), F.lit("\n"))
    rows = av.attempts(spark, sf).withColumns({"judge_fix_suggestion": F.lit(None).cast("string"), "triton_code": code})
    return att.with_prior(rows).select("dataset_id", "attempt_n", "patch_from_previous")


@query(f"SELECT kind, count(*) AS n FROM (SELECT {_KINDS} AS kind FROM part) GROUP BY 1")
def r1_ingest(spark: SparkSession, sf: str) -> DataFrame:
    folder, root = _lines(spark, sf), _folder(spark)
    feeds.ingest(spark, folder, OBSERVATION, {"constraint": F.col("shape_rank").isin(RANKS)}, root).awaitTermination()
    good, bad = feeds.ingested(spark, root, OBSERVATION)
    both = good.select(F.lit("good").alias("kind")).unionByName(bad.select(F.col("violations")[0].alias("kind")))
    return both.groupBy("kind").agg(F.count("*").alias("n"))


#: Seconds from a job's first event to its timeout, and by which the watermark waits.
_LIMIT, _WAIT = 172_800, 600


@query(
    f"""SELECT job_id, CASE WHEN ended <= first_ts + INTERVAL {_LIMIT} SECOND THEN status ELSE 'timeout' END AS status, first_ts, CASE WHEN ended <= first_ts + INTERVAL {_LIMIT} SECOND THEN ended ELSE first_ts + INTERVAL {_LIMIT} SECOND END AS ts FROM
    (SELECT user_id AS job_id, date_trunc('millisecond', min(ts)) AS first_ts, date_trunc('millisecond', max(ts)) AS last_ts, date_trunc('millisecond', min(ts) FILTER (event_type IN ('error', 'purchase'))) AS ended, arg_min(CASE event_type WHEN 'purchase' THEN 'done' ELSE 'error' END, ts) FILTER (event_type IN ('error', 'purchase')) AS status FROM events GROUP BY 1)
    WHERE ended <= first_ts + INTERVAL {_LIMIT} SECOND OR last_ts > first_ts + INTERVAL {_LIMIT} SECOND OR (SELECT max(ts) FROM events) - INTERVAL {_WAIT} SECOND >= first_ts + INTERVAL {_LIMIT} SECOND"""
)
def r4_timeouts(spark: SparkSession, sf: str) -> DataFrame:
    """Users as jobs: an error or a purchase ends one; silent ones are ended by the stream's own timers."""
    events = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parque[t]")
    status = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "error").otherwise("running")
    rows = events.select(F.col("user_id").alias("job_id"), status.alias("status"), F.col("ts").cast("timestamp").alias("ts"))
    out = feeds.drain(feeds.ended(rows, _LIMIT, f"{_WAIT} seconds"))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("ts", "first_ts")})


@query("SELECT p_partkey AS dataset_id, p_brand FROM part")
def r5_append_new(spark: SparkSession, sf: str) -> DataFrame:
    """The table as a stream, sent twice, with a quarter of it there before: each key is written once."""
    root, ddl = _folder(spark), "dataset_id bigint, p_brand string"
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("dataset_id"), "p_brand", "p_size")
    before = rows.where("p_size % 4 = 0").drop("p_size")
    for turn in ("a", "b"):
        rows.drop("p_size").write.json(f"{root}/in/{turn}")
    stream = feeds.read_feed(spark, f"{root}/in/*", ddl, files_per_batch=4).drop(feeds.CORRUPT)
    feeds.append_new(stream, f"{root}/out", existing=before).awaitTermination()
    return feeds.committed(spark, f"{root}/out", "rows", stream.schema).drop("batch").unionByName(before)


@query(
    f"""SELECT p_partkey AS seq, kind, count(*) OVER w AS n, count(*) FILTER (kind = 'good') OVER w AS accepted, count(*) FILTER (kind <> 'good') OVER w AS rejected
    FROM (SELECT *, {_KINDS} AS kind FROM part) WINDOW w AS (ORDER BY p_partkey ROWS UNBOUNDED PRECEDING)"""
)
def a16_running_totals(spark: SparkSession, sf: str) -> DataFrame:
    """How many were accepted and rejected so far, after every row."""
    size = F.col("p_size")
    kind = F.when(size % 7 == 0, "malformed").when(size % 5 == 4, "constraint").otherwise("good")
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("seq"), kind.alias("kind"))
    return describe.running_totals(rows, {"accepted": F.col("kind") == "good", "rejected": F.col("kind") != "good"}, ["seq"])


@query(f"SELECT kind, count(*) AS n, true AS grows FROM (SELECT {_KINDS} AS kind FROM part) GROUP BY 1")
def r6_running_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Totals after each batch of a feed of eight files; they only grow and end at the whole."""
    folder, size = _folder(spark), F.col("p_size")
    kind = F.when(size % 7 == 0, "malformed").when(size % 5 == 4, "constraint").otherwise("good")
    table(spark, sf, "part").select(kind.alias("kind")).repartition(8).write.json(folder)
    stream = feeds.read_feed(spark, folder, "kind string", files_per_batch=1).drop(feeds.CORRUPT)
    out = feeds.drain(feeds.totals(stream, "kind"), "update", batches=True)
    sorted_by = lambda c: F.array_sort(F.collect_list(F.struct(F.col(c).alias("by"), "n")))
    per = out.groupBy("kind").agg(F.max("n").alias("total"), sorted_by("batch").alias("by_batch"), sorted_by("n").alias("by_n"))
    ns = lambda c: F.transform(c, lambda x: x["n"])
    return per.select("kind", F.col("total").alias("n"), (ns("by_batch") == ns("by_n")).alias("grows"))
