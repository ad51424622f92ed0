"""Views of the given tables as the records that the operators work on, for Spark and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofmill.operators.constraints import outcome_of
from proofmill.tables import table

#: Labels of the event types, in order.
LABELS = ["click", "error", "purchase", "signup", "view"]

EVAL_SQL = """ev AS (SELECT *, CAST(json_extract_string(props,'$.k') AS INT) AS k FROM events),
eval_rows AS (SELECT event_id AS seq, event_type AS model_label, concat('ex', CAST(user_id AS VARCHAR)) AS example_id, ts, k,
  CASE WHEN user_id % 4 = 0 THEN 'easy' WHEN user_id % 4 = 3 THEN 'hard' ELSE 'medium' END AS tier,
  CASE WHEN k < 5 THEN 'compile_fail' WHEN k < 10 THEN 'runtime_fail' WHEN k < 15 THEN 'correctness_failed'
       WHEN 40.0/greatest(value, 0.01) >= 1.1 THEN 'compiled_correct_faster_than_inductor'
       WHEN 40.0/greatest(value, 0.01) >= 1.0 THEN 'compiled_correct_parity' ELSE 'compiled_correct_slow' END AS final_outcome,
  CASE WHEN k >= 15 THEN 0 END AS final_winning_attempt_n,
  CASE WHEN k >= 15 THEN 40.0/greatest(value, 0.01) END AS speedup_vs_inductor, CASE WHEN k >= 15 THEN 55.0/greatest(value, 0.01) END AS speedup_vs_eager, value AS triton_ms FROM ev),
last_rows AS (SELECT * FROM eval_rows QUALIFY row_number() OVER (PARTITION BY model_label, example_id ORDER BY seq DESC) = 1)"""
ATTEMPT_SQL = """numbered AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem),
all_attempts AS (SELECT CAST(l_orderkey AS VARCHAR) AS dataset_id, CAST(o_custkey AS VARCHAR) AS example_id, o_orderpriority AS op_category, n - 1 AS attempt_n,
  CASE WHEN l_returnflag = 'A' AND l_quantity < 10 THEN 'failed' ELSE 'success' END AS compile_status,
  CASE WHEN l_returnflag = 'R' THEN 'RuntimeError' END AS run_error,
  CASE WHEN (l_returnflag = 'A' AND l_quantity < 10) OR l_returnflag = 'R' THEN NULL WHEN l_linestatus = 'F' THEN 'passed' ELSE 'failed' END AS correctness_status
  FROM numbered JOIN orders ON l_orderkey = o_orderkey),
attempts AS (SELECT * FROM all_attempts WHERE attempt_n < 3),
outcome AS (SELECT dataset_id, min(example_id) AS example_id, min(op_category) AS op_category, CASE WHEN count(*) FILTER (correctness_status = 'passed') > 0 THEN 'compiled_correct' WHEN count(correctness_status) > 0 THEN 'numeric_fail'
  WHEN count(*) FILTER (compile_status = 'success') > 0 THEN 'runtime_fail' ELSE 'compile_fail' END AS final_outcome, count(*) AS n_attempts FROM attempts GROUP BY dataset_id)"""
CORPUS_SQL = """corpus AS (SELECT doc_id AS seq, text AS pytorch_code, sha256(text) AS code_sha, lang AS op_category, source AS origin FROM documents
  UNION ALL SELECT 1000000000 + item_id, text, sha256(text), 'en', 'leak' FROM benchmark WHERE item_id % 10 = 0)"""
OBSERVATION_SQL = """observations AS (SELECT p_partkey AS seq, p_type AS op_category, concat(CAST(1 + p_size % 4 AS VARCHAR), 'D') AS shape_rank,
  CASE p_size % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'row' WHEN 2 THEN 'col' WHEN 3 THEN 'channel' ELSE 'batch' END AS broadcast_pattern, p_brand AS origin FROM part)"""
ELEMENT_SQL = """e AS (SELECT vec_id, generate_subscripts(embedding, 1) AS idx, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
pairs AS (SELECT a.vec_id AS task_id, a.idx, a.v AS candidate, b.v AS reference FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 AND a.idx = b.idx WHERE a.vec_id % 2 = 0)"""
CODE_SQL = """code AS (SELECT p_partkey AS seq, p_size, concat('import torch', chr(10), chr(10), 'def f', CAST(p_partkey AS VARCHAR), '(x):', chr(10),
  '    return torch.', CASE p_size % 4 WHEN 0 THEN 'relu' WHEN 1 THEN 'tanh' WHEN 2 THEN 'exp' ELSE 'rand' END, '(x)', chr(10)) AS pytorch_code FROM part)"""


def eval_rows(spark: SparkSession, d: str) -> DataFrame:
    """AV1: results of five labels; a label may have several rows of an example, the last by ``seq`` counts."""
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    ratio, won = F.lit(40.0) / F.greatest("value", F.lit(0.01)), F.col("k") >= 15
    outcome = F.when(F.col("k") < 5, "compile_fail").when(F.col("k") < 10, "runtime_fail").when(~won, "correctness_failed").when(ratio >= 1.1, "compiled_correct_faster_than_inductor").when(ratio >= 1.0, "compiled_correct_parity").otherwise("compiled_correct_slow")
    tier = F.when(F.col("user_id") % 4 == 0, "easy").when(F.col("user_id") % 4 == 3, "hard").otherwise("medium")
    return e.select(F.col("event_id").alias("seq"), F.col("event_type").alias("model_label"), F.concat(F.lit("ex"), F.col("user_id").cast("string")).alias("example_id"), "ts", "k", tier.alias("tier"), outcome.alias("final_outcome"), F.when(won, 0).alias("final_winning_attempt_n"), F.when(won, ratio).alias("speedup_vs_inductor"), F.when(won, F.lit(55.0) / F.greatest("value", F.lit(0.01))).alias("speedup_vs_eager"), F.col("value").alias("triton_ms"))


def attempts(spark: SparkSession, d: str, limit: int | None = 3) -> DataFrame:
    """AV2: attempt sequences, in a total order as line numbers repeat."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag", "l_linestatus").withColumn("n", F.row_number().over(order))
    line = line if limit is None else line.where(F.col("n") <= limit)
    failed = (F.col("l_returnflag") == "A") & (F.col("l_quantity") < 10)
    compared = F.when(failed | (F.col("l_returnflag") == "R"), None).when(F.col("l_linestatus") == "F", "passed").otherwise("failed")
    rows = line.join(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(F.col("l_orderkey").cast("string").alias("dataset_id"), F.col("o_custkey").cast("string").alias("example_id"), F.col("o_orderpriority").alias("op_category"), (F.col("n") - 1).alias("attempt_n"), F.when(failed, "failed").otherwise("success").alias("compile_status"), F.when(F.col("l_returnflag") == "R", "RuntimeError").alias("run_error"), compared.alias("correctness_status"))


def dataset_rows(spark: SparkSession, d: str) -> DataFrame:
    """AV2 nested: one row for each order with its attempts and a source block."""
    a = attempts(spark, d)
    one = F.struct("attempt_n", F.concat_ws("-", F.lit("code"), "dataset_id", F.col("attempt_n").cast("string")).alias("triton_code"), F.struct(F.col("compile_status").alias("status"), F.when(F.col("compile_status") == "failed", "CompilationError").alias("error")).alias("compile"), F.when(F.col("compile_status") == "success", F.col("run_error")).alias("run_error"), F.when(F.col("correctness_status").isNotNull(), F.struct(F.col("correctness_status").alias("status"), F.lit("default_fp32").alias("tolerance_policy_used"))).alias("correctness"))
    source = F.struct(F.min("example_id").alias("example_id"), F.concat(F.lit("src-"), F.min("dataset_id")).alias("pytorch_code"), F.array(F.array(F.lit(32), F.lit(1024))).alias("input_shapes"), F.array(F.lit("float32")).alias("input_dtypes"), F.min("op_category").alias("op_category"), F.lit("default_fp32").alias("tolerance_policy"))
    nested = a.groupBy("dataset_id").agg(F.min("example_id").alias("example_id"), F.min("op_category").alias("op_category"), source.alias("source"), F.array_sort(F.collect_list(one)).alias("attempts"))
    return nested.withColumn("final_outcome", outcome_of())


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """AV3: a code corpus with a few holdout texts in it."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("seq"), F.col("text").alias("pytorch_code"), F.col("lang").alias("op_category"), F.col("source").alias("origin"))
    leak = table(spark, d, "benchmark").where("item_id % 10 = 0").select((F.col("item_id") + 1000000000).alias("seq"), F.col("text").alias("pytorch_code"), F.lit("en").alias("op_category"), F.lit("leak").alias("origin"))
    return docs.unionByName(leak).withColumn("code_sha", F.sha2("pytorch_code", 256))


def holdout(spark: SparkSession, d: str) -> DataFrame:
    """AV3: the locked holdout."""
    return table(spark, d, "benchmark").select("item_id", F.col("text").alias("pytorch_code"))


def observations(spark: SparkSession, d: str) -> DataFrame:
    """AV5: observations with two of the axes."""
    size = F.col("p_size")
    pattern = F.when(size % 5 == 0, "none").when(size % 5 == 1, "row").when(size % 5 == 2, "col").when(size % 5 == 3, "channel").otherwise("batch")
    return table(spark, d, "part").select(F.col("p_partkey").alias("seq"), F.col("p_type").alias("op_category"), F.concat((1 + size % 4).cast("string"), F.lit("D")).alias("shape_rank"), pattern.alias("broadcast_pattern"), F.col("p_brand").alias("origin"))


def element_pairs(spark: SparkSession, d: str) -> DataFrame:
    """AV6: elements of neighbouring vectors."""
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v")).select("vec_id", (F.col("pos") + 1).alias("idx"), F.col("v").cast("double").alias("v"))
    a, b = e.where("vec_id % 2 = 0").select(F.col("vec_id").alias("task_id"), "idx", F.col("v").alias("candidate")), e.select((F.col("vec_id") - 1).alias("task_id"), "idx", F.col("v").alias("reference"))
    return a.join(b, ["task_id", "idx"])


def code(spark: SparkSession, d: str) -> DataFrame:
    """AV7: small functions, of which some call what is banned."""
    size = F.col("p_size")
    op = F.when(size % 4 == 0, "relu").when(size % 4 == 1, "tanh").when(size % 4 == 2, "exp").otherwise("rand")
    text = F.concat(F.lit("import torch\n\ndef f"), F.col("p_partkey").cast("string"), F.lit("(x):\n    return torch."), op, F.lit("(x)\n"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("seq"), "p_size", text.alias("pytorch_code"))
