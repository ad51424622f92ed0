"""Registered queries over the given tables and their DuckDB SQL. Fractions are rounded to six places in both."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofmill import adapters as av
from proofmill import vocab
from proofmill.functions import classify, code, ids
from proofmill.operators import attempts as att
from proofmill.operators import constraints, records, sampling, training
from proofmill.plans import describe as d
from proofmill.plans import hypothesis as h
from proofmill.streaming import feeds
from proofmill.tables import cut, shared_dir, table

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None, *views: str):
    """Register a function under its name; ``views`` are the SQL views that ``sql`` reads."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = (f"WITH {', '.join(views)} " if views else "") + sql
        return f

    return add


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    """Fractions rounded for comparison; all double columns if none is named."""
    names = names or tuple(f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType))
    return df.withColumns({n: F.round(F.col(n).cast("double"), places) for n in names})


# --- constraints -----------------------------------------------------------------------------------


@query(
    """SELECT op_category, count(*) AS n, count(*) FILTER (bad_rank) AS n_bad_rank, count(*) FILTER (bad_broadcast) AS n_bad_broadcast FROM
    (SELECT op_category, shape_rank NOT IN ('1D','2D','3D') AS bad_rank, broadcast_pattern NOT IN ('none','row') AS bad_broadcast FROM observations) GROUP BY 1""",
    av.OBSERVATION_SQL,
)
def v4_vocabulary_violations(spark: SparkSession, sf: str) -> DataFrame:
    checks = {"rank": F.col("shape_rank").isin("1D", "2D", "3D"), "broadcast": F.col("broadcast_pattern").isin("none", "row")}
    rows = av.observations(spark, sf).withColumn("violations", constraints.violations(checks))
    has = lambda name: F.count_if(F.array_contains("violations", name))
    return rows.groupBy("op_category").agg(F.count("*").alias("n"), has("rank").alias("n_bad_rank"), has("broadcast").alias("n_bad_broadcast"))


@query(
    """SELECT dataset_id, CASE WHEN k % 11 = 0 THEN 'has_attempts,' WHEN k % 7 = 1 THEN 'attempt_numbers,' ELSE '' END || CASE WHEN k % 11 = 0 THEN CASE WHEN final_outcome <> 'compile_fail' THEN 'final_outcome,' ELSE '' END WHEN k % 5 = 2 AND final_outcome <> 'numeric_fail' THEN 'final_outcome,' ELSE '' END
    || CASE WHEN k % 3 = 1 AND k % 11 <> 0 AND compared > 0 THEN 'policy,' ELSE '' END || CASE WHEN k % 4 = 3 THEN 'example_id,' ELSE '' END AS broken FROM
    (SELECT o.dataset_id, final_outcome, CAST(o.dataset_id AS BIGINT) AS k, compared FROM outcome o JOIN (SELECT dataset_id, count(correctness_status) AS compared FROM attempts GROUP BY 1) USING (dataset_id))""",
    av.ATTEMPT_SQL,
)
def v9_dataset_row_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Dataset rows with planted faults: no attempts, numbers that start late, another outcome, policy or example; each row's broken checks."""
    k, rows = F.col("dataset_id").cast("bigint"), av.dataset_rows(spark, sf)
    late = F.transform("attempts", lambda a: a.withField("attempt_n", a["attempt_n"] + F.when(k % 7 == 1, 1).otherwise(0)))
    changed = rows.withColumns({
        "attempts": F.when(k % 11 == 0, F.slice("attempts", 1, 0)).otherwise(late), "final_outcome": F.when((k % 5 == 2) & (k % 11 != 0), "numeric_fail").otherwise(F.col("final_outcome")),
        "source": F.col("source").withField("tolerance_policy", F.when(k % 3 == 1, "default_fp16").otherwise("default_fp32")), "example_id": F.when(k % 4 == 3, "another").otherwise(F.col("example_id")),
    })
    broken = constraints.violations(constraints.dataset_row())
    return changed.select("dataset_id", F.concat_ws("", F.transform(broken, lambda v: F.concat(v, F.lit(",")))).alias("broken"))


@query("SELECT seq, (k >= 15) = (k % 4 <> 0 AND k >= 15 OR k % 9 = 0) AS winner_ok, CASE k % 3 WHEN 0 THEN tier ELSE 'medium' END = tier AS difficulty_ok FROM eval_rows", av.EVAL_SQL)
def v11_winner_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Results of which some have lost their winner, some have one without a pass, and some another difficulty."""
    k = F.col("k")
    winner = F.when((k >= 15) & (k % 4 != 0) | (k % 9 == 0), 0)
    stats = "struct<max_abs_diff:double,max_rel_diff:double,mean_abs_diff:double,n_elements_exceeding_tol:bigint,pct_elements_exceeding_tol:double>"
    attempts = F.array().cast(f"array<struct<attempt_n:int,correctness:struct<status:string,vs_eager:{stats},vs_inductor:{stats}>,benchmark:struct<triton_ms:double,eager_ms:double,inductor_ms:double,speedup_vs_eager:double,speedup_vs_inductor:double,triton_samples_ms:array<double>,eager_samples_ms:array<double>,inductor_samples_ms:array<double>>>>")
    rows = av.eval_rows(spark, sf).withColumns({"final_winning_attempt_n": winner, "attempts": attempts, "spec": F.struct("tier", F.array(F.lit("a"), F.lit("b")).alias("ops")), "difficulty": F.when(k % 3 == 0, F.col("tier")).otherwise("medium")})
    return rows.select("seq", constraints.eval_row()["winner"].alias("winner_ok"), constraints.difficulty_is_tier().alias("difficulty_ok"))


@query(
    """SELECT count(*) AS n, count(*) FILTER (len(list_filter(json_keys(props), lambda x: x NOT IN ('k'))) > 0) AS n_extra,
    count(*) FILTER (len(list_filter(json_keys(props), lambda x: x NOT IN ('z'))) > 0) AS n_extra_z FROM events"""
)
def v14_extra_keys(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.agg(F.count("*").alias("n"), F.count_if(~constraints.no_extra_keys(F.col("props"), ["k"])).alias("n_extra"), F.count_if(~constraints.no_extra_keys(F.col("props"), ["z"])).alias("n_extra_z"))


# --- identifiers -----------------------------------------------------------------------------------

_UUID5 = "substr(h,1,8) || '-' || substr(h,9,4) || '-5' || substr(h,14,3) || '-' || translate(substr(h,17,1),'0123456789abcdef','89ab89ab89ab89ab') || substr(h,18,3) || '-' || substr(h,21,12)"


@query(f"SELECT seq, {_UUID5} AS example_id FROM (SELECT seq, sha1(unhex('00000000000000000000000000000eab') || encode(code_sha)) AS h FROM corpus)", av.CORPUS_SQL)
def i1_example_ids(spark: SparkSession, sf: str) -> DataFrame:
    return records.with_example_id(av.corpus(spark, sf)).select("seq", "example_id")


@query(
    f"""SELECT seq, {_UUID5} AS dataset_id FROM (SELECT seq, sha1(unhex('00000000000000000000000000000da7') || encode(sha256(
    '{{"op_category":"' || op_category || '","origin":"' || origin || '","rank":"' || shape_rank || '","seq":' || CAST(seq AS VARCHAR) || '}}'))) AS h FROM observations)""",
    av.OBSERVATION_SQL,
)
def i2_dataset_ids(spark: SparkSession, sf: str) -> DataFrame:
    o = av.observations(spark, sf)
    return o.select("seq", ids.dataset_id({"seq": F.col("seq"), "op_category": F.col("op_category"), "origin": F.col("origin"), "rank": F.col("shape_rank")}).alias("dataset_id"))


@query(
    f"""SELECT seq, {_UUID5} AS spec_id FROM (SELECT seq, sha1(unhex('00000000000000000000000000000c01') || encode(concat_ws('|', op_category, shape_rank, broadcast_pattern,
    CAST(p_size AS VARCHAR) || 'x1024' || CASE WHEN p_size % 2 = 0 THEN ',8' ELSE '' END, CASE WHEN p_size % 3 = 0 THEN 'float16' ELSE 'float32' END || CASE WHEN p_size % 2 = 0 THEN ',int8' ELSE '' END))) AS h FROM observations JOIN part ON p_partkey = seq)""",
    av.OBSERVATION_SQL,
)
def i3_skeleton_spec_ids(spark: SparkSession, sf: str) -> DataFrame:
    """One or two inputs, of shapes and dtypes that follow the table."""
    size, two = F.col("p_size"), F.col("p_size") % 2 == 0
    first, kind = F.array(size, F.lit(1024)), F.when(size % 3 == 0, "float16").otherwise("float32")
    shapes, dtypes = F.when(two, F.array(first, F.array(F.lit(8)))).otherwise(F.array(first)), F.when(two, F.array(kind, F.lit("int8"))).otherwise(F.array(kind))
    rows = av.observations(spark, sf).join(table(spark, sf, "part").select(F.col("p_partkey").alias("seq"), "p_size"), "seq")
    return rows.select("seq", ids.skeleton_spec_id(F.col("op_category"), [F.col("shape_rank"), F.col("broadcast_pattern")], shapes, dtypes).alias("spec_id"))


@query(
    f"""SELECT seq, {_UUID5} AS spec_id FROM (SELECT p_partkey AS seq, sha1(unhex('00000000000000000000000000000eaa') || encode('{{"form": "' || p_type || '", "form_metadata": {{"keepdim": ' || CASE p_size % 2 WHEN 0 THEN 'false' ELSE 'true' END || ', "reduce_dim": -' || CAST(1 + p_size % 3 AS VARCHAR)
    || '}}, "input_shapes": [[' || CAST(p_size AS VARCHAR) || ', 8], [4]], "ops": ["torch.relu", "torch.' || lower(p_type) || '"], "rng_seed": ' || CAST(p_partkey AS VARCHAR) || '}}')) AS h FROM part)"""
)
def i4_eval_spec_ids(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    metadata = F.to_json(F.struct((-(1 + size % 3)).alias("reduce_dim"), (size % 2 == 1).alias("keepdim")))
    fields = {"ops": F.array(F.lit("torch.relu"), F.concat(F.lit("torch."), F.lower("p_type"))), "form": F.col("p_type"), "form_metadata": metadata, "input_shapes": F.array(F.array(size, F.lit(8)), F.array(F.lit(4))), "rng_seed": F.col("p_partkey")}
    return table(spark, sf, "part").select(F.col("p_partkey").alias("seq"), ids.eval_spec_id(fields).alias("spec_id"))


@query(
    "SELECT seq, CAST((CAST(('0x' || substr(u,1,8))::UBIGINT AS HUGEINT) * 8 + ('0x' || substr(u,9,8))::UBIGINT * 4 + ('0x' || substr(u,17,8))::UBIGINT * 2 + ('0x' || substr(u,25,8))::UBIGINT) % 2147483647 AS BIGINT) AS rng_seed FROM (SELECT seq, replace("
    + _UUID5
    + ", '-', '') AS u FROM (SELECT seq, sha1(unhex('00000000000000000000000000000eab') || encode(code_sha)) AS h FROM corpus))",
    av.CORPUS_SQL,
)
def i5_rng_seeds(spark: SparkSession, sf: str) -> DataFrame:
    return records.with_example_id(av.corpus(spark, sf)).select("seq", ids.seed_of(F.col("example_id")).alias("rng_seed"))


@query("SELECT min(seq) AS seq, count(*) AS n_same FROM code GROUP BY p_size % 4", av.CODE_SQL)
def i6_canonical_groups(spark: SparkSession, sf: str) -> DataFrame:
    rows = av.code(spark, sf).withColumn("canonical_sha", code.canonical("pytorch_code"))
    return rows.groupBy("canonical_sha").agg(F.min("seq").alias("seq"), F.count("*").alias("n_same")).drop("canonical_sha")


# --- checks and classifiers ------------------------------------------------------------------------


@query(
    """SELECT seq, CASE p_size % 9 WHEN 0 THEN 'syntax@4' WHEN 1 THEN 'import' WHEN 2 THEN 'module' WHEN 3 THEN 'no_argument' WHEN 4 THEN 'argument_kind' WHEN 5 THEN 'method:cuda@4' WHEN 6 THEN 'result@4' WHEN 7 THEN 'flow@4' ELSE CASE WHEN p_size % 4 = 3 THEN 'call:torch.rand@4' END END AS reason FROM code""",
    av.CODE_SQL,
)
def c1_train_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Functions of which most have a fault: syntax, imports, module, arguments, banned calls and methods, result, flow."""
    kind, text = F.col("p_size") % 9, F.col("pytorch_code")
    changes = [(r"\n$", "(\n"), ("^import torch", "import torch as t"), (r"\n$", "\nx = 1\n"), (r"\(x\):", "():"), (r"\(x\):", "(x, *y):"), (r"\n$", ".cuda()\n"), (r"\n$", ", x\n"), (r"    return (.*)\n$", "    if x: return $1\n")]
    for i, (old, new) in enumerate(changes):
        text = F.when(kind == i, F.regexp_replace("pytorch_code", old, new)).otherwise(text)
    return av.code(spark, sf).select("seq", code.guard_train(text).alias("reason"))


@query(
    """SELECT seq, CASE WHEN p_size % 5 = 4 THEN 'import:os@1' WHEN p_size % 5 = 0 THEN 'operator:Add@4' WHEN p_size % 4 = 3 THEN 'call:torch.rand@4' WHEN p_size % 5 = 3 THEN 'inputs:1/2@3' WHEN p_size % 5 = 1 THEN 'count:1/2'
    WHEN p_size % 4 <> 0 THEN 'order:' || CASE p_size % 4 WHEN 1 THEN 'torch.tanh' ELSE 'torch.exp' END || ',torch.tanh' END AS reason FROM code""",
    av.CODE_SQL,
)
def c2_spec_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Functions of one or two operations, some with an operator, another import or a wrong number of inputs."""
    size, text = F.col("p_size"), F.col("pytorch_code")
    text = F.when(size % 5 == 4, F.regexp_replace(text, "^import torch", "import os")).when(size % 5 == 0, F.regexp_replace(text, r"\(x\)\n$", "(x + x)\n")).when(size % 5 == 2, F.regexp_replace(text, r"return (.*)\n", "return torch.tanh($1)\n")).otherwise(text)
    reason = code.guard_spec(text, F.lit("chain_2_unary"), F.array(F.lit("torch.relu"), F.lit("torch.tanh")), F.when((size % 5 == 3) & (size % 4 != 3), 2).otherwise(1))
    return av.code(spark, sf).select("seq", reason.alias("reason"))


@query("SELECT seq, CASE p_size % 4 WHEN 0 THEN 'torch.relu' WHEN 1 THEN 'torch.tanh' WHEN 2 THEN 'torch.exp' ELSE '' END AS ops FROM code", av.CODE_SQL)
def c3_operations(spark: SparkSession, sf: str) -> DataFrame:
    return av.code(spark, sf).select("seq", F.array_join(code.ops_of("pytorch_code"), ",").alias("ops"))


@query("SELECT seq, CASE p_size % 5 WHEN 3 THEN 'a ```b``` c' WHEN 4 THEN '' ELSE regexp_replace(pytorch_code, '\\s+$', '') END AS body FROM code", av.CODE_SQL)
def c4_strip_fences(spark: SparkSession, sf: str) -> DataFrame:
    """Fences with a language and without, one that never ends, a fence inside a text, and an empty one."""
    kind, bare = F.col("p_size") % 5, F.regexp_replace("pytorch_code", r"\s+$", "")
    around = F.when(kind == 0, F.concat(F.lit("  ```python\n"), "pytorch_code", F.lit("```\n"))).when(kind == 1, F.concat(F.lit("```\n"), bare, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("```py\n"), bare)).when(kind == 3, "a ```b``` c ").otherwise("```\n```")
    return av.code(spark, sf).select("seq", classify.strip_fences(around).alias("body"))


@query(
    """SELECT seq, CASE WHEN p_size % 5 = 0 THEN 'unrealizable' WHEN p_size % 5 = 1 THEN 'parse_error' ELSE 'code' END AS status,
    CASE WHEN p_size % 5 > 1 THEN regexp_replace(pytorch_code, '\\s+$', '') END AS code, CASE WHEN p_size % 5 = 0 THEN 'no' WHEN p_size % 5 = 1 THEN 'nothing_found' END AS detail FROM code""",
    av.CODE_SQL,
)
def c5_parse_response(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size") % 5
    answer = F.when(size == 0, 'sorry: {"error": "no"}').when(size == 1, "nothing").otherwise(F.concat(F.lit("Here:\n```py\n"), "pytorch_code", F.lit("```")))
    return av.code(spark, sf).select("seq", classify.parse_response(answer).alias("r")).select("seq", "r.*")


@query("SELECT CASE WHEN event_id % 3 = 0 THEN 'empty' WHEN event_id % 3 = 1 THEN 'not_json' ELSE 'ok' END AS status, count(*) AS n FROM events GROUP BY 1")
def c6_structured_response(spark: SparkSession, sf: str) -> DataFrame:
    third = F.col("event_id") % 3
    answer = F.when(third == 0, "").when(third == 1, F.concat(F.lit("oops "), "props")).otherwise(F.col("props"))
    return table(spark, sf, "events").select(classify.structured_response(answer, "k int", ["k"])["status"].alias("status")).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT event_id, CAST(json_extract_string(props,'$.k') AS BIGINT) + 1 AS input_tokens, user_id AS output_tokens FROM events")
def c7_token_usage(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    turn = lambda a, b: F.format_string('{"type":"turn.completed","usage":{"input_tokens":%d,"output_tokens":%d}}', a, b)
    log = F.concat_ws("\n", F.lit('{"type":"start"}'), turn(k, F.lit(1).cast("bigint")), turn(k + 1, F.col("user_id")), F.lit("done"))
    return table(spark, sf, "events").select("event_id", classify.last_usage(log).alias("u")).select("event_id", "u.*")


@query("SELECT count(*) FILTER (contains(lower(text), 'quota') OR contains(text, '429') OR contains(lower(text), 'rate limit') OR contains(lower(text), 'rate_limit') OR contains(lower(text), 'too many requests')) AS n_limited, count(*) AS n FROM documents")
def c8_rate_limits(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").agg(F.count_if(classify.is_rate_limited(F.col("text"))).alias("n_limited"), F.count("*").alias("n"))


@query("SELECT concat('f', CAST(seq AS VARCHAR)) AS function_name, count(*) AS n FROM code WHERE p_size % 2 = 0 GROUP BY 1", av.CODE_SQL)
def c9_jit_functions(spark: SparkSession, sf: str) -> DataFrame:
    text = F.regexp_replace("pytorch_code", "def ", "@triton.jit\ndef ")
    files = av.code(spark, sf).select(F.col("seq").cast("string").alias("file_path"), F.when(F.col("p_size") % 2 == 0, text).otherwise(F.col("pytorch_code")).alias("text"))
    return code.extract_functions(files).groupBy("function_name").agg(F.count("*").alias("n"))


def _first_match_sql(blob: str, rules: list, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'contains({blob}, {w!r})' for w in words)} THEN '{label}'" for label, words in rules) + f" ELSE '{default}' END"


@query(f"SELECT op_category, count(*) AS n FROM (SELECT {_first_match_sql('lower(text)', classify.CATEGORY_RULES, 'elementwise_chain')} AS op_category FROM documents) GROUP BY 1")
def c10_op_categories(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(classify.op_category(F.lower("text")).alias("op_category")).groupBy("op_category").agg(F.count("*").alias("n"))


@query(
    f"""SELECT shape_rank, reduction_axis, memory_pattern, fusion_shape, count(*) AS n FROM (SELECT {_first_match_sql('t', classify.RANK_RULES, '2D')} AS shape_rank,
    CASE WHEN {' OR '.join(f"contains(t, '{w}')" for w in classify.REDUCTION_WORDS)} THEN {_first_match_sql('t', classify.REDUCTION_RULES, 'none')} ELSE 'none' END AS reduction_axis,
    {_first_match_sql('t', classify.MEMORY_RULES, 'contiguous')} AS memory_pattern,
    CASE WHEN {_first_match_sql('t', classify.FUSION_RULES, '')} <> '' THEN {_first_match_sql('t', classify.FUSION_RULES, '')} WHEN m >= 3 THEN 'triplet' WHEN m >= 2 THEN 'pair' ELSE 'single_op' END AS fusion_shape
    FROM (SELECT lower(text) AS t, {' + '.join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in classify.FUSION_MARKS)} AS m FROM documents)) GROUP BY ALL"""
)
def c11_axes(spark: SparkSession, sf: str) -> DataFrame:
    names = ["shape_rank", "reduction_axis", "memory_pattern", "fusion_shape"]
    axes = classify.axes(F.lower("text"))
    return table(spark, sf, "documents").select(*[axes[n].alias(n) for n in names]).groupBy(*names).agg(F.count("*").alias("n"))


# A text and its symptom; the first rule that fits counts.
_SYMPTOMS = [
    ("GPU task Timed out", "timeout"), ("CUDA error: an Illegal Memory Access", "cuda_illegal_memory_access"), ("Unsupported ptr type", "unsupported_ptr_type"), ("Incompatible dimensions at 0", "incompatible_block_shape"), ("arange bound must be Constexpr", "non_constexpr_arange_bound"),
    ("NameError: x", "undefined_symbol"), ("y is not defined", "undefined_symbol"), ("UnsupportedLanguageConstruct at 3", "unsupported_language_construct"), ("missing 1 required argument", "launch_signature_mismatch"), ("module 'triton.language' has no attribute z", "invalid_triton_api"),
    ("unexpected output type", "invalid_output_type"), ("The size of tensor a (3) must match 4", "host_shape_error"), ("CompilationError: at 1", "triton_compilation_error"), ("at 1: CompilationError", "python_runtime_error"), ("ReadTimeout: did not respond", "python_runtime_error"), ("timed out: illegal memory access", "timeout"), ("", None),
]
_SYMPTOM_CASES = " ".join(f"WHEN {i} THEN {'NULL' if x is None else repr(x)}" for i, (_, x) in enumerate(_SYMPTOMS))


@query(f"SELECT seq, CASE k % {len(_SYMPTOMS)} {_SYMPTOM_CASES} END AS symptom FROM eval_rows", av.EVAL_SQL)
def c12_failure_symptoms(spark: SparkSession, sf: str) -> DataFrame:
    text = F.element_at(F.array(*[F.lit(t) for t, _ in _SYMPTOMS]), (F.col("k") % len(_SYMPTOMS) + 1).cast("int"))
    return av.eval_rows(spark, sf).select("seq", classify.failure_symptom(text).alias("symptom"))


@query("SELECT event_id, k >= 50 AS accept, CASE WHEN k < 10 THEN 'harness:boom' WHEN k < 30 THEN 'failed' WHEN k < 50 THEN 'no_timings' END AS reason FROM ev", av.EVAL_SQL)
def c13_preflight_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    e, k, none = av.eval_rows(spark, sf), F.col("k"), F.lit(None).cast("double")
    verdict = classify.preflight_verdict(k >= 30, F.when(k < 10, "boom"), none, none, none, F.when(k >= 50, 1.0), F.when(k >= 40, 1.0))
    return e.select(F.col("seq").alias("event_id"), verdict.alias("v")).select("event_id", "v.*")


# --- joins, dedup, resume --------------------------------------------------------------------------


@query("SELECT code_sha, min(seq) AS seq, count(*) - 1 AS n_skipped FROM corpus GROUP BY 1", av.CORPUS_SQL)
def j1_merge_corpora(spark: SparkSession, sf: str) -> DataFrame:
    c = av.corpus(spark, sf).select("seq", "code_sha")
    kept, skipped = records.merge([c.where("seq < 1000000000"), c.where("seq >= 1000000000")], "code_sha")
    lost = skipped.groupBy(F.col("code_sha").alias("s")).agg(F.count("*").alias("c"))
    return kept.join(lost, F.col("code_sha") == F.col("s"), "left").select("code_sha", "seq", F.coalesce("c", F.lit(0)).alias("n_skipped"))


@query("SELECT example_id, min(seq) AS seq, count(*) - 1 AS variants FROM eval_rows GROUP BY 1", av.EVAL_SQL)
def j2_collapse_variants(spark: SparkSession, sf: str) -> DataFrame:
    return records.collapse_variants(av.eval_rows(spark, sf).select("seq", "example_id"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def j3_resume(spark: SparkSession, sf: str) -> DataFrame:
    done = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return records.resume(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), done, "o_custkey")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 10) AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY 1")
def j4_resume_either_key(spark: SparkSession, sf: str) -> DataFrame:
    done = table(spark, sf, "part").where("p_size < 10").select(F.col("p_partkey").alias("l_partkey"), F.lit(None).cast("bigint").alias("l_suppkey"))
    done = done.union(table(spark, sf, "supplier").where("s_acctbal < 0").select(F.lit(None).cast("bigint"), "s_suppkey"))
    return records.resume_any(table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey"), done, ("l_partkey", "l_suppkey")).groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT spec_id FROM (SELECT CAST(p_partkey AS VARCHAR) AS spec_id FROM part WHERE p_size < 20 UNION ALL SELECT CAST(s_suppkey AS VARCHAR) FROM supplier)")
def j5_processed_ids(spark: SparkSession, sf: str) -> DataFrame:
    top = table(spark, sf, "part").where("p_size < 20").select(F.col("p_partkey").cast("string").alias("spec_id"))
    nested = table(spark, sf, "supplier").select(F.struct(F.col("s_suppkey").cast("string").alias("spec_id")).alias("spec"))
    return records.processed_ids([top, nested])


@query("SELECT seq, CASE WHEN code_sha IN (SELECT sha256(text) FROM benchmark) THEN 'identical_code' WHEN seq IN (SELECT item_id FROM benchmark) THEN 'identical_id' END AS leak FROM corpus", av.CORPUS_SQL)
def j6_contamination(spark: SparkSession, sf: str) -> DataFrame:
    held = av.holdout(spark, sf).withColumnRenamed("item_id", "seq")
    return records.contamination(av.corpus(spark, sf), held, key="seq").select("seq", "leak")


@query("SELECT seq, p_size % 4 IN (SELECT p_size % 4 FROM part WHERE p_size % 4 <> 1) AS in_corpus FROM code", av.CODE_SQL)
def j7_canonical_contamination(spark: SparkSession, sf: str) -> DataFrame:
    rows = av.code(spark, sf).withColumn("canonical_sha", code.canonical("pytorch_code"))
    return records.canonical_contamination(rows, rows.where("p_size % 4 <> 1")).select("seq", "in_corpus")


@query("SELECT seq, p_size % 4 IN (SELECT p_size % 4 FROM part WHERE p_size % 2 = 0) AS in_corpus FROM code", av.CODE_SQL)
def j7_canonical_contamination_all(spark: SparkSession, sf: str) -> DataFrame:
    rows = av.code(spark, sf).withColumn("canonical_sha", code.canonical("pytorch_code"))
    return records.canonical_contamination(rows, rows.where("p_size % 2 = 0")).select("seq", "in_corpus")


@query("SELECT seq, CASE WHEN seq > min(seq) OVER (PARTITION BY code_sha) THEN substr(code_sha, 1, 12) END AS duplicate_of FROM corpus", av.CORPUS_SQL)
def j8_self_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return records.self_dedup(av.corpus(spark, sf), "code_sha").select("seq", "duplicate_of")


@query(
    """SELECT coalesce(stage, 'accepted') AS stage, count(*) AS n FROM (SELECT CASE WHEN length(pytorch_code) < 200 THEN 'parse' WHEN op_category <> 'en' THEN 'ast' WHEN seq > first THEN 'dedup' END AS stage FROM
    (SELECT *, min(seq) FILTER (length(pytorch_code) >= 200 AND op_category = 'en') OVER (PARTITION BY code_sha) AS first FROM corpus)) GROUP BY 1""",
    av.CORPUS_SQL,
)
def j9_stage_cascade(spark: SparkSession, sf: str) -> DataFrame:
    parse, ast = F.when(F.char_length("pytorch_code") < 200, "short"), F.when(F.col("op_category") != "en", "language")
    rows = av.corpus(spark, sf).withColumns({"parse": parse, "ast": ast})
    good = records.self_dedup(rows.where("parse is null and ast is null"), "code_sha").select(F.col("seq").alias("s"), "duplicate_of")
    staged = records.cascade(rows.join(good, F.col("seq") == F.col("s"), "left"), {"parse": F.col("parse"), "ast": F.col("ast"), "dedup": F.col("duplicate_of")})
    return d.stage_counts(staged).select("stage", "n")


@query(
    """SELECT o_orderpriority AS op_category, CAST(o_orderkey AS VARCHAR) AS example_id FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, CAST(o_orderkey AS VARCHAR)) AS n FROM orders WHERE o_orderkey % 10 > 0)
    JOIN (SELECT o_orderpriority AS p, count(*) AS have FROM orders WHERE o_orderkey % 10 = 0 GROUP BY 1) ON p = o_orderpriority WHERE n + have <= 400"""
)
def j10_category_cap(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("op_category"), F.col("o_orderkey").cast("string").alias("example_id"), F.col("o_orderdate").alias("seq"), "o_orderkey")
    return records.cap(o.where("o_orderkey % 10 > 0"), o.where("o_orderkey % 10 = 0"), 400).select("op_category", "example_id")


@query(
    """SELECT o_orderpriority AS op_category, count(*) FILTER (o_orderkey % 10 > 0) AS n_rows, greatest(0, least(count(*) FILTER (o_orderkey % 10 > 0), 400 - count(*) FILTER (o_orderkey % 10 = 0))) AS n_kept,
    count(*) FILTER (o_orderkey % 10 > 0) - greatest(0, least(count(*) FILTER (o_orderkey % 10 > 0), 400 - count(*) FILTER (o_orderkey % 10 = 0))) AS n_skipped FROM orders GROUP BY 1"""
)
def j10_cap_skipped(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("op_category"), F.col("o_orderkey").cast("string").alias("example_id"), F.col("o_orderdate").alias("seq"), "o_orderkey")
    rows = o.where("o_orderkey % 10 > 0")
    return records.cap_skipped(rows, records.cap(rows, o.where("o_orderkey % 10 = 0"), 400))


@query("SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_unique, count(*) FILTER (n > 1) AS n_duplicated, CAST(sum(n - 1) AS BIGINT) AS n_surplus, (SELECT count(DISTINCT l_partkey) FROM lineitem) AS n_examples FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)")
def j11_dataset_index(spark: SparkSession, sf: str) -> DataFrame:
    return records.index(table(spark, sf, "lineitem").select("l_orderkey", "l_partkey"), "l_orderkey", "l_partkey")


@query("SELECT a.seq, a.example_id, b.seq AS b_seq, b.final_outcome AS b_final_outcome FROM eval_rows a JOIN last_rows b ON a.example_id = b.example_id WHERE a.model_label = 'click' AND b.model_label = 'view'", av.EVAL_SQL)
def j12_label_join(spark: SparkSession, sf: str) -> DataFrame:
    rows = av.eval_rows(spark, sf).select("seq", "example_id", "model_label", "final_outcome")
    side = lambda x: rows.where(F.col("model_label") == x).drop("model_label")
    return records.pair(side("click"), side("view")).select("seq", "example_id", "b_seq", "b_final_outcome")


@query("SELECT example_id FROM eval_rows GROUP BY 1 HAVING count(DISTINCT model_label) = 5", av.EVAL_SQL)
def j13_in_all_labels(spark: SparkSession, sf: str) -> DataFrame:
    return records.in_all(av.eval_rows(spark, sf), 5)


@query("SELECT p_partkey, policy, CASE WHEN policy IN ('default_fp32') THEN 1e-5 WHEN policy IN ('default_fp16') THEN 1e-3 ELSE 0 END AS atol, CASE WHEN policy = 'exact_integer' THEN 'exact' ELSE 'numeric' END AS mode FROM (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'default_fp32' WHEN 1 THEN 'default_fp16' ELSE 'exact_integer' END AS policy FROM part)")
def j14_tolerance_lookup(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size") % 3
    rows = table(spark, sf, "part").select("p_partkey", F.when(size == 0, "default_fp32").when(size == 1, "default_fp16").otherwise("exact_integer").alias("policy"))
    return rows.join(F.broadcast(vocab.tolerance_table(spark)), "policy").select("p_partkey", "policy", "atol", "mode")


@query("SELECT p_partkey FROM part WHERE p_type IN ('SMALL', 'LARGE')")
def j15_category_filter(spark: SparkSession, sf: str) -> DataFrame:
    names = records.allowed_categories(["matmul, loss"])
    shown = F.when(F.col("p_type") == "SMALL", "matmul").when(F.col("p_type") == "LARGE", "loss").otherwise("other")
    return table(spark, sf, "part").where(shown.isin(names)).select("p_partkey")


@query("SELECT o_orderkey, 'after' AS placed FROM (SELECT o_orderkey FROM orders WHERE o_custkey % 3 > 0 ORDER BY o_orderkey LIMIT 50) UNION ALL SELECT o_orderkey, 'before' FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 50) WHERE o_custkey % 3 > 0")
def j16_limit_placement(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    done = o.where("o_custkey % 3 = 0").select("o_orderkey").distinct()
    one = lambda before: records.limited(o, done, 50, before, "o_orderkey", "o_orderkey").select("o_orderkey", F.lit("before" if before else "after").alias("placed"))
    return one(False).union(one(True))


@query("SELECT DISTINCT l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE (l_partkey, l_suppkey, l_linenumber) NOT IN (SELECT l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE l_quantity < 5)")
def j17_incremental_discovery(spark: SparkSession, sf: str) -> DataFrame:
    keys = ("l_partkey", "l_suppkey", "l_linenumber")
    rows = table(spark, sf, "lineitem").select(*keys, "l_quantity")
    return records.discovered(rows, rows.where("l_quantity < 5").select(*keys), keys).select(*keys)


@query("SELECT (SELECT count(*) FROM (SELECT c_custkey FROM customer UNION SELECT o_custkey FROM orders)) AS n_union, (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) AS n_only, (SELECT count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)) AS n_both")
def j18_seen_sets(spark: SparkSession, sf: str) -> DataFrame:
    c, o = table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    sides = c.distinct().withColumn("c", F.lit(1)).join(o.distinct().withColumn("o", F.lit(1)), "k", "full")
    return sides.agg(F.count("*").alias("n_union"), F.count_if(F.col("o").isNull()).alias("n_only"), F.count_if(F.col("o").isNotNull() & F.col("c").isNotNull()).alias("n_both"))


_RANK_SQL = "CASE final_outcome WHEN 'compiled_correct' THEN 1 WHEN 'numeric_fail' THEN 2 WHEN 'runtime_fail' THEN 3 ELSE 4 END"


@query(f"SELECT example_id, final_outcome, n_attempts, CAST(dataset_id AS BIGINT) AS seq FROM outcome QUALIFY row_number() OVER (PARTITION BY example_id ORDER BY {_RANK_SQL}, n_attempts DESC, CAST(dataset_id AS BIGINT)) = 1", av.ATTEMPT_SQL)
def j19_best_per_source(spark: SparkSession, sf: str) -> DataFrame:
    return records.best_per_source(_outcomes(spark, sf).select("example_id", "final_outcome", "n_attempts", F.col("dataset_id").cast("bigint").alias("seq")))


@query("SELECT p_partkey, CAST(row_number() OVER (ORDER BY sha256('11' || CAST(p_partkey AS VARCHAR)), p_partkey) AS BIGINT) AS place FROM part")
def j20_seeded_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    return records.shuffle_places(table(spark, sf, "part").select("p_partkey"), "11", "p_partkey")


@query("SELECT p_partkey, CAST(row_number() OVER (ORDER BY sha256('7' || CAST(p_partkey AS VARCHAR)), p_partkey) AS BIGINT) AS place FROM part")
def j20_seeded_shuffle_all(spark: SparkSession, sf: str) -> DataFrame:
    return records.shuffle_places(table(spark, sf, "part").select("p_partkey"), "7", "p_partkey")


@query("SELECT a.example_id, a.s AS seq_a, b.s AS seq_b FROM (SELECT example_id, min(seq) AS s FROM eval_rows WHERE model_label = 'click' GROUP BY 1) a JOIN (SELECT example_id, min(seq) AS s FROM eval_rows WHERE model_label = 'error' GROUP BY 1) b USING (example_id)", av.EVAL_SQL)
def j21_aligned_ids(spark: SparkSession, sf: str) -> DataFrame:
    rows = av.eval_rows(spark, sf).select("model_label", "example_id", "seq")
    a, b = records.aligned(rows.where("model_label = 'click'"), rows.where("model_label = 'error'"))
    return a.select("example_id", F.col("seq").alias("seq_a")).join(b.select("example_id", F.col("seq").alias("seq_b")), "example_id")


@query("SELECT 'corpus' AS output, count(*) FILTER (code_sha IN (SELECT sha256(text) FROM benchmark) OR seq IN (SELECT item_id FROM benchmark)) AS n_leaks FROM corpus", av.CORPUS_SQL)
def j22_leakage_audit(spark: SparkSession, sf: str) -> DataFrame:
    held = av.holdout(spark, sf).withColumnRenamed("item_id", "seq")
    return records.leaks({"corpus": av.corpus(spark, sf)}, held, key="seq")


# --- sampling and grids ----------------------------------------------------------------------------


@query(
    """SELECT c.op_category, a.axis, a.value, round(CASE WHEN t.n IS NULL THEN 1.0 / a.size ELSE coalesce(x.n, 0) * 1.0 / t.n END, 6) AS share FROM (SELECT unnest(['elementwise_chain','reduction','matmul','convolution','fused_attention','normalization','activation','loss','embedding','quantization','other']) AS op_category) c
    CROSS JOIN (SELECT 'shape_rank' AS axis, unnest(['1D','2D','3D','4D']) AS value, 4 AS size UNION ALL SELECT 'broadcast_pattern', unnest(['none','row','col','channel','batch']), 5) a
    LEFT JOIN (SELECT op_category, count(*) AS n FROM o GROUP BY 1) t USING (op_category)
    LEFT JOIN (SELECT op_category, 'shape_rank' AS axis, shape_rank AS value, count(*) AS n FROM o GROUP BY ALL UNION ALL SELECT op_category, 'broadcast_pattern', broadcast_pattern, count(*) FROM o GROUP BY ALL) x ON x.op_category = c.op_category AND x.axis = a.axis AND x.value = a.value""",
    av.OBSERVATION_SQL,
    "o AS (SELECT * REPLACE (CASE op_category WHEN 'SMALL' THEN 'matmul' WHEN 'LARGE' THEN 'loss' ELSE 'reduction' END AS op_category) FROM observations)",
)
def e1_axis_distributions(spark: SparkSession, sf: str) -> DataFrame:
    axes = {a: vocab.AXES[a] for a in ("shape_rank", "broadcast_pattern")}
    kind = F.when(F.col("op_category") == "SMALL", "matmul").when(F.col("op_category") == "LARGE", "loss").otherwise("reduction")
    return rounded(sampling.distributions(av.observations(spark, sf).withColumn("op_category", kind), axes).drop("ord"))


@query(
    """SELECT p, CAST(f + CASE WHEN row_number() OVER (ORDER BY raw - f DESC, p) <= 500 - sum(f) OVER () THEN 1 ELSE 0 END AS BIGINT) AS n FROM
    (SELECT p_type || p_brand AS p, count(*) * 500.0::DOUBLE / (SELECT count(*) FROM part) AS raw, floor(count(*) * 500.0::DOUBLE / (SELECT count(*) FROM part)) AS f FROM part GROUP BY 1)"""
)
def e2_scaled_quotas(spark: SparkSession, sf: str) -> DataFrame:
    weights = table(spark, sf, "part").groupBy(F.concat("p_type", "p_brand").alias("p")).agg(F.count("*").alias("quota")).withColumn("ord", F.col("p"))
    return sampling.scaled_quotas(weights, 500, "p").select("p", "n")


@query(
    """SELECT p_partkey, CASE WHEN (p_partkey % 1000) / 1000.0 * 10 <= 1 THEN 'a' WHEN (p_partkey % 1000) / 1000.0 * 10 <= 4 THEN 'b' ELSE 'c' END AS value FROM part"""
)
def e3_weighted_draw(spark: SparkSession, sf: str) -> DataFrame:
    weights = spark.createDataFrame([("x", 0, "a", 1.0), ("x", 1, "b", 3.0), ("x", 2, "c", 6.0)], "op_category string, ord int, value string, share double")
    rows = table(spark, sf, "part").select("p_partkey", F.lit("x").alias("op_category"), (F.col("p_partkey") % 1000 / 1000.0).alias("pivot"))
    return sampling.draw(rows, weights, ["op_category"], "pivot").select("p_partkey", "value")


@query(
    """SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN '2,3,4' WHEN 1 THEN '1,1,4' WHEN 2 THEN '2,1,1' WHEN 3 THEN '1,3,1' ELSE '1,3,4' END AS shape, CASE p_size % 2 WHEN 0 THEN 'float32,float16,float32' ELSE 'float16,float32,float16' END AS dtypes FROM part"""
)
def e4_shapes_and_dtypes(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "part").select("p_partkey", "p_size")
    size = F.col("p_size") % 5
    pattern = F.when(size == 0, "none").when(size == 1, "row").when(size == 2, "col").when(size == 3, "channel").otherwise("batch")
    shape = sampling.broadcast_shape(F.array(F.lit(2), F.lit(3), F.lit(4)), pattern)
    dtypes = sampling.input_dtypes(F.lit("mixed_fp32_fp16"), F.lit(3), F.col("p_size") % 2 / 1.0)
    return o.select("p_partkey", F.array_join(shape.cast("array<string>"), ",").alias("shape"), F.array_join(dtypes, ",").alias("dtypes"))


# Specs of each category for 1,000 in all.
_E5 = "(VALUES ('matmul', 120), ('fused_attention', 100), ('normalization', 100), ('reduction', 100), ('activation', 100), ('elementwise_chain', 100), ('embedding', 80), ('loss', 80), ('convolution', 80), ('quantization', 80), ('other', 60)) AS t(op_category, quota)"


@query(f"SELECT op_category, CAST(quota AS BIGINT) AS quota, CAST(quota AS BIGINT) AS n, false AS capped, CAST(quota AS BIGINT) AS n_ids, CASE op_category WHEN 'matmul' THEN (SELECT count(*) FROM part WHERE p_type = 'SMALL') WHEN 'loss' THEN (SELECT count(*) FROM part WHERE p_type = 'LARGE') WHEN 'reduction' THEN (SELECT count(*) FROM part WHERE p_type NOT IN ('SMALL', 'LARGE')) ELSE 0 END AS n_seen FROM {_E5}")
def e5_sampled_specs(spark: SparkSession, sf: str) -> DataFrame:
    """Specs to quota: as many different ids as the quota asks for in each category, beside the observations they were drawn from."""
    kind = F.when(F.col("op_category") == "SMALL", "matmul").when(F.col("op_category") == "LARGE", "loss").otherwise("reduction")
    rest = {a: F.lit(v[0]) for a, v in vocab.AXES.items() if a not in ("shape_rank", "broadcast_pattern")}
    seen = av.observations(spark, sf).withColumns({"op_category": kind, **rest})
    specs, report = sampling.sample_specs(seen, 1000, "7")
    made = specs.groupBy("op_category").agg(F.countDistinct("spec_id").alias("n_ids"))
    out = report.join(made, "op_category", "left").join(seen.groupBy("op_category").agg(F.count("*").alias("n_seen")), "op_category", "left")
    return out.select("op_category", F.col("quota").cast("bigint").alias("quota"), "n", "capped", "n_ids", F.coalesce("n_seen", F.lit(0)).alias("n_seen"))


# Cells of each form of the published grid, shapes with their metadata by two dtypes by the operations of each slot.
_FORM_SQL = """forms AS (SELECT * FROM (VALUES (0, 'chain_2_unary', 1152), (1, 'unary_then_residual', 96), (2, 'chain_3_unary', 6144), (3, 'unary_then_reduction', 2080), (4, 'softmax_then_unary', 256), (5, 'unary_then_norm', 48),
  (6, 'attention_qkv', 8), (7, 'fused_linear_norm_activation', 64), (8, 'gated_mlp_swiglu', 8), (9, 'chain_4_unary', 24576), (10, 'embedding_then_norm', 48)) AS t(ord, form, size))"""


@query("SELECT form, size AS n_cells, size AS n_distinct, count(*) AS asked FROM part JOIN forms ON ord = p_size % 11 GROUP BY ALL", _FORM_SQL)
def e6_design_grid(spark: SparkSession, sf: str) -> DataFrame:
    names = spark.createDataFrame(list(enumerate(vocab.FORMS)), "k int, form string")
    wanted = table(spark, sf, "part").groupBy((F.col("p_size") % 11).alias("k")).agg(F.count("*").alias("asked")).join(F.broadcast(names), "k").drop("k")
    cells = sampling.design_grid(spark).join(F.broadcast(wanted), "form")  # eleven forms at most
    return cells.groupBy("form").agg(F.count("*").cast("int").alias("n_cells"), F.countDistinct("cell").cast("int").alias("n_distinct"), F.first("asked").alias("asked"))


@query("SELECT form, count(*) AS n, least(count(*), CAST(min(size) AS BIGINT)) AS n_cells, CAST(min(ord) AS BIGINT) * 1000000 AS first_seed, CAST(min(ord) AS BIGINT) * 1000000 + count(*) - 1 AS last_seed FROM part JOIN forms ON ord = p_size % 11 GROUP BY 1", _FORM_SQL)
def e7_taken_cells(spark: SparkSession, sf: str) -> DataFrame:
    names = spark.createDataFrame(list(enumerate(vocab.FORMS)), "ord int, form string")
    targets = table(spark, sf, "part").groupBy((F.col("p_size") % 11).alias("ord")).agg(F.count("*").alias("n")).join(F.broadcast(names), "ord")
    cells = sampling.take_cells(sampling.design_grid(spark), targets, "7")
    return cells.groupBy("form").agg(F.count("*").alias("n"), F.countDistinct("cell").alias("n_cells"), F.min("rng_seed").alias("first_seed"), F.max("rng_seed").alias("last_seed"))


@query(
    """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN CASE WHEN p_partkey % 2 = 0 THEN '8,16' ELSE '8,1,16' END WHEN 1 THEN '8,4,32' WHEN 2 THEN '8,4,16,7' ELSE '8,4,16' END AS shape, CASE WHEN p_size % 4 = 0 THEN 'int64' WHEN p_size % 4 = 2 THEN 'float16' ELSE 'float32' END AS dtype FROM part"""
)
def e8_output_shapes(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size") % 4
    form = F.when(size == 0, "unary_then_reduction").when(size == 1, "gated_mlp_swiglu").when(size == 2, "embedding_then_norm").otherwise("chain_2_unary")
    weight = F.when(size == 2, F.array(F.lit(99), F.lit(7))).otherwise(F.array(F.lit(32), F.lit(16)))
    shapes = F.array(F.array(F.lit(8), F.lit(4), F.lit(16)), weight)
    meta = F.create_map(F.lit("reduce_dim"), F.lit("-2"), F.lit("keepdim"), F.when(F.col("p_partkey") % 2 == 0, "false").otherwise("true"))
    rows = table(spark, sf, "part").select("p_partkey", "p_size")
    dtype = sampling.output_dtype(form, F.array(F.lit("float32"), F.lit("float16")), F.array(F.lit("torch.relu"), F.lit("torch.argmax")))
    return rows.select("p_partkey", F.array_join(sampling.output_shape(form, shapes, meta).cast("array<string>"), ",").alias("shape"), dtype.alias("dtype"))


@query("SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS spec_id FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def e9_append_specs(spark: SparkSession, sf: str) -> DataFrame:
    new = table(spark, sf, "lineitem").select(F.col("l_partkey").cast("string").alias("spec_id"))
    have = table(spark, sf, "part").where("p_size > 25").select(F.col("p_partkey").cast("string").alias("spec_id"))
    return sampling.append_specs(have, new)


@query("SELECT p_type AS op_category, CAST(330 AS BIGINT) AS quota, count(*) AS got, CAST(greatest(330 - count(*), 0) AS BIGINT) AS missing FROM part GROUP BY 1")
def e10_quota_fulfilment(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select(F.col("p_type").alias("op_category"))
    return sampling.fulfilment(rows, rows.distinct().withColumn("n", F.lit(330)))


@query(
    """SELECT p_partkey, '  - arg 0: shape [' || CAST(p_size AS VARCHAR) || ', 8], dtype float32' || chr(10) || '  - arg 1: shape [4], dtype int8' AS inputs, '1. torch.relu' || chr(10) || '2. torch.' || lower(p_type) AS ops FROM part"""
)
def e11_spec_prompts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select("p_partkey", F.array(F.array(F.col("p_size"), F.lit(8)), F.array(F.lit(4))).alias("shapes"), F.array(F.lit("float32"), F.lit("int8")).alias("dtypes"), F.array(F.lit("torch.relu"), F.concat(F.lit("torch."), F.lower("p_type"))).alias("names"))
    return rows.select("p_partkey", sampling.input_lines("shapes", "dtypes").alias("inputs"), sampling.numbered_ops("names").alias("ops"))


# --- comparisons and attempts ----------------------------------------------------------------------


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'exact_integer' WHEN p_size % 3 = 1 THEN CASE p_type WHEN 'SMALL' THEN 'reduction_fp16' WHEN 'LARGE' THEN 'attention_softmax_fp16' ELSE 'default_fp16' END ELSE CASE p_type WHEN 'SMALL' THEN 'reduction_fp32' ELSE 'default_fp32' END END AS policy FROM part")
def t1_policy_of_inputs(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size") % 3
    dtypes = F.when(size == 0, F.array(F.lit("int8"), F.lit("bool"))).when(size == 1, F.array(F.lit("float32"), F.lit("bfloat16"))).otherwise(F.array(F.lit("float32"), F.lit("int8")))
    kind = F.when(F.col("p_type") == "SMALL", "reduction").when(F.col("p_type") == "LARGE", "fused_attention").otherwise("matmul")
    return table(spark, sf, "part").select("p_partkey", classify.policy_of_inputs(kind, dtypes).alias("policy"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'exact_integer' WHEN 1 THEN 'attention_softmax_fp16' ELSE 'default_fp32' END AS policy FROM part")
def t2_policy_of_form(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size") % 3
    form = F.when(size == 0, "unary_then_reduction").when(size == 1, "attention_qkv").otherwise("softmax_then_unary")
    return table(spark, sf, "part").select("p_partkey", classify.policy_of_form(form, F.when(size == 0, "int64").when(size == 1, "float16").otherwise("float32")).alias("policy"))


@query(
    """SELECT task_id, round(max(abs(candidate - reference)), 6) AS max_abs_diff, round(max(abs(candidate - reference) / greatest(abs(reference), 1e-8)), 3) AS max_rel_diff, round(avg(abs(candidate - reference)), 6) AS mean_abs_diff,
    count(*) FILTER (abs(candidate - reference) > 0.1 + 0.1 * abs(reference)) AS n_elements_exceeding_tol, round(100.0 * count(*) FILTER (abs(candidate - reference) > 0.1 + 0.1 * abs(reference)) / count(*), 6) AS pct_elements_exceeding_tol,
    count(*) FILTER (abs(candidate - reference) > 0.1 + 0.1 * abs(reference)) = 0 AS passed FROM pairs GROUP BY 1""",
    av.ELEMENT_SQL,
)
def t3_element_comparison(spark: SparkSession, sf: str) -> DataFrame:
    policy = spark.createDataFrame([("loose", 0.1, 0.1, "numeric")], "policy string, atol double, rtol double, mode string")
    out = att.compare_elements(av.element_pairs(spark, sf).withColumn("policy", F.lit("loose")), policy)
    return rounded(rounded(out, "max_abs_diff", "mean_abs_diff", "pct_elements_exceeding_tol"), "max_rel_diff", places=3)


@query("SELECT task_id, CASE WHEN max(abs(candidate - reference)) <= 0.5 AND max(abs(candidate - reference)) <= 0.4 THEN 'passed' ELSE 'failed' END AS status FROM pairs GROUP BY 1", av.ELEMENT_SQL)
def t4_status(spark: SparkSession, sf: str) -> DataFrame:
    policies = spark.createDataFrame([("a", 0.5, 0.0, "numeric"), ("b", 0.4, 0.0, "numeric")], "policy string, atol double, rtol double, mode string")
    one = lambda p: att.compare_elements(av.element_pairs(spark, sf).withColumn("policy", F.lit(p)), policies).select("task_id", F.col("passed").alias(p))
    return one("a").join(one("b"), "task_id").select("task_id", att.status_of(F.col("a"), F.col("b")).alias("status"))


@query(
    """SELECT vec_id, round(median(abs(v) + 1), 6) AS triton_ms, round(stddev_samp(abs(v) + 1), 6) AS triton_std_ms, round(median(abs(v) + 2), 6) AS eager_ms, round(stddev_samp(abs(v) + 2), 6) AS eager_std_ms,
    round(median(abs(v) + 3), 6) AS inductor_ms, round(stddev_samp(abs(v) + 3), 6) AS inductor_std_ms, round(median(abs(v) + 2) / median(abs(v) + 1), 6) AS speedup_vs_eager, round(median(abs(v) + 3) / median(abs(v) + 1), 6) AS speedup_vs_inductor FROM e GROUP BY 1""",
    av.ELEMENT_SQL,
)
def t5_benchmark_summary(spark: SparkSession, sf: str) -> DataFrame:
    plus = lambda n: F.transform("embedding", lambda v: F.abs(v.cast("double")) + n)
    rows = table(spark, sf, "embeddings").select("vec_id", *[plus(i).alias(f"{s}_samples_ms") for i, s in enumerate(("triton", "eager", "inductor"), 1)])
    return rounded(att.benchmark_summary(rows, "vec_id"))


def _outcomes(spark: SparkSession, sf: str) -> DataFrame:
    a = av.attempts(spark, sf)
    who = a.groupBy("dataset_id").agg(F.min("example_id").alias("example_id"), F.min("op_category").alias("op_category"))
    return att.outcomes(a).join(who, "dataset_id")


@query("SELECT dataset_id, final_outcome, n_attempts FROM outcome", av.ATTEMPT_SQL)
def o1_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return att.outcomes(av.attempts(spark, sf))


@query("SELECT dataset_id, attempt_n, coalesce(correctness_status = 'passed' AND attempt_n <> 1, false) AS passed, CASE WHEN correctness_status IS NULL THEN coalesce(run_error, 'correctness stats missing') END AS error FROM attempts", av.ATTEMPT_SQL)
def o2_passes_and_errors(spark: SparkSession, sf: str) -> DataFrame:
    eager, inductor = F.when(F.col("correctness_status").isNotNull(), 1.0), F.when(F.col("correctness_status").isNotNull() & (F.col("attempt_n") != 1), 1.0)
    rows = av.attempts(spark, sf)
    return rows.select("dataset_id", "attempt_n", att.attempt_passed(F.col("correctness_status"), eager, inductor).alias("passed"), att.run_error(eager, eager, F.col("run_error")).alias("error"))


@query("SELECT dataset_id, attempt_n, correctness_status AS status, CASE WHEN correctness_status IS NOT NULL THEN CASE WHEN attempt_n = 0 THEN 'own' ELSE 'default_fp32' END END AS tolerance_policy_used FROM attempts", av.ATTEMPT_SQL)
def o4_compact_correctness(spark: SparkSession, sf: str) -> DataFrame:
    compact = att.compact_correctness(F.col("correctness_status"), F.when(F.col("attempt_n") == 0, "own"), F.lit("default_fp32"))
    return av.attempts(spark, sf).select("dataset_id", "attempt_n", compact.alias("c")).select("dataset_id", "attempt_n", "c.*")


@query("SELECT CASE WHEN compile_status = 'failed' THEN 'triton_compilation_error' WHEN correctness_status = 'failed' THEN 'numeric_mismatch' WHEN correctness_status IS NULL THEN 'python_runtime_error' END AS symptom, count(*) AS n FROM attempts GROUP BY 1", av.ATTEMPT_SQL)
def o5_symptoms(spark: SparkSession, sf: str) -> DataFrame:
    s = att.symptom(F.col("compile_status"), F.lit("CompilationError: x"), F.col("correctness_status"), F.col("run_error"))
    return av.attempts(spark, sf).select(s.alias("symptom")).groupBy("symptom").agg(F.count("*").alias("n"))


@query("SELECT dataset_id, attempt_n, correctness_status FROM all_attempts a WHERE attempt_n < 3 AND NOT EXISTS (SELECT 1 FROM all_attempts b WHERE b.dataset_id = a.dataset_id AND b.attempt_n < a.attempt_n AND b.correctness_status = 'passed')", av.ATTEMPT_SQL)
def o6_truncated_attempts(spark: SparkSession, sf: str) -> DataFrame:
    return att.truncate(av.attempts(spark, sf, None)).select("dataset_id", "attempt_n", "correctness_status")


@query(
    """SELECT dataset_id, attempt_n, lag(compile_status) OVER (PARTITION BY dataset_id ORDER BY attempt_n) AS prior_advice_applied, CASE WHEN attempt_n = 0 THEN NULL WHEN coalesce(correctness_status, 'none') = coalesce(lag(correctness_status) OVER (PARTITION BY dataset_id ORDER BY attempt_n), 'none') THEN false ELSE true END AS changed FROM attempts""",
    av.ATTEMPT_SQL,
)
def o7_prior_and_patch(spark: SparkSession, sf: str) -> DataFrame:
    rows = av.attempts(spark, sf).withColumns({"judge_fix_suggestion": F.col("compile_status"), "triton_code": F.coalesce("correctness_status", F.lit("none"))})
    return att.with_prior(rows).select("dataset_id", "attempt_n", "prior_advice_applied", (F.col("patch_from_previous") != "").alias("changed"))


@query("SELECT dataset_id, count(*) AS n, string_agg(coalesce(correctness_status, '-'), ',' ORDER BY attempt_n) AS statuses, min(op_category) AS op_category FROM attempts GROUP BY 1", av.ATTEMPT_SQL)
def o9_assembled_rows(spark: SparkSession, sf: str) -> DataFrame:
    a = av.attempts(spark, sf)
    rows = att.assemble(a.select("dataset_id", "attempt_n", "correctness_status"), a.groupBy("dataset_id").agg(F.min("op_category").alias("op_category")))
    return rows.select("dataset_id", F.size("attempts").cast("bigint").alias("n"), F.array_join(F.transform("attempts", lambda x: F.coalesce(x["correctness_status"], F.lit("-"))), ",").alias("statuses"), "source.op_category")


@query("SELECT dataset_id, attempt_n, compile_status FROM attempts", av.ATTEMPT_SQL)
def o10_flattened(spark: SparkSession, sf: str) -> DataFrame:
    return att.flatten(av.dataset_rows(spark, sf)).select("dataset_id", "attempt_n", F.col("compile.status").alias("compile_status"))


@query("SELECT seq, final_outcome FROM eval_rows", av.EVAL_SQL)
def o11_eval_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    outcome = att.eval_outcome(F.when(k < 5, "failed").otherwise("success"), F.when((k >= 5) & (k < 10), "err"), F.when(k >= 15, "passed").when(k >= 10, "failed"), F.col("speedup_vs_inductor"))
    return av.eval_rows(spark, sf).select("seq", outcome.alias("final_outcome"))


@query("SELECT dataset_id, w AS final_winning_attempt_n, w AS attempt_n FROM (SELECT dataset_id, min(attempt_n) FILTER (correctness_status = 'passed') AS w FROM attempts GROUP BY 1)", av.ATTEMPT_SQL)
def o12_winning_attempts(spark: SparkSession, sf: str) -> DataFrame:
    won = F.filter("attempts", lambda a: F.coalesce(a["correctness"]["status"] == "passed", F.lit(False)))
    rows = av.dataset_rows(spark, sf).withColumn("final_winning_attempt_n", F.get(won, F.lit(0))["attempt_n"])
    return rows.select("dataset_id", "final_winning_attempt_n", att.winning_attempt()["attempt_n"].alias("attempt_n"))


# --- training files --------------------------------------------------------------------------------

_PROMPT = "'Translate the following PyTorch function to a Triton kernel.' || chr(10) || chr(10) || 'PyTorch function:' || chr(10) || 'src-' || dataset_id || chr(10) || chr(10) || 'Input shapes: [32, 1024]' || chr(10) || 'Input dtypes: float32' || chr(10) || chr(10) || 'Output only the Python code.' || chr(10)"
_BOTH = "(SELECT dataset_id, min(example_id) AS example_id, min(attempt_n) FILTER (correctness_status = 'passed') AS w, min(attempt_n) FILTER (correctness_status IS NULL OR correctness_status <> 'passed') AS l FROM attempts GROUP BY 1)"


def _val(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").where("c_custkey % 10 = 0").select(F.col("c_custkey").cast("string").alias("example_id"))


@query(f"SELECT dataset_id, {_PROMPT} AS prompt, 'code-' || dataset_id || '-' || CAST(w AS VARCHAR) AS answer FROM {_BOTH} WHERE w IS NOT NULL AND CAST(example_id AS BIGINT) % 10 <> 0", av.ATTEMPT_SQL)
def f1_sft_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = training.sft(av.dataset_rows(spark, sf), _val(spark, sf), "You write kernels.")
    return rows.select("dataset_id", F.col("messages")[1]["content"].alias("prompt"), F.col("messages")[2]["content"].alias("answer"))


@query(f"SELECT dataset_id, {_PROMPT} AS prompt, 'code-' || dataset_id || '-' || CAST(w AS VARCHAR) AS chosen, 'code-' || dataset_id || '-' || CAST(l AS VARCHAR) AS rejected FROM {_BOTH} WHERE w IS NOT NULL AND l IS NOT NULL AND CAST(example_id AS BIGINT) % 10 <> 0", av.ATTEMPT_SQL)
def f2_dpo_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return training.dpo(av.dataset_rows(spark, sf), _val(spark, sf))


@query(f"SELECT dataset_id, w IS NOT NULL AS sft, w IS NOT NULL AND l IS NOT NULL AS dpo FROM {_BOTH} WHERE w IS NOT NULL AND CAST(example_id AS BIGINT) % 10 = 0", av.ATTEMPT_SQL)
def f3_validation_outputs(spark: SparkSession, sf: str) -> DataFrame:
    rows, val = av.dataset_rows(spark, sf), _val(spark, sf)
    a = training.sft(rows, val, "s", validation=True).select("dataset_id", F.lit(True).alias("sft"))
    b = training.dpo(rows, val, validation=True).select("dataset_id", F.lit(True).alias("dpo"))
    return a.join(b, "dataset_id", "left").select("dataset_id", "sft", F.coalesce("dpo", F.lit(False)).alias("dpo"))


@query(
    """SELECT op_category, dataset_id FROM (SELECT *, row_number() OVER (PARTITION BY op_category ORDER BY sha256('7' || dataset_id), dataset_id) AS r, count(*) OVER (PARTITION BY op_category) AS n FROM outcome WHERE final_outcome = 'compiled_correct') WHERE r <= greatest(1, ceil(n * 0.05::DOUBLE))""",
    av.ATTEMPT_SQL,
)
def f4_validation_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = _outcomes(spark, sf).where("final_outcome = 'compiled_correct'")
    return training.validation_split(rows, 0.05, "7").select("op_category", "dataset_id")


_DRAW = "row_number() OVER (PARTITION BY op_category ORDER BY sha256('7' || dataset_id), dataset_id) AS r, count(*) OVER (PARTITION BY op_category) AS n"


@query(
    f"""SELECT op_category, dataset_id, turn FROM (SELECT op_category, dataset_id, 1 AS turn FROM early WHERE r <= greatest(1, ceil(n * 0.05::DOUBLE)) UNION ALL
    SELECT op_category, dataset_id, 2 AS turn FROM (SELECT w.op_category, w.dataset_id, row_number() OVER (PARTITION BY w.op_category ORDER BY sha256('7' || w.dataset_id), w.dataset_id) AS k, greatest(1, ceil(t.n * 0.05::DOUBLE)) - coalesce(h.have, 0) AS more FROM won w
      JOIN (SELECT op_category, count(*) AS n FROM won GROUP BY 1) t USING (op_category) LEFT JOIN (SELECT op_category, count(*) AS have FROM early WHERE r <= greatest(1, ceil(n * 0.05::DOUBLE)) GROUP BY 1) h USING (op_category)
      WHERE w.dataset_id NOT IN (SELECT dataset_id FROM early WHERE r <= greatest(1, ceil(n * 0.05::DOUBLE)))) WHERE k <= more)""",
    av.ATTEMPT_SQL,
    f"won AS (SELECT op_category, dataset_id FROM outcome WHERE final_outcome = 'compiled_correct'), early AS (SELECT *, {_DRAW} FROM won WHERE CAST(dataset_id AS BIGINT) % 3 > 0)",
)
def f4_kept_split(spark: SparkSession, sf: str) -> DataFrame:
    """A split drawn from two thirds of the rows, read again and extended with all of them: ``turn`` says when each member came."""
    rows, path = _outcomes(spark, sf).where("final_outcome = 'compiled_correct'"), f"{shared_dir(spark)}/split-{uuid.uuid4().hex}"
    first = cut(training.kept_split(rows.where(F.col("dataset_id").cast("bigint") % 3 > 0), path, 0.05, "7"))
    both = training.kept_split(rows, path, 0.05, "7")
    return both.join(first.select("dataset_id", F.lit(1).alias("t")), "dataset_id", "left").select("op_category", "dataset_id", F.coalesce("t", F.lit(2)).alias("turn"))


@query(
    """SELECT seq, sha256('Translate the following PyTorch function to a Triton kernel.' || n || n || 'PyTorch function:' || n || pytorch_code || n || n || 'Input shapes: [' || CAST(p_size AS VARCHAR) || ', 8], [4]' || n || 'Input dtypes: float32, int8' || n
    || CASE WHEN p_size % 2 = 1 THEN n || 'The previous attempt produced this Triton code:' || n || '```python' || n || 'old' || n || '```' || n || n || 'It failed. Apply the following fix to that code, preserving the parts that were already correct — do not rewrite from scratch:' || n || 'fix it' || n ELSE '' END
    || n || 'Output only the Python code.' || n) AS prompt_sha256 FROM (SELECT *, chr(10) AS n FROM code)""",
    av.CODE_SQL,
)
def f5_generator_prompts(spark: SparkSession, sf: str) -> DataFrame:
    odd = F.col("p_size") % 2 == 1
    prompt = training.generator_prompt(F.col("pytorch_code"), F.array(F.array(F.col("p_size"), F.lit(8)), F.array(F.lit(4))), F.array(F.lit("float32"), F.lit("int8")), F.when(odd, "old"), F.lit("fix it"))
    return av.code(spark, sf).select("seq", F.sha2(prompt, 256).alias("prompt_sha256"))


@query(
    """SELECT dataset_id, string_agg('--- Attempt ' || CAST(attempt_n AS VARCHAR) || CASE WHEN attempt_n = last THEN ' (current)' ELSE '' END || ' ---' || chr(10) || 'Triton code:' || chr(10) || 'c' || chr(10) || 'Compile: ' || compile_status || coalesce(chr(10) || 'Run error: ' || run_error, '')
    || coalesce(chr(10) || 'Correctness: ' || correctness_status || CASE WHEN correctness_status = 'failed' THEN ' — max_abs_diff=0.5000, pct_exceeding=12.5%' ELSE '' END, ''), chr(10) || chr(10) ORDER BY attempt_n) AS prompt FROM (SELECT *, max(attempt_n) OVER (PARTITION BY dataset_id) AS last FROM attempts) GROUP BY 1""",
    av.ATTEMPT_SQL,
)
def f6_judge_prompts(spark: SparkSession, sf: str) -> DataFrame:
    one = F.struct("attempt_n", F.lit("c").alias("triton_code"), "compile_status", F.lit(None).cast("string").alias("compile_error"), "run_error", "correctness_status", F.lit(0.5).alias("max_abs_diff"), F.lit(12.5).alias("pct_exceeding"), F.lit(None).cast("string").alias("fix_suggestion"))
    nested = av.attempts(spark, sf).groupBy("dataset_id").agg(F.array_sort(F.collect_list(one)).alias("attempts"))
    return nested.select("dataset_id", training.judge_attempts().alias("prompt"))


@query("SELECT kind, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS share FROM (SELECT CASE WHEN correctness_status = 'failed' THEN 'numeric' WHEN compile_status = 'failed' THEN 'compile' ELSE 'runtime' END AS kind FROM attempts WHERE correctness_status IS NULL OR correctness_status = 'failed') GROUP BY 1", av.ATTEMPT_SQL)
def f7_failure_mix(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("correctness_status") == "failed", "numeric").when(F.col("compile_status") == "failed", "compile").otherwise("runtime")
    lost = av.attempts(spark, sf).where("correctness_status is null or correctness_status = 'failed'")
    return rounded(training.failure_mix(lost.select(kind.alias("kind"))))


@query("SELECT role AS side, count(*) AS n_rows, max(n) AS max_tokens, round(quantile_cont(n, 0.99), 6) AS p99_tokens, count(*) FILTER (n > 100) AS n_over FROM (SELECT role, CAST(len(string_split(text, ' ')) AS BIGINT) AS n FROM conversations) GROUP BY 1")
def f8_length_audit(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select(F.col("role").alias("side"), F.size(F.split("text", " ", -1)).cast("bigint").alias("n_tokens"))
    limits = spark.createDataFrame([(r, 100) for r in ("system", "user", "assistant")], "side string, token_limit int")
    return rounded(training.length_audit(rows, limits), "p99_tokens")


# --- descriptive statistics ------------------------------------------------------------------------

_BUCKET = "CASE final_outcome WHEN 'compiled_correct_faster_than_inductor' THEN 'correct_faster' WHEN 'compiled_correct_parity' THEN 'correct_parity' WHEN 'compiled_correct_slow' THEN 'correct_slow' WHEN 'correctness_failed' THEN 'correctness_failed' ELSE 'compile_or_runtime_fail' END"
_WILSON = "round(greatest(0.0, ((k*1.0::DOUBLE/n) + 1.96*1.96/(2*n) - 1.96*sqrt((k*1.0::DOUBLE/n)*(1-k*1.0::DOUBLE/n)/n + 1.96*1.96/(4.0*n*n))) / (1 + 1.96*1.96/n)), 6) AS wilson_lo, round(least(1.0, ((k*1.0::DOUBLE/n) + 1.96*1.96/(2*n) + 1.96*sqrt((k*1.0::DOUBLE/n)*(1-k*1.0::DOUBLE/n)/n + 1.96*1.96/(4.0*n*n))) / (1 + 1.96*1.96/n)), 6) AS wilson_hi"
_DESCRIBE = "count(x) AS n, round(min(x), 6) AS min, round(quantile_cont(x, 0.25), 6) AS q1, round(quantile_cont(x, 0.5), 6) AS median, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.75), 6) AS q3, round(max(x), 6) AS max, round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 6) AS iqr, round(coalesce(stddev_samp(x), 0), 6) AS std"
_WON = "final_winning_attempt_n IS NOT NULL"


def _last(spark: SparkSession, sf: str) -> DataFrame:
    return records.last_per_key(av.eval_rows(spark, sf), ["model_label", "example_id"])


@query(f"SELECT model_label, coalesce(tier, '__all__') AS tier, final_outcome, bucket, count(*) AS n FROM (SELECT *, {_BUCKET} AS bucket FROM last_rows) GROUP BY GROUPING SETS ((model_label, final_outcome, bucket), (model_label, tier, final_outcome, bucket))", av.EVAL_SQL)
def a1_outcome_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return d.outcome_distribution(_last(spark, sf))


@query(f"SELECT model_label, tier, k, n, round(k * 1.0 / n, 6) AS rate, {_WILSON} FROM (SELECT model_label, coalesce(tier, '__overall__') AS tier, count(*) FILTER ({_WON}) AS k, count(*) AS n FROM last_rows GROUP BY GROUPING SETS ((model_label), (model_label, tier)))", av.EVAL_SQL)
def a2_pass_rates(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(d.pass_rates(_last(spark, sf)))


@query(f"SELECT model_label, measure, {_DESCRIBE} FROM (SELECT model_label, unnest(['vs_inductor','vs_eager','log_vs_inductor','log_vs_eager']) AS measure, unnest([speedup_vs_inductor, speedup_vs_eager, ln(speedup_vs_inductor), ln(speedup_vs_eager)]) AS x FROM last_rows WHERE {_WON}) GROUP BY ALL", av.EVAL_SQL)
def a5_speedup_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = {f"vs_{x}": F.col(f"speedup_vs_{x}") for x in ("inductor", "eager")}
    return rounded(d.measure_summary(_last(spark, sf), s | {f"log_{k}": F.log(c) for k, c in s.items()}, ["model_label"]))


@query(f"SELECT model_label, measure, {_DESCRIBE} FROM (SELECT model_label, unnest(['triton_ms','eager_ms','compile_ms']) AS measure, unnest([triton_ms, 55.0::DOUBLE, k::DOUBLE]) AS x FROM last_rows WHERE {_WON}) GROUP BY ALL", av.EVAL_SQL)
def a6_timing_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(d.measure_summary(_last(spark, sf), {"triton_ms": F.col("triton_ms"), "eager_ms": F.lit(55.0), "compile_ms": F.col("k")}, ["model_label"]))


@query("SELECT coalesce(correctness_status, 'judge_skipped') AS value, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM attempts), 6) AS pct FROM attempts GROUP BY 1", av.ATTEMPT_SQL)
def a8_judge_shares(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(d.shares(av.attempts(spark, sf), "correctness_status", "judge_skipped"))


@query("SELECT count(*) AS n_rows, CAST(sum(n_attempts) AS BIGINT) AS n_attempts, count(*) FILTER (final_outcome = 'compiled_correct') AS n_with_pass, CAST(0 AS BIGINT) AS n_repeated_ids FROM outcome", av.ATTEMPT_SQL)
def a8_dataset_summary(spark: SparkSession, sf: str) -> DataFrame:
    return d.dataset_summary(av.dataset_rows(spark, sf))


@query(f"SELECT model_label, n, k, round(m, 6) AS median_speedup, round(k * 1.0 / n, 6) AS rate, {_WILSON} FROM (SELECT model_label, count(*) AS n, count(*) FILTER ({_WON}) AS k, quantile_cont(speedup_vs_inductor, 0.5) AS m FROM last_rows GROUP BY 1)", av.EVAL_SQL)
def a9_headline(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(d.headline(_last(spark, sf)))


@query("SELECT model_label, example_id, CASE WHEN final_winning_attempt_n IS NULL THEN 0 ELSE 1 END AS passed FROM last_rows", av.EVAL_SQL)
def a10_pass_map(spark: SparkSession, sf: str) -> DataFrame:
    return h.pass_map(av.eval_rows(spark, sf))


@query(f"SELECT model_label, example_id, round(speedup_vs_inductor, 6) AS speedup FROM (SELECT *, row_number() OVER (PARTITION BY model_label, example_id ORDER BY seq DESC) AS r FROM eval_rows WHERE {_WON}) WHERE r = 1", av.EVAL_SQL)
def a10_speedup_map(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(h.speedup_map(av.eval_rows(spark, sf)))


@query("SELECT model_label, tier, final_outcome, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY model_label, tier), 6) AS p FROM last_rows GROUP BY model_label, tier, final_outcome", av.EVAL_SQL)
def a11_conditional_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(d.conditional(_last(spark, sf)))


@query("SELECT coalesce(model_label, '*') AS model_label, coalesce(tier, '*') AS tier, coalesce(final_outcome, '*') AS final_outcome, count(*) AS n FROM last_rows GROUP BY CUBE (model_label, tier, final_outcome)", av.EVAL_SQL)
def a12_cross_tab(spark: SparkSession, sf: str) -> DataFrame:
    return d.cross_tab(_last(spark, sf), ["model_label", "tier", "final_outcome"])


@query("SELECT seq, triton_ms < q1 - 1.5 * (q3 - q1) OR triton_ms > q3 + 1.5 * (q3 - q1) AS is_outlier FROM eval_rows JOIN (SELECT model_label, quantile_cont(triton_ms, 0.25) AS q1, quantile_cont(triton_ms, 0.75) AS q3 FROM eval_rows GROUP BY 1) USING (model_label)", av.EVAL_SQL)
def a13_outliers(spark: SparkSession, sf: str) -> DataFrame:
    return d.outliers(av.eval_rows(spark, sf), ["model_label"], "triton_ms").select("seq", "is_outlier")


@query(None)
def a14_bootstrap_median(spark: SparkSession, sf: str) -> DataFrame:
    return d.bootstrap_median(_last(spark, sf), "model_label", "speedup_vs_inductor")


@query("SELECT op_category, final_outcome, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY op_category), 6) AS p FROM outcome GROUP BY op_category, final_outcome", av.ATTEMPT_SQL)
def a15_category_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    rows = _outcomes(spark, sf).withColumn("model_label", F.lit("all"))
    return rounded(d.conditional(rows, given="op_category")).drop("model_label")


@query("SELECT CASE WHEN compile_status = 'failed' THEN 'compile' WHEN run_error IS NOT NULL THEN 'run' ELSE 'accepted' END AS stage, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS share FROM attempts GROUP BY 1", av.ATTEMPT_SQL)
def a16_stage_counts(spark: SparkSession, sf: str) -> DataFrame:
    stage = F.when(F.col("compile_status") == "failed", "compile").when(F.col("run_error").isNotNull(), "run")
    return rounded(d.stage_counts(av.attempts(spark, sf).withColumn("stage", stage)))


# --- hypothesis tests ------------------------------------------------------------------------------

_PIVOT = "(SELECT example_id, " + ", ".join(f"max(CASE WHEN model_label = '{x}' THEN v END) AS {x}" for x in av.LABELS) + " FROM {src} GROUP BY 1 HAVING count(DISTINCT model_label) = 5)"
_PASSED = f"(SELECT model_label, example_id, CASE WHEN {_WON} THEN 1 ELSE 0 END AS v FROM last_rows)"
_SPEED = f"(SELECT model_label, example_id, speedup_vs_inductor AS v FROM (SELECT *, row_number() OVER (PARTITION BY model_label, example_id ORDER BY seq DESC) AS r FROM eval_rows WHERE {_WON}) WHERE r = 1)"


@query(f"SELECT * FROM {_PIVOT.format(src=_PASSED)}", av.EVAL_SQL)
def h1_pass_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return h.matrix(h.pass_map(av.eval_rows(spark, sf)), av.LABELS, "passed")


@query("SELECT example_id, " + ", ".join(f"round({x}, 6) AS {x}" for x in av.LABELS) + f" FROM {_PIVOT.format(src=_SPEED)}", av.EVAL_SQL)
def h2_speedup_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(h.matrix(h.speedup_map(av.eval_rows(spark, sf)), av.LABELS, "speedup"))


_SUM = "(" + " + ".join(av.LABELS) + ")"


@query(
    f"""SELECT n, 5 AS k, round(q, 6) AS statistic, 4 AS df, round(exp(-q / 2) * (1 + q / 2), 6) AS p_value, round(CASE WHEN n * 4 - q > 0 THEN (q - 4) / (n * 4 - q) ELSE 0 END, 6) AS epsilon_squared FROM
    (SELECT n, 4.0::DOUBLE * (5 * g2 - t * t) / (5 * t - l2) AS q FROM (SELECT count(*) AS n, sum({_SUM}) AS t, sum({_SUM} * {_SUM}) AS l2, {' + '.join(f'sum({x}) * sum({x})' for x in av.LABELS)} AS g2 FROM {_PIVOT.format(src=_PASSED)}))""",
    av.EVAL_SQL,
)
def h3_cochran_q(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(h.cochran_q(av.eval_rows(spark, sf), av.LABELS).drop("skipped_reason"))


_NAMES = ", ".join(f"('{b} vs click', 'click', '{b}')" for b in av.LABELS[1:])
_COUNTS = f"""counts AS (SELECT name, count(*) AS n_common, count(*) FILTER (a.v = 1 AND b.v = 1) AS n11, count(*) FILTER (a.v = 1 AND b.v = 0) AS n10, count(*) FILTER (a.v = 0 AND b.v = 1) AS n01, count(*) FILTER (a.v = 0 AND b.v = 0) AS n00
  FROM (VALUES {_NAMES}) t(name, la, lb) JOIN {_PASSED} a ON a.model_label = la JOIN {_PASSED} b ON b.model_label = lb AND a.example_id = b.example_id GROUP BY 1)"""


def _tail(z: str) -> str:
    """SQL of the two-sided tail of the normal distribution: a series of positive terms for the error function."""
    x = f"(abs({z}) / sqrt(2.0::DOUBLE))"
    return f"CASE WHEN {x} = 0 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - list_sum(list_transform(range(0, 300), lambda i: exp(-{x} * {x} + (2 * i + 1) * ln({x}) - lgamma(i + 1.5::DOUBLE))))) END"


#: Exact binomial tail below 25 discordant examples, else chi-squared of one degree with correction.
_EXACT = "least(1.0::DOUBLE, 2 * list_sum(list_transform(range(0, least(n10, n01) + 1), lambda i: exp(lgamma(n10 + n01 + 1.0::DOUBLE) - lgamma(i + 1.0::DOUBLE) - lgamma(n10 + n01 - i + 1.0::DOUBLE) - (n10 + n01) * ln(2.0::DOUBLE)))))"
_TESTED = f"tested AS (SELECT *, n10 + n01 < 25 AS exact, CASE WHEN n10 + n01 < 25 THEN {_EXACT} ELSE {_tail('(abs(n10 - n01) - 1) / sqrt(n10 + n01)')} END AS p, (n10 - n01) * 1.0::DOUBLE / n_common AS delta FROM counts)"
_HOLM = "holm AS (SELECT *, max(least(1.0, (m - r + 1) * p)) OVER (ORDER BY r) AS p_holm, 0.05::DOUBLE / (m - r + 1) AS threshold FROM (SELECT *, row_number() OVER (ORDER BY p, name) AS r, count(*) OVER () AS m FROM tested))"
_STATISTIC = "CASE WHEN n10 + n01 < 25 THEN least(n10, n01) ELSE (abs(n10 - n01) - 1) * (abs(n10 - n01) - 1) * 1.0 / (n10 + n01) END"


@query(
    f"""SELECT name, n_common, n11, n10, n01, n00, round((n11 + n10) * 1.0 / n_common, 6) AS p_a, round((n11 + n01) * 1.0 / n_common, 6) AS p_b, exact, round({_STATISTIC}, 6) AS statistic, round(p, 6) AS p_value,
    round(2 * (asin(sqrt((n11 + n10) * 1.0 / n_common)) - asin(sqrt((n11 + n01) * 1.0 / n_common))), 6) AS cohen_h, round(delta, 6) AS delta_p FROM tested""",
    av.EVAL_SQL,
    _COUNTS,
    _TESTED,
)
def h4_mcnemar(spark: SparkSession, sf: str) -> DataFrame:
    out = h.mcnemar_of(h.pass_patterns(av.eval_rows(spark, sf), av.LABELS), av.LABELS, h.default_contrasts(spark, av.LABELS))
    return rounded(out.select("name", "n_common", "n11", "n10", "n01", "n00", "p_a", "p_b", "exact", "statistic", "p_value", "cohen_h", "delta_p"), "p_a", "p_b", "statistic", "p_value", "cohen_h", "delta_p")


@query(
    f"""SELECT t.name, n_common, n11, n10, n01, n00, exact, round({_STATISTIC}, 6) AS statistic, round(p, 6) AS p_value, round(p_holm, 6) AS p_holm, round(threshold, 6) AS holm_threshold, p_holm < 0.05 AS reject_holm, p < 0.05 AND delta <= -0.03 AS headline, n_common IS NULL AS missing
    FROM (SELECT name FROM counts UNION ALL SELECT 'absent vs click') t LEFT JOIN holm ON holm.name = t.name""",
    av.EVAL_SQL,
    _COUNTS,
    _TESTED,
    _HOLM,
)
def h5_planned_contrasts(spark: SparkSession, sf: str) -> DataFrame:
    out = h.planned_contrasts(av.eval_rows(spark, sf), h.default_contrasts(spark, [*av.LABELS, "absent"]))
    out = out.select("name", "n_common", "n11", "n10", "n01", "n00", "exact", "statistic", "p_value", "p_holm", "holm_threshold", "reject_holm", "headline", "missing")
    return rounded(out, "statistic", "p_value", "p_holm", "holm_threshold")


@query(
    """SELECT p_type || p_brand AS name, round(p, 6) AS p_value, round(max(least(1.0, (m - r + 1) * p)) OVER (ORDER BY r), 6) AS p_holm, round(0.05::DOUBLE / (m - r + 1), 6) AS holm_threshold FROM (SELECT *, row_number() OVER (ORDER BY p, p_type || p_brand) AS r, count(*) OVER () AS m FROM (SELECT p_type, p_brand, avg(p_size) / 1000.0::DOUBLE AS p FROM part GROUP BY ALL))"""
)
def h6_holm(spark: SparkSession, sf: str) -> DataFrame:
    tests = table(spark, sf, "part").groupBy(F.concat("p_type", "p_brand").alias("name")).agg((F.avg("p_size") / 1000.0).alias("p_value"))
    return rounded(h.holm(tests).drop("reject_holm"))


@query(None)
def h7_shapiro(spark: SparkSession, sf: str) -> DataFrame:
    return h.shapiro(av.eval_rows(spark, sf))


@query(
    f"""SELECT n, 5 AS k, CASE WHEN n >= 30 THEN round(q, 6) END AS statistic, 4 AS df, CASE WHEN n >= 30 THEN round(exp(-q / 2) * (1 + q / 2), 6) END AS p_value FROM (SELECT n, (12.0::DOUBLE / (n * 5 * 6) * r2 - 3 * n * 6) / (1 - ties / (n * 5.0::DOUBLE * 24)) AS q FROM (SELECT max(n) AS n, sum(r * r) AS r2, sum(t) AS ties FROM (SELECT lab, count(*) AS n, sum(r) AS r, sum(c * c - 1) AS t FROM
    (SELECT example_id, lab, rank() OVER (PARTITION BY example_id ORDER BY v) + (count(*) OVER (PARTITION BY example_id, v) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY example_id, v) AS c FROM (SELECT example_id, unnest([{', '.join(repr(x) for x in av.LABELS)}]) AS lab, unnest([{', '.join(av.LABELS)}]) AS v FROM {_PIVOT.format(src=_SPEED)})) GROUP BY 1)))""",
    av.EVAL_SQL,
)
def h8_friedman(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(h.friedman(av.eval_rows(spark, sf), av.LABELS).select("n", "k", "statistic", "df", "p_value"), "statistic", "p_value")


@query(
    f"""SELECT label_a, label_b, round(z, 6) AS z, round(p, 6) AS p_value, round(max(least(1.0, (m - r + 1) * p)) OVER (ORDER BY r), 6) AS p_holm FROM (SELECT *, row_number() OVER (ORDER BY p, label_a || '|' || label_b) AS r, count(*) OVER () AS m FROM (SELECT *, {_tail("z")} AS p FROM zs))""",
    av.EVAL_SQL,
    f"ranked AS (SELECT model_label, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY v) AS c FROM {_SPEED})",
    """zs AS (SELECT a.model_label AS label_a, b.model_label AS label_b, abs(a.mr - b.mr) / sqrt((m * (m + 1.0::DOUBLE) / 12 - ties / (12.0::DOUBLE * (m - 1))) * (1.0::DOUBLE / a.n + 1.0::DOUBLE / b.n)) AS z FROM
    (SELECT model_label, avg(r) AS mr, count(*) AS n FROM ranked GROUP BY 1) a JOIN (SELECT model_label, avg(r) AS mr, count(*) AS n FROM ranked GROUP BY 1) b ON a.model_label < b.model_label CROSS JOIN (SELECT count(*) AS m, sum(c * c - 1.0::DOUBLE) AS ties FROM ranked))""",
)
def h9_dunn(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(h.dunn(av.eval_rows(spark, sf)).select("label_a", "label_b", "z", "p_value", "p_holm"))


def _wilcoxon_sql(key: str) -> str:
    """The signed-rank test over ``diffs`` (key, d): exact up to 50 different distances without ties, else normal with the tie term."""
    # how many subsets of the ranks 1 to n have each sum, rank by rank
    ways = "list_reduce(list_prepend([1.0::DOUBLE] || list_transform(range(0, CAST(n * (n + 1) / 2 AS BIGINT)), lambda i: 0.0::DOUBLE), list_transform(range(1, n + 1), lambda i: [CAST(i AS DOUBLE)])), lambda a, x: list_transform(range(1, len(a) + 1), lambda j: a[j] + CASE WHEN j - x[1] >= 1 THEN a[CAST(j - x[1] AS BIGINT)] ELSE 0 END))"
    exact = f"least(1.0::DOUBLE, 2 * list_sum(list_slice({ways}, 1, CAST(floor(w) AS BIGINT) + 1)) / pow(2.0::DOUBLE, n))"
    normal = _tail("(w - n * (n + 1) / 4.0::DOUBLE) / sqrt((n * (n + 1.0::DOUBLE) * (2 * n + 1) - ties / 2.0::DOUBLE) / 24)")
    return f"""SELECT {key}, n_pairs, round(w, 4) AS statistic, round(CASE WHEN n <= 50 AND ties = 0 AND n = n_pairs THEN {exact} ELSE {normal} END, 6) AS p_value, round((up - down) / (up + down), 6) AS effect_r, round(med, 6) AS median_log_diff, round(exp(med), 6) AS median_ratio FROM
    (SELECT {key}, count(*) AS n_pairs, count(r) AS n, quantile_cont(d, 0.5) AS med, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS up, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS down, least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)) AS w, sum(CASE WHEN d <> 0 THEN c * c - 1.0::DOUBLE ELSE 0 END) AS ties FROM
    (SELECT *, count(*) OVER (PARTITION BY {key}, abs(d)) AS c, CASE WHEN d <> 0 THEN rank() OVER (PARTITION BY {key}, d <> 0 ORDER BY abs(d)) + (count(*) OVER (PARTITION BY {key}, abs(d)) - 1) / 2.0::DOUBLE END AS r FROM diffs) GROUP BY 1)"""


@query(
    _wilcoxon_sql("name"),
    av.EVAL_SQL,
    f"diffs AS (SELECT name, ln(a.v) - ln(b.v) AS d FROM (VALUES {_NAMES}) t(name, la, lb) JOIN {_SPEED} a ON a.model_label = la JOIN {_SPEED} b ON b.model_label = lb AND a.example_id = b.example_id)",
)
def h10_wilcoxon(spark: SparkSession, sf: str) -> DataFrame:
    out = h.wilcoxon_contrasts(av.eval_rows(spark, sf), h.default_contrasts(spark, av.LABELS))
    out = out.select("name", "n_pairs", F.round("statistic", 4).alias("statistic"), "p_value", "effect_r", "median_log_diff", "median_ratio")
    return rounded(out, "p_value", "effect_r", "median_log_diff", "median_ratio")


@query(None)
def h11_compare_report(spark: SparkSession, sf: str) -> DataFrame:
    tables = h.compare(av.eval_rows(spark, sf), av.LABELS)
    out = None
    for name, t in tables.items():
        one = t.select(F.lit(name).alias("part"), F.to_json(F.struct(*t.columns)).alias("row"))
        out = one if out is None else out.union(one)
    return out


@query(_wilcoxon_sql("vec_id"), "diffs AS (SELECT vec_id, ln(abs(unnest(embedding)::DOUBLE) + 1) - ln(unnest(list_reverse(list_transform(embedding, lambda x: abs(x::DOUBLE) * 1.5::DOUBLE + 1)))) AS d FROM embeddings)")
def h13_sample_wilcoxon(spark: SparkSession, sf: str) -> DataFrame:
    sample = lambda by: F.transform("embedding", lambda v: F.abs(v.cast("double")) * by + 1)
    rows = table(spark, sf, "embeddings").select("vec_id", sample(1.0).alias("a"), F.reverse(sample(1.5)).alias("b"))
    out = h.wilcoxon_samples(rows, "vec_id", "a", "b").drop("skipped_reason").withColumn("statistic", F.round("statistic", 4))
    return rounded(out, "p_value", "effect_r", "median_log_diff", "median_ratio")


@query("SELECT p_partkey, round(2 * (asin(sqrt(p_size / 100.0::DOUBLE)) - asin(sqrt(0.25::DOUBLE))), 6) AS cohen_h FROM part")
def p1_cohens_h(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(table(spark, sf, "part").select("p_partkey", h.cohens_h(F.col("p_size") / 100.0, F.lit(0.25)).alias("cohen_h")))


_Z975 = repr(h.tails.NORMAL.inv_cdf(0.975))


@query(
    f"SELECT model_label, round(CASE WHEN z > 0 THEN 1 - {_tail('z')} / 2 ELSE {_tail('z')} / 2 END, 6) AS power FROM (SELECT model_label, abs(2 * (asin(sqrt(count(*) FILTER ({_WON}) * 1.0::DOUBLE / count(*))) - asin(sqrt(0.8::DOUBLE)))) * sqrt(count(*)) - {_Z975} AS z FROM last_rows GROUP BY 1)",
    av.EVAL_SQL,
)
def p2_post_hoc_power(spark: SparkSession, sf: str) -> DataFrame:
    rates = d.pass_rates(_last(spark, sf)).where("tier = '__overall__'")
    return rounded(rates.select("model_label", h.post_hoc_power(F.col("rate"), F.lit(0.8), F.col("n")).alias("power")))


_MDE = (h.tails.NORMAL.inv_cdf(0.975) + h.tails.NORMAL.inv_cdf(0.8)).__repr__()


@query(
    f"""SELECT tier, n, p AS baseline_p, round({_MDE} / sqrt(n), 6) AS mde_h, round(CASE WHEN asin(sqrt(p)) + {_MDE} / sqrt(n) / 2 <= pi() / 2 THEN pow(sin(asin(sqrt(p)) + {_MDE} / sqrt(n) / 2), 2) - p END, 6) AS mde_delta_p FROM
    (SELECT tier, count(DISTINCT example_id) AS n FROM eval_rows GROUP BY 1 UNION ALL SELECT 'all', count(DISTINCT example_id) FROM eval_rows) CROSS JOIN (SELECT unnest([0.05::DOUBLE, 0.1, 0.2, 0.3]) AS p)""",
    av.EVAL_SQL,
)
def p3_mde_table(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(h.mde_table(av.eval_rows(spark, sf)), "mde_h", "mde_delta_p")


# --- streams ---------------------------------------------------------------------------------------


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table as a stream: the pattern matches a single file and a folder alike. Event times become instants."""
    rows = spark.readStream.schema(table(spark, sf, name).schema).parquet(f"{sf}/{name}.parque[t]")
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in rows.columns else rows


@query("SELECT user_id, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1")
def r2_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    seen = feeds.first_seen(_stream(spark, sf, "events"), ["user_id", "event_type"])
    return feeds.drain(seen).groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT final_outcome, n_attempts, count(*) AS n FROM (SELECT CASE WHEN passed > 0 THEN 'compiled_correct' WHEN compared > 0 THEN 'numeric_fail' ELSE 'runtime_fail' END AS final_outcome, n_attempts FROM (SELECT p_brand, count(*) FILTER (s = 'passed' AND r <= 3) AS passed, count(s) FILTER (r <= 3) AS compared, least(coalesce(min(r) FILTER (s = 'passed' AND r <= 3), 3), 3) AS n_attempts FROM (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r, CASE p_size % 3 WHEN 0 THEN 'passed' WHEN 1 THEN 'failed' END AS s FROM part) WHERE r <= 3 GROUP BY 1)) GROUP BY ALL")
def r3_attempt_fold(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size") % 3
    rows = _stream(spark, sf, "part").select(F.col("p_brand").alias("dataset_id"), F.col("p_partkey").alias("attempt_n"), F.lit("success").alias("compile_status"), F.when(size == 0, "passed").when(size == 1, "failed").alias("correctness_status"), F.timestamp_seconds(F.lit(1700000000)).alias("ts"))
    return feeds.drain(feeds.fold_attempts(rows)).groupBy("final_outcome", F.col("n_attempts").cast("bigint").alias("n_attempts")).agg(F.count("*").alias("n"))


@query("SELECT user_id AS job_id, arg_max(event_type, ts) AS status, max(ts) AS ts, min(ts) AS first_ts FROM events GROUP BY 1")
def r4_status_fold(spark: SparkSession, sf: str) -> DataFrame:
    rows = _stream(spark, sf, "events").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("status"), "ts")
    return feeds.drain(feeds.fold_status(rows), "complete").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("ts", "first_ts")})


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def r6_windowed_rates(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.drain(feeds.rates(_stream(spark, sf, "events"), "event_type", "1 day"), "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")
