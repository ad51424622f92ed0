"""Explicit schemas of the JSON Lines records; never inferred."""

from __future__ import annotations

from pyspark.sql.types import StructType

#: Record name: DDL of its fields.
SLIM = "example_id string, op_category string, pytorch_code string, input_shapes array<array<int>>, input_dtypes array<string>, rng_seed bigint, tolerance_policy string"
CORPUS = SLIM + ", dataset_id string, split string, origin string, difficulty string"
ATTEMPT = (
    "attempt_n int, prior_advice_applied string, patch_from_previous string, triton_code string, compile struct<status:string,error:string>, run_error string, "
    "correctness struct<status:string,tolerance_policy_used:string>, failure_symptom string, judge_classification string, judge_root_cause string, judge_repair_action string, judge_fix_suggestion string, timestamp timestamp"
)
DATASET = (
    "dataset_id string, example_id string, source struct<example_id:string,pytorch_code:string,origin:string,input_shapes:array<array<int>>,input_dtypes:array<string>,rng_seed:bigint,op_category:string,tolerance_policy:string>, "
    "attempts array<struct<attempt_n:int,prior_advice_applied:string,patch_from_previous:string,triton_code:string,compile:struct<status:string,error:string>,run_error:string,"
    "correctness:struct<status:string,tolerance_policy_used:string>,failure_symptom:string,judge_classification:string,judge_root_cause:string,judge_repair_action:string,judge_fix_suggestion:string,timestamp:timestamp>>, final_outcome string"
)
_STATS = "struct<max_abs_diff:double,max_rel_diff:double,mean_abs_diff:double,n_elements_exceeding_tol:bigint,pct_elements_exceeding_tol:double>"
_BENCH = "struct<triton_ms:double,eager_ms:double,inductor_ms:double,speedup_vs_eager:double,speedup_vs_inductor:double,triton_std_ms:double,eager_std_ms:double,inductor_std_ms:double,triton_samples_ms:array<double>,eager_samples_ms:array<double>,inductor_samples_ms:array<double>>"
EVAL_RESULT = (
    "example_id string, spec struct<spec_id:string,tier:string,form:string,ops:array<string>,input_shapes:array<array<int>>,input_dtypes:array<string>,expected_output_shape:array<int>,expected_output_dtype:string,tolerance_policy:string,rng_seed:bigint,form_metadata:map<string,string>>, "
    f"attempts array<struct<attempt_n:int,prior_advice_applied:string,triton_code:string,compile:struct<status:string,error:string>,run_error:string,correctness:struct<status:string,tolerance_policy_used:string,vs_eager:{_STATS},vs_inductor:{_STATS}>,"
    f"benchmark:{_BENCH},latency:struct<generator_ms:bigint,compile_ms:bigint,run_ms:bigint>,tokens:struct<generator_prompt:bigint,generator_completion:bigint>,timestamp:timestamp>>, final_outcome string, final_winning_attempt_n int"
)
OBSERVATION = "repo string, file_path string, function_name string, op_category string, shape_rank string, dtype_mix string, broadcast_pattern string, reduction_axis string, fusion_shape string, memory_pattern string"
STATUS = "job_id string, status string, ts timestamp, error_message string"


def schema(ddl: str) -> StructType:
    """A schema of DDL fields."""
    return StructType.fromDDL(ddl)
