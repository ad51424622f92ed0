"""Closed vocabularies and registries of the data model. All values are fixed by the record formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# They must equal those in existing records.
OP_CATEGORY = ["elementwise_chain", "reduction", "matmul", "convolution", "fused_attention", "normalization", "activation", "loss", "embedding", "quantization", "other"]
DTYPE = ["float16", "float32", "bfloat16", "float64", "int8", "int16", "int32", "int64", "bool"]
SPLIT = ["train", "eval"]
TIER = ["easy", "medium", "hard"]
DATASET_OUTCOME = ["compiled_correct", "numeric_fail", "runtime_fail", "compile_fail"]
EVAL_OUTCOME = ["correctness_failed", "runtime_fail", "compile_fail", "compiled_correct_slow", "compiled_correct_parity", "compiled_correct_faster_than_inductor"]
PASSING = ["compiled_correct_faster_than_inductor", "compiled_correct_parity", "compiled_correct_slow"]
TOLERANCE_POLICY = ["default_fp32", "default_fp16", "reduction_fp32", "reduction_fp16", "exact_integer", "masked_logits", "attention_softmax_fp16", "recurrent_scan_fp16", "low_precision_dequant", "fp8_cast"]
JUDGE_CLASS = ["shape_mismatch", "dtype_mismatch", "indexing_error", "triton_api_error", "correctness_failed_numeric", "compiled_correct", "other"]
FAILURE_SYMPTOM = ["numeric_mismatch", "unsupported_ptr_type", "incompatible_block_shape", "non_constexpr_arange_bound", "undefined_symbol", "unsupported_language_construct", "launch_signature_mismatch", "invalid_triton_api", "invalid_output_type", "host_shape_error", "cuda_illegal_memory_access", "timeout", "triton_compilation_error", "python_runtime_error"]
JUDGE_ROOT_CAUSE = [
    "raw_data_ptr_passed_as_pointer", "invalid_pointer_arithmetic_or_offset_dtype", "runtime_value_used_as_constexpr", "broadcast_or_mask_rank_mismatch", "wrong_launch_grid_or_meta_signature", "wrong_program_id_mapping", "wrong_linearization_or_stride", "wrong_reduction_axis_or_extent",
    "wrong_matmul_tile_or_accumulation", "dtype_cast_or_dot_operand_mismatch", "wrong_output_shape_or_return_type", "invalid_triton_api_usage", "host_wrapper_shape_logic_error", "memory_safety_or_out_of_bounds", "unsupported_python_construct_in_kernel", "unknown",
]
JUDGE_REPAIR_ACTION = [
    "replace_data_ptr_with_tensor_args", "cast_offsets_or_strides_to_int32", "make_dimension_constexpr_or_tile", "fix_mask_broadcast_rank", "fix_launch_grid_or_meta_args", "fix_program_id_mapping", "fix_linear_indexing_or_strides", "fix_reduction_axis_or_loop_extent",
    "fix_matmul_tiling_or_accumulator", "add_or_change_dtype_cast", "fix_output_allocation_shape_or_return", "replace_invalid_triton_api", "fix_host_wrapper_shape_logic", "add_bounds_masking", "remove_unsupported_kernel_construct", "unknown",
]
COMPILE_STATUS = ["success", "failed"]
CORRECTNESS_STATUS = ["passed", "failed"]
AXES = {
    "shape_rank": ["1D", "2D", "3D", "4D"],
    "dtype_mix": ["fp32_only", "fp16_only", "bf16_only", "mixed_fp32_fp16", "mixed_fp32_bf16", "with_int8"],
    "broadcast_pattern": ["none", "row", "col", "channel", "batch"],
    "reduction_axis": ["none", "last", "all", "channel", "batch"],
    "fusion_shape": ["single_op", "pair", "triplet", "reduce_then_op", "op_then_reduce"],
    "memory_pattern": ["contiguous", "strided", "jagged", "masked"],
}
#: Rows asked for in each category of a full sample.
QUOTAS = {"matmul": 120, "fused_attention": 100, "normalization": 100, "reduction": 100, "activation": 100, "elementwise_chain": 100, "embedding": 80, "loss": 80, "convolution": 80, "quantization": 80, "other": 60}
#: Policy: absolute and relative tolerance, comparison mode.
TOLERANCES = {
    "default_fp32": (1e-5, 1e-5, "numeric"),
    "default_fp16": (1e-3, 1e-3, "numeric"),
    "reduction_fp32": (1e-4, 1e-4, "numeric"),
    "reduction_fp16": (5e-3, 5e-3, "numeric"),
    "exact_integer": (0.0, 0.0, "exact"),
    "masked_logits": (1e-5, 1e-5, "inf_aware_numeric"),
    "attention_softmax_fp16": (5e-3, 5e-3, "numeric"),
    "recurrent_scan_fp16": (1e-2, 1e-2, "numeric"),
    "low_precision_dequant": (2e-2, 2e-2, "numeric"),
    "fp8_cast": (1e-2, 1e-2, "numeric"),
}
# Shapes that specs are drawn from, by rank.
STOCK_SHAPES = {
    "1D": [[256], [512], [1024], [2048], [4096], [8192], [16384], [32768], [65536]],
    "2D": [[8, 512], [16, 768], [32, 1024], [64, 1024], [64, 2048], [128, 1024], [128, 2048], [256, 1024], [256, 2048], [256, 4096], [512, 1024], [32, 8192], [64, 4096], [16, 16384]],
    "3D": [[4, 64, 4096], [4, 128, 2048], [8, 128, 1024], [8, 256, 1024], [16, 128, 1024], [16, 256, 2048], [32, 128, 1024], [32, 256, 1024], [32, 512, 1024], [64, 128, 512], [4, 1024, 1024], [16, 512, 2048]],
    "4D": [[2, 8, 128, 128], [2, 32, 128, 256], [4, 8, 128, 128], [4, 16, 64, 64], [4, 16, 128, 128], [8, 8, 64, 64], [8, 16, 64, 64], [8, 16, 128, 128], [16, 8, 64, 64], [16, 16, 64, 128], [16, 32, 64, 128], [32, 32, 32, 64]],
}
# Operations that count, by kind, and those that only move data.
UNARY = ["torch.abs", "torch.exp", "torch.nn.functional.gelu", "torch.nn.functional.silu", "torch.relu", "torch.sigmoid", "torch.sqrt", "torch.tanh"]
BINARY = ["torch.add", "torch.div", "torch.mul", "torch.sub"]
REDUCTION = ["torch.amax", "torch.argmax", "torch.mean", "torch.sum", "torch.var"]
NORMALIZATION = ["torch.nn.functional.layer_norm", "torch.nn.functional.log_softmax", "torch.nn.functional.softmax"]
MATMUL = ["torch.bmm", "torch.matmul", "torch.nn.functional.linear"]
INDEXING = ["torch.gather", "torch.nn.functional.embedding"]
COUNTED_OPS = frozenset(UNARY + BINARY + REDUCTION + NORMALIZATION + MATMUL + INDEXING)
FREE_OPS = frozenset([
    "view", "reshape", "transpose", "permute", "contiguous", "unsqueeze", "squeeze", "flatten", "expand", "expand_as", "size",
    "torch.transpose", "torch.permute", "torch.reshape", "torch.unsqueeze", "torch.squeeze", "torch.flatten",
])
# Fusion forms: tier, category, pool of each slot, required metadata, input shapes.
FORMS = {
    "chain_2_unary": ("easy", "elementwise_chain", [UNARY, UNARY], [], [[[1024]], [[4096]], [[16384]], [[32, 1024]], [[64, 2048]], [[128, 4096]], [[8, 128, 1024]], [[16, 256, 2048]], [[32, 512, 1024]]]),
    "unary_then_residual": ("easy", "elementwise_chain", [UNARY, ["torch.add"]], [], [[[32, 1024]], [[64, 2048]], [[128, 4096]], [[8, 128, 1024]], [[16, 256, 2048]], [[32, 512, 1024]]]),
    "chain_3_unary": ("medium", "elementwise_chain", [UNARY, UNARY, UNARY], [], [[[32, 1024]], [[64, 2048]], [[128, 4096]], [[8, 128, 1024]], [[16, 256, 2048]], [[32, 512, 1024]]]),
    "unary_then_reduction": ("medium", "reduction", [UNARY, REDUCTION], ["reduce_dim", "keepdim"], [[[32, 1024]], [[128, 4096]], [[8, 128, 1024]], [[16, 256, 2048]], [[32, 512, 1024]]]),
    "softmax_then_unary": ("medium", "normalization", [["torch.nn.functional.softmax"], UNARY], ["softmax_dim"], [[[32, 1024]], [[8, 128, 1024]], [[16, 256, 2048]], [[4, 8, 128, 128]], [[4, 16, 256, 256]]]),
    "unary_then_norm": ("medium", "normalization", [UNARY, ["torch.nn.functional.layer_norm"]], ["normalized_shape", "norm_eps"], [[[8, 128, 1024]], [[16, 256, 2048]], [[32, 512, 1024]]]),
    "attention_qkv": ("hard", "fused_attention", [["torch.matmul"], ["torch.mul"], ["torch.nn.functional.softmax"], ["torch.matmul"]], ["num_heads", "causal", "scale"], [[[2, 4, 64, 64], [2, 4, 64, 64], [2, 4, 64, 64]], [[2, 8, 128, 64], [2, 8, 128, 64], [2, 8, 128, 64]], [[4, 8, 256, 64], [4, 8, 256, 64], [4, 8, 256, 64]], [[4, 16, 128, 128], [4, 16, 128, 128], [4, 16, 128, 128]]]),
    "fused_linear_norm_activation": ("hard", "fused_attention", [["torch.nn.functional.linear"], ["torch.nn.functional.layer_norm"], UNARY], ["normalized_shape", "norm_eps"], [[[4, 128, 256], [1024, 256]], [[4, 256, 512], [2048, 512]], [[8, 128, 768], [3072, 768]], [[8, 256, 1024], [4096, 1024]]]),
    "gated_mlp_swiglu": ("hard", "activation", [["torch.nn.functional.linear"], ["torch.nn.functional.linear"], ["torch.nn.functional.silu"], ["torch.mul"]], [], [[[4, 128, 256], [1024, 256], [1024, 256]], [[4, 256, 512], [2048, 512], [2048, 512]], [[8, 128, 768], [3072, 768], [3072, 768]], [[8, 256, 1024], [4096, 1024], [4096, 1024]]]),
    "chain_4_unary": ("hard", "elementwise_chain", [UNARY, UNARY, UNARY, UNARY], [], [[[8, 128, 1024]], [[16, 256, 2048]], [[32, 512, 1024]]]),
    "embedding_then_norm": ("hard", "embedding", [["torch.nn.functional.embedding"], ["torch.nn.functional.layer_norm"], UNARY], ["num_embeddings", "norm_eps"], [[[4, 128], [4096, 256]], [[8, 256], [8192, 512]], [[4, 512], [16384, 1024]]]),
}


def form_dtypes(form: str) -> list[list[str]]:
    """The dtype variants of a form's inputs: all single or all half precision, indices of embeddings as integers."""
    n = len(FORMS[form][4][0])
    return [["int64" if form == "embedding_then_norm" and i == 0 else kind for i in range(n)] for kind in ("float32", "float16")]


def tolerance_table(spark: SparkSession) -> DataFrame:
    """``policy``, ``atol``, ``rtol``, ``mode``."""
    return spark.createDataFrame([(k, *v) for k, v in TOLERANCES.items()], "policy string, atol double, rtol double, mode string")


def form_table(spark: SparkSession) -> DataFrame:
    """``form``, ``tier``, ``op_category``, ``op_count``, ``n_inputs``, ``required``."""
    return spark.createDataFrame([(k, v[0], v[1], len(v[2]), len(v[4][0]), v[3]) for k, v in FORMS.items()], "form string, tier string, op_category string, op_count int, n_inputs int, required array<string>")
