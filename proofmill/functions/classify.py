"""First-match classifiers over text and outcomes, as chained conditions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _any(text: Column, *words: str) -> Column:
    out = text.contains(words[0])
    for w in words[1:]:
        out = out | text.contains(w)
    return out


def first_match(text: Column, rules: list[tuple[str, tuple[str, ...]]], default: str) -> Column:
    """The label of the first rule of which any word occurs in the text (as a part of words too)."""
    out = None
    for label, words in rules:
        out = F.when(_any(text, *words), label) if out is None else out.when(_any(text, *words), label)
    return out.otherwise(default)


# Words of the category and axis rules, in order.
CATEGORY_RULES = [
    ("fused_attention", ("softmax", "attn", "flash")), ("matmul", ("matmul", "gemm")), ("normalization", ("rmsnorm", "layer_norm", "layernorm", "norm")),
    ("other", ("rope", "scan")), ("convolution", ("conv",)), ("embedding", ("embed", "emb")), ("loss", ("loss", "ce", "jsd", "kl")),
    ("quantization", ("quant", "dequant", "nf4", "fp8", "int4", "int8")), ("activation", ("relu", "gelu", "silu", "swiglu", "geglu")), ("reduction", ("sum", "mean", "max", "argmax")),
]
RANK_RULES = [("4D", ("4d", "nchw", "nhwc", "conv2d", "image")), ("3D", ("3d", "bth", "qkv", "sequence", "token")), ("1D", ("1d", "vector", "flat"))]
BROADCAST_RULES = [("channel", ("channel", "channels")), ("batch", ("batch", "bcast_b")), ("col", ("col", "column")), ("row", ("row",))]
REDUCTION_WORDS = ("reduce", "sum", "mean", "argmax", "amax", "max")
REDUCTION_RULES = [("last", ("dim=-1", "axis=-1", "last")), ("all", ("all", "global")), ("channel", ("channel", "dim=1", "axis=1")), ("batch", ("batch", "dim=0", "axis=0"))]
FUSION_RULES = [("reduce_then_op", ("reduce_then", "reduction_then", "sum_then", "mean_then")), ("op_then_reduce", ("then_reduce", "op_then_reduce"))]
FUSION_MARKS = ("relu", "gelu", "silu", "swiglu", "geglu", "softmax", "matmul", "add", "mul", "sum", "mean", "norm")
MEMORY_RULES = [("jagged", ("jagged", "ragged")), ("masked", ("mask", "causal", "block_sparse")), ("strided", ("stride", "strided"))]


def op_category(blob: Column) -> Column:
    """Category of lower-cased text."""
    return first_match(blob, CATEGORY_RULES, "elementwise_chain")


def axes(blob: Column) -> dict[str, Column]:
    """C11: the six structural axes of lower-cased text."""
    half, brain, full = _any(blob, "fp16", "float16"), _any(blob, "bf16", "bfloat16"), _any(blob, "fp32", "float32")
    mix = F.when(_any(blob, "int8", "int4", "fp8"), "with_int8").when(full & half, "mixed_fp32_fp16").when(full & brain, "mixed_fp32_bf16").when(brain, "bf16_only").when(half, "fp16_only").otherwise("fp32_only")
    marks = sum((blob.contains(w).cast("int") for w in FUSION_MARKS), F.lit(0))
    plain = F.when(marks >= 3, "triplet").when(marks >= 2, "pair").otherwise("single_op")
    fusion = first_match(blob, FUSION_RULES, "")
    return {
        "shape_rank": first_match(blob, RANK_RULES, "2D"),
        "dtype_mix": mix,
        "broadcast_pattern": F.when(blob.contains("broadcast"), first_match(blob, BROADCAST_RULES, "none")).otherwise("none"),
        "reduction_axis": F.when(_any(blob, *REDUCTION_WORDS), first_match(blob, REDUCTION_RULES, "none")).otherwise("none"),
        "fusion_shape": F.when(fusion != "", fusion).otherwise(plain),
        "memory_pattern": first_match(blob, MEMORY_RULES, "contiguous"),
    }


def _has(word: str):
    return lambda text: text.contains(word)


def _starts(word: str):
    return lambda text: text.startswith(word)


def _matches(pattern: str):
    return lambda text: text.rlike(pattern)


# Each symptom's alternatives; the conditions of one alternative must all hold.
SYMPTOM_RULES = [
    ("timeout", [[_has("timed out")]]),
    ("cuda_illegal_memory_access", [[_has("illegal memory access")]]),
    ("unsupported_ptr_type", [[_has("unsupported ptr type")], [_has("cannot be accessed from triton")]]),
    ("incompatible_block_shape", [[_has("cannot make_shape_compatible")], [_has("incompatible dimensions")], [_has("equal ranks")], [_has("block type")]]),
    ("non_constexpr_arange_bound", [[_has("arange"), _has("constexpr")]]),
    ("undefined_symbol", [[_starts("nameerror")], [_has(" is not defined")], [_has("out of scope")], [_starts("unboundlocalerror")]]),
    ("unsupported_language_construct", [[_has("unsupportedlanguageconstruct")], [_has("simultaneous multiple comparison")]]),
    ("launch_signature_mismatch", [[_has("unrecognised")], [_has("unexpected keyword")], [_has("missing"), _has("argument")], [_has("grid"), _has("tuple")]]),
    ("invalid_triton_api", [[_has("module 'triton.language' has no attribute")], [_has("cannot call @triton.jit")], [_has("device option is deprecated")], [_has("tl.store"), _has("unsupported")]]),
    ("invalid_output_type", [[_has("unexpected output type")], [_has("return"), _has("tensor")]]),
    ("host_shape_error", [[_has("dimension out of range")], [_has("tuple index out of range")], [_has("not enough values to unpack")], [_has("invalid for input of size")], [_matches("size of tensor .* must match")], [_has("incompatible shapes for matmul")]]),
    ("triton_compilation_error", [[_starts("compilationerror")]]),
]


def failure_symptom(message: Column) -> Column:
    """Symptom of a failure text, null for null or empty text."""
    text = F.lower(message)

    out = F.when(message.isNull() | (message == ""), F.lit(None).cast("string"))
    for label, ways in SYMPTOM_RULES:
        hit = F.lit(False)
        for conditions in ways:
            every = F.lit(True)
            for holds in conditions:
                every = every & holds(text)
            hit = hit | every
        out = out.when(hit, label)
    return out.otherwise("python_runtime_error")


def strip_fences(text: Column) -> Column:
    """C4: the text without a Markdown fence around it."""
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    body = F.regexp_replace(bare, r"(?s)^```[^\n]*\n", "")
    return F.when(bare.startswith("```"), F.when(body.endswith("```"), F.regexp_replace(F.regexp_replace(body, r"```$", ""), r"\s+$", "")).otherwise(body)).otherwise(bare)


# What an answer to the generator prompt holds, a Python block or an object of one field, ``error``.
FENCE = r"(?is)```(?:python|py)\s*\n(.*?)```"
ERROR_JSON = r"""(?s)\{\s*"error"\s*:\s*"[^"]*"\s*\}"""


def parse_response(text: Column) -> Column:
    """``struct(status, code, detail)`` of a model answer.

    ``code``: the first block, stripped. ``unrealizable``: no block, but an error object, its text in
    ``detail``. Else ``parse_error`` with ``empty_fence``, ``bad_error_json`` or ``nothing_found``.
    """
    block = F.nullif(F.regexp_extract(text, FENCE, 0), F.lit(""))
    code = F.regexp_replace(F.regexp_extract(text, FENCE, 1), r"^\s+|\s+$", "")
    given = F.nullif(F.regexp_extract(text, ERROR_JSON, 0), F.lit(""))
    error = F.get_json_object(given, "$.error")
    cases = {"code": block.isNotNull() & (code != ""), "empty_fence": block.isNotNull(), "unrealizable": error.isNotNull(), "bad_error_json": given.isNotNull()}
    kind = F.lit("nothing_found")
    for name, holds in reversed(cases.items()):
        kind = F.when(holds, name).otherwise(kind)
    found = kind.isin("code", "unrealizable")
    return F.struct(F.when(found, kind).otherwise("parse_error").alias("status"), F.when(kind == "code", code).alias("code"), F.when(kind == "unrealizable", error).when(~found, kind).alias("detail"))


def structured_response(text: Column, schema: str, required: list[str]) -> Column:
    """``struct(status, value)`` of a JSON answer: empty, not JSON, schema (a required field is missing), or ok."""
    value = F.from_json(text, schema, {"mode": "PERMISSIVE"})
    is_json = F.try_parse_json(text).isNotNull()
    missing = F.lit(False)
    for name in required:
        missing = missing | value[name].isNull()
    status = F.when(text.isNull() | (F.trim(text) == ""), "empty").when(~is_json, "not_json").when(missing, "schema").otherwise("ok")
    return F.struct(status.alias("status"), F.when(status == "ok", value).alias("value"))


# Phrases of rate and quota errors.
RATE_HINTS = ("rate limit", "rate_limit", "quota", "429", "too many requests")


def is_rate_limited(message: Column) -> Column:
    """Whether a message speaks of a rate limit or quota."""
    return _any(F.lower(F.coalesce(message, F.lit(""))), *RATE_HINTS)


def last_usage(log: Column) -> Column:
    """``struct(input_tokens, output_tokens)`` of the last completed turn in a log of one JSON event a line; zeros without one."""
    events = F.filter(F.transform(F.split(log, "\n"), lambda line: F.from_json(line, "type string, usage struct<input_tokens:bigint,output_tokens:bigint>")), lambda e: e["type"] == "turn.completed")
    last = F.get(events, F.size(events) - 1)["usage"]
    return F.struct(F.coalesce(last["input_tokens"], F.lit(0)).alias("input_tokens"), F.coalesce(last["output_tokens"], F.lit(0)).alias("output_tokens"))


def preflight_verdict(passed: Column, error: Column, max_abs: Column, max_rel: Column, pct: Column, eager_ms: Column, inductor_ms: Column) -> Column:
    """``struct(accept, reason)`` of a preflight answer; null statistics mean that there are none.

    Reasons, of which the first counts: ``harness:<error>``, ``apart:<max_abs>/<max_rel>/<percent>``,
    ``failed`` (no statistics), ``no_timings``; null for accepted ones.
    """
    apart = F.format_string("apart:%.3e/%.3e/%.2f", max_abs, max_rel, pct)
    failed = F.when(~passed, F.when(max_abs.isNotNull(), apart).otherwise("failed"))
    untimed = F.when(F.least(eager_ms.isNotNull(), inductor_ms.isNotNull()) == F.lit(False), "no_timings")
    reason = F.coalesce(F.concat(F.lit("harness:"), error), failed, untimed)
    return F.struct(reason.isNull().alias("accept"), reason.alias("reason"))


def policy_of_inputs(category: Column, dtypes: Column) -> Column:
    """Tolerance policy from a category and the dtypes of its inputs."""
    whole = F.forall(dtypes, lambda d: d.isin("int8", "int16", "int32", "int64", "bool"))
    half = F.exists(dtypes, lambda d: d.isin("float16", "bfloat16"))
    return F.when(whole, "exact_integer").when(half, F.when(category == "reduction", "reduction_fp16").when(category == "fused_attention", "attention_softmax_fp16").otherwise("default_fp16")).when(category == "reduction", "reduction_fp32").otherwise("default_fp32")


def policy_of_form(form: Column, dtype: Column) -> Column:
    """Tolerance policy from a fusion form and its output dtype."""
    attention, reduction = form.isin("softmax_then_unary", "attention_qkv"), form == "unary_then_reduction"
    half = F.when(attention, "attention_softmax_fp16").when(reduction, "reduction_fp16").otherwise("default_fp16")
    return F.when((dtype == "int64") & ~attention, "exact_integer").when(dtype == "float16", half).when(reduction, "reduction_fp32").otherwise("default_fp32")
