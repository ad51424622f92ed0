"""Derived identifiers as column expressions: name-based UUIDs, canonical JSON, seeds."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Namespaces of existing identifiers.
EXAMPLE = "00000000-0000-0000-0000-000000000eab"
DATASET = "00000000-0000-0000-0000-000000000da7"
SKELETON = "00000000-0000-0000-0000-000000000c01"
EVAL_SPEC = "00000000-0000-0000-0000-000000000eaa"


def uuid5(namespace: str, name: Column) -> Column:
    """The version-5 UUID of ``name`` (as UTF-8) in ``namespace``."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def example_id(code: Column) -> Column:
    """Identifier of a code text, from the hexadecimal digest of its bytes."""
    return uuid5(EXAMPLE, F.sha2(code, 256))


def seed_of(uuid: Column) -> Column:
    """The UUID as a 128-bit integer, modulo 2^31 - 1, by 16-bit parts."""
    plain, out = F.replace(uuid, F.lit("-")), F.lit(0).cast("bigint")
    for i in range(8):
        out = (out * 65536 + F.conv(F.substring(plain, 4 * i + 1, 4), 16, 10).cast("bigint")) % (2**31 - 1)
    return out


def skeleton_spec_id(category: Column, axes: list[Column], shapes: Column, dtypes: Column) -> Column:
    """Identifier of a skeleton spec from its pipe-joined content."""
    dims = F.array_join(F.transform(shapes, lambda s: F.array_join(s.cast("array<string>"), "x")), ",")
    return uuid5(SKELETON, F.concat_ws("|", category, *axes, dims, F.array_join(dtypes, ",")))


@F.pandas_udf(StringType())
def _escaped(text: pd.Series) -> pd.Series:
    """JSON with every character outside ASCII as an escape."""
    return text.map(lambda t: None if t is None else json.dumps(json.loads(t), sort_keys=True, separators=(",", ":")))


def canonical_json(fields: dict[str, Column]) -> Column:
    """Compact JSON with sorted keys and ASCII characters only; null fields stay.

    Spark's own JSON serves plain ASCII; only other rows go through a Python helper.
    """
    own = F.to_json(F.struct(*[c.alias(k) for k, c in sorted(fields.items())]), {"ignoreNullFields": "false"})
    return F.when(own.rlike(r"[^\x20-\x7e]"), _escaped(own)).otherwise(own)


def dataset_id(fields: dict[str, Column]) -> Column:
    """Identifier of a whole record, from the digest of its canonical JSON."""
    return uuid5(DATASET, F.sha2(canonical_json(fields), 256))


@F.pandas_udf(StringType())
def _spaced(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else json.dumps({k: json.loads(v) if k == "form_metadata" and isinstance(v, str) else v for k, v in json.loads(t).items()}, sort_keys=True))


def eval_spec_id(fields: dict[str, Column]) -> Column:
    """I4: identifier of an evaluation spec; its JSON has spaces behind commas and colons, ``form_metadata`` may be JSON text."""
    own = F.to_json(F.struct(*[c.alias(k) for k, c in sorted(fields.items())]), {"ignoreNullFields": "false"})
    return uuid5(EVAL_SPEC, _spaced(own))
