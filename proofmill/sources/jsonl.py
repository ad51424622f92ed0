"""JSON Lines and text sources and sinks."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from proofmill.operators.constraints import violations
from proofmill.schemas import schema
from proofmill.tables import cut

CORRUPT = "_corrupt_record"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) not in (None, [])


#: Files' parts of which the offsets are broadcast at most; more are shuffled.
SMALL = 100_000


class Read(NamedTuple):
    """What one pass over JSON Lines gives: rows that keep all checks, and a table of the others by line."""

    rows: DataFrame
    errors: DataFrame


def _read(spark: SparkSession, path: str, ddl: str, judge: Callable[[], Column], ids: tuple[str, ...], more: dict[str, Column] | None = None) -> Read:
    """Parse each line of ``path`` once; ``judge`` gives the names of what a well-formed line breaks, over the fields and ``_value``, its text.

    Lines are numbered by file, blank ones too. A scan meets the lines of a part of a file in order,
    so a line's place in its part is that of its running number; the lines of earlier parts of the
    file are added from their counts, one row for each part. All is written once as Parquet, as
    places and counts must be of one scan; rows are then read from there, not parsed again.
    """
    names = schema(ddl).names
    wide = StructType([*schema(ddl).fields, StructField(CORRUPT, StringType())])
    lines = spark.read.text(path).select(F.col("value").alias("_value"), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"))
    blank = F.col("_value").rlike(r"^\s*$")
    parsed = lines.withColumn("_row", F.when(~blank, F.from_json("_value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})))
    flat = parsed.select("_value", "_path", "_start", "_at", F.col("_row").isNull().alias("_none"), "_row.*").withColumn("_malformed", F.col("_none") | F.col(CORRUPT).isNotNull())
    kind = F.when(blank, "blank").when(F.col("_malformed"), "malformed").when(F.size("_broken") > 0, "constraint").otherwise("good")
    stored = flat.withColumn("_broken", F.when(~F.col("_malformed"), judge())).withColumns({"_kind": kind, **(more or {})})
    stored = stored.withColumn("_value", F.when(F.col("_kind").isin("malformed", "constraint"), F.col("_value"))).drop("_none", "_malformed", CORRUPT)
    stored = cut(stored)
    parts = stored.groupBy("_path", "_start").agg(F.count("*").alias("n"), F.min("_at").alias("first"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("_path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = parts.select("_path", "_start", (earlier - F.col("first") + 1).alias("_shift"))
    shifts = F.broadcast(shifts) if parts.count() <= SMALL else shifts
    bad = stored.where(F.col("_kind").isin("malformed", "constraint")).join(shifts, ["_path", "_start"])
    recovered = [F.coalesce(F.get_json_object("_value", f"$.{i}"), F.col(i).cast("string") if i in names else F.lit(None)).alias(i) for i in ids]
    line = F.col("_at") + F.col("_shift")
    what = F.when(F.col("_kind") == "malformed", "malformed").otherwise(F.array_join("_broken", ", "))
    errors = bad.select(*recovered, F.col("_kind").alias("error_type"), F.concat(F.col("_path"), F.lit(":"), line.cast("string"), F.lit(": "), what).alias("message"), F.col("_path").alias("corpus_path"), line.alias("line_no"), F.col("_value").alias("line"), F.current_timestamp().alias("timestamp"))
    return Read(stored.where("_kind = 'good'").select(*names, *(more or {})), errors)


def _checked(checks: dict[str, Column] | None) -> Callable[[], Column]:
    return lambda: violations(checks) if checks else F.array().cast("array<string>")


def _or_fail(found: Read) -> DataFrame:
    """The rows, or an error that names the first bad line as ``path:line``."""
    first = found.errors.orderBy("corpus_path", "line_no").select("message").first()
    if first:
        raise ValueError(first["message"])
    return found.rows


def read_strict(spark: SparkSession, path: str, ddl: str, checks: dict[str, Column] | None = None) -> DataFrame:
    """Rows of ``path``; a malformed line, or one that breaks a check, is an error that names the first as ``path:line``.

    Blank lines are left out; a missing path has no rows. Lines are parsed once, before this returns.
    """
    if not _exists(spark, path):
        return spark.createDataFrame([], schema(ddl))
    return _or_fail(_read(spark, path, ddl, _checked(checks), ()))


def read_tolerant(spark: SparkSession, path: str, ddl: str, checks: dict[str, Column] | None = None, ids: tuple[str, ...] = ("dataset_id", "example_id")) -> tuple[DataFrame, DataFrame]:
    """Good rows, and a table of the other lines: ids, error_type, message, corpus_path, line_no, line, timestamp.

    ``line_no`` counts from 1 within each file, however it is split. Ids of a bad line are recovered
    where its JSON can be parsed that far.
    """
    return tuple(_read(spark, path, ddl, _checked(checks), ids))


def read_lenient(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """S3: rows that can be read; malformed lines are dropped, see ``dropped_lines``."""
    return spark.read.schema(schema(ddl)).option("mode", "DROPMALFORMED").json(path)


def dropped_lines(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """S3: ``corpus_path, line_no, line`` of the lines that ``read_lenient`` leaves out, to count or to warn of."""
    return _read(spark, path, ddl, _checked(None), ()).errors.select("corpus_path", "line_no", "line")


def read_either(spark: SparkSession, path: str, slim: str, full: str, slim_checks: dict[str, Column] | None = None, full_checks: dict[str, Column] | None = None, optional: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the slim or else of the full schema, with ``is_full``; an error names the first line that fits neither as ``path:line``.

    A row fits a schema if it has each of its fields, not null but for ``optional`` ones, no other
    field, and keeps the schema's checks. Lines are parsed once, by the full schema.
    """
    names = {"slim": schema(slim).names, "full": schema(full).names}

    def broken(kind: str, checks: dict[str, Column] | None) -> Column:
        other = F.array_except(F.json_object_keys("_value"), F.array(*map(F.lit, names[kind])))
        needed = {f"{kind}: {c} is missing": F.col(c).isNotNull() for c in names[kind] if c not in optional}
        own = {f"{kind}: {k}": v for k, v in (checks or {}).items()}
        return F.concat(violations(needed | own), F.transform(other, lambda c: F.concat(F.lit(f"{kind}: unknown field "), c)))

    as_slim, as_full = broken("slim", slim_checks), broken("full", full_checks)
    either = F.when((F.size(as_slim) == 0) | (F.size(as_full) == 0), F.array().cast("array<string>")).otherwise(F.concat(as_slim, as_full))
    return _or_fail(_read(spark, path, full, lambda: either, (), {"is_full": F.size(as_slim) > 0}))


def read_labels(spark: SparkSession, root: str, ddl: str, name: str = "eval_rows.jsonl") -> DataFrame:
    """``<root>/<label>/<name>`` of all labels; ``model_label`` is the folder's name."""
    rows = spark.read.schema(schema(ddl)).json(f"{root}/*/{name}")
    return rows.withColumn("model_label", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))


#: Parts of the index of keys beside a table.
BUCKETS = 64


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(BUCKETS)).cast("int")


def known_keys(spark: SparkSession, path: str, new: DataFrame, key: str) -> DataFrame:
    """Keys that the JSON Lines of ``path`` may have in common with ``new``.

    An index in ``<path>/_keys`` (a folder that readers of ``path`` pass over) holds the keys of
    all files but the latest, by hash. Files that it lacks are read once and added; then only the parts
    that keys of ``new`` fall into are read. An interrupted run leaves at most keys that are there twice.
    """
    index, listed = f"{path.rstrip('/')}/_keys/by_hash", f"{path.rstrip('/')}/_keys/files"
    kind = dict(new.dtypes)[key]
    files = spark.read.text(path).inputFiles()
    done = {r["file"] for r in spark.read.schema("file string").parquet(listed).collect()} if _exists(spark, listed) else set()
    fresh = sorted(set(files) - done)
    if fresh:
        keys = spark.read.schema(new.select(key).schema).json(fresh).distinct()
        keys.withColumn("bucket", _bucket(key)).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(index)
        spark.createDataFrame([(f,) for f in fresh], "file string").coalesce(1).write.mode("append").parquet(listed)
    touched = [r["bucket"] for r in new.select(_bucket(key).alias("bucket")).distinct().collect()]
    return spark.read.schema(f"`{key}` {kind}, bucket int").parquet(index).where(F.col("bucket").isin(touched)).select(key)


def append(new: DataFrame, path: str, key: str = "dataset_id", on_duplicate: str = "skip", checks: dict[str, Column] | None = None) -> DataFrame:
    """Append rows whose key ``path`` lacks; returns what was written. ``raise`` fails on a duplicate, ``append`` writes all.

    Only keys are compared, see ``known_keys``; a null key counts as new each time. Within ``new`` any one
    row of a key counts. Rows that break a check are an error, and nothing is written.
    """
    spark = new.sparkSession
    if on_duplicate not in ("skip", "raise", "append"):
        raise ValueError(f"on_duplicate must be skip, raise or append, not {on_duplicate!r}")
    new = cut(new)
    if checks:
        first = new.select(key, violations(checks).alias("broken")).where(F.size("broken") > 0).first()
        if first:
            raise ValueError(f"{key} {first[key]}: {', '.join(first['broken'])}")
    if on_duplicate != "append":
        rows = new.where(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(new.where(F.col(key).isNull()))
        known = known_keys(spark, path, new, key) if _exists(spark, path) else new.select(key).limit(0)
        if on_duplicate == "raise" and (rows.count() < new.count() or not new.join(known, key, "left_semi").isEmpty()):
            raise ValueError(f"duplicate {key}")
        new = cut(rows.join(known, key, "left_anti"))
    new.write.mode("append").option("ignoreNullFields", "false").json(path)
    return new


def routed_write(rows: DataFrame, accepted: str, rejected: str, stage: str = "stage") -> None:
    """Rows without a stage are accepted; the others are written by the stage that rejected them."""
    rows.where(F.col(stage).isNull()).drop(stage, "reason", "message").write.mode("append").option("ignoreNullFields", "false").json(accepted)
    rows.where(F.col(stage).isNotNull()).write.mode("append").partitionBy(stage).json(rejected)


def unwrap(rows: DataFrame, column: str = "candidate") -> DataFrame:
    """The fields of a struct column as columns."""
    return rows.select(f"{column}.*")


def write_training(rows: DataFrame, path: str) -> None:
    """One JSON object a line, null fields included."""
    rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """First token of each line that is neither blank nor a comment."""
    line = F.trim(F.regexp_replace("value", r"\s+", " "))
    return spark.read.text(path).select(line.alias("line")).where((F.col("line") != "") & ~F.col("line").startswith("#")).select(F.split("line", " ")[0].alias("entry"))


# Folders that are not searched.
SKIPPED = [".git", "tests", "docs", "examples", "benchmarks", "__pycache__"]


def read_sources(spark: SparkSession, root: str, glob: str = "*.py") -> DataFrame:
    """``file_path`` and ``text`` of all Python files (or those that ``glob`` names) below ``root``, but for those in a skipped folder."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("wholetext", "true").text(root)
    path = F.col("_metadata.file_path")
    below = F.regexp_replace(path, r"^.*?" + root.rstrip("/").split(":")[-1].replace(".", r"\."), "")
    return files.select(path.alias("file_path"), F.col("value").alias("text"), below.alias("below")).where(~F.arrays_overlap(F.split("below", "/"), F.array(*map(F.lit, SKIPPED)))).drop("below")
