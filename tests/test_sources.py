"""Lines named by place however files are split; two schemas; the index of known keys."""

import json
import random

import pytest
from pyspark.sql import functions as F

from proofmill.sources import jsonl

DDL = "dataset_id string, n int"


@pytest.fixture
def small_parts(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def _file(path, seed, n):
    """Lines of many sizes with blanks and faults; returns the faults as (line_no, type)."""
    r, lines, bad = random.Random(seed), [], []
    for i in range(1, n + 1):
        kind = r.choice(["good"] * 6 + ["blank", "cut", "check", "kind", "null"])
        line = json.dumps({"dataset_id": f"d{i}", "n": -i if kind == "check" else i, "more": "x" * r.randint(0, 90)})
        lines.append({"blank": "  ", "cut": line[:-3], "kind": line.replace(f": {i},", ': "z",'), "null": "null"}.get(kind, line))
        if kind in ("cut", "kind", "null", "check"):
            bad.append((i, "constraint" if kind == "check" else "malformed"))
    path.write_bytes("\n".join(lines).encode() + b"\n")
    return bad


def test_every_bad_line_is_named_in_files_of_many_parts(spark, tmp_path, small_parts):
    want = {f"{k}.jsonl": _file(tmp_path / f"{k}.jsonl", k, n) for k, n in enumerate((400, 37, 1))}
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 2 and len(want["0.jsonl"]) > 50
    good, bad = jsonl.read_tolerant(spark, str(tmp_path), DDL, {"positive": F.col("n") > 0})
    rows = bad.collect()
    assert sorted((r["corpus_path"].rpartition("/")[2], r["line_no"], r["error_type"]) for r in rows) == sorted((f, i, t) for f, ls in want.items() for i, t in ls)
    for r in rows:
        assert r["message"] == f"{r['corpus_path']}:{r['line_no']}: {'malformed' if r['error_type'] == 'malformed' else 'positive'}" and r["timestamp"] is not None
        assert (r["dataset_id"] == f"d{r['line_no']}") or r["line"] == "null" or not r["line"].endswith("}")
    assert good.columns == ["dataset_id", "n"] and good.count() + len(rows) == sum(1 for p in tmp_path.iterdir() for x in p.read_text().splitlines() if x.strip())
    assert jsonl.dropped_lines(spark, str(tmp_path), DDL).count() == sum(t == "malformed" for ls in want.values() for _, t in ls)


def test_strict_read_names_the_first_bad_line(spark, tmp_path, small_parts):
    p = tmp_path / "x.jsonl"
    lines = [json.dumps({"dataset_id": str(i), "n": i}) for i in range(300)]
    p.write_text("\n".join([*lines[:100], "", *lines[100:]]))
    assert sorted(r["n"] for r in jsonl.read_strict(spark, str(p), DDL, {"whole": F.col("n") >= 0}).collect()) == list(range(300))
    with pytest.raises(ValueError, match=r"x\.jsonl:252: below$"):
        jsonl.read_strict(spark, str(p), DDL, {"below": F.col("n") < 250})
    lines[200] = "{oops"
    p.write_text("\n".join([*lines[:100], "", *lines[100:]]))
    with pytest.raises(ValueError, match=r"x\.jsonl:202: malformed$"):
        jsonl.read_strict(spark, str(p), DDL)
    assert jsonl.read_strict(spark, str(tmp_path / "none"), DDL).count() == 0
    (tmp_path / "empty.jsonl").write_text("")
    assert jsonl.read_strict(spark, str(tmp_path / "empty.jsonl"), DDL).count() == 0


def test_two_schemas_and_their_checks(spark, tmp_path):
    slim, full = "a int, b string", "a int, b string, c int, d string"
    read = lambda *rows, **more: (tmp_path / "e.jsonl").write_text("\n".join(map(json.dumps, rows))) and sorted(map(tuple, jsonl.read_either(spark, str(tmp_path / "e.jsonl"), slim, full, **more).collect()))
    rows = [{"a": 1, "b": "x"}, {"a": 2, "b": "y", "c": 3, "d": "z"}]
    assert read(*rows) == [(1, "x", None, None, False), (2, "y", 3, "z", True)]
    # half of the full fields, a missing slim field, a field of neither, and faults of each branch
    for wrong, what in (({"a": 1, "b": "x", "c": 3}, "full: d is missing"), ({"a": 1}, "slim: b is missing"), ({"a": 1, "b": "x", "q": 1}, "slim: unknown field q"), ([1], "malformed")):
        with pytest.raises(ValueError, match=rf"e\.jsonl:3: .*{what}"):
            read(*rows, wrong)
    assert read({"a": 1, "b": "x", "c": 3}, optional=("d",)) == [(1, "x", 3, None, True)]
    with pytest.raises(ValueError, match=r":1: slim: small, full: c is missing"):
        read(rows[0], slim_checks={"small": F.col("a") < 1})
    with pytest.raises(ValueError, match=r":2: .*full: even"):
        read(*rows, full_checks={"even": F.col("c") % 2 == 0})


def test_append_reads_new_files_and_touched_parts_only(spark, tmp_path):
    out = str(tmp_path / "out")
    batch = lambda keys: spark.createDataFrame([(k, 1) for k in keys], "dataset_id string, v int")
    for at in range(0, 200, 50):
        assert jsonl.append(batch(map(str, range(at, at + 60))), out).count() == (60 if at == 0 else 50)
    assert spark.read.json(out).count() == 210 and "bucket" not in spark.read.json(out).columns
    found = jsonl.known_keys(spark, out, batch(["7", "900"]), "dataset_id")
    assert found.where("dataset_id = '7'").count() == 1 and found.count() < 40
    # files that another writer added are indexed, too
    batch(["900"]).write.mode("append").json(out)
    assert jsonl.append(batch(["7", "900", "901"]), out).collect()[0]["dataset_id"] == "901"
    assert jsonl.append(spark.createDataFrame([(None, 1), (None, 2)], "dataset_id string, v int"), out).count() == 2
    with pytest.raises(ValueError, match="dataset_id 5: v"):
        jsonl.append(spark.createDataFrame([("5", -1)], "dataset_id string, v int"), out, checks={"v": F.col("v") > 0})
