"""Streams that fail and start again, silent jobs, running totals."""

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from proofmill.plans import describe
from proofmill.streaming import feeds


def _write(folder, name, rows):
    folder.mkdir(exist_ok=True)
    p = folder / name
    p.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
    at = 1_700_000_000 + len(list(folder.iterdir()))
    os.utime(p, (at, at))  # a feed reads files by age


@pytest.mark.parametrize("after", ["accepted", "quarantine", "nothing"])
def test_a_failure_between_both_writes_loses_and_repeats_nothing(spark, tmp_path, after):
    ddl, root, folder = "k int", str(tmp_path / "out"), tmp_path / "in"
    for f in range(3):
        _write(folder, f"{f}.json", [{"k": f * 10 + i} for i in range(10)] + ["{bad"])
    checks = {"small": F.col("k") % 10 < 7}
    good_parts = feeds.routed(checks)

    def failing(batch):
        parts = good_parts(batch)
        if batch.where("k >= 10").isEmpty():
            return parts
        fail = parts["accepted"].select(F.raise_error(F.lit("lost")).cast("int").alias("k"))
        return {"nothing": {"a": fail}, "accepted": {"accepted": parts["accepted"], "b": fail}, "quarantine": parts | {"c": fail}}[after]

    def start(parts):
        feed = feeds.read_feed(spark, str(folder), ddl, 1)
        return feed.writeStream.foreachBatch(feeds.by_batch(root, parts)).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()

    with pytest.raises(Exception, match="lost"):
        start(failing).awaitTermination()
    good, bad = feeds.ingested(spark, root, ddl)
    assert sorted(r["k"] for r in good.collect()) == list(range(7)) and bad.count() == 4  # the first batch only
    feeds.ingest(spark, str(folder), ddl, checks, root, 1).awaitTermination()
    feeds.ingest(spark, str(folder), ddl, checks, root, 1).awaitTermination()  # nothing new
    good, bad = feeds.ingested(spark, root, ddl)
    assert sorted(r["k"] for r in good.collect()) == [k for k in range(30) if k % 10 < 7]
    assert sorted((r["k"] is None, tuple(r["violations"])) for r in bad.collect()) == [(False, ("small",))] * 9 + [(True, ("malformed",))] * 3


def test_reading_before_anything_was_committed(spark, tmp_path):
    assert [x.count() for x in feeds.ingested(spark, str(tmp_path), "k int")] == [0, 0]


STATUS = "job_id string, status string, ts timestamp"


def _signs(folder, batches):
    for i, rows in enumerate(batches):
        _write(folder, f"{i}.json", [{"job_id": j, "status": s, "ts": f"2024-01-01T{t}:00"} for j, s, t in rows])


def _got(rows):
    return sorted((r["job_id"], r["status"], r["first_ts"].strftime("%H:%M"), r["ts"].strftime("%H:%M")) for r in rows)


@pytest.mark.parametrize("files", [1, 10])
def test_timers_end_silent_jobs_in_event_time(spark, tmp_path, files):
    _signs(tmp_path / "in", [
        [("done", "pending", "00:00"), ("silent", "pending", "00:01"), ("failed", "running", "00:02")],
        [("done", "running", "00:05"), ("done", "done", "00:09"), ("failed", "error", "00:08")],
        [("late", "pending", "00:30"), ("done", "running", "00:20")],
        [("late", "done", "00:41"), ("open", "running", "02:00")],
        [("silent", "done", "02:00")],
    ])
    stream = feeds.read_feed(spark, str(tmp_path / "in"), STATUS, files).drop("_corrupt_record")
    rows = feeds.drain(feeds.ended(stream, 600, "0 seconds")).collect()
    assert _got(rows) == [("done", "done", "00:00", "00:09"), ("failed", "error", "00:02", "00:08"), ("late", "timeout", "00:30", "00:40"), ("silent", "timeout", "00:01", "00:11")]


def test_timers_end_silent_jobs_by_the_clock_and_hold_over_a_restart(spark, tmp_path):
    folder, root = tmp_path / "in", str(tmp_path / "out")
    _signs(folder, [[("quick", "done", "00:00"), ("silent", "running", "00:00")]])

    def run(wanted):
        stream = feeds.read_feed(spark, str(folder), STATUS).drop("_corrupt_record")
        out = feeds.ended(stream, 6, event_time=False)
        sink = feeds.by_batch(root, lambda b: {"jobs": b})
        query = feeds.start_with_timers(out.writeStream.foreachBatch(sink).option("checkpointLocation", f"{root}/checkpoint").trigger(processingTime="1 second"), spark)
        until = time.time() + 60
        while time.time() < until and feeds.committed(spark, root, "jobs", out.schema).count() < wanted:
            time.sleep(0.5)
        query.stop()
        return {r["job_id"]: r["status"] for r in feeds.committed(spark, root, "jobs", out.schema).collect()}

    assert run(1)["quick"] == "done"
    _write(folder, "late.json", [{"job_id": "other", "status": "running", "ts": "2024-01-01T00:05:00"}])  # a sign of another job
    assert run(3) == {"quick": "done", "silent": "timeout", "other": "timeout"}


def test_an_idle_attempt_sequence_is_closed(spark, tmp_path):
    row = lambda d, n, t, status=None: {"dataset_id": d, "attempt_n": n, "compile_status": "success", "correctness_status": status, "ts": f"2024-01-01T{t}:00"}
    _write(tmp_path / "in", "0.json", [row("idle", 0, "00:00"), row("idle", 1, "00:01", "failed"), row("won", 0, "00:00", "passed")])
    _write(tmp_path / "in", "1.json", [row("other", 0, "03:00")])
    _write(tmp_path / "in", "2.json", [row("other", 1, "06:00", "passed")])
    stream = feeds.read_feed(spark, str(tmp_path / "in"), "dataset_id string, attempt_n int, compile_status string, correctness_status string, ts timestamp", 1)
    got = {r["dataset_id"]: (r["n_attempts"], r["final_outcome"], r["closed_by"]) for r in feeds.drain(feeds.fold_attempts(stream)).collect()}
    assert got == {"idle": (2, "numeric_fail", "timeout"), "won": (1, "compiled_correct", "pass"), "other": (1, "runtime_fail", "timeout")} or got["other"] == (2, "compiled_correct", "pass") and got["idle"] == (2, "numeric_fail", "timeout")


def test_append_of_new_keys_survives_a_failed_batch(spark, tmp_path, monkeypatch):
    folder, root, ddl = tmp_path / "in", str(tmp_path / "out"), "dataset_id string, v int"
    for f in range(4):
        _write(folder, f"{f}.json", [{"dataset_id": str(k), "v": f} for k in range(f * 5, f * 5 + 10)] * 2)
    stream = lambda: feeds.read_feed(spark, str(folder), ddl, 1).drop("_corrupt_record")
    real, state = feeds.by_batch, {"left": 2}

    def breaking(root, parts):
        inner = real(root, parts)

        def sink(batch, n):
            state["left"] -= 1
            inner(batch, n)
            if not state["left"]:
                raise RuntimeError("lost after the write")

        return sink

    monkeypatch.setattr(feeds, "by_batch", breaking)
    existing = spark.createDataFrame([("3",), ("24",)], "dataset_id string")
    with pytest.raises(Exception, match="lost after"):
        feeds.append_new(stream(), root, existing=existing).awaitTermination()
    monkeypatch.undo()
    feeds.append_new(stream(), root, existing=existing).awaitTermination()
    rows = feeds.committed(spark, root, "rows", stream().schema).collect()
    assert sorted(int(r["dataset_id"]) for r in rows) == [k for k in range(25) if k not in (3, 24)]
    assert {r["dataset_id"]: r["v"] for r in rows}["5"] == 0  # the first row of a key


def test_running_totals_over_many_ranges(spark):
    r = random.Random(3)
    data = [(i, r.random() < 0.4, None if i % 5 else "x") for i in range(3000)]
    shuffled = r.sample(data, len(data))
    df = spark.createDataFrame(shuffled, "seq int, ok boolean, tag string").repartition(7)
    got = describe.running_totals(df, {"good": F.col("ok"), "tagged": F.col("tag") == "x"}, ["seq"]).orderBy("seq").collect()
    good = tagged = 0
    for i, (row, (seq, ok, tag)) in enumerate(zip(got, data, strict=True)):
        good, tagged = good + ok, tagged + (tag == "x")
        assert (row["seq"], row["n"], row["good"], row["tagged"]) == (seq, i + 1, good, tagged)
    assert describe.running_totals(df.limit(0), {"good": F.col("ok")}, ["seq"]).count() == 0
