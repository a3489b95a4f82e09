"""Stream sinks and states: replays, late rows, and states that end."""

from __future__ import annotations

import datetime as dt

import pytest

from foliolens.session import work_folder
from foliolens.streaming import flows, guards

DAY = dt.datetime(2024, 1, 1)


def at(hours):
    return DAY + dt.timedelta(hours=hours)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_repeated_batch_of_the_upsert_changes_nothing(spark, tmp_path):
    write, path = flows.upsert_batch(str(tmp_path / "t")), str(tmp_path / "t")
    first, second = [("a", 1), ("b", 2)], [("b", 5), ("c", 7)]
    batches = [spark.createDataFrame(x, "k string, n int") for x in (first, second)]
    for i in (0, 1, 0, 1, 1):  # the driver failed after writing and runs batches again
        write(batches[i], i)
        if i:
            assert rows_of(flows.latest(spark, path, ["k"])) == [("a", 1), ("b", 5), ("c", 7)]


def test_repeated_batch_of_rates_keeps_counts_and_late_rows(spark, tmp_path):
    path = str(tmp_path / "rates")
    write = flows.rates_batch(path, "at", ["rule"], "1 hour", "2 hours")
    # the watermark of batches 1 and 2 is 3:30
    batches = [[(at(0.1), "x"), (at(5.5), "x")], [(at(3.6), "x"), (at(3.4), "late")], [(at(9), "y"), (at(3.7), "x")], []]
    frames = [spark.createDataFrame(b, "at timestamp, rule string") for b in batches]
    for i in (0, 1, 1, 2, 0, 2, 3):
        write(frames[i], i)
    rates = rows_of(flows.read_rates(spark, path, ["rule"]).select("window_start", "rule", "n"))
    assert rates == [(at(0), "x", 1), (at(3), "x", 2), (at(5), "x", 1), (at(9), "y", 1)]
    assert rows_of(flows.read_late(spark, path)) == [(at(3.4), "late")]


def drain(spark, name, parts, make):
    """Run a stream in micro-batches; its rows and the number of states after each."""
    folder, out = work_folder(spark, name), work_folder(spark, name)
    states = []

    def start():
        query = flows.to_parquet(make(flows.file_stream(spark, folder, "*.parquet", parts[0].schema)), out + "/t", out + "/s")
        query.awaitTermination()
        states.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
        return query

    flows.in_steps(parts, folder, start)
    return spark.read.parquet(out + "/t"), states


def guard_events(spark, rows):
    """(task, seq, kind, hours) as events; a state record admits anything new."""
    full = [(t, s, k, "image_generate", None, "b" * 64, None, None, *(("transient_retry", 3, 0, "a" * 64, True, "pass", "none") if k == "state" else [None] * 7), at(h)) for t, s, k, h in rows]
    return spark.createDataFrame(full, guards.EVENT_SCHEMA + ", at timestamp")


def test_guard_state_ends_with_its_time_to_live(spark):
    parts = [[(1, 1, "state", 0), (1, 2, "call", 5), (2, 1, "state", 1)], [(1, 3, "call", 11), (1, 4, "state", 11.5), (1, 5, "call", 12)],
             [(1, 6, "call", 21.4), (1, 5, "call", 21), (2, 2, "call", 30), (1, 7, "call", 31)], [(9, 1, "call", 100)]]
    got, states = drain(spark, "guard", [guard_events(spark, p) for p in parts], lambda s: guards.retry_guard_stream(s, ["image_generate"], "at", "10 hours", "1 hour"))
    want = {(1, 2, "transient_retry"), (1, 3, "state_missing"), (1, 5, "transient_retry"), (1, 6, "transient_retry"), (2, 2, "state_missing"), (1, 7, "state_missing"), (9, 1, "state_missing")}
    assert {(r["task_id"], r["seq"], r["reason"]) for r in got.collect()} == want | {(1, 5, "late_event")}
    batch = guards.retry_guard(guard_events(spark, [r for p in parts for r in p if r != (1, 5, "call", 21)]), ["image_generate"], event_time="at", ttl="10 hours")
    assert {(r["task_id"], r["seq"], r["reason"]) for r in batch.collect()} == want
    assert states[-1] < max(states)  # timers have removed the states of tasks 1 and 2, that of task 9 is left


def test_ledger_of_a_forgotten_workflow_must_start_anew(spark):
    import hashlib
    digest = lambda s, p: hashlib.sha256(f"1~{s}~{p}".encode()).hexdigest()
    chain, last = [], guards.HEADER
    for seq, hours in enumerate((0, 1, 2, 40, 41)):
        chain.append((1, seq, f"p{seq}", last, digest(seq, f"p{seq}"), at(hours)))
        last = chain[-1][4]
    schema = "workflow_id bigint, seq bigint, payload string, prev_hash string, entry_hash string, at timestamp"
    parts = [spark.createDataFrame(p, schema) for p in (chain[:2], chain[2:4], chain[4:])]
    got, _ = drain(spark, "ledger", parts, lambda s: guards.ledger_stream(s, "at", "24 hours", "1 hour"))
    assert rows_of(got) == [(1, 3, "chain_mismatch")]


def test_keep_first_takes_an_early_row_that_arrives_late(spark):
    parts = [[("k", 5, at(3)), ("m", 1, at(3))], [("k", 2, at(2.5)), ("k", 9, at(3.2))], [("k", 7, at(30)), (None, 0, at(500))]]
    frames = [spark.createDataFrame(p, "k string, n int, at timestamp") for p in parts]
    got, _ = drain(spark, "first", frames, lambda s: flows.keep_first(s, ["k"], "at", "4 hours", ["n"], "1 hour"))
    assert rows_of(got) == [("k", 2, at(2.5)), ("k", 7, at(30)), ("m", 1, at(3))]
    batch = flows.keep_first(frames[0].unionByName(frames[1]).unionByName(frames[2]), ["k"], "at", "4 hours", ["n"])
    assert rows_of(batch.where("k IS NOT NULL")) == rows_of(got)


def test_shared_folder_is_required_off_local_sessions(spark, monkeypatch):
    class Other:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"getConf": staticmethod(lambda: type("C", (), {"get": staticmethod(lambda *a: None)})), "master": "spark://x:7077"})  # noqa: N815
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        work_folder(Other, "x")
