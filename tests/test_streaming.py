"""Streams over many small files that are not in time order."""

import pytest
from pyspark.sql import functions as F

from tidebook.streaming import flows, sinks, timed


def test_dedupe_drops_nothing_late_and_no_repeat_returns(spark, tmp_path):
    hours = [50, 1, 30, 0, 60, 2, 50, 1]  # of event ids 0..5, then 0 and 1 again: late ones, and repeats hours apart
    for i, hour in enumerate(hours):
        rows = spark.createDataFrame([(i % 6, hour * 3600)], "event_id long, s long").select("event_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"))
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    stream = flows.events(spark, str(tmp_path / "events"), per_trigger=1)
    got = flows.drained(flows.deduplicated(stream, ["event_id"]), "append")
    assert sorted(r.event_id for r in got.select("event_id").collect()) == list(range(6))
    assert sum(f.startswith("file:") and "/flow-" in f for f in got.inputFiles()) >= 6


def test_an_empty_stream_has_an_empty_result(spark, tmp_path):
    spark.createDataFrame([], "event_id long, ts timestamp_ntz").write.parquet(str(tmp_path / "events"))
    stream = flows.events(spark, str(tmp_path / "events"))
    assert flows.drained(flows.deduplicated(stream, ["event_id"]), "append").count() == 0


def _files(spark, path, rows, schema):
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)


def test_stateful_flows_carry_state_over_batches(spark, tmp_path):
    import tidebook
    from pyspark import cloudpickle
    from tests.test_operators import FRAMES

    cloudpickle.register_pickle_by_value(tidebook)
    read = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    schema = "stream long, ordinal long, seq long, recovery boolean"
    rows = [(1, i, s, r) for i, (s, r, _) in enumerate(FRAMES)]
    _files(spark, str(tmp_path / "v"), [rows[:3], rows[3:8], rows[8:]], schema)
    got = flows.drained(flows.verdicts(read("v", schema)), "append").orderBy("ordinal").collect()
    assert [r.verdict for r in got] == [v for *_, v in FRAMES]

    schema = "market long, ordinal long, ms long, kind string, side string, price long, delta long"
    book = [(1, 1, 0, "delta", "yes", 400_000, 5), (1, 2, 0, "delta", "no", 550_000, 7), (1, 3, 1, "delta", "yes", 400_000, -6), (1, 4, 2, "delta", "yes", 300_000, 1), (1, 5, 3, "reset", None, None, None), (1, 6, 4, "delta", "no", 500_000, 2), (1, 7, 5, "down", None, None, None)]
    _files(spark, str(tmp_path / "b"), [book[:2], book[2:5], book[5:]], schema)
    got = flows.drained(flows.books(read("b", schema)), "append").orderBy("ordinal").collect()
    assert [(r.valid, r.bid, r.bid_size, r.ask, r.ask_size) for r in got] == [
        (True, 400_000, 5, None, None), (True, 400_000, 5, 450_000, 7), (False, None, None, None, None), (False, None, None, None, None), (True, None, None, None, None), (True, None, None, 500_000, 2), (False, None, None, None, None)]


def _timed(spark, path, rows, schema):
    """A stream over files of rows, one a batch, with their seconds as the instant."""
    _files(spark, path, rows, schema)
    return timed.marked(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(path).withColumn("at", F.timestamp_millis("t")), "0 seconds").drop("t")


def test_recovery_episodes_close_at_the_last_market_or_by_the_clock(spark, tmp_path):
    schema = "stream long, ordinal long, t long, kind string, market long, affected array<long>"
    one = [
        (10, "gap", None, [7, 8]), (20, "gap", None, [9]), (25, "frame", 1, None), (30, "request", None, None), (31, "request", None, None), (40, "snapshot", 9, None), (41, "snapshot", 7, None),
        (42, "snapshot", 7, None), (50, "snapshot", 8, None), (55, "request", None, None),
        (60, "gap", None, [7]), (160, "frame", 1, None), (165, "request", None, None), (170, "snapshot", 7, None), (180, "gap", None, [7, 7]), (185, "unavailable", None, None), (190, "request", None, None),
        (200, "gap", None, []), (210, "end", None, None), (220, "gap", None, [1]), (230, "request", None, None), (329, "frame", 1, None), (330, "gap", None, [2]),
    ]
    rows = [(1, i, *r) for i, r in enumerate(one)] + [(2, 100, 30, "gap", None, [1, 2]), (3, 101, 9999, "frame", None, None)]
    stream = _timed(spark, str(tmp_path / "r"), [rows[:4] + rows[-2:-1], rows[4:12], rows[12:-2], rows[-1:]], schema)
    got = sorted((r.stream, r.episode, r.ms, r.event, r.state, r.outstanding, r.snapshots, r.withheld) for r in flows.drained(timed.episodes(stream, 100), "append").collect())
    assert got == sorted([
        (1, 1, 10, "opened", "degraded", 2, 0, 0), (1, 1, 30, "requested", "recovering", 2, 0, 2), (1, 1, 41, "snapshot", "recovering", 1, 1, 2), (1, 1, 50, "completed", "healthy", 0, 2, 2),
        (1, 2, 60, "opened", "degraded", 1, 0, 0), (1, 2, 160, "timeout", "degraded", 1, 0, 0),
        (1, 3, 180, "opened", "degraded", 1, 0, 0), (1, 3, 185, "unavailable", "degraded", 1, 0, 0),
        (1, 4, 200, "opened", "degraded", 0, 0, 0), (1, 4, 210, "superseded", "closed", 0, 0, 0),
        (1, 5, 220, "opened", "degraded", 1, 0, 0), (1, 5, 230, "requested", "recovering", 1, 0, 0), (1, 5, 330, "timeout", "degraded", 1, 0, 1), (1, 6, 330, "opened", "degraded", 1, 0, 0),
        (1, 6, 430, "timeout", "degraded", 1, 0, 0),  # no frame of its own after 330: the clock of the others
        (2, 1, 30, "opened", "degraded", 2, 0, 0), (2, 1, 130, "timeout", "degraded", 2, 0, 0),
    ])


def test_samples_on_a_clock_without_events(spark, tmp_path):
    schema = "market long, ordinal long, t long, kind string, side string, price long, delta long"
    rows = [
        (1, 1, 5, "delta", "yes", 400_000, 3), (1, 2, 20, "reset", None, None, None), (1, 3, 21, "delta", "yes", 400_000, 5), (1, 4, 30, "delta", "no", 550_000, 7), (1, 5, 31, "delta", "yes", 300_000, 1),
        (1, 6, 32, "delta", "yes", 300_000, -1), (1, 7, 71, "delta", "yes", 400_000, -6), (1, 8, 85, "delta", "yes", 400_000, 6), (1, 9, 95, "reset", None, None, None), (2, 10, 131, "down", None, None, None),
    ]
    want = [(10, False, None, None, 0), (20, True, None, None, 0), (30, True, 400_000, 450_000, 2), (40, True, 400_000, 450_000, 2), (50, True, 400_000, 450_000, 2), (60, True, 400_000, 450_000, 2), (70, True, 400_000, 450_000, 2),
            (80, False, None, None, 2), (90, False, None, None, 2), (100, True, None, None, 0), (110, True, None, None, 0), (120, True, None, None, 0), (130, True, None, None, 0)]
    for suppress, written in ((True, {20, 30, 100}), (False, {20, 30, 40, 50, 60, 70, 100, 110, 120, 130})):
        stream = _timed(spark, str(tmp_path / f"s{suppress}"), [rows[:4], rows[4:6], rows[6:]], schema)
        got = sorted(flows.drained(timed.samples(stream, 10, suppress), "append").where("market = 1").collect())
        assert [(r.bucket_ms, r.valid, r.bid, r.ask, r.levels) for r in got] == want
        assert {r.bucket_ms for r in got if r.written} == written


def test_a_batch_that_runs_again_leaves_one_copy_and_a_failed_one_none(spark, tmp_path):
    tables = [
        sinks.Table("child", lambda f: f.where("kind = 'c'").select("ordinal", "k"), ("k",), parent="raw"),
        sinks.Table("raw", lambda f: f.select("ordinal", "kind")),
    ]
    assert [t.name for t in sinks.in_order(tables)] == ["raw", "child"]
    for wrong in ([sinks.Table("a", None, parent="b")], [sinks.Table("a", None, parent="b"), sinks.Table("b", None, parent="a")]):
        with pytest.raises(ValueError, match="no order"):
            sinks.in_order(wrong)
    folder = f"file://{tmp_path}/out"
    assert sinks.table(spark, folder, tables[0]) is None
    write = sinks.writer(spark, folder, tables)
    frames = lambda *rows: spark.createDataFrame(list(rows), "ordinal long, kind string, k long")
    first = frames((1, "c", 5), (2, "c", 5), (3, "d", 6))
    write(first, 0)
    write(first, 0)  # the driver was lost before the commit
    write(frames((4, "c", 5), (5, "c", 7)), 1)
    failing = sinks.writer(spark, folder, [tables[1], sinks.Table("child", lambda f: f.select(F.raise_error(F.lit("no")).alias("k"), "ordinal"), parent="raw")])
    with pytest.raises(Exception, match="no"):
        failing(frames((6, "c", 8)), 2)
    rows = lambda i: sorted(tuple(r) for r in sinks.table(spark, folder, tables[i]).collect())
    assert rows(1) == [(1, "c"), (2, "c"), (3, "d"), (4, "c"), (5, "c")] and rows(0) == [(1, 5), (5, 7)]
    write(frames((6, "c", 8)), 2)
    assert rows(0) == [(1, 5), (5, 7), (6, 8)] and sinks.committed(spark, folder) == [0, 1, 2]


def test_drained_keeps_one_copy_of_a_batch_that_runs_again(spark, tmp_path, monkeypatch):
    from pyspark.sql.streaming.readwriter import DataStreamWriter

    def twice(self, keep, real=DataStreamWriter.foreachBatch):
        return real(self, lambda rows, batch: (keep(rows, batch), keep(rows, batch)))

    monkeypatch.setattr(DataStreamWriter, "foreachBatch", twice)
    _files(spark, str(tmp_path / "e"), [[(1,)], [(2,), (3,)]], "x long")
    stream = spark.readStream.schema("x long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e"))
    assert sorted(r.x for r in flows.drained(stream, "append").collect()) == [1, 2, 3]
