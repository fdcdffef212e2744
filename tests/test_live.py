"""The newest events as a stream's state, against the batch forms over all that has come."""

import pytest
from pyspark.sql import functions as F

from lodestar.engine import FACTS, Engine
from lodestar.operators import monitor as M
from lodestar.sources import tables as S
from lodestar.streaming import live, streams

SF = "/root/testdata/sf0.001"


def close(got, want):
    assert set(got) == set(want)
    for name in want:
        assert got[name] == pytest.approx(want[name], abs=1e-6), name


def test_summaries_equal_batch_after_every_batch(spark, tmp_path):
    folder, seen = f"{tmp_path}/events", []
    # In no order of id, so that what came late has to find its place.
    spark.read.parquet(f"{SF}/events.parquet").repartition(4, F.xxhash64("event_id")).write.parquet(folder)
    files = sorted(str(f) for f in (tmp_path / "events").glob("*.parquet"))
    events = streams.read_events(spark, folder, 1)
    stream = live.watch(streams.metrics_of(events), f"{tmp_path}/live", seen.append, lambda: S.external(spark, SF), 86400.0, lambda: S.NOW, parts=3)
    stream.awaitTermination()
    assert [s["batch"] for s in seen] == list(range(len(files)))
    close(seen[-1]["health"], M.health(S.metrics(spark, SF), S.external(spark, SF)).first().asDict())
    close(seen[-1]["realtime"], M.realtime(S.metrics(spark, SF), S.NOW, 86400.0).first().asDict())
    # Each summary is that of some of the files: one more each time.
    sizes = {f: spark.read.parquet(f).count() for f in files}
    totals = [s["health"]["search_total"] for s in seen]
    assert sorted(b - a for a, b in zip([0, *totals], totals, strict=False)) == sorted(sizes.values())
    held = live.Snapshots(f"{tmp_path}/live/parts")
    assert held.numbers(spark) == list(range(len(files)))[-2:]
    rows = held.read(spark)
    assert rows.groupBy("part").count().agg(F.max("count")).first()[0] <= live.BUFFER
    # Started again there is nothing new, and what is held stays.
    live.watch(streams.metrics_of(streams.read_events(spark, folder)), f"{tmp_path}/live", seen.append, parts=3).awaitTermination()
    assert live.health(held.read(spark), S.external(spark, SF)).first().search_total == totals[-1]


def test_small_buffers_nulls_and_repeats(spark, tmp_path):
    rows = [(i, float(i), None if i % 5 == 0 else i * 1.5, i % 4 == 0, None, i % 3 == 0) for i in range(40)] + [(None, 1.0, 2.0, True, True, False)]
    metrics = spark.createDataFrame(rows, live.EVENT)
    metrics.repartition(5).write.parquet(f"{tmp_path}/m")
    stream = spark.readStream.schema(live.EVENT).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/m")
    held = live.Snapshots(f"{tmp_path}/parts")
    with live._state_store(spark):
        q = live.newest(stream, keep=10, parts=2).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/c").foreachBatch(lambda b, n: (held.write(b, n), held.write(b, n))).trigger(availableNow=True).start()
    q.awaitTermination()
    got, calls = held.read(spark), S.external(spark, SF)
    assert got.where("id IS NOT NULL").count() == 20
    close(live.health(got, calls, 10).first().asDict(), M.health(metrics, calls, 10).first().asDict())
    close(live.realtime(got, 39.0, 6.0, 10).first().asDict(), M.realtime(metrics, 39.0, 6.0, 10).first().asDict())


def test_nothing_yet(spark, tmp_path):
    none = live.Snapshots(f"{tmp_path}/none").read(spark)
    calls = spark.createDataFrame([], "service string, ok boolean")
    close(live.health(none, calls).first().asDict(), M.health(spark.createDataFrame([], live.EVENT), calls).first().asDict())
    assert live.realtime(none, 1.0).first().events == 0


def test_engine_watches_its_log(spark, tmp_path):
    engine, seen = Engine(spark, f"file://{tmp_path}/e"), []
    log = "id long, user_id long, query string, top_ids array<string>, latencies map<string,double>, cache_hit boolean, degraded boolean, error boolean, clicked_sid string, ts double"
    assert log == FACTS["searches"]
    for part in range(2):
        rows = [(part * 150 + i, 1, "q", ["a"], {"total": 10.0 * i}, i % 2 == 0, False, i % 10 == 0, None, 100.0 + i) for i in range(150)]
        engine.record("searches", spark.createDataFrame(rows, log))
        engine.watch(f"file://{tmp_path}/live", seen.append, 60.0, lambda: 249.0).awaitTermination()
        close(seen[-1]["health"], engine.health().first().asDict())
        close(seen[-1]["realtime"], engine.realtime(249.0).first().asDict())
