from pyspark.sql import functions as F

from lodestar.operators import monitor as M
from lodestar.sources import tables as S
from lodestar.streaming import streams

SF = "/root/testdata/sf0.001"


def events_folder(spark, tmp_path, parts=3):
    out = str(tmp_path / "events")
    spark.read.parquet(f"{SF}/events.parquet").repartitionByRange(parts, "event_id").write.parquet(out)
    return out


def run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_windows_equal_batch(spark, tmp_path):
    got = run(streams.windowed_metrics(streams.read_events(spark, events_folder(spark, tmp_path)), "1 hour"), "w1", "complete")
    want = M.windows(S.metrics(spark, SF), "1 hour")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_consecutive_failures_equal_batch(spark, tmp_path):
    e = streams.read_events(spark, events_folder(spark, tmp_path))
    ext = e.select(F.col("event_id").alias("id"), F.col("event_type").alias("service"), (F.col("k") % 5 != 0).alias("ok"))
    got = {r.service: r.consecutive for r in run(streams.consecutive_failures(ext), "cf", "update").collect()}
    assert got == {r.service: r.consecutive for r in M.consecutive_failures(S.external(spark, SF)).collect()}


def test_rate_limit_equals_batch(spark, tmp_path):
    e = streams.read_events(spark, events_folder(spark, tmp_path, 1))
    req = e.select(F.col("event_id").alias("id"), "user_id", (F.unix_micros("ts") / F.lit(1e6) / 3600).alias("ts"))
    got = {r.id: r.allowed for r in run(streams.rate_limited(req, 1.2), "rl", "append").collect()}
    want = M.token_bucket(S.events(spark, SF).withColumn("ts", F.col("ts") / 3600), 1.2)
    assert got == {r.id: r.allowed for r in want.collect()}


def test_click_backfill_emits_unmatched(spark, tmp_path):
    e = streams.read_events(spark, events_folder(spark, tmp_path))
    s = e.where("event_type = 'view'").select(F.col("event_id").alias("log_id"), "user_id", F.col("k").alias("service_id"), "ts")
    c = e.where("event_type = 'click'").select("user_id", F.col("k").alias("service_id"), "ts")
    got = run(streams.click_backfill(s, c, "1 hour"), "cb", "append")
    assert got.where("c_ts IS NULL").count() > 0


def test_alert_sink(spark):
    sent = []
    streams.alert_sink(sent.extend)(S.metrics(spark, SF), 0)
    assert any(a["rule"] == "error_rate" for a in sent)


def test_alert_sink_tries_again_and_goes_on(spark):
    calls, waits = [], [streams.backoff(i) for i in range(3)]

    def fails(rows):
        calls.append(len(rows))
        if len(calls) != 2:
            raise OSError("away")

    sink = streams.alert_sink(fails, base_s=0.0)
    sink(S.metrics(spark, SF), 0)
    assert len(calls) == 2 and waits == [0.5, 1.0, 2.0]
    calls[:] = [0, 0]
    sink(S.metrics(spark, SF), 1)
    assert len(calls) == 5
