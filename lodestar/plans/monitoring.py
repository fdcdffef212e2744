"""Queries of monitoring: percentiles, health, windows, failures, alerts, caches, sessions by gaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import monitor as M
from lodestar.sources import tables as S
from lodestar.sources.tables import NOW, with_

from .registry import query


def pct(v: str, p: int) -> str:
    return f"round(list_sort({v})[least(len({v}) * {p} // 100, len({v}) - 1) + 1], 6) AS p{p}"


@query("latency_percentiles", with_("metrics") + f", v AS (SELECT list(total_ms) AS v FROM metrics) SELECT {pct('v', 50)}, {pct('v', 95)}, {pct('v', 99)} FROM v")
def latency_percentiles(spark, sf):
    return M.latency_percentiles(S.metrics(spark, sf))


@query("stage_percentiles", with_("metrics") + f", s AS (SELECT 'retrieval' AS stage, total_ms * 0.6 AS x FROM metrics UNION ALL SELECT 'rerank', CASE WHEN cache_hit THEN 0 ELSE total_ms * 0.3 END FROM metrics), v AS (SELECT stage, list(x) AS v FROM s GROUP BY 1) SELECT stage, len(v) AS n, {pct('v', 50)}, {pct('v', 95)}, {pct('v', 99)} FROM v")
def stage_percentiles(spark, sf):
    return M.stage_percentiles(S.metrics(spark, sf))


HEALTH = with_("metrics", "external") + f""", r AS (SELECT * FROM metrics ORDER BY id DESC LIMIT 100), n AS (SELECT count(*) AS c, count(*) FILTER (WHERE error) AS e, count(*) FILTER (WHERE degraded) AS d, list(total_ms) AS v FROM r),
health AS (SELECT (SELECT count(*) FROM metrics) AS search_total, (SELECT count(*) FILTER (WHERE error) FROM metrics) AS search_errors, (SELECT round(count(*) FILTER (WHERE error) / count(*), 4) FROM metrics) AS error_rate,
  (SELECT round(count(*) FILTER (WHERE cache_hit) / count(*), 4) FROM metrics) AS cache_hit_rate, c AS recent_total, round(e / c, 4) AS recent_error_rate, round(d / c, 4) AS recent_degraded_rate,
  {pct('v', 95).replace('AS p95', 'AS p95_ms')}, (SELECT round(count(*) FILTER (WHERE ok) / count(*), 4) FROM external) AS external_success_rate FROM n)"""


@query("health_summary", HEALTH + " SELECT * FROM health")
def health_summary(spark, sf):
    return M.health(S.metrics(spark, sf), S.external(spark, sf))


@query("realtime_summary", with_("metrics") + f""", r AS (SELECT * FROM (SELECT * FROM metrics ORDER BY id DESC LIMIT 600) WHERE ts >= 1706659200.0 - 86400), n AS (SELECT count(*) AS n, count(*) FILTER (WHERE error) AS e, count(*) FILTER (WHERE cache_hit) AS h, count(*) FILTER (WHERE degraded) AS d, list(total_ms) AS v FROM r)
SELECT n AS events, round(n / 86400.0, 4) AS qps, round(e / n, 4) AS error_rate, round(h / n, 4) AS cache_hit_rate, round(d / n, 4) AS degraded_rate, {pct('v', 50)}, {pct('v', 95)}, {pct('v', 99)} FROM n""")
def realtime_summary(spark, sf):
    return M.realtime(S.metrics(spark, sf), NOW, window_s=86400.0)


@query("tumbling_metrics", with_("metrics") + "SELECT time_bucket(INTERVAL 1 HOUR, make_timestamp(CAST(ts * 1e6 AS BIGINT))) AS start, count(*) AS n, count(*) FILTER (WHERE error) AS errors, round(avg(total_ms), 6) AS avg_ms FROM metrics GROUP BY 1")
def tumbling_metrics(spark, sf):
    return M.windows(S.metrics(spark, sf), "1 hour").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("sliding_metrics", with_("metrics") + ", m AS (SELECT make_timestamp(CAST(ts * 1e6 AS BIGINT)) AS t, error, total_ms FROM metrics) SELECT time_bucket(INTERVAL 30 MINUTE, t) - INTERVAL 30 MINUTE * k AS start, count(*) AS n, count(*) FILTER (WHERE error) AS errors, round(avg(total_ms), 6) AS avg_ms FROM m CROSS JOIN range(2) r(k) GROUP BY 1")
def sliding_metrics(spark, sf):
    return M.windows(S.metrics(spark, sf), "60 minutes", "30 minutes").withColumn("start", F.col("start").cast("timestamp_ntz"))


FAIL = "fails AS (SELECT service, count(*) FILTER (WHERE id > last_ok) AS consecutive FROM (SELECT *, coalesce(max(CASE WHEN ok THEN id END) OVER (PARTITION BY service), -1) AS last_ok FROM external) GROUP BY 1)"


@query("consecutive_failures", with_("external") + f", {FAIL} SELECT service, consecutive FROM fails")
def consecutive_failures(spark, sf):
    return M.consecutive_failures(S.external(spark, sf))


@query("alerts_eval", HEALTH + f""", {FAIL} SELECT 'ERROR' AS level, 'error_rate' AS rule, '' AS subject, recent_error_rate::DOUBLE AS value FROM health WHERE recent_total >= 5 AND recent_error_rate > 0.05
UNION ALL SELECT 'WARN', 'p95_latency', '', p95_ms FROM health WHERE recent_total >= 5 AND p95_ms > 1000 UNION ALL SELECT 'WARN', 'cache_hit_rate', '', cache_hit_rate FROM health WHERE recent_total >= 5 AND cache_hit_rate < 0.3
UNION ALL SELECT 'ERROR', 'external_consecutive_fail', service, consecutive FROM fails WHERE consecutive >= 5""")
def alerts_eval(spark, sf):
    return M.alerts(M.health(S.metrics(spark, sf), S.external(spark, sf)), M.consecutive_failures(S.external(spark, sf)))


@query("metrics_exposition", HEALTH + """ SELECT unnest(['search_total ' || search_total, 'search_errors_total ' || search_errors, 'search_latency_seconds{quantile="0.95"} ' || printf('%.6f', p95_ms / 1000)]) AS line FROM health
UNION ALL SELECT 'search_external_call_total{service="' || service || '",status="' || CASE WHEN ok THEN 'ok' ELSE 'fail' END || '"} ' || count(*) FROM external GROUP BY service, ok""")
def metrics_exposition(spark, sf):
    return M.exposition(M.health(S.metrics(spark, sf), S.external(spark, sf)), S.external(spark, sf))


@query("cache_hit_simulation", with_("queries") + "SELECT id, coalesce(ts - lag(ts) OVER (PARTITION BY user_id, query ORDER BY ts, id) <= 86400, false) AS hit FROM queries")
def cache_hit_simulation(spark, sf):
    q = S.queries(spark, sf).select("id", F.concat_ws(":", F.col("user_id").cast("string"), "query").alias("key"), "ts")
    return M.cache_hits(q, 86400.0).select("id", "hit")


@query("sessionize_gap", with_("queries") + """, m AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, id) <= 21600 THEN 0 ELSE 1 END AS new FROM queries), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, id) AS session FROM m)
SELECT user_id, session::BIGINT AS session, round(min(ts), 3) AS start, round(max(ts), 3) AS "end", count(*) AS n FROM s GROUP BY ALL""")
def sessionize_gap(spark, sf):
    return M.sessionize(S.queries(spark, sf), 21600.0).select("user_id", "session", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "n")


@query("rate_limit_simulation")
def rate_limit_simulation(spark, sf):
    return M.token_bucket(S.events(spark, sf).withColumn("ts", F.col("ts") / 3600), 60.0 / 50)
