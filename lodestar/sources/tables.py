"""Logical tables of the engine (catalog, clicks, queries, feedback, logs, metrics) over the columnar source tables.

The catalog is the whole part table; behaviour comes from the events stream. Every view is a lazy projection, so column
pruning and filters reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import text as T

#: All compared queries take this moment as now: 2024-01-31 00:00:00 UTC, just after the last event.
NOW = 1706659200.0
#: Weight of each catalog field in multi-field scoring.
FIELD_WEIGHTS = {"name": 3.0, "aliases": 2.0, "intro": 1.0, "route": 1.5}
#: The batch of queries that the examples run: (query_id, user_id, text).
QUERY_BATCH = [
    (1, 3, "small ring"), (2, 8, "red widget"), (3, 46, "PROMO"), (4, 7, "smal rng"), (5, 16, "blue and bolt"),
    (6, 8, "what is steel"), (7, 3, "old anvil large"), (8, 20, "Brand 17 hot gear gear"), (9, 11, "zzz"), (10, 12, "economy plate size 11"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of part with their service_id."""
    return table(spark, sf_dir, "part").withColumn("service_id", F.concat(F.lit("p"), F.col("p_partkey").cast("string")))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """service_id, ord, service_name, aliases, service_intro, path, component, decision_button, derived, components."""
    return services(parts(spark, sf_dir))


def services(p: DataFrame) -> DataFrame:
    """The catalog of rows of parts()."""
    is_dict = F.col("p_partkey") % 7 == 0
    path = F.concat(F.lit("/go/"), F.lower("p_type"), F.lit("/"), F.translate("p_name", " ", "-"))
    return p.select(
        "service_id",
        F.col("p_partkey").alias("ord"),
        F.col("p_name").alias("service_name"),
        F.array("p_type", "p_brand").alias("aliases"),
        F.concat_ws(" ", "p_type", "p_name", F.lit("size"), F.col("p_size").cast("string")).alias("service_intro"),
        path.alias("path"),
        F.when(is_dict, F.concat(F.lit("Page"), F.col("p_size").cast("string"))).otherwise(T.slug_component(path)).alias("component"),
        F.when(is_dict, F.lit("Open")).otherwise(F.lit(T.ENTER)).alias("decision_button"),
        (~is_dict).alias("derived"),
        F.array(
            F.struct(F.concat("p_brand", F.lit(" view")).alias("name"), F.lit("view").alias("action")),
            F.struct(F.col("p_type").alias("name"), F.when(F.col("p_size") % 2 == 0, F.lit("open")).otherwise(F.lit("")).alias("action")),
        ).alias("components"),
    )


def route_text(kb: DataFrame):
    return F.concat_ws(" ", "path", "component", "decision_button")


def searchable_text(kb: DataFrame) -> DataFrame:
    """Adds the text that stands for a service as a whole."""
    return kb.withColumn("searchable", F.concat_ws(" ", "service_name", F.array_join("aliases", " "), "service_intro", route_text(kb)))


def catalog_fields(kb: DataFrame) -> DataFrame:
    """Long form: (service_id, ord, field, weight, text)."""
    texts = {"name": F.col("service_name"), "aliases": F.array_join("aliases", " "), "intro": F.col("service_intro"), "route": route_text(kb)}
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(FIELD_WEIGHTS[f]).alias("weight"), t.alias("text")) for f, t in texts.items()])
    return kb.select("service_id", "ord", F.inline(fields))


def events(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """id, user_id, event_type, value, k and ts (epoch seconds) of events, of those kinds alone if any are given."""
    e = table(spark, sf_dir, "events")
    if kinds:
        e = e.where(F.col("event_type").isin(*kinds))
    return e.select(
        F.col("event_id").alias("id"), "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("ts"),
    )


def _service():
    return F.concat(F.lit("p"), F.col("k").cast("string")).alias("service_id")


def clicks(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir, "click").select("id", "user_id", _service(), "ts", (F.col("k") % 25 == 0).alias("deprecated"))


def queries(spark, sf_dir) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("query"))
    return events(spark, sf_dir, "view").join(names, "k").select("id", "user_id", "query", "ts")


def feedback(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir, "purchase").select("id", "user_id", _service(), (F.col("value") * 60).cast("int").alias("dwell_ms"), "ts")


def search_logs(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir, "view", "error").select(
        "id", "user_id", F.concat(F.lit("q"), (F.col("k") % 20).cast("string")).alias("query"),
        F.create_map(F.lit("total"), F.col("value") * 15, F.lit("retrieval"), F.col("value") * 9).alias("latencies"),
        (F.col("k") % 3 == 0).alias("cache_hit"), (F.col("event_type") == "error").alias("degraded"),
        F.when(F.col("k") % 4 == 0, F.concat(F.lit("p"), F.col("k").cast("string"))).alias("clicked_sid"), "ts",
    )


def metrics(spark, sf_dir) -> DataFrame:
    """One row per search: total_ms, stages, error, cache_hit, degraded."""
    hit, total = F.col("k") % 3 == 0, F.col("value") * 10
    stages = F.when(hit, F.create_map(F.lit("retrieval"), total * 0.6)).otherwise(F.create_map(F.lit("retrieval"), total * 0.6, F.lit("rerank"), total * 0.3))
    return events(spark, sf_dir).select("id", "ts", total.alias("total_ms"), stages.alias("stages"), (F.col("event_type") == "error").alias("error"), hit.alias("cache_hit"), (F.col("event_type") == "signup").alias("degraded"))


def external(spark, sf_dir) -> DataFrame:
    """Calls to outside services: service, ok, in order of id."""
    return events(spark, sf_dir).select("id", F.col("event_type").alias("service"), (F.col("k") % 5 != 0).alias("ok"), F.col("value").alias("latency_ms"))


def sessions(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    turn = F.expr("row_number() OVER (PARTITION BY conv_id ORDER BY turn)") - 1
    return c.select(F.col("conv_id").alias("session_id"), turn.alias("turn_idx"), F.col("text").alias("query"))


def query_batch(spark) -> DataFrame:
    return spark.createDataFrame(QUERY_BATCH, "query_id int, user_id long, text string")


# The same tables as common table expressions, for SQL that checks the queries.
_ROWS = ", ".join(f"({i}, {u}, '{t}')" for i, u, t in QUERY_BATCH)
K = "CAST(json_extract_string(props, '$.k') AS INT)"
EPOCH = "epoch_us(ts) / 1e6"
CTE = {
    "kb": """kb AS (SELECT *, service_name || ' ' || aliases[1] || ' ' || aliases[2] || ' ' || service_intro || ' ' || path || ' ' || component || ' ' || decision_button AS searchable FROM (
      SELECT 'p' || p_partkey AS service_id, p_partkey AS ord, p_name AS service_name, [p_type, p_brand] AS aliases,
        p_type || ' ' || p_name || ' size ' || p_size AS service_intro, '/go/' || lower(p_type) || '/' || replace(p_name, ' ', '-') AS path,
        CASE WHEN p_partkey % 7 = 0 THEN 'Page' || p_size ELSE array_to_string([upper(x[1]) || x[2:] for x in string_split(p_name, ' ')], '') END AS component,
        CASE WHEN p_partkey % 7 = 0 THEN 'Open' ELSE '进入' END AS decision_button, p_partkey % 7 <> 0 AS derived,
        p_brand || ' view' AS c1, p_type AS c2, CASE WHEN p_size % 2 = 0 THEN 'open' ELSE '' END AS a2 FROM part))""",
    "kbf": """kbf AS (SELECT service_id, ord, unnest(['name', 'aliases', 'intro', 'route']) AS field, unnest([3.0::DOUBLE, 2.0, 1.0, 1.5]) AS weight,
      unnest([service_name, aliases[1] || ' ' || aliases[2], service_intro, path || ' ' || component || ' ' || decision_button]) AS text FROM kb)""",
    "clicks": f"clicks AS (SELECT event_id AS id, user_id, 'p' || {K} AS service_id, {EPOCH} AS ts, {K} % 25 = 0 AS deprecated FROM events WHERE event_type = 'click')",
    "queries": f"queries AS (SELECT event_id AS id, user_id, p_name AS query, {EPOCH} AS ts FROM events JOIN part ON p_partkey = {K} WHERE event_type = 'view')",
    "feedback": f"feedback AS (SELECT event_id AS id, user_id, 'p' || {K} AS service_id, CAST(trunc(value * 60) AS INT) AS dwell_ms, {EPOCH} AS ts FROM events WHERE event_type = 'purchase')",
    "logs": f"""logs AS (SELECT event_id AS id, user_id, 'q' || ({K} % 20) AS query, value * 15 AS total_ms, value * 9 AS retrieval_ms, {K} % 3 = 0 AS cache_hit,
      event_type = 'error' AS degraded, CASE WHEN {K} % 4 = 0 THEN 'p' || {K} END AS clicked_sid, {EPOCH} AS ts FROM events WHERE event_type IN ('view', 'error'))""",
    "metrics": f"metrics AS (SELECT event_id AS id, {EPOCH} AS ts, value * 10 AS total_ms, event_type = 'error' AS error, {K} % 3 = 0 AS cache_hit, event_type = 'signup' AS degraded FROM events)",
    "external": f"external AS (SELECT event_id AS id, event_type AS service, {K} % 5 <> 0 AS ok, value AS latency_ms FROM events)",
    "sessions": "sessions AS (SELECT conv_id AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn_idx, text AS query FROM conversations WHERE role = 'user')",
    "batch": f"batch(query_id, user_id, text) AS (VALUES {_ROWS})",
}


def with_(*names: str) -> str:
    """WITH clause of those tables, to be followed by more of them or the query."""
    return "WITH RECURSIVE " + ",\n".join(CTE[n] for n in names)
