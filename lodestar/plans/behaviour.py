"""Queries over behaviour: popularity, feedback, histories, attribution, recommendations, sessions, search logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators import dcn
from lodestar.operators import logs as L
from lodestar.operators import recommend as C
from lodestar.operators import session as E
from lodestar.operators import signals as G
from lodestar.operators import threshold
from lodestar.operators import vector as V
from lodestar.sources import tables as S
from lodestar.sources.tables import NOW, with_

from .registry import query
from .retrieval import EMBED, INDEX, RECALL, embed_sql, kb, popularity, recall, services_index

POP = "SELECT service_id, round(sum(exp(-greatest(0.0, 1706659200.0 - ts) / 2592000.0)), 6) AS popularity FROM clicks WHERE ts >= 1706659200.0 - {d} * 86400 GROUP BY 1"


@query("popularity_decayed", with_("clicks") + POP.format(d=90))
def popularity_decayed(spark, sf):
    return G.popularity_decayed(S.clicks(spark, sf), NOW).select("service_id", F.round("popularity", 6).alias("popularity"))


@query("popularity_decayed_14d", with_("clicks") + POP.format(d=14))
def popularity_14d(spark, sf):
    return G.popularity_decayed(S.clicks(spark, sf), NOW, window_days=14).select("service_id", F.round("popularity", 6).alias("popularity"))


@query("negative_signals", with_("feedback") + "SELECT service_id, count(*) AS negatives FROM feedback WHERE dwell_ms < 3000 AND ts >= 1706659200.0 - 90 * 86400 GROUP BY 1")
def negative_signals(spark, sf):
    return G.negative_signals(S.feedback(spark, sf), NOW)


@query("popularity_penalized", with_("clicks", "feedback") + """, p AS (SELECT service_id, sum(exp(-greatest(0.0, 1706659200.0 - ts) / 2592000.0)) AS v FROM clicks WHERE ts >= 1706659200.0 - 7776000 GROUP BY 1),
n AS (SELECT service_id, count(*) AS n FROM feedback WHERE dwell_ms < 3000 AND ts >= 1706659200.0 - 7776000 GROUP BY 1) SELECT service_id, round(greatest(0.0, coalesce(v, 0) - 0.5 * coalesce(n, 0)), 6) AS popularity FROM p FULL JOIN n USING (service_id)""")
def popularity_penalized(spark, sf):
    p = G.penalized(G.popularity_decayed(S.clicks(spark, sf), NOW), G.negative_signals(S.feedback(spark, sf), NOW))
    return p.select("service_id", F.round("popularity", 6).alias("popularity"))


@query("query_count", with_("queries") + "SELECT user_id, count(*) AS n FROM queries GROUP BY 1")
def query_count(spark, sf):
    return S.queries(spark, sf).groupBy("user_id").agg(F.count("*").alias("n"))


@query("user_click_counts", with_("clicks") + "SELECT user_id, service_id, count(*) AS clicks FROM clicks WHERE NOT deprecated GROUP BY ALL")
def user_click_counts(spark, sf):
    return S.clicks(spark, sf).where(~F.col("deprecated")).groupBy("user_id", "service_id").agg(F.count("*").alias("clicks"))


@query("global_click_counts", with_("clicks") + "SELECT service_id, count(*) AS clicks FROM clicks WHERE NOT deprecated GROUP BY ALL")
def global_click_counts(spark, sf):
    return S.clicks(spark, sf).where(~F.col("deprecated")).groupBy("service_id").agg(F.count("*").alias("clicks"))


HOT = "hot AS (SELECT service_id, count(*) AS clicks, row_number() OVER (ORDER BY count(*) DESC, service_id) AS rank FROM clicks WHERE NOT deprecated GROUP BY 1 QUALIFY rank <= 12)"


@query("hot_services", with_("clicks") + f", {HOT} SELECT service_id, clicks, rank FROM hot WHERE rank <= 3")
def hot_services(spark, sf):
    return C.hot(S.clicks(spark, sf), 3)


CF = """live AS (SELECT DISTINCT user_id, service_id FROM clicks WHERE NOT deprecated), br AS (SELECT DISTINCT user_id, service_id FROM clicks),
pairs AS (SELECT DISTINCT l.user_id, b.user_id AS other FROM live l JOIN br b USING (service_id) WHERE l.user_id <> b.user_id),
cf AS (SELECT p.user_id, t.service_id, count(DISTINCT p.other) AS co_count FROM pairs p JOIN live t ON t.user_id = p.other WHERE NOT EXISTS (SELECT 1 FROM live m WHERE m.user_id = p.user_id AND m.service_id = t.service_id) GROUP BY ALL)"""


@query("collaborative_filter", with_("clicks") + f", {CF} SELECT user_id, service_id, co_count FROM cf")
def collaborative_filter(spark, sf):
    return G.collaborative(S.clicks(spark, sf))


def _recent_sql(source: str, value: str, name: str = "rec", limit: int = 3, where: str = "TRUE") -> str:
    return f"""{name}0 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY id DESC) AS n FROM {source} WHERE {where} QUALIFY n <= {max(10 * limit, 50)}),
{name} AS (SELECT user_id, {value}, row_number() OVER (PARTITION BY user_id ORDER BY max(id) DESC) AS rn FROM {name}0 GROUP BY user_id, {value} QUALIFY rn <= {limit})"""


@query("recent_queries", with_("queries") + ", " + _recent_sql("queries", "query") + " SELECT user_id, query, rn FROM rec")
def recent_queries(spark, sf):
    return G.recent_distinct(S.queries(spark, sf), "query", 3)


@query("recent_clicks", with_("clicks") + ", " + _recent_sql("clicks", "service_id") + " SELECT user_id, service_id, rn FROM rec")
def recent_clicks(spark, sf):
    return G.recent_distinct(S.clicks(spark, sf), "service_id", 3)


@query("query_history", with_("queries") + "SELECT user_id, n_back, query FROM (SELECT user_id, query, row_number() OVER (PARTITION BY user_id ORDER BY id DESC) AS n_back FROM queries) WHERE n_back <= 50")
def query_history(spark, sf):
    w = Window.partitionBy("user_id").orderBy(F.desc("id"))
    return S.queries(spark, sf).withColumn("n_back", F.row_number().over(w)).where("n_back <= 50").select("user_id", "n_back", "query")


@query("click_query_pairs", with_("clicks", "queries") + "SELECT c.id, c.service_id, q.query, q.id AS query_id FROM (SELECT c.id, c.service_id, max(q.id) AS qid FROM clicks c JOIN queries q ON q.user_id = c.user_id AND q.ts <= c.ts GROUP BY ALL) c JOIN queries q ON q.id = c.qid")
def click_query_pairs(spark, sf):
    return attributed(spark, sf).select("id", "service_id", "query", "query_id")


def attributed(spark, sf):
    """Clicks with the last query of their user before them."""
    a = G.as_of(S.clicks(spark, sf).select("id", "user_id", "service_id", "ts"), S.queries(spark, sf), "query")
    return a.where(F.col("matched_id").isNotNull()).select("id", "service_id", F.col("matched").alias("query"), F.col("matched_id").alias("query_id"))


@query("dcn_training_pairs")
def dcn_training_pairs(spark, sf):
    return dcn.training_pairs(attributed(spark, sf), S.catalog(spark, sf))


@query("log_click_backfill", with_("clicks", "logs") + """, shown AS (SELECT id, user_id, ts, 'p' || (CAST(substr(query, 2) AS INT) + 20 * unnest(range(5))) AS service_id FROM logs WHERE clicked_sid IS NULL),
h AS (SELECT c.id, c.service_id, c.ts, arg_max(s.id, (s.ts, s.id)) AS log_id FROM clicks c JOIN shown s ON s.user_id = c.user_id AND s.service_id = c.service_id AND s.ts <= c.ts GROUP BY ALL)
SELECT log_id, arg_min(service_id, (ts, id)) AS clicked_sid FROM h GROUP BY 1""")
def log_click_backfill(spark, sf):
    logs = S.search_logs(spark, sf)
    shown = logs.select(F.col("id").alias("log_id"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("j"), "query")
    shown = shown.select("log_id", F.concat(F.lit("p"), (F.substr("query", F.lit(2)).cast("int") + 20 * F.col("j")).cast("string")).alias("service_id"))
    return L.backfill_clicks(logs, S.clicks(spark, sf), shown)


SINCE = "1706659200.0 - 7 * 86400"
_since = NOW - 7 * 86400


@query("no_click_queries", with_("logs") + f"SELECT query, count(*) AS total, count(*) FILTER (WHERE clicked_sid IS NULL) AS no_click, round(count(*) FILTER (WHERE clicked_sid IS NULL) / count(*), 4) AS rate FROM logs WHERE ts >= {SINCE} GROUP BY 1")
def no_click_queries(spark, sf):
    return L.no_click(S.search_logs(spark, sf), _since)


@query("slow_queries", with_("logs") + f"SELECT query, count(*) AS n, round(avg(total_ms), 2) AS avg_ms, round(max(total_ms), 2) AS max_ms, count(*) FILTER (WHERE total_ms >= 1000) AS slow_count FROM logs WHERE ts >= {SINCE} GROUP BY 1")
def slow_queries(spark, sf):
    return L.slow(S.search_logs(spark, sf), _since)


@query("degradation_stats", with_("logs") + f"SELECT count(*) AS total, count(*) FILTER (WHERE cache_hit) AS hits, count(*) FILTER (WHERE degraded) AS degraded, round(count(*) FILTER (WHERE cache_hit) / count(*), 4) AS hit_rate, round(count(*) FILTER (WHERE degraded) / count(*), 4) AS degraded_rate FROM logs WHERE ts >= {SINCE}")
def degradation_stats(spark, sf):
    return L.degradation(S.search_logs(spark, sf), _since)


@query("recent_search_logs", with_("logs") + "SELECT id, user_id, query, total_ms, cache_hit, degraded, clicked_sid FROM logs ORDER BY id DESC LIMIT 100")
def recent_search_logs(spark, sf):
    return L.recent(S.search_logs(spark, sf), 100).select("id", "user_id", "query", F.col("latencies")["total"].alias("total_ms"), "cache_hit", "degraded", "clicked_sid")


def _related(spark, sf) -> DataFrame:
    """Catalog stand-in: services 1 to 3 steps on by id, for those that have clicks: nobody's last click is another."""
    c = S.catalog(spark, sf)
    n = c.select(F.col("ord").alias("o"), F.col("service_id").alias("related_id"))
    steps = c.join(S.clicks(spark, sf).select("service_id").distinct(), "service_id", "left_semi").select("service_id", F.posexplode(F.array(*[F.col("ord") + d for d in (1, 2, 3)])).alias("rank", "o"))
    return steps.join(n, "o").select("service_id", "related_id", (F.col("rank") + 1).alias("rank"))


REL = "rel AS (SELECT a.service_id, b.service_id AS related_id, d AS rank FROM kb a CROSS JOIN range(1, 4) r(d) JOIN kb b ON b.ord = a.ord + d)"


def guess_sql(exclude: str = "") -> str:
    ex = f" WHERE NOT EXISTS (SELECT 1 FROM shown s WHERE s.user_id = x.user_id AND s.service_id = x.service_id)" if exclude else ""
    return f"""{CF}, u AS (SELECT DISTINCT user_id FROM clicks), {_recent_sql('clicks', 'service_id', 'rc')}, {HOT}, {REL}{exclude},
cfx AS (SELECT * FROM cf x{ex}), c1 AS (SELECT user_id, 1 AS stage, row_number() OVER (PARTITION BY user_id ORDER BY co_count DESC, service_id) AS pos, service_id FROM cfx QUALIFY pos <= 3),
c2 AS (SELECT user_id, 2 AS stage, rn * 100 + rel.rank AS pos, related_id AS service_id FROM rc JOIN rel USING (service_id)), c3 AS (SELECT user_id, 3 AS stage, rank AS pos, service_id FROM u CROSS JOIN hot),
every AS (SELECT * FROM (SELECT * FROM c1 UNION ALL SELECT * FROM c2 UNION ALL SELECT * FROM c3) x{ex}), firsts AS (SELECT user_id, service_id, min((stage, pos)) AS f, arg_min(stage, (stage, pos)) AS stage FROM every WHERE service_id IN (SELECT service_id FROM kb) GROUP BY ALL),
guess AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY f, service_id) AS rank, service_id, stage FROM firsts QUALIFY rank <= 3)"""


@query("guess_you_like", with_("kb", "clicks") + ", " + guess_sql() + " SELECT user_id, rank, service_id, stage FROM guess")
def guess_you_like(spark, sf):
    clicks = S.clicks(spark, sf)
    return C.guess(clicks.select("user_id").distinct(), clicks, S.catalog(spark, sf), _related(spark, sf))


SHOWN = ", shown AS (SELECT user_id, service_id FROM rc UNION SELECT user_id, service_id FROM u CROSS JOIN hot WHERE rank <= 3)"


@query("dropdown", with_("kb", "clicks", "queries") + ", " + guess_sql(SHOWN) + ", " + _recent_sql("queries", "query", "rq") + """
SELECT user_id, 'recent_queries' AS section, rn AS pos, query AS item FROM rq WHERE user_id IN (SELECT user_id FROM u) UNION ALL SELECT user_id, 'recent_clicks', rn, service_id FROM rc WHERE service_id IN (SELECT service_id FROM kb)
UNION ALL SELECT user_id, 'hot', rank, service_id FROM u CROSS JOIN hot WHERE rank <= 3 UNION ALL SELECT user_id, 'recommended', rank, service_id FROM guess""")
def dropdown(spark, sf):
    clicks = S.clicks(spark, sf)
    return C.dropdown(clicks.select("user_id").distinct(), S.queries(spark, sf), clicks, S.catalog(spark, sf), _related(spark, sf))


@query("session_rollback", with_("sessions") + "SELECT session_id, max(turn_idx) - 1 AS turn_idx, arg_max(query, turn_idx) FILTER (WHERE turn_idx < m) AS query FROM (SELECT *, max(turn_idx) OVER (PARTITION BY session_id) AS m FROM sessions) GROUP BY 1")
def session_rollback(spark, sf):
    return E.rollback(S.sessions(spark, sf))


DIN = f"""{with_('kb', 'batch', 'queries')}, {EMBED}, h0 AS (SELECT b.query_id, q.query, row_number() OVER (PARTITION BY b.query_id ORDER BY q.id DESC) AS i FROM batch b JOIN queries q ON q.user_id = b.user_id QUALIFY i <= 50),
ht AS (SELECT DISTINCT query FROM h0), {embed_sql('hv', 'ht', 'query', 'query')}, w AS (SELECT query_id, i, hv.vec, 0.7 * greatest(0, list_inner_product(qv.vec, hv.vec)) + 0.3 / i AS w FROM h0 JOIN hv USING (query) JOIN qv USING (query_id)),
d AS (SELECT query_id, j, sum(w * vec[j]) / sum(w) AS x FROM w CROSS JOIN range(1, 33) r(j) GROUP BY ALL), m AS (SELECT query_id, j, 0.8 * qv.vec[j] + 0.2 * x AS x FROM d JOIN qv USING (query_id)), n AS (SELECT query_id, sqrt(sum(x * x)) AS n FROM m GROUP BY 1)
SELECT query_id, j - 1 AS i, round(x / n, 6) AS x FROM m JOIN n USING (query_id) UNION ALL SELECT query_id, unnest(range(32)), round(unnest(vec), 6) FROM qv WHERE query_id NOT IN (SELECT query_id FROM w)"""


@query("din_query_vector", DIN)
def din_query_vector(spark, sf):
    batch = S.query_batch(spark)
    history = E.history(batch, S.queries(spark, sf), 50)
    hv = V.hash_embedding(history.select("query").distinct(), "query", "query")
    v = E.din(V.hash_embedding(batch, "query_id", "text"), history.join(hv, "query"))
    return v.select("query_id", F.posexplode("vec").alias("i", "x")).select("query_id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@query("session_refine", RECALL + ", s AS (SELECT query_id, query_id % 3 AS session_id, query_id // 3 AS turn FROM batch), seen AS (SELECT DISTINCT a.query_id, r.service_id FROM s a JOIN s b ON a.session_id = b.session_id AND b.turn <= a.turn JOIN recall r ON r.query_id = b.query_id), x AS (SELECT sc.query_id, sc.service_id, sc.score, row_number() OVER (PARTITION BY sc.query_id ORDER BY score DESC, ord) AS rank FROM scored sc JOIN seen USING (query_id, service_id)) SELECT query_id, service_id, score, rank FROM x WHERE rank <= 40")
def session_refine(spark, sf):
    turns = S.query_batch(spark).select("query_id", (F.col("query_id") % 3).alias("session_id"), F.floor(F.col("query_id") / 3).alias("turn"))
    # Scored are the pairs that the turns recalled, a few for each query, and no others.
    asked = threshold.Asked(S.query_batch(spark), services_index(spark, sf), popularity(spark, sf))
    return E.best(asked.pairs(E.seen(recall(spark, sf), turns)), 40)


@query("suggest_context", with_("clicks", "queries", "kb") + ", " + _recent_sql("queries", "query", "rq", 5) + ", " + _recent_sql("clicks", "service_id", "rc", 5) + """
SELECT user_id, 'query' AS kind, rn, query AS value FROM rq UNION ALL SELECT user_id, 'click', rn, service_name FROM rc JOIN kb USING (service_id)""")
def suggest_context(spark, sf):
    q = G.recent_distinct(S.queries(spark, sf), "query", 5).select("user_id", F.lit("query").alias("kind"), "rn", F.col("query").alias("value"))
    c = G.recent_distinct(S.clicks(spark, sf), "service_id", 5).join(S.catalog(spark, sf), "service_id")
    return q.unionByName(c.select("user_id", F.lit("click").alias("kind"), "rn", F.col("service_name").alias("value")))
