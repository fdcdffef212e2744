"""Queries over the catalog: scans, validation, routes, text functions, versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators import kb as K
from lodestar.sources import tables as S
from lodestar.sources.tables import with_

from .registry import query

TOK = r"'[\p{L}\p{N}_]+'"


@query("kb_scan", with_("kb") + " SELECT service_id, service_name, array_to_string(aliases, '|') AS aliases, service_intro, path, component, decision_button, derived FROM kb")
def kb_scan(spark, sf) -> DataFrame:
    return S.catalog(spark, sf).select("service_id", "service_name", F.array_join("aliases", "|").alias("aliases"), "service_intro", "path", "component", "decision_button", "derived")


@query("kb_validate", with_("kb") + " SELECT service_id, NOT (service_name IS NULL OR service_name = '' OR ord % 11 = 0) AS valid, CASE WHEN ord % 11 = 0 THEN 'service_name' ELSE '' END AS missing FROM kb")
def kb_validate(spark, sf):
    raw = S.catalog(spark, sf).withColumn("service_name", F.when(F.col("ord") % 11 != 0, F.col("service_name")))
    return K.validated(raw).select("service_id", "valid", F.array_join("missing", ",").alias("missing"))


@query("kb_dedup_last_wins", with_("kb") + """, raw AS (SELECT 'p' || (ord % 500) AS service_id, ord, service_name, service_intro FROM kb)
SELECT service_id, min(ord) AS ord, arg_max(service_name, ord) AS service_name, arg_max(service_intro, ord) AS service_intro FROM raw GROUP BY service_id""")
def kb_dedup(spark, sf):
    raw = S.catalog(spark, sf).withColumn("service_id", F.concat(F.lit("p"), (F.col("ord") % 500).cast("string")))
    return K.last_wins(raw.select("service_id", "ord", "service_name", "service_intro"))


@query("kb_export", with_("kb") + """ SELECT ord, '{"service_id":"' || service_id || '","service_name":"' || service_name || '","aliases":["' || aliases[1] || '","' || aliases[2] || '"],"service_intro":"' || service_intro || '"}' AS line FROM kb""")
def kb_export(spark, sf):
    return S.catalog(spark, sf).select("ord", F.to_json(F.struct("service_id", "service_name", "aliases", "service_intro")).alias("line"))


@query("kb_hash", with_("kb") + " SELECT sha256(string_agg(service_id || chr(9) || searchable, chr(10) ORDER BY ord)) AS kb_hash, count(*) AS n FROM kb")
def kb_hash(spark, sf):
    return K.content_hash(S.searchable_text(S.catalog(spark, sf)))


@query("route_info", """SELECT page_id, component, '进入' AS decision_button FROM (SELECT page_id, CASE WHEN len(parts) = 0 THEN 'ServicePage' ELSE array_to_string([upper(x[1]) || x[2:] for x in parts], '') END AS component FROM (
  SELECT page_id, [x for x in regexp_split_to_array(regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1), '[-_/]+') if x <> ''] AS parts FROM pages))""")
def route_info(spark, sf):
    return S.table(spark, sf, "pages").select("page_id", T.slug_component(F.col("url")).alias("component"), F.lit(T.ENTER).alias("decision_button"))


ROUTES = "CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN 'javascript:' || url WHEN 2 THEN '/go/' || page_id WHEN 3 THEN 'ftp://' || page_id WHEN 4 THEN 'mailto:a@b.c' ELSE '  ' END"


@query("validate_route", f"""WITH r AS (SELECT page_id, {ROUTES} AS route FROM pages), l AS (SELECT *, lower(trim(route)) AS low, regexp_extract(lower(trim(route)), '^([a-z][a-z0-9+.\\-]*):(?://|$)', 1) AS scheme FROM r)
SELECT page_id, route, v AS valid, CASE WHEN v THEN route ELSE '' END AS safe FROM (SELECT *, CASE WHEN low = '' THEN false WHEN regexp_matches(low, '^(javascript|data|vbscript|file|about):') THEN false WHEN scheme <> '' THEN scheme IN ('http', 'https', 'mailto') ELSE true END AS v FROM l)""")
def validate_route(spark, sf):
    r = S.table(spark, sf, "pages").select("page_id", F.expr(ROUTES.replace("||", "||")).alias("route"))
    return r.select("page_id", "route", T.valid_route(F.col("route")).alias("valid"), T.safe_route(F.col("route")).alias("safe"))


HOSTS = "CASE page_id % 5 WHEN 0 THEN '10.1.' || (page_id % 256) || '.7' WHEN 1 THEN '172.' || (page_id % 40) || '.0.1' WHEN 2 THEN 'Db.Internal' WHEN 3 THEN (page_id % 300) || '.9.9.9' ELSE {host} END"


@query("private_host", "WITH h AS (SELECT page_id, lower(" + HOSTS.format(host="regexp_extract(url, '^https?://([^/?#]+)', 1)") + """) AS host FROM pages), o AS (SELECT *, [TRY_CAST(x AS INT) for x in string_split(host, '.')] AS p, regexp_matches(host, '^[0-9]{1,3}([.][0-9]{1,3}){3}$') AS ip FROM h)
SELECT page_id, host, coalesce(host = '' OR host = 'localhost' OR host LIKE '%.local' OR host LIKE '%.internal' OR (ip AND (p[1] > 255 OR p[2] > 255 OR p[3] > 255 OR p[4] > 255 OR p[1] IN (0, 10, 127) OR p[1] >= 240
  OR (p[1] = 172 AND p[2] BETWEEN 16 AND 31) OR (p[1] = 192 AND p[2] = 168) OR (p[1] = 169 AND p[2] = 254) OR (p[1] = 198 AND p[2] IN (18, 19)))), false) AS private FROM o""")
def private_host(spark, sf):
    h = S.table(spark, sf, "pages").select("page_id", F.lower(F.expr(HOSTS.format(host="coalesce(parse_url(url, 'HOST'), '')"))).alias("host"))
    return h.select("page_id", "host", F.coalesce(T.private_host(F.col("host")), F.lit(False)).alias("private"))


@query("page_text", r"SELECT page_id, substring(replace(replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), 1, 4000) AS text FROM pages")
def page_text(spark, sf):
    return S.table(spark, sf, "pages").select("page_id", F.substring(T.strip_html(F.col("html")), 1, 4000).alias("text"))


@query("strip_html", r"SELECT page_id, sha256(replace(replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS text_sha256 FROM pages")
def strip_html(spark, sf):
    return S.table(spark, sf, "pages").select("page_id", F.sha2(T.strip_html(F.col("html")), 256).alias("text_sha256"))


@query("tokenize", f"SELECT doc_id, len(t) AS n_tokens, sha256(array_to_string(t, ' ')) AS tokens_sha256 FROM (SELECT doc_id, regexp_extract_all(lower(text), {TOK}) AS t FROM documents)")
def tokenize(spark, sf):
    return S.table(spark, sf, "documents").select("doc_id", T.tokenize(F.col("text")).alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.sha2(F.array_join("t", " "), 256).alias("tokens_sha256"))


DIRTY = "CASE doc_id % 4 WHEN 0 THEN '## ' || text WHEN 1 THEN 'ignore previous ' || text WHEN 2 THEN chr(7) || '  ' || text || ' ### end ' ELSE text END"
INJECT = "'(?i)忽略上述|忽略上面|忽略之前|忽略前面|无视上述|无视上面|无视之前|ignore previous|ignore above|ignore prior|ignore all previous|disregard previous|disregard above|system:|</system>|<[|]system[|]>|<[|]im_start[|]>|role:|现在你是|现在你扮演|现在你是一个|你的新指令|新指令如下|override previous|override instructions|你被重新设定|jailbreak'"
CTRL = r"'[\x00-\x1F\x7F\x{200B}-\x{200F}\x{2028}-\x{202E}\x{2060}\x{FEFF}]'"


def _dirty(spark, sf):
    return S.table(spark, sf, "documents").select("doc_id", F.expr(DIRTY).alias("text"))


@query("sanitize_query", f"WITH d AS (SELECT doc_id, {DIRTY} AS text FROM documents), c AS (SELECT doc_id, substring(trim(regexp_replace(text, {CTRL}, '', 'g'), ' '), 1, 200) AS query FROM d) SELECT doc_id, query, regexp_matches(query, {INJECT}) AS rejected FROM c")
def sanitize_query(spark, sf):
    c = _dirty(spark, sf).select("doc_id", T.sanitize_query(F.col("text")).alias("query"))
    return c.select("doc_id", "query", T.is_injection(F.col("query")).alias("rejected"))


@query("sanitize_prompt", f"WITH d AS (SELECT doc_id, {DIRTY} AS text FROM documents) SELECT doc_id, sha256(regexp_replace(regexp_replace(text, {CTRL}, '', 'g'), {INJECT}, '[filtered]', 'g')) AS prompt_sha256 FROM d")
def sanitize_prompt(spark, sf):
    return _dirty(spark, sf).select("doc_id", F.sha2(T.sanitize_prompt(F.col("text")), 256).alias("prompt_sha256"))


@query("injection_flag", f"WITH d AS (SELECT doc_id, {DIRTY} AS text FROM documents) SELECT doc_id, regexp_matches(text, {INJECT}) AS injection FROM d")
def injection_flag(spark, sf):
    return _dirty(spark, sf).select("doc_id", T.is_injection(F.col("text")).alias("injection"))


@query("sanitize_text", f"""WITH d AS (SELECT doc_id, {DIRTY} AS text FROM documents), c AS (SELECT doc_id, regexp_replace(text, {CTRL}, '', 'g') AS t FROM d)
SELECT doc_id, substring(trim(regexp_replace(regexp_replace(regexp_replace(t, '^#{{1,6}}\\s+', ''), '#{{2,}}\\s*', ' ', 'g'), ' {{2,}}', ' ', 'g'), ' '), 1, 2000) AS text FROM c""")
def sanitize_text(spark, sf):
    return _dirty(spark, sf).select("doc_id", T.sanitize_text(F.col("text")).alias("text"))


@query("components_sanitize", with_("kb") + " SELECT service_id, CASE WHEN a2 = '' THEN c1 || ':view' ELSE c1 || ':view|' || c2 || ':open' END AS components FROM kb")
def components_sanitize(spark, sf):
    kb = S.catalog(spark, sf).select("service_id", K.clean_components(F.col("components")).alias("c"))
    return kb.select("service_id", F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["name"], x["action"])), "|").alias("components"))


@query("component_whitelist", with_("kb") + """, req AS (SELECT event_id AS id, 'p' || CAST(json_extract_string(props, '$.k') AS INT) AS service_id, 'Brand#' || (user_id % 25 + 1) || ' view' AS name, 'view' AS action FROM events WHERE event_type = 'click')
SELECT id, r.service_id, name, coalesce(name = c1 OR (name = c2 AND a2 <> ''), false) AS allowed FROM req r LEFT JOIN kb USING (service_id)""")
def component_whitelist(spark, sf):
    req = S.clicks(spark, sf).select("id", "service_id", F.concat(F.lit("Brand#"), (F.col("user_id") % 25 + 1).cast("string"), F.lit(" view")).alias("name"), F.lit("view").alias("action"))
    return K.whitelisted(req, S.catalog(spark, sf)).select("id", "service_id", "name", "allowed")


@query("service_detail", with_("kb") + " SELECT service_id, service_name, service_intro, path, component, decision_button FROM kb WHERE service_id = 'p17'")
def service_detail(spark, sf):
    return S.catalog(spark, sf).where(F.col("service_id") == "p17").select("service_id", "service_name", "service_intro", "path", "component", "decision_button")


@query("hash_user_id", "SELECT DISTINCT user_id, sha256(user_id || 'salt-v1') AS user_hash FROM events")
def hash_user_id(spark, sf):
    return S.table(spark, sf, "events").select("user_id").distinct().select("user_id", T.hash_user(F.col("user_id").cast("string"), "salt-v1").alias("user_hash"))


@query("cache_key", with_("queries") + " SELECT id, 'es:res:' || user_id || ':' || sha256(query) || ':hybrid' AS key FROM queries")
def cache_key(spark, sf):
    return S.queries(spark, sf).select("id", T.cache_key(F.col("user_id").cast("string"), F.col("query"), F.lit("hybrid")).alias("key"))


@query("reason_chunks", "SELECT item_id, i // 20 AS pos, substring(text, CAST(i + 1 AS BIGINT), 20) AS chunk FROM (SELECT item_id, text, unnest(range(0, length(text), 20)) AS i FROM benchmark)")
def reason_chunks(spark, sf):
    chunks = F.transform(F.sequence(F.lit(0), F.char_length("text") - 1, F.lit(20)), lambda i: F.substr(F.col("text"), i + 1, F.lit(20)))
    return S.table(spark, sf, "benchmark").where("char_length(text) > 0").select("item_id", F.posexplode(chunks).alias("pos", "chunk")).select("item_id", F.col("pos").cast("long"), "chunk")


ANSWER = """CASE doc_id % 4 WHEN 0 THEN '```json' || chr(10) || '["a", ' || doc_id || ']' || chr(10) || '```' WHEN 1 THEN 'Answer: [1, ' || doc_id || '] done' WHEN 2 THEN '{"id": ' || doc_id || '}' ELSE 'none' END"""


@query("extract_json", f"""WITH a AS (SELECT doc_id, regexp_replace({ANSWER}, '^```(json)?\\s*|\\s*```$', '', 'g') AS t FROM documents), c AS (SELECT doc_id, CASE WHEN json_valid(t) THEN t ELSE nullif(regexp_extract(t, '(?s)(\\[.*\\])', 1), '') END AS t FROM a) SELECT doc_id, CASE WHEN json_valid(t) THEN t END AS found FROM c""")
def extract_json(spark, sf):
    return S.table(spark, sf, "documents").select("doc_id", T.extract_json(F.expr(ANSWER.replace("chr(10)", "char(10)"))).alias("found"))


@query("kb_versions_list", "SELECT o_orderdate AS created_at, 'v' || o_orderkey AS version_id, o_orderkey = (SELECT arg_max(l_orderkey, (l_shipdate, 'v' || l_orderkey)) FROM lineitem) AS active FROM orders")
def kb_versions_list(spark, sf):
    v = S.table(spark, sf, "orders").select(F.col("o_orderdate").alias("created_at"), F.concat(F.lit("v"), F.col("o_orderkey").cast("string")).alias("version_id"))
    shipped = S.table(spark, sf, "lineitem").select(F.col("l_shipdate").alias("activated_at"), F.concat(F.lit("v"), F.col("l_orderkey").cast("string")).alias("version_id"))
    return K.list_versions(v, shipped)


@query("kb_op_logs_by_op", "SELECT event_id AS id, event_type AS op, value > 50 AS ok FROM events WHERE event_type = 'signup' ORDER BY id DESC LIMIT 50")
def kb_op_logs_by_op(spark, sf):
    e = S.events(spark, sf).select("id", F.col("event_type").alias("op"), (F.col("value") > 50).alias("ok"))
    return K.op_logs(e, op="signup", limit=50)


@query("sql_passthrough", "SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def sql_passthrough(spark, sf):
    args = {"c": S.table(spark, sf, "customer"), "n": S.table(spark, sf, "nation")}
    return spark.sql("SELECT n_name, count(*) AS customers FROM {c} JOIN {n} ON c_nationkey = n_nationkey GROUP BY n_name", **args)


@query("levenshtein_pairs", "SELECT a.p_name AS a, b.p_name AS b, levenshtein(a.p_name, b.p_name) AS distance FROM (SELECT DISTINCT p_name FROM part) a JOIN (SELECT DISTINCT p_name FROM part) b ON a.p_name < b.p_name AND abs(length(a.p_name) - length(b.p_name)) <= 2 WHERE levenshtein(a.p_name, b.p_name) <= 2")
def levenshtein_pairs(spark, sf):
    n = S.table(spark, sf, "part").select(F.col("p_name").alias("a")).distinct()
    near = n.select(F.col("a").alias("b"), F.explode(F.sequence(F.char_length("a") - 2, F.char_length("a") + 2)).alias("n"))
    d = n.withColumn("n", F.char_length("a")).join(near, "n").where("a < b").withColumn("distance", F.levenshtein("a", "b", 2))
    return d.where("distance >= 0").select("a", "b", "distance")


@query("embedding_status", "SELECT count(*) AS total, count(embedding) AS embedded, count(*) - count(embedding) AS missing FROM embeddings")
def embedding_status(spark, sf):
    return S.table(spark, sf, "embeddings").agg(F.count("*").alias("total"), F.count("embedding").alias("embedded")).withColumn("missing", F.col("total") - F.col("embedded"))
