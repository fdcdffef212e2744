"""The recall pipeline: signals joined to the catalog, fused, ranked, reranked and diversified, for a batch of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import MAX_ID, MAX_REASON, strip_, strip_html, tokenize
from lodestar.operators import bm25 as B
from lodestar.operators import normalize as N
from lodestar.operators import rank as R
from lodestar.operators import vector as V


#: Queries that are broadcast against the catalog at a time.
BATCH = 1_000


#: Parts of the catalog that a block of a larger batch meets one by one, so that a block is not one task.
PARTS = 64


def every_pair(batch: DataFrame, kb: DataFrame, n: int | None = None) -> DataFrame:
    """Every query with every service, the catalog's partitions staying where they are.

    A batch of up to BATCH rows is broadcast, its size having been counted; a larger one meets the catalog in blocks of that size,
    and each block meets the catalog in PARTS parts. n: the batch's size, where it is known.
    """
    n = batch.count() if n is None else n
    if n <= BATCH:
        return kb.crossJoin(F.broadcast(batch))
    blocks = -(-n // BATCH)
    cut = batch.withColumns({"__block": F.pmod(F.xxhash64(*batch.columns), F.lit(blocks)).cast("int"), "__part": F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))})
    dealt = kb.withColumns({"__block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), "__part": F.pmod(F.xxhash64(*kb.columns), F.lit(PARTS)).cast("int")})
    return dealt.join(cut, ["__block", "__part"]).drop("__block", "__part")


def scores(
    batch: DataFrame, kb: DataFrame, index: B.Index, popularity: DataFrame, mode: str = "hybrid",
    query_vectors: DataFrame | None = None, vectors: DataFrame | None = None, terms: DataFrame | None = None,
) -> DataFrame:
    """(query_id, service_id, ord, cos, vec, bmn, popn, score) of every query and service, as the full scan scores them.

    BM25 is normalised over all services, zeros included; popularity over the services that have any. The modes leave a
    signal's plan out, not just its weight. Each side is complete before the two meet: a service with its popularity, vector
    and the BM25 scores of the queries that it matches, a query with its vector and the extremes of its BM25 scores. So
    the product of both is neither joined nor shuffled again: a top-k after it keeps k rows a task. A batch over BATCH
    queries keeps a service's matches as rows, as there is no bound for them, and joins them. terms (query_id, term, qtf)
    are the words of the queries for BM25, if not those of their texts.
    """
    asked, services = batch.select("query_id"), kb.select("service_id", "ord")
    n = batch.count()
    services = services.join(N.minmax(popularity, "popularity", "popn").select("service_id", "popn"), "service_id", "left")
    hits = None
    if mode != "semantic":
        raw = B.score(index, terms if terms is not None else B.query_terms(batch)).withColumnRenamed("id", "service_id")
        raw = raw.join(kb.select("service_id").hint("merge"), "service_id", "left_semi")  # as many rows as services: not to be broadcast
        found = raw.groupBy("query_id").agg(F.max("bm25").alias("hi"), F.min("bm25").alias("least"), F.count("*").alias("hits"))
        size = kb.agg(F.count("*").alias("services"))
        found = found.crossJoin(F.broadcast(size)).select("query_id", "hi", F.when(F.col("hits") < F.col("services"), F.lit(0.0)).otherwise(F.col("least")).alias("lo"))
        asked = asked.join(found, "query_id", "left")
        if n <= BATCH:
            own = raw.groupBy("service_id").agg(F.map_from_entries(F.collect_list(F.struct("query_id", "bm25"))).alias("matches"))
            services = services.join(own, "service_id", "left")
        else:
            hits = raw
    if mode != "keyword":
        qv = query_vectors if query_vectors is not None else V.hash_embedding(batch, "query_id", "text")
        kv = vectors if vectors is not None else V.hash_embedding(kb, "service_id", "searchable")
        asked = asked.join(qv.select("query_id", F.col("vec").alias("qvec")), "query_id", "left")
        services = services.join(kv.select("service_id", F.col("vec").alias("kvec")).hint("merge"), "service_id", "left")  # likewise
    out = every_pair(asked, services, n)
    if mode != "semantic":
        if hits is None:
            out = out.withColumn("bm25", F.try_element_at("matches", F.col("query_id"))).drop("matches")
        else:
            out = out.join(hits, ["query_id", "service_id"], "left")
        value, lo, hi = (F.coalesce(c, F.lit(0.0)) for c in ("bm25", "lo", "hi"))
        out = out.withColumn("bmn", F.when(N.close(hi, lo), 0.0).otherwise((value - lo) / (hi - lo))).drop("bm25", "lo", "hi")
    else:
        out = out.withColumn("bmn", F.lit(0.0))
    if mode != "keyword":
        out = out.withColumn("cos", F.coalesce(V.dot(F.col("qvec"), F.col("kvec")), F.lit(0.0))).drop("qvec", "kvec")
    else:
        out = out.withColumn("cos", F.lit(0.0))
    out = out.withColumns({"vec": F.greatest(F.lit(0.0), F.col("cos")), "popn": F.coalesce("popn", F.lit(0.0))})
    return out.withColumn("score", F.round(R.hybrid(F.col("vec"), F.col("bmn"), F.col("popn"), mode), 6))


def recall(scored: DataFrame, k: int = 20) -> DataFrame:
    """The k best services of each query, ties by ord."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "ord")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def signal_lists(scored: DataFrame, k: int) -> DataFrame:
    """(query_id, list, id, rank): the best k by keywords (list 0) and by vector (list 1)."""
    parts = []
    for i, c in enumerate(("bmn", "vec")):
        w = Window.partitionBy("query_id").orderBy(F.desc(F.round(c, 6)), "ord")
        parts.append(scored.select("query_id", F.lit(i).alias("list"), F.col("service_id").alias("id"), F.row_number().over(w).alias("rank")).where(F.col("rank") <= k))
    return parts[0].unionByName(parts[1])


def pruned(scored: DataFrame, k: int = 100) -> DataFrame:
    """(query_id, service_id): the best k by either signal."""
    return signal_lists(scored, k).select("query_id", F.col("id").alias("service_id")).distinct()


def features(recalled: DataFrame, batch: DataFrame, kb: DataFrame, popularity: DataFrame) -> DataFrame:
    """recalled with idx, cosine, name_ov, intro_ov and pop (min-max over the query's candidates)."""
    own = kb.select("service_id", "service_name", "service_intro")
    j = recalled.join(batch.select("query_id", F.array_distinct(tokenize(F.col("text"))).alias("q")), "query_id").join(own, "service_id").join(popularity, "service_id", "left")
    n = F.greatest(F.size("q"), F.lit(1))
    w = Window.partitionBy("query_id")
    p = F.coalesce("popularity", F.lit(0.0))
    lo, hi = F.min(p).over(w), F.max(p).over(w)
    return j.withColumns({
        "idx": F.col("ord"), "cosine": F.col("cos"),
        "name_ov": R.overlap(F.col("q"), tokenize(F.col("service_name"))) / n,
        "intro_ov": R.overlap(F.col("q"), tokenize(F.col("service_intro"))) / n,
        "pop": (p - lo) / F.when(hi == lo, 1.0).otherwise(hi - lo),
    })


def _ordered(df: DataFrame) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "ord")
    return df.withColumn("rank", F.row_number().over(w))


def reranked(featured: DataFrame) -> DataFrame:
    """The heuristic reranker over features()."""
    return _ordered(featured.withColumn("rerank_score", F.round(R.heuristic(F.col("cosine"), F.col("score"), F.col("name_ov"), F.col("intro_ov")), 6)))


def network_reranked(featured: DataFrame, judged: DataFrame) -> DataFrame:
    """featured in the order of judged (query_id, service_id, dcn_score); a query of one candidate has the fixed weights."""
    n = F.count("*").over(Window.partitionBy("query_id"))
    own = F.when(n > 1, F.col("dcn_score")).otherwise(R.heuristic(F.col("cosine"), F.col("score"), F.col("name_ov"), F.col("intro_ov")))
    return _ordered(featured.join(judged, ["query_id", "service_id"]).withColumn("rerank_score", F.round(own, 6)).drop("dcn_score"))


def provider_reranked(featured: DataFrame, responses: DataFrame) -> DataFrame:
    """featured in the order that a model gave: responses (query_id, index, relevance), index being the place in the recall from 0.

    A candidate without relevance keeps its score, one that the model left out goes, one named twice counts by its largest
    relevance. Places that no candidate has are dropped; a query left without any is reranked here.
    """
    said = responses.groupBy("query_id", (F.col("index") + 1).alias("rank")).agg(F.max("relevance").alias("__said"))
    mapped = featured.join(said, ["query_id", "rank"]).withColumn("rerank_score", F.round(F.coalesce("__said", "score"), 6)).drop("__said")
    rest = featured.join(mapped.select("query_id").distinct(), "query_id", "left_anti")
    return _ordered(mapped).unionByName(reranked(rest))


def overlap_reranked(recalled: DataFrame, batch: DataFrame, kb: DataFrame) -> DataFrame:
    """score plus 0.01 for each distinct token that query and service share."""
    j = recalled.join(batch.select("query_id", F.array_distinct(tokenize(F.col("text"))).alias("q")), "query_id").join(kb.select("service_id", "searchable"), "service_id")
    return _ordered(j.withColumn("rerank_score", F.round(F.col("score") + 0.01 * R.overlap(F.col("q"), tokenize(F.col("searchable"))), 6)))


def diversified(ranked: DataFrame, vectors: DataFrame, k: int = 10, rel: str = "score") -> DataFrame:
    """(query_id, pos, service_id): maximal marginal relevance over a query's few ranked rows."""
    own = ranked.select("query_id", "rank", F.col(rel).alias("rel"), "service_id")
    c = own.join(vectors.select("service_id", "vec"), "service_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "rel", "vec", "service_id"))).alias("c"))
    return c.select("query_id", "c", F.posexplode(R.mmr(F.col("c"), k)).alias("pos", "p")).select("query_id", "pos", F.get("c", F.col("p"))["service_id"].alias("service_id"))


def clean_reasons(reasons: DataFrame, id_col: str = "service_id", reason_col: str = "reason") -> DataFrame:
    """reasons with tags stripped from both columns, cut to their limits, without empty ones."""
    own = reasons.withColumns({id_col: F.substring(strip_(F.col(id_col)), 1, MAX_ID), reason_col: F.substring(strip_(strip_html(F.col(reason_col))), 1, MAX_REASON)})
    return own.where(F.col(reason_col) != "")


def valid_reasons(reasons: DataFrame, kb: DataFrame) -> DataFrame:
    """(service_id, reason) of known services, tags stripped, cut to the limit, without empty ones."""
    return clean_reasons(reasons.select("service_id", "reason")).join(kb.select("service_id"), "service_id", "left_semi")


def pick_component(tokens: Column, components: Column, button: Column, path: Column) -> Column:
    """struct(label, action, href): the first component that shares a token with the query, else the route's entry."""
    hit = F.get(F.filter(components, lambda c: F.arrays_overlap(tokenize(c["name"]), tokens)), 0)
    return F.when(hit.isNotNull(), F.struct(hit["name"].alias("label"), hit["action"].alias("action"), F.lit("").alias("href"))).otherwise(F.struct(button.alias("label"), F.lit("").alias("action"), path.alias("href")))
