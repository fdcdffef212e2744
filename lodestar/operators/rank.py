"""Ranking: weighted fusion, rerankers, reciprocal rank fusion, intersection, diversity, confidence and reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import tokenize
from lodestar.operators.vector import dot

VECTOR, BM25, POPULARITY = 0.6, 0.3, 0.1
RRF = 60
MMR_LAMBDA = 0.85
#: Worths nearer to each other than this are a tie: vectors and cosines are sums, whose last digits follow the order of summing.
MMR_TIE = 1e-12
NEGATIVE_HINTS = ("次", "不", "较弱", "次要", "较差", "无关", "更低", "靠后")
#: Words of weakness (above) and of praise, and the texts of reasons below.
DIRECT = "精确命中服务名称，直达该服务。"
POSITIVE_HINTS = ("最相关", "最佳", "首选", "top1", "第一位", "最优", "强相关")


def hybrid(vector: Column, bm25: Column, popularity: Column, mode: str = "hybrid") -> Column:
    """Weighted sum; keyword mode leaves the vector out, semantic mode the keywords, without planning for them."""
    out = F.lit(0.0)
    if mode != "keyword":
        out = out + VECTOR * F.coalesce(vector, F.lit(0.0))
    if mode != "semantic":
        out = out + BM25 * F.coalesce(bm25, F.lit(0.0))
    return out + POPULARITY * F.coalesce(popularity, F.lit(0.0))


def overlap(query_tokens: Column, text_tokens: Column) -> Column:
    """Distinct tokens in common."""
    return F.size(F.array_intersect(query_tokens, text_tokens))


def heuristic(cosine: Column, score: Column, name_share: Column, intro_share: Column) -> Column:
    return 0.5 * cosine + 0.3 * score + 0.1 * name_share + 0.1 * intro_share


def rrf(lists: DataFrame, k: int, keys: list[str], constant: int = RRF) -> DataFrame:
    """lists (keys..., list, rank from 1, id) -> (keys..., id, rrf, rank): sum of 1 / (constant + rank); ties keep the order
    in which ids were first seen, list by list."""
    fused = lists.groupBy(*keys, "id").agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 9).alias("rrf"), F.min(F.struct("list", "rank")).alias("__seen"))
    w = Window.partitionBy(*keys).orderBy(F.desc("rrf"), "__seen", "id") if keys else Window.orderBy(F.desc("rrf"), "__seen", "id")
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("__seen")


def intersect(lists: DataFrame, keys: list[str], k: int = 30) -> DataFrame:
    """Ids that are in all of a query's lists, in the order of the first list; where there are none, the fused union.

    mode tells which: `default` for a single list, `intersection`, or `union`.
    """
    n = lists.groupBy(*keys).agg(F.countDistinct("list").alias("__n"))
    per_id = lists.groupBy(*keys, "id").agg(F.countDistinct("list").alias("__in"), F.min(F.struct("list", "rank")).alias("__first"))
    common = per_id.join(n, keys).where("__in = __n").select(*keys, "id", F.col("__first.rank").alias("__rank"), F.when(F.col("__n") == 1, "default").otherwise("intersection").alias("mode"))
    w = Window.partitionBy(*keys).orderBy("__rank", "id")
    common = common.select(*keys, "id", F.row_number().over(w).alias("rank"), "mode").where(F.col("rank") <= k)
    rest = rrf(lists.join(common.select(*keys).distinct(), keys, "left_anti"), k, keys).select(*keys, "id", "rank", F.lit("union").alias("mode"))
    return common.unionByName(rest)


def mmr(candidates: Column, k: int = 10, balance: float = MMR_LAMBDA) -> Column:
    """Positions (from 0) chosen from an array of struct<rel, vec> in rank order: the first, then again and again the one of
    largest balance * rel - (1 - balance) * max(0, largest cosine to those chosen), ties (MMR_TIE) to the smaller position.
    Vectors are of unit length. k or fewer candidates are all kept in order.

    A fold over positions inside the row, for the few candidates that are left of a query.
    """
    n = F.size(candidates)

    def step(chosen: Column, _: Column) -> Column:
        left = F.filter(F.sequence(F.lit(0), n - 1), lambda p: ~F.array_contains(chosen, p))

        def worth(p: Column) -> Column:
            c = F.get(candidates, p)
            nearest = F.array_max(F.transform(chosen, lambda j: dot(c["vec"], F.get(candidates, j)["vec"])))
            v = balance * c["rel"] - (1 - balance) * F.greatest(F.lit(0.0), nearest)
            return F.struct(F.coalesce(v, F.lit(float("-inf"))).alias("v"), p.alias("p"))

        def better(best: Column, c: Column) -> Column:
            return F.when(best["p"].isNull() | (c["v"] > best["v"] + MMR_TIE), c).otherwise(best)

        none = F.struct(F.lit(float("-inf")).alias("v"), F.lit(None).cast("int").alias("p"))
        return F.array_append(chosen, F.aggregate(F.transform(left, worth), none, better)["p"])

    picked = F.aggregate(F.sequence(F.lit(1), F.lit(k - 1)), F.array(F.lit(0)), step)
    return F.when(n <= k, F.sequence(F.lit(0), n - 1)).otherwise(picked)


def confidence(results: DataFrame, intent: Column, cold: Column) -> DataFrame:
    """results (query_id, rank, score, ...) with intent and cold per query -> delta, n_hits, n_triggers, deep, confidence."""
    own = results.groupBy("query_id", intent.alias("intent"), cold.alias("cold")).agg(
        F.sort_array(F.collect_list(F.when(F.col("rank") <= 3, F.col("score"))), asc=False).alias("s"), F.count_if(F.col("score") > 0).alias("n_hits")
    )
    top1, top2 = F.get("s", 0), F.coalesce(F.get("s", 1), F.lit(0.0))
    skipped = F.col("intent").isin("navigational", "multi_condition", "conversational")
    delta = F.round(top1 - top2, 6)
    triggers = (delta < 0.05).cast("int") + (F.col("n_hits") < 3).cast("int") + ((F.col("intent") == "informational") & (top1 < 0.4)).cast("int")
    n = F.when(skipped, 0).otherwise(triggers)
    sure = F.when(skipped, 1.0).when(n == 0, 0.8).otherwise(F.greatest(F.lit(0.0), 1.0 - 0.3 * n - F.when(F.col("cold"), 0.1).otherwise(0.0)))
    return own.select("query_id", "intent", F.when(skipped, 0.0).otherwise(delta).alias("delta"), "n_hits", n.alias("n_triggers"), (n > 0).alias("deep"), F.round(sure, 4).alias("confidence"))


def template_reason(query: Column, name: Column, aliases: Column, intro: Column, score: Column) -> Column:
    """Why a row was found, by the field that holds a word of the query."""
    tokens, tail = F.array_distinct(tokenize(query)), F.concat(F.lit("综合分"), F.format_string("%.4f", F.round(score, 4)), F.lit("。"))
    name_hit = F.exists(tokens, lambda t: name.contains(t)) | ((name != "") & F.contains(query, name))
    alias = F.get(F.filter(aliases, lambda a: (a != "") & (F.contains(query, a) | F.exists(tokens, lambda t: a.contains(t)))), 0)
    return (
        F.when(F.size(tokens) == 0, F.concat(F.lit("综合相关性与关键词覆盖，"), tail))
        .when(name_hit, F.concat(F.lit("服务名「"), name, F.lit("」直接命中查询，"), tail))
        .when(alias.isNotNull(), F.concat(F.lit("别名「"), alias, F.lit("」命中查询，"), tail))
        .when(F.exists(tokens, lambda t: intro.contains(t)), F.concat(F.lit("服务简介包含查询关键词，"), tail))
        .otherwise(F.concat(F.lit("语义相似匹配（无关键词字面命中），"), tail))
    )


def contradicts_rank(reason: Column, rank: Column, n: Column) -> Column:
    """True for a reason with words of weakness in the first half of the ranks, or of praise in the second."""
    half = F.greatest(F.lit(1), F.floor(n / 2))
    return F.when(rank <= half, reason.rlike("|".join(NEGATIVE_HINTS))).otherwise(reason.rlike("|".join(POSITIVE_HINTS)))


def pin(results: DataFrame, target: DataFrame) -> DataFrame:
    """results (query_id, id, rank, score) with target (query_id, id) put first; a target not among them enters with score 1."""
    t = target.select("query_id", "id", F.lit(True).alias("__pin"))
    both = results.join(t, ["query_id", "id"], "full_outer").select("query_id", "id", F.coalesce("score", F.lit(1.0)).alias("score"), "rank", F.coalesce("__pin", F.lit(False)).alias("__pin"))
    w = Window.partitionBy("query_id").orderBy(F.desc("__pin"), "rank", "id")
    return both.select("query_id", "id", "score", F.row_number().over(w).alias("rank"), F.col("__pin").alias("pinned"))
