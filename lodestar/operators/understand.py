"""Query understanding: intent, pre-classification, synonyms and spelling, for batches of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions.text import is_injection, strip_, tokenize
from lodestar.operators import fuzzy
from lodestar.operators.components import components
from lodestar.sources.shared import stored

# Fixed values, equal to those of the behaviour reproduced: connectors and phrases.
CONNECTORS = ("并且", "同时", "而且", "和", "且", "与", "及", "+", "&")
GUIDE_HINTS = (
    "如何开始", "怎么开始", "新手", "入门", "流程", "步骤", "怎么操作", "如何操作", "怎么玩",
    "如何玩", "怎么用", "如何使用", "操作流程", "使用流程", "指引", "引导", "操作指引",
)
INFO_HINTS = ("怎么", "如何", "怎样", "是什么", "什么是", "为什么", "为啥", "哪儿", "哪里", "哪个", "哪些", "多少", "是否")
ATTACK_HINTS = (
    "点击数", "点击次数", "总点击", "访问量", "密码", "密钥", "api key", "apikey", "系统提示", "system prompt",
    "越狱", "绕过限制", "扮演", "假装你是", "作为开发者", "后台数据", "数据库导出", "泄露",
)
IRRELEVANT_HINTS = (
    "每句话", "结尾带", "作诗", "写一首", "讲个", "讲笑话", "陪我聊天", "写代码", "写一篇", "续写", "改写这段",
    "你是谁", "你叫什么", "你是机器人", "你是ai", "你是什么",
)
OFF_TOPIC_HINTS = ("天气", "笑话", "星座", "运势", "讲个故事", "唱歌", "菜谱", "做饭", "电影", "球赛", "今天吃什么")
#: Canonical word -> its synonyms.
DOMAIN_SYNONYMS = {
    "开户": ["开股东卡", "证券开户", "网上开户", "新开户", "开立账户"],
    "银证转账": ["三方存管", "存管转账", "资金转账", "转入转出", "入金出金"],
    "申购": ["打新", "新股申购", "新债申购", "ipo申购", "一键打新"],
    "新股新债": ["打新", "新股", "新债", "ipo"],
    "订单": ["订单审批", "订单管理", "订单查询"],
    "委托": ["下单", "提交订单", "买卖委托"],
    "审批": ["审核", "复核", "审批通过", "审批流程"],
    "持仓": ["股票持仓", "持仓查询", "持仓明细"],
    "撤单": ["撤销委托", "撤委托", "取消订单"],
    "买入": ["买", "买进", "加仓", "建仓"],
    "卖出": ["卖", "减仓", "清仓"],
    "行情": ["股价", "实时行情", "股票行情", "看盘"],
    "查询": ["查看", "搜索", "查找"],
    "资金": ["余额", "可用资金", "资金账户"],
    "转账": ["转钱", "划转", "资金流转"],
    "风险": ["风控", "风险评估", "风险测评"],
    "账户": ["账号", "证券账户", "资金账户"],
    "密码": ["交易密码", "资金密码", "登录密码"],
    "登录": ["登入", "登陆", "sign in"],
    "退出": ["登出", "退出登录", "注销"],
    "消息": ["通知", "公告", "提醒"],
    "客服": ["在线客服", "联系客服", "人工服务"],
    "融资": ["融资融券", "融资买入", "两融"],
    "融券": ["融券卖出", "卖空", "做空"],
    "港股": ["港股通", "沪港通", "深港通"],
    "美股": ["海外股票", "中概股"],
    "基金": ["公募基金", "etf", "lof"],
    "理财": ["理财产品", "固收", "活期理财"],
    "可转债": ["转债", "可转换债券", "发债"],
}


def _any(c: Column, words) -> Column:
    return c.rlike("|".join(rf"\Q{w}\E" for w in words))


def connector_pattern(connectors=CONNECTORS) -> str:
    return "|".join(rf"\Q{c}\E" for c in sorted(connectors, key=len, reverse=True))


def split_subqueries(c: Column, connectors=CONNECTORS) -> Column:
    """Parts between connectors, the longest connector first, without blank ones."""
    return F.filter(F.transform(F.split(c, connector_pattern(connectors)), strip_), lambda x: x != "")


def navigational(queries: DataFrame, kb: DataFrame, text_col: str = "text") -> DataFrame:
    """(query_id, matched_id): the service whose name, or else one of whose aliases, is the query; the first one by ord."""
    names = kb.select(F.lower(strip_(F.col("service_name"))).alias("__q"), F.lit(0).alias("__kind"), "ord", "service_id")
    aliases = kb.select(F.explode("aliases").alias("a"), "ord", "service_id").select(F.lower(strip_(F.col("a"))).alias("__q"), F.lit(1).alias("__kind"), "ord", "service_id")
    best = names.unionByName(aliases).where("__q <> ''").groupBy("__q").agg(F.min(F.struct("__kind", "ord", "service_id")).alias("b"))
    return queries.select("query_id", F.lower(strip_(F.col(text_col))).alias("__q")).join(best, "__q").select("query_id", F.col("b.service_id").alias("matched_id"))


def classify(queries: DataFrame, kb: DataFrame, text_col: str = "text", connectors=CONNECTORS, guide=GUIDE_HINTS, info=INFO_HINTS, has_session: Column | None = None) -> DataFrame:
    """queries with intent, matched_id and sub_queries: exact match, connectors, guide, question, session, default."""
    q = strip_(F.col(text_col))
    multi = q.rlike(connector_pattern(connectors))
    intent = (
        F.when(q == "", "default").when(F.col("matched_id").isNotNull(), "navigational").when(multi, "multi_condition")
        .when(_any(q, guide), "guide").when(_any(q, info), "informational")
        .when(F.coalesce(has_session, F.lit(False)) if has_session is not None else F.lit(False), "conversational").otherwise("default")
    )
    found = queries.join(navigational(queries, kb, text_col), "query_id", "left").withColumn("intent", intent)
    return found.withColumn("sub_queries", F.when(F.col("intent") == "multi_condition", split_subqueries(q, connectors)).otherwise(F.array().cast("array<string>")))


def preclassify(c: Column) -> Column:
    """Rule class of a query: prompt_attack, irrelevant_prompt, off_topic or normal."""
    return (
        F.when(is_injection(c), "prompt_attack").when(_any(c, ATTACK_HINTS) | _any(F.lower(c), ATTACK_HINTS), "prompt_attack")
        .when(_any(c, IRRELEVANT_HINTS), "irrelevant_prompt").when(_any(c, OFF_TOPIC_HINTS), "off_topic").otherwise("normal")
    )


def synonym_pairs(spark: SparkSession, dictionary: dict[str, list[str]] | None = None) -> DataFrame:
    """(ord, canonical, word) of registered groups, in order of registration."""
    d = DOMAIN_SYNONYMS if dictionary is None else dictionary
    return spark.createDataFrame([(i, c, w) for i, (c, ws) in enumerate(d.items()) for w in [c, *ws]], "ord int, canonical string, word string")


def kb_synonym_pairs(kb: DataFrame, offset: int = 0) -> DataFrame:
    """A service's name and aliases as a group, registered after offset others. Blank words are left out."""
    words = F.concat(F.array("service_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    pairs = kb.select((F.col("ord") + offset).cast("long").alias("ord"), F.lower("service_name").alias("canonical"), F.explode(F.transform(words, F.lower)).alias("word"))
    return pairs.where("word <> ''")


def synonym_groups(pairs: DataFrame) -> DataFrame:
    """(word, group_id, canonical): groups that share a word are one; its canonical word is that of the first registered.

    A word ties the groups that have it to the first of them, so a word of n groups makes n edges, and the groups are components of
    these ties. The rounds grow with the logarithm of the longest chain of groups. Of groups of the same words the first stands for all: the others tie nothing
    more, and none of them is a first one.
    """
    given = pairs.select(F.col("ord").cast("long").alias("ord"), "canonical", "word").distinct()
    # A set of words is known by its number and 128 bits of hash.
    each = given.select("ord", "word").distinct().groupBy("ord").agg(F.count("*").alias("n"), *[F.bit_xor(F.xxhash64(F.lit(i), "word")).alias(f"h{i}") for i in (0, 1)])
    first = each.groupBy("n", "h0", "h1").agg(F.min("ord").alias("ord"))
    own = stored(given.join(first.select("ord"), "ord", "left_semi"), "pairs")
    ties = own.join(own.groupBy("word").agg(F.min("ord").alias("first")), "word").select(F.col("ord").alias("a"), F.col("first").alias("b")).where("a <> b")
    roots, _ = components(ties)
    names = own.groupBy("ord").agg(F.min("canonical").alias("canonical")).withColumnRenamed("ord", "group_id")
    kind = pairs.schema["ord"].dataType
    found = own.join(roots.withColumnRenamed("node", "ord"), "ord", "left").select("word", F.coalesce("root", "ord").alias("group_id")).distinct()
    return found.join(names, "group_id").select("word", F.col("group_id").cast(kind).alias("group_id"), "canonical")


def add_synonyms(groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """synonym_groups() of what made groups and of pairs, registered later, without working out the first ones again.

    An old group counts as one, so the work follows the number of groups and not the chains that made them.
    """
    old = groups.select(F.col("group_id").cast("long").alias("ord"), "canonical", "word")
    return synonym_groups(old.unionByName(pairs.select(F.col("ord").cast("long").alias("ord"), "canonical", "word")))


def expand(tokens: DataFrame, groups: DataFrame) -> DataFrame:
    """tokens (query_id, token) -> the tokens, the tokens of their synonyms, and the synonyms whole; distinct."""
    own = tokens.select("query_id", "token").distinct()
    g = groups.select("word", "group_id")
    syn = own.join(g.withColumnRenamed("word", "token"), "token").join(g, "group_id").where("word <> token").select("query_id", F.col("word").alias("token"))
    parts = syn.select("query_id", F.explode(tokenize(F.col("token"))).alias("token"))
    return own.unionByName(parts).unionByName(syn).distinct()


def normalize(queries: DataFrame, groups: DataFrame, text_col: str = "text") -> DataFrame:
    """(query_id, normalized): each token replaced by its group's canonical word, joined by spaces; without tokens the query."""
    tokens = queries.select("query_id", F.posexplode(tokenize(F.col(text_col))).alias("pos", "token"))
    named = tokens.join(groups.select(F.col("word").alias("token"), "canonical"), "token", "left")
    joined = named.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("canonical", "token").alias("t")))), lambda s: s["t"]), " ").alias("normalized"))
    return queries.join(joined, "query_id", "left").select("query_id", F.coalesce("normalized", F.col(text_col)).alias("normalized"))


def corrections(tokens: DataFrame, vocabulary: DataFrame, distance: int = 2, min_length: int = 2, index: DataFrame | None = None) -> DataFrame:
    """(token, candidate, distance) of tokens not in vocabulary (term): the nearest term, ties to the shorter, then smaller.

    Tokens and terms meet on a form that both have with letters taken out; index is the vocabulary's, where one is kept.
    """
    oov = tokens.select("token").distinct().where(F.char_length("token") >= min_length).join(vocabulary.withColumnRenamed("term", "token"), "token", "left_anti")
    near = fuzzy.near_terms(oov, index if index is not None else fuzzy.vocabulary_index(vocabulary, distance, min_length), distance)
    best = near.groupBy("token").agg(F.min(F.struct("d", F.char_length("term").alias("len"), "term")).alias("b"))
    return best.select("token", F.col("b.term").alias("candidate"), F.col("b.d").alias("distance"))


def suggest(queries: DataFrame, vocabulary: DataFrame, index: DataFrame | None = None, text_col: str = "text", readings: DataFrame | None = None) -> DataFrame:
    """(query_id, suggestion) of queries in which a token could be corrected; with readings, a token that has no near term is
    given one that sounds alike."""
    tokens = queries.select("query_id", F.posexplode(tokenize(F.col(text_col))).alias("pos", "token"))
    near = corrections(tokens, vocabulary, index=index).select("token", "candidate")
    if readings is not None:
        near = near.unionByName(phonetic(tokens.join(near, "token", "left_anti"), vocabulary, readings))
    fixed = tokens.join(near, "token", "left")
    out = fixed.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("candidate", "token").alias("t")))), lambda s: s["t"]), " ").alias("suggestion"), F.count("candidate").alias("n"))
    return out.where("n > 0").select("query_id", "suggestion")


def named_words(queries: DataFrame, kb: DataFrame, vocabulary: DataFrame, text_col: str = "text") -> DataFrame:
    """(query_id) of queries that have a word of the vocabulary (term), or are part of a service's name or alias."""
    by_word = queries.select("query_id", F.explode(tokenize(F.col(text_col))).alias("term")).join(vocabulary, "term", "left_semi").select("query_id")
    names = kb.select(F.explode(F.transform(F.concat(F.array("service_name"), F.col("aliases")), F.lower)).alias("text")).distinct()
    asked = queries.select(F.col("query_id").alias("key"), F.lower(strip_(F.col(text_col))).alias("part"))
    by_name = fuzzy.held(asked, fuzzy.gram_index(names)).withColumnRenamed("key", "query_id")
    return by_word.union(by_name).distinct()


def rescued(queries: DataFrame, kb: DataFrame, vocabulary: DataFrame, text_col: str = "text") -> DataFrame:
    """(query_id, class, rescued): a query classed as not normal is taken back if it is of the catalog's words or names."""
    c = queries.select("query_id", text_col, preclassify(F.col(text_col)).alias("class"))
    back = named_words(c.where("class <> 'normal'"), kb, vocabulary, text_col).withColumn("__back", F.lit(True))
    return c.join(back, "query_id", "left").select("query_id", "class", F.coalesce("__back", F.lit(False)).alias("rescued"))


#: What letters sound like where no table of readings is given: one letter for each group that is easily mistaken, none for vowels.
LETTER_SOUNDS = {"b": "bfpv", "c": "cgjkqsxz", "d": "dt", "l": "l", "m": "mn", "r": "r", "": "aeiouhwy"}


def letter_readings(spark: SparkSession) -> DataFrame:
    """(char, reading) of LETTER_SOUNDS."""
    return spark.createDataFrame([(c, sound) for sound, letters in LETTER_SOUNDS.items() for c in letters], "char string, reading string")


def sounds(words: DataFrame, readings: DataFrame) -> DataFrame:
    """words (word), readings (char, reading) -> (word, sound): what a word can sound like, one row for each combination of its characters' readings.

    A character of several readings is each of them in turn; one that the table lacks stands for itself, in lower case. Words without a sound are
    left out. The rows of a word are the product of its readings, all of them: words are short.
    """
    chars = words.select("word").distinct().select("word", F.posexplode(F.split(F.lower("word"), "")).alias("pos", "char"))
    known = readings.groupBy(F.lower("char").alias("char")).agg(F.array_sort(F.collect_set(F.lower("reading"))).alias("options"))
    each = chars.join(known, "char", "left").select("word", F.struct("pos", F.coalesce("options", F.array("char")).alias("options")).alias("c"))
    listed = each.groupBy("word").agg(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["options"]).alias("options"))
    joined = F.aggregate("options", F.array(F.lit("")), lambda done, more: F.array_distinct(F.flatten(F.transform(done, lambda d: F.transform(more, lambda m: F.concat(d, m))))))
    return listed.select("word", F.explode(joined).alias("sound")).where("sound <> ''")


def phonetic(tokens: DataFrame, vocabulary: DataFrame, readings: DataFrame | None = None) -> DataFrame:
    """(token, candidate) of tokens not in vocabulary (term): the shortest term that sounds alike, ties to the smaller one.

    Words sound alike if some reading of one is some reading of the other; they are joined on the sounds. readings (char, reading) is the table
    of a script's sounds, such as the syllables of Chinese characters; without one, letters that are easily mistaken sound alike.
    """
    table = readings if readings is not None else letter_readings(tokens.sparkSession)
    oov = tokens.select("token").distinct().join(vocabulary.withColumnRenamed("term", "token"), "token", "left_anti")
    mine = sounds(oov.withColumnRenamed("token", "word"), table).withColumnRenamed("word", "token")
    hit = mine.join(sounds(vocabulary.withColumnRenamed("term", "word"), table).withColumnRenamed("word", "term"), "sound")
    best = hit.groupBy("token").agg(F.min(F.struct(F.char_length("term").alias("n"), "term")).alias("b"))
    return best.select("token", F.col("b.term").alias("candidate"))


def deep_expand(queries: DataFrame, kb: DataFrame, groups: DataFrame, limit: int = 40, text_col: str = "text") -> DataFrame:
    """(query_id, token, n): the query's tokens, then those of synonyms, then those of names and aliases that share a token with
    the query; limit tokens at most, each kind in order of the token."""
    own = queries.select("query_id", F.explode(tokenize(F.col(text_col))).alias("token")).distinct()
    wide = expand(own, groups)
    sets = kb.select(F.array_sort(F.array_distinct(tokenize(F.concat_ws(" ", "service_name", F.array_join("aliases", " "))))).alias("toks")).distinct()
    by_token = sets.select(F.explode("toks").alias("token"), "toks").select("token", F.explode("toks").alias("other")).distinct()
    near = own.join(by_token, "token").select("query_id", F.col("other").alias("token")).distinct()
    every = own.withColumn("kind", F.lit(0)).unionByName(wide.withColumn("kind", F.lit(1))).unionByName(near.withColumn("kind", F.lit(2)))
    first = every.groupBy("query_id", "token").agg(F.min("kind").alias("kind"))
    w = Window.partitionBy("query_id").orderBy("kind", "token")
    return first.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit).select("query_id", "token", "n")
