"""The engine as one object: a catalog and a behaviour store in a folder, and every question a user of it may ask.

All methods take and give DataFrames; single questions are batches of one. Indexes are built once per version of the
catalog, stored as Parquet under its content hash, and read back, so a question reads postings and vectors alone.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.functions.text import tokenize
from lodestar.operators import answers as A
from lodestar.operators import bm25 as B
from lodestar.operators import dcn
from lodestar.operators import kb as K
from lodestar.operators import logs as L
from lodestar.operators import monitor as M
from lodestar.operators import rank as R
from lodestar.operators import recommend as C
from lodestar.operators import retrieve
from lodestar.operators import session as H
from lodestar.operators import fuzzy
from lodestar.operators import signals as G
from lodestar.operators import threshold
from lodestar.operators import understand as U
from lodestar.operators import vector as V
from lodestar.sources import shared
from lodestar.sources import tables as S
from lodestar.sources.commits import Commits, Numbers
from lodestar.streaming import live

#: Tables of behaviour: append-only facts.
FACTS = {
    "clicks": "id long, user_id long, service_id string, ts double, deprecated boolean",
    "queries": "id long, user_id long, query string, ts double",
    "feedback": "id long, user_id long, service_id string, dwell_ms int, ts double",
    "op_logs": "id long, op string, version_id string, ok boolean, ts double",
    "searches": "id long, user_id long, query string, top_ids array<string>, latencies map<string,double>, cache_hit boolean, degraded boolean, error boolean, clicked_sid string, ts double",
    "external": "id long, service string, ok boolean, latency_ms double",
    "turns": "session_id string, turn_idx int, query string, top_ids array<string>",
}
#: What answered queries have found.
ANSWERS = "cache_key string, results array<struct<pos:int,service_id:string,pinned:boolean,deep:boolean,score:double,reason:string>>, ts double"
#: Users with so many queries have a history that counts; so many of the newest ones, the present one included, do. Seconds that
#: an answer is kept for.
HISTORY, HISTORY_WINDOW, CACHE_S = 10, 50, 300.0
#: Related services that are kept for each service.
RELATED = 3
Embedder = Callable[[DataFrame, str, str], DataFrame]
Reranker = Callable[[DataFrame], DataFrame]
Reasoner = Callable[[DataFrame], DataFrame]
Completer = Callable[[DataFrame], DataFrame]
Classifier = Callable[[DataFrame], DataFrame]
#: Queries and clicks of a user that a completion is told of.
RECENT = 5


class Engine:
    """root is a folder that all executors share. embed turns (id, text) columns of a DataFrame into (id, vec); the default is the
    hash embedding, and a model served elsewhere can be put in its place. Its vectors are normalised here.

    rerank turns (query_id, text, index, service_id, searchable) of the recalled services, index being their place from 0, into
    (query_id, index, relevance); reason turns (query_id, text, pos, service_id, service_name, service_intro) of the results into
    (query_id, service_id, reason). Where they are not given, or give nothing of use, the local forms stand in.

    complete turns (query_id, partial, queries array<string>, clicks array<string>), the user's newest distinct queries and names of
    clicked services, into (query_id, completion); classifier turns (query_id, text) of the queries that the rules let pass into
    (query_id, answer), JSON as answers.parse_class() reads it. Without them there are no completions and the rules alone decide."""

    def __init__(
        self, spark: SparkSession, root: str, embed: Embedder = V.hash_embedding, synonyms: dict[str, list[str]] | None = None,
        rerank: Reranker | None = None, reason: Reasoner | None = None, complete: Completer | None = None, classifier: Classifier | None = None,
    ):
        self.spark, self.root, self.embed, self.synonyms = spark, root.rstrip("/"), embed, synonyms
        self.rerank, self.reason, self.complete, self.classifier = rerank, reason, complete, classifier
        self.kb: DataFrame | None = None
        self.index: B.Index | None = None
        self.vectors: DataFrame | None = None
        self.blocks: threshold.Catalog | None = None
        self.groups: DataFrame | None = None
        self.spelling: DataFrame | None = None
        self.network: dcn.Network | None = None
        self.version = ""

    # Catalog ------------------------------------------------------------------------------------------------------

    def import_catalog(self, raw: DataFrame, version_id: str, now: float = 0.0) -> str:
        """Check, clean, deduplicate and index a catalog, and make it the active version. Gives its content hash."""
        good = K.validated(raw)
        bad = good.where(~F.col("valid")).count()
        if bad:
            self._append("op_logs", self.spark.createDataFrame([(0, "import", version_id, False, now)], FACTS["op_logs"]))
            raise ValueError(f"{bad} rows lack required fields")
        kb = K.last_wins(good.drop("missing", "valid")).withColumn("components", K.clean_components(F.col("components")))
        K.snapshot(kb, f"{self.root}/kb", version_id)
        K.activate(self.spark, f"{self.root}/kb", version_id)
        self._append("op_logs", self.spark.createDataFrame([(0, "import", version_id, True, now)], FACTS["op_logs"]))
        return self.open()

    def start(self, given: str | None = None, default: str | None = None, now: float = 0.0) -> str | None:
        """Open the first catalog that is there: the JSON file given, the active version, the default JSON file. None if none is."""
        if given and K.exists(self.spark, given):
            source = given
        elif K.active_version(self.spark, f"{self.root}/kb"):
            return self.open()
        elif default and K.exists(self.spark, default):
            source = default
        else:
            return None
        return self.import_catalog(S.searchable_text(K.read_json(self.spark, source)), uuid.uuid4().hex, now)

    def rollback(self, version_id: str) -> str:
        """Make an earlier version the active one."""
        self.spark.read.parquet(f"{self.root}/kb/version={version_id}")
        K.activate(self.spark, f"{self.root}/kb", version_id)
        return self.open()

    def open(self) -> str:
        """Load the active version; what answers questions is built only if none is stored under its hash: postings and vectors in
        blocks, forms of the vocabulary, and the synonym groups of this engine's dictionary."""
        self.kb = S.searchable_text(K.active(self.spark, f"{self.root}/kb"))
        self.version = K.merkle_hash(self.kb).first()["kb_hash"]
        path, read = f"{self.root}/index/{self.version}", self.spark.read.parquet

        def build(place: str) -> None:
            B.save(B.build(S.catalog_fields(self.kb).withColumnRenamed("service_id", "id")), place)
            self.embed(self.kb, "service_id", "searchable").write.parquet(f"{place}/vectors")
            index = B.load(self.spark, place)
            threshold.index(self.kb, index, read(f"{place}/vectors"), f"{place}/blocks")
            fuzzy.vocabulary_index(index.terms.select("term").distinct()).write.parquet(f"{place}/forms")

        shared.whole(self.spark, path, build)
        self.index, self.vectors, self.spelling = B.load(self.spark, path), read(f"{path}/vectors"), read(f"{path}/forms")
        self.blocks = threshold.load(self.spark, f"{path}/blocks")
        known = U.DOMAIN_SYNONYMS if self.synonyms is None else self.synonyms
        words = f"{self.root}/synonyms/{self.version}-{hashlib.sha256(repr(known).encode()).hexdigest()[:16]}"
        pairs = lambda: U.synonym_pairs(self.spark, known).unionByName(U.kb_synonym_pairs(self.kb, len(known)))
        with shared.passing(self.spark):
            shared.whole(self.spark, words, lambda place: U.synonym_groups(pairs()).write.parquet(place))
        self.groups = read(words)
        newest = self._rounds().newest()
        self.network = dcn.load(self.spark, newest[1], self.kb.count()) if newest else None
        return self.version

    def _rounds(self) -> Commits:
        """The trained rerankers of this version of the catalog, in order."""
        return Commits(self.spark, f"{self.root}/reranker/{self.version}/rounds")

    def train_reranker(self, now: float, steps: int = dcn.STEPS) -> dict:
        """Train the reranker on the recorded clicks and the queries before them, and rank by it from now on.

        Gives trained, positives, negatives, round and losses. It takes LEAST_CLICKS clicks and two services; with fewer nothing changes. Weights belong to
        a version of the catalog: another version has its own, or ranks by the fixed weights.
        """
        with shared.passing(self.spark):
            clicks = self.facts("clicks").where("NOT deprecated").select("id", "user_id", "service_id", "ts")
            found = G.as_of(clicks, self.facts("queries"), "query").where(F.col("matched_id").isNotNull())
            pairs = self._stored(dcn.training_pairs(found.select("id", "service_id", F.col("matched").alias("query")), self.kb))
            counts = {r.label: r["count"] for r in pairs.groupBy("label").count().collect()}
            done = {"trained": False, "positives": counts.get(1, 0), "negatives": counts.get(0, 0), "round": None, "losses": []}
            services = self.kb.count()
            if done["positives"] < dcn.LEAST_CLICKS or services < 2:
                return done
            samples = self._stored(dcn.samples(pairs, self.kb, self.vectors, self.popularity(now), self.embed))
            net, losses = dcn.train(samples, dcn.initial(services), steps)
        path = f"{self.root}/reranker/{self.version}/{uuid.uuid4().hex}"
        dcn.save(self.spark, net, path)
        number, _ = self._rounds().append(lambda _: path)
        self.network = net
        return done | {"trained": True, "round": number, "losses": losses}

    def versions(self) -> DataFrame:
        """(created_at, version_id, active) of the imported versions, newest first."""
        made = self.facts("op_logs").where("op = 'import' AND ok").groupBy("version_id").agg(F.max("ts").alias("created_at"))
        activated = self.spark.createDataFrame([(0, K.active_version(self.spark, f"{self.root}/kb"))], "activated_at int, version_id string")
        return K.list_versions(made, activated)

    def embedding_status(self) -> DataFrame:
        """One row: total, embedded and missing services of the active version."""
        own = self.kb.select("service_id").join(self.vectors.select("service_id", "vec"), "service_id", "left")
        return own.agg(F.count("*").alias("total"), F.count("vec").alias("embedded")).withColumn("missing", F.col("total") - F.col("embedded"))

    def export(self, path: str) -> None:
        self.kb.drop("searchable").write.mode("overwrite").json(path)

    # Behaviour ----------------------------------------------------------------------------------------------------

    def _append(self, fact: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.root}/{fact}")

    def record(self, fact: str, rows: DataFrame) -> None:
        """Append rows of a fact; clicks on services that are not in the catalog are marked deprecated."""
        if fact == "clicks":
            known = self.kb.select("service_id", F.lit(False).alias("__gone"))
            rows = rows.drop("deprecated").join(known, "service_id", "left").withColumn("deprecated", F.col("__gone").isNull()).drop("__gone")
        self._append(fact, rows.select(*[c.split()[0] for c in FACTS[fact].split(", ")]))

    def reset(self) -> None:
        """Forget all behaviour, logs and kept answers; the catalog and its versions' files stay."""
        for name, schema in {**FACTS, "answers": ANSWERS}.items():
            self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{self.root}/{name}")

    def facts(self, fact: str) -> DataFrame:
        """The rows of a fact; none if nothing is recorded yet. Clicks of files without the column deprecated are not deprecated."""
        rows = self._read(fact, FACTS[fact])
        return rows.withColumn("deprecated", F.coalesce("deprecated", F.lit(False))) if fact == "clicks" else rows

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def popularity(self, now: float) -> DataFrame:
        return G.penalized(G.popularity_decayed(self.facts("clicks"), now), G.negative_signals(self.facts("feedback"), now))

    # Questions ----------------------------------------------------------------------------------------------------

    def _stored(self, df: DataFrame) -> DataFrame:
        """Steps of a question that later ones read more than once; they go when the question is answered."""
        return shared.stored(df, "step")

    def _answered(self, df: DataFrame) -> DataFrame:
        """A question's result, before its steps go."""
        return shared.stored(df, "result", keep=True)

    def _first_id(self, n: int, now: float) -> int:
        """The first of n ids that no other row of the store has."""
        return Numbers(Commits(self.spark, f"{self.root}/numbers")).take(n, now)

    def terms(self, batch: DataFrame) -> DataFrame:
        """(query_id, term, qtf): a query's words, those of their synonyms, and the nearest known word for each unknown one."""
        words = U.expand(batch.select("query_id", F.explode(tokenize(F.col("text"))).alias("token")), self.groups)
        fixed = U.corrections(words, self.index.terms.select("term").distinct(), index=self.spelling).select("token", "candidate")
        near = words.join(fixed, "token").select("query_id", F.col("candidate").alias("token"))
        return words.unionByName(near).distinct().select("query_id", F.col("token").alias("term"), F.lit(1).cast("long").alias("qtf"))

    def plain_vectors(self, batch: DataFrame) -> DataFrame:
        return self.embed(U.normalize(batch, self.groups), "query_id", "normalized").select("query_id", "vec")

    def history_vectors(self, history: DataFrame) -> DataFrame:
        """history (query_id, query, i) with the vectors of its queries; each distinct text is embedded once."""
        return history.join(self.embed(history.select("query").distinct(), "query", "query"), "query")

    def query_vectors(self, batch: DataFrame) -> DataFrame:
        """(query_id, vec) of the queries in canonical words, drawn towards the history of users with HISTORY queries or more."""
        own = self.plain_vectors(batch)
        asked = self.facts("queries").join(batch.select("user_id").distinct(), "user_id", "left_semi")
        often = asked.groupBy("user_id").agg(F.count("*").alias("n")).where(F.col("n") >= HISTORY)
        history = H.history(batch.join(often.select("user_id"), "user_id", "left_semi"), asked, HISTORY_WINDOW - 1)
        return H.din(own, self.history_vectors(history))

    def scores(self, batch: DataFrame, now: float, mode: str = "hybrid", query_vectors: DataFrame | None = None, terms: DataFrame | None = None) -> DataFrame:
        """All services scored for each query (query_id, user_id, text): the full scan, for those who want every score."""
        qv = query_vectors if query_vectors is not None else self._stored(self.query_vectors(batch))
        words = terms if terms is not None else self._stored(self.terms(batch))
        return retrieve.scores(batch, self.kb, self.index, self.popularity(now), mode, qv, self.vectors, words)

    def asked(self, batch: DataFrame, now: float, mode: str = "hybrid", query_vectors: DataFrame | None = None, terms: DataFrame | None = None) -> threshold.Asked:
        """The batch before it meets the services: its best() ones, or the scores of given pairs()."""
        qv = query_vectors if query_vectors is not None else self._stored(self.query_vectors(batch))
        words = terms if terms is not None else self._stored(self.terms(batch))
        return threshold.Asked(batch, self.blocks, self.popularity(now), mode, qv, words)

    def recall(self, batch: DataFrame, now: float, k: int = 20, mode: str = "hybrid", query_vectors: DataFrame | None = None, terms: DataFrame | None = None) -> DataFrame:
        """(query_id, service_id, ord, cos, vec, bmn, popn, score, rank): the k best services of each query, as a full scan finds them."""
        return self.asked(batch, now, mode, query_vectors, terms).best(k).best

    def score_pairs(self, pairs: DataFrame, now: float, mode: str = "hybrid") -> DataFrame:
        """pairs (query_id, user_id, text, service_id) -> the scores of these services for these queries, without meeting any other."""
        with shared.passing(self.spark):
            batch = self._stored(pairs.select("query_id", "user_id", "text").distinct())
            return self._answered(self.asked(batch, now, mode).pairs(pairs))

    def search(self, batch: DataFrame, now: float, mode: str = "hybrid", recall: int = 20, k: int = 10) -> DataFrame:
        """(query_id, pos, service_id, pinned, deep, score, reason): recall, rerank, diversify; results that are not sure are fused
        with a second recall by expanded words; a query that names a service has it first.

        Modes keyword and semantic keep the order of their recall and are not reranked. Queries that hold nothing, or an injected
        prompt, have no results.
        """
        with shared.passing(self.spark):
            return self._answered(self._search(batch, now, mode, recall, k))

    def _search(self, batch: DataFrame, now: float, mode: str, recall: int, k: int) -> DataFrame:
        clean = T.sanitize_query(F.col("text"))
        batch = batch.where(~T.is_injection(F.col("text"))).withColumn("text", clean).where("text <> ''")
        batch = self._stored(batch.select("query_id", "user_id", "text"))
        qv = self._stored(self.query_vectors(batch))
        top = self._stored(self.recall(batch, now, recall, mode, qv))
        if mode == "hybrid":
            ranked = self._reranked(top, batch, now)
        else:
            ranked = top.withColumn("rerank_score", F.col("score"))
        best = retrieve.diversified(ranked.select("query_id", "rank", "rerank_score", "service_id"), self.vectors, k, "rerank_score")
        first = best.join(ranked.select("query_id", "service_id", "rerank_score"), ["query_id", "service_id"]).select("query_id", F.col("service_id").alias("id"), (F.col("pos") + 1).alias("rank"), F.col("rerank_score").alias("score"))
        first = self._stored(first)
        meant = U.classify(batch, self.kb).select("query_id", "intent")
        known = self.facts("queries").join(batch.select("user_id").distinct(), "user_id", "left_semi").select("user_id").distinct().withColumn("__known", F.lit(True))
        about = batch.join(meant, "query_id").join(known, "user_id", "left").select("query_id", "intent", F.col("__known").isNull().alias("cold"))
        sure = R.confidence(first.join(about, "query_id"), F.col("intent"), F.col("cold")).select("query_id", "deep")
        sure = self._stored(sure)
        unsure = self._stored(batch.join(sure.where("deep"), "query_id", "left_semi"))
        again = self._stored(self.recall(unsure, now, 30, mode, qv, self._stored(A.deep_terms(unsure, self.kb, self.groups))))
        fused = A.deepened(first, sure, again.select("query_id", F.col("service_id").alias("id"), "rank"), k)
        named = U.navigational(batch, self.kb).select("query_id", F.col("matched_id").alias("id"))
        out = R.pin(fused.select("query_id", "id", "rank", F.lit(0.0).alias("score")), named).where(F.col("rank") <= k).select("query_id", (F.col("rank") - 1).alias("pos"), F.col("id").alias("service_id"), "pinned")
        # Where a score is of neither recall, the row was put first by its name.
        both = top.select("query_id", "service_id", "score").unionByName(again.select("query_id", "service_id", "score")).groupBy("query_id", "service_id").agg(F.max("score").alias("score"))
        own = self.kb.select("service_id", "service_name", "aliases", "service_intro")
        shown = out.join(both, ["query_id", "service_id"], "left").join(own, "service_id").join(sure, "query_id", "left").join(batch.select("query_id", "text"), "query_id")
        score = F.coalesce("score", F.lit(1.0))
        told = F.when(F.col("pinned"), F.lit(R.DIRECT)).otherwise(R.template_reason(F.col("text"), F.col("service_name"), F.col("aliases"), F.col("service_intro"), score))
        if self.reason:
            asked = self._stored(shown.select("query_id", "text", "pos", "service_id", "service_name", "service_intro"))
            shown = shown.join(self._reasons(asked), ["query_id", "service_id"], "left")
            told = F.when(F.col("pinned"), F.lit(R.DIRECT)).otherwise(F.coalesce("said", told))
        return shown.select("query_id", "pos", "service_id", "pinned", F.coalesce("deep", F.lit(False)).alias("deep"), score.alias("score"), told.alias("reason"))

    def reasons(self, pairs: DataFrame) -> DataFrame:
        """pairs (query_id, text, pos, service_id, score) -> (query_id, service_id, reason): the model's reason where it gives a fit one,
        else the template's."""
        with shared.passing(self.spark):
            shown = self._stored(pairs.join(self.kb.select("service_id", "service_name", "aliases", "service_intro"), "service_id"))
            told = R.template_reason(F.col("text"), F.col("service_name"), F.col("aliases"), F.col("service_intro"), F.col("score"))
            if self.reason:
                shown = shown.join(self._reasons(shown.select("query_id", "text", "pos", "service_id", "service_name", "service_intro")), ["query_id", "service_id"], "left")
                told = F.coalesce("said", told)
            return self._answered(shown.select("query_id", "service_id", told.alias("reason")))

    def _reranked(self, recalled: DataFrame, batch: DataFrame, now: float) -> DataFrame:
        featured = retrieve.features(recalled, batch, self.kb, self.popularity(now))
        if not self.rerank and self.network:
            return retrieve.network_reranked(featured, dcn.score(featured, self.network))
        if not self.rerank:
            return retrieve.reranked(featured)
        asked = recalled.join(batch.select("query_id", "text"), "query_id").join(self.kb.select("service_id", "searchable"), "service_id")
        answered = self._stored(self.rerank(asked.select("query_id", "text", (F.col("rank") - 1).alias("index"), "service_id", "searchable")))
        return retrieve.provider_reranked(featured, answered)

    def _reasons(self, asked: DataFrame) -> DataFrame:
        """(query_id, service_id, said): what the model gave as reasons, without those of other services, empty ones and those
        that speak against the order."""
        own = asked.select("query_id", "service_id", (F.col("pos") + 1).alias("rank"), F.count("*").over(Window.partitionBy("query_id")).alias("n"))
        given = self.reason(asked).select("query_id", F.col("service_id").alias("id"), "reason")
        clean = retrieve.clean_reasons(given, "id", "reason").withColumnRenamed("id", "service_id").join(own, ["query_id", "service_id"])
        fit = clean.where(~R.contradicts_rank(F.col("reason"), F.col("rank"), F.col("n")))
        return self._stored(fit.groupBy("query_id", "service_id").agg(F.min("reason").alias("said")))

    def combination(self, batch: DataFrame, now: float) -> DataFrame:
        """batch (query_id, user_id, steps array<string>) -> (query_id, step, label, service_id, score, reason): the first result of
        each step that is not blank, in the steps' order from 0; a step that finds nothing has null for its service."""
        steps = F.filter(F.transform("steps", lambda s: F.trim(s)), lambda s: s.isNotNull() & (s != ""))
        wide = shared.stored(batch.select("query_id", "user_id", F.posexplode(steps).alias("step", "label")).withColumn("one", F.to_json(F.struct("query_id", "step"))), "steps", keep=True)
        best = self.search(wide.select(F.col("one").alias("query_id"), "user_id", F.col("label").alias("text")), now).where("pos = 0")
        return wide.join(best.select(F.col("query_id").alias("one"), "service_id", "score", "reason"), "one", "left").drop("one", "user_id")

    def answer(self, batch: DataFrame, now: float, mode: str = "hybrid") -> DataFrame:
        """search() of a batch, stored and written to the log: the queries join their users' histories, each gets a row in the
        search log, and what it found is kept. A query that its user has asked of this version in this mode within CACHE_S seconds
        is answered from what was kept."""
        began = time.time()
        cleaned = batch.withColumn("text", T.sanitize_query(F.col("text")))
        keyed = cleaned.where("text <> ''").withColumn("cache_key", F.concat_ws(":", F.lit(self.version), T.cache_key(F.col("user_id").cast("string"), F.col("text"), F.lit(mode))))
        kept = self._read("answers", ANSWERS).where((F.col("ts") > now - CACHE_S) & (F.col("ts") <= now)).join(keyed.select("cache_key").distinct(), "cache_key", "left_semi")
        newest = kept.groupBy("cache_key").agg(F.max_by("results", "ts").alias("results"))
        hit = keyed.join(newest, "cache_key").select("query_id", "user_id", "text", "cache_key", "results", F.lit(True).alias("cache_hit"))
        found = self.search(keyed.join(newest, "cache_key", "left_anti").select("query_id", "user_id", "text"), now, mode)
        listed = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "service_id", "pinned", "deep", "score", "reason"))).alias("results"))
        none = F.array().cast(ANSWERS.split("results ")[1].split(", ts")[0])
        fresh = keyed.join(newest, "cache_key", "left_anti").join(listed, "query_id", "left").select("query_id", "user_id", "text", "cache_key", F.coalesce("results", none).alias("results"), F.lit(False).alias("cache_hit"))
        done = self._numbered(hit.unionByName(fresh), now)
        total = (time.time() - began) * 1000
        top_ids = F.transform("results", lambda r: r["service_id"])
        # The log comes first: a query that is in the history has its log, and an answer is kept only after both.
        self._append("searches", done.select(
            "id", "user_id", F.col("text").alias("query"), top_ids.alias("top_ids"), F.create_map(F.lit("total"), F.lit(total)).alias("latencies"), "cache_hit",
            (F.size("results") == 0).alias("degraded"), F.lit(False).alias("error"), F.lit(None).cast("string").alias("clicked_sid"), F.lit(float(now)).alias("ts"),
        ))
        self._append("queries", done.select("id", "user_id", F.col("text").alias("query"), F.lit(float(now)).alias("ts")))
        self._append("answers", done.where("NOT cache_hit").select("cache_key", "results", F.lit(float(now)).alias("ts")))
        return done.select("query_id", "cache_hit", F.inline("results"))

    def _numbered(self, df: DataFrame, now: float) -> DataFrame:
        """df, stored, with an id for each row: the place of the row after the first id of a range that is this run's alone."""
        df = shared.numbered(df)
        first = self._first_id(df.count(), now)
        return df.withColumn("id", F.col("no") + first).drop("no")

    def intersection(self, batch: DataFrame, now: float, recall: int = 30) -> DataFrame:
        """Services that all sub-queries of a query find, by the connectors in its text; else their fused union."""
        parts = batch.select("query_id", "user_id", F.posexplode(U.split_subqueries(F.col("text"))).alias("list", "text"))
        wide = parts.withColumn("sub", F.concat_ws("/", F.col("query_id").cast("string"), F.col("list").cast("string")))
        with shared.passing(self.spark):
            wide = self._stored(wide)
            top = self.recall(wide.select(F.col("sub").alias("query_id"), "user_id", "text"), now, recall)
            lists = top.withColumnRenamed("query_id", "sub").join(wide.select("sub", "query_id", "list"), "sub").select("query_id", "list", F.col("service_id").alias("id"), "rank")
            return self._answered(R.intersect(lists, ["query_id"], recall))

    def route(self, batch: DataFrame, connectors=U.CONNECTORS, answers: DataFrame | None = None) -> DataFrame:
        """(query_id, class, intent, route, sub_queries, steps): the method that answers each query.

        A query of an odd class that the catalog's words do not take back is refused, an attack always. What a model says of a query
        that the rules let pass, answers (query_id, answer json), or else the engine's classifier, comes next: one that it finds irrelevant is refused unless the catalog's words take it
        back, one that it takes apart goes to combination with its steps. Several sub-queries go to intersection, requests for steps to
        guide, running sessions (a column session_id that is not null) to session, all others to search.
        """
        judged = U.rescued(batch, self.kb, self.index.terms.select("term").distinct())
        running = F.col("session_id").isNotNull() if "session_id" in batch.columns else None
        if answers is None and self.classifier:
            answers = self.classifier(batch.join(judged.where("class = 'normal'"), "query_id", "left_semi").select("query_id", "text"))
        meant = U.classify(batch, self.kb, connectors=connectors, has_session=running).select("query_id", "intent", "sub_queries")
        said = A.parse_class(answers).select("query_id", "category", "steps") if answers is not None else None
        own = judged.join(meant, "query_id")
        none = F.array().cast("array<string>")
        own = own.join(said, "query_id", "left") if said is not None else own.withColumns({"category": F.lit(None).cast("string"), "steps": none})
        odd = (F.col("class") != "normal") & ~F.col("rescued")
        known = U.named_words(batch, self.kb, self.index.terms.select("term").distinct()).withColumn("__known", F.lit(True)) if said is not None else None
        if known is not None:
            own = own.join(known, "query_id", "left")
            odd = odd | ((F.col("category") == "irrelevant") & F.col("__known").isNull())
        way = (
            F.when((F.col("class") == "prompt_attack") | F.coalesce(odd, F.lit(False)), "refuse").when(F.col("category") == "combination", "combination")
            .when(F.size("sub_queries") > 1, "intersection").when(F.col("intent") == "guide", "guide").when(F.col("intent") == "conversational", "session").otherwise("search")
        )
        return own.select("query_id", "class", "intent", way.alias("route"), "sub_queries", F.coalesce("steps", none).alias("steps"))

    def ask(self, batch: DataFrame, now: float, connectors=U.CONNECTORS, answers: DataFrame | None = None) -> DataFrame:
        """(query_id, route, pos, service_id, score, reason): each query answered by the method that route() names for it.

        A refused query has no rows. Of a combination pos is the step, and a step that found nothing has no service. Intersections and
        sessions have no reasons, and no scores. Queries of running sessions need columns session_id and turn, with the session's
        earlier turns in the same batch. Only the methods that some query of the batch needs are run.
        """
        with shared.passing(self.spark):
            batch = self._stored(batch)
            ways = self._stored(self.route(batch, connectors, answers))
            parts = [self.spark.createDataFrame([], batch.select("query_id").schema).select("query_id", F.lit("").alias("route"), F.lit(0).alias("pos"), F.lit("").alias("service_id"), F.lit(0.0).alias("score"), F.lit("").alias("reason"))]

            def own(way: str) -> DataFrame:
                return self._stored(batch.join(ways.where(F.col("route") == way), "query_id", "left_semi"))

            def put(way: str, df: DataFrame, **columns) -> None:
                none = {"score": F.lit(None).cast("double"), "reason": F.lit(None).cast("string")}
                parts.append(df.withColumns(columns | {c: v for c, v in none.items() if c not in df.columns}).select("query_id", F.lit(way).alias("route"), F.col("pos").cast("int"), "service_id", "score", "reason"))

            needed = {r.route for r in ways.select("route").distinct().collect()}
            if "search" in needed:
                put("search", self.answer(own("search"), now))
            if "intersection" in needed:
                put("intersection", self.intersection(own("intersection"), now), pos=F.col("rank") - 1, service_id=F.col("id"))
            if "guide" in needed:
                put("guide", self.guide_search(own("guide"), now)[1])
            if "session" in needed:
                put("session", self.session_search(own("session"), now))
            if "combination" in needed:
                put("combination", self.combination(own("combination").join(ways.select("query_id", "steps"), "query_id"), now), pos=F.col("step"))
            out = parts[0]
            for part in parts[1:]:
                out = out.unionByName(part)
            return self._answered(out)

    def completions(self, batch: DataFrame) -> DataFrame:
        """batch (query_id, user_id, text) -> (query_id, completion): what the model makes of a partial query, where it begins with what was
        typed and is longer. None for blank queries, or without a model."""
        if not self.complete:
            return batch.select("query_id", F.lit(None).cast("string").alias("completion")).where("false")
        typed = batch.select("query_id", "user_id", T.sanitize_query(F.col("text")).alias("partial")).where("partial <> ''")
        users = typed.select("user_id").distinct()

        def newest(rows: DataFrame, value: str) -> DataFrame:
            return G.recent_distinct(rows.join(users, "user_id", "left_semi"), value, RECENT).select("user_id", "rn", F.col(value).alias("value"))

        def listed(rows: DataFrame, name: str) -> DataFrame:
            return rows.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "value"))), lambda r: r["value"]).alias(name))

        clicked = newest(self.facts("clicks"), "service_id").join(self.kb.select(F.col("service_id").alias("value"), "service_name"), "value").select("user_id", "rn", F.col("service_name").alias("value"))
        told = typed.join(listed(newest(self.facts("queries"), "query"), "queries"), "user_id", "left").join(listed(clicked, "clicks"), "user_id", "left")
        none = F.array().cast("array<string>")
        asked = told.select("query_id", "partial", F.coalesce("queries", none).alias("queries"), F.coalesce("clicks", none).alias("clicks"))
        said = self.complete(asked).select("query_id", F.col("completion").alias("__said"))
        return typed.join(said, "query_id").select("query_id", A.completion(F.col("partial"), F.col("__said")).alias("completion")).where("completion IS NOT NULL")

    def ranked(self, batch: DataFrame, now: float, k: int = 10) -> DataFrame:
        """(query_id, pos, service_id, score): the k best of a recall of 20, reranked and diversified, and no more than that."""
        with shared.passing(self.spark):
            return self._answered(self._ranked(self._stored(batch), now, k))

    def _ranked(self, batch: DataFrame, now: float, k: int, query_vectors: DataFrame | None = None) -> DataFrame:
        ranked = self._stored(self._reranked(self._stored(self.recall(batch, now, 20, query_vectors=query_vectors)), batch, now))
        best = retrieve.diversified(ranked.select("query_id", "rank", "rerank_score", "service_id"), self.vectors, k, "rerank_score")
        return best.join(ranked.select("query_id", "service_id", F.col("rerank_score").alias("score")), ["query_id", "service_id"]).select("query_id", "pos", "service_id", "score")

    def guide_search(self, batch: DataFrame, now: float, steps: DataFrame | None = None, k: int = 10) -> tuple[DataFrame, DataFrame]:
        """batch (query_id, user_id, text) -> ((query_id, step_id, step_text, services), (query_id, pos, service_id, score)).

        steps (query_id, step_id, raw) is what a model wrote from the candidates, of which only references to known services stay. A query
        with a step that is left has these; the others have the k best of a recall of 20, reranked and diversified, and are logged as
        degraded. All of them join their users' histories and the log.
        """
        with shared.passing(self.spark):
            batch = self._stored(batch.select("query_id", "user_id", T.sanitize_query(F.col("text")).alias("text")).where("text <> ''"))
            told = self.spark.createDataFrame([], "query_id long, step_id long, step_text string, services string")
            if steps is not None:
                wide = self._stored(steps.select(F.to_json(F.struct("query_id", "step_id")).alias("one"), "query_id", "step_id", "raw"))
                own = A.guide_steps(wide.select(F.col("one").alias("step_id"), "raw"), self.kb).withColumnRenamed("step_id", "one")
                place = Window.partitionBy("query_id").orderBy("step_id")
                told = wide.drop("raw").join(own, "one").drop("one").withColumn("__n", F.row_number().over(place)).where(F.col("__n") <= A.MAX_STEPS).drop("__n")
            told = self._answered(told)
            rest = self._stored(batch.join(told.select("query_id").distinct(), "query_id", "left_anti"))
            listed = self._answered(self._ranked(rest, now, k))
            ids = F.array_compact(F.flatten(F.collect_list(F.split("services", ","))))
            shown = told.groupBy("query_id").agg(F.slice(ids, 1, 10).alias("top_ids"), F.lit(False).alias("degraded")).unionByName(
                listed.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "service_id"))), lambda r: r["service_id"]).alias("top_ids"), F.lit(True).alias("degraded")))
            done = self._numbered(batch.join(shown, "query_id", "left").select("user_id", "text", F.coalesce("top_ids", F.array().cast("array<string>")).alias("top_ids"), F.coalesce("degraded", F.lit(True)).alias("degraded")), now)
        self._append("searches", done.select(
            "id", "user_id", F.col("text").alias("query"), "top_ids", F.create_map().cast("map<string,double>").alias("latencies"), F.lit(False).alias("cache_hit"),
            "degraded", F.lit(False).alias("error"), F.lit(None).cast("string").alias("clicked_sid"), F.lit(float(now)).alias("ts"),
        ))
        self._append("queries", done.select("id", "user_id", F.col("text").alias("query"), F.lit(float(now)).alias("ts")))
        return told, listed

    def session(self, turns: DataFrame, now: float, k: int = 40) -> DataFrame:
        """turns (query_id, user_id, text, session_id, turn) -> (query_id, service_id, score, rank): the best k for a turn of all that
        its session has found. A first turn is searched as any query; the vector of a later one is drawn towards the turns before,
        and recalls k services beside theirs."""
        with shared.passing(self.spark):
            return self._answered(self._session(turns, now, k))

    def _session(self, turns: DataFrame, now: float, k: int) -> DataFrame:
        batch = turns.select("query_id", "user_id", "text")
        before = turns.select("session_id", F.col("turn").alias("then"), F.col("text").alias("query"))
        w = Window.partitionBy("query_id").orderBy(F.desc("then"))
        past = turns.select("query_id", "session_id", "turn").join(before, "session_id").where("then < turn").select("query_id", "query", F.row_number().over(w).alias("i"))
        later = turns.where("turn > 0").select("query_id")
        fused = H.din(self.plain_vectors(batch.join(later, "query_id", "left_semi")), self.history_vectors(past))
        qv = self._stored(fused.unionByName(self.query_vectors(batch.join(later, "query_id", "left_anti"))))
        asked = self.asked(batch, now, "hybrid", qv)
        found = self._stored(asked.best(k).best.select("query_id", "service_id"))
        seen = self._stored(H.seen(found, turns.select("query_id", "session_id", "turn")))
        return H.best(asked.pairs(seen), k)

    def session_search(self, turns: DataFrame, now: float, k: int = 10) -> DataFrame:
        """session() of the turns, reranked and diversified: (query_id, pos, service_id). What each turn found is recorded, and its
        query joins the user's history."""
        found = self.session(turns, now)
        listed = found.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "service_id"))), lambda r: r["service_id"]).alias("top_ids"))
        recorded = turns.join(listed, "query_id").select(F.col("session_id").cast("string"), F.col("turn").cast("int").alias("turn_idx"), F.col("text").alias("query"), "top_ids")
        self._append("turns", recorded)
        self._append("queries", self._numbered(turns.select("user_id", F.col("text").alias("query")), now).select("id", "user_id", "query", F.lit(float(now)).alias("ts")))
        return self.session_ranked(found, turns, now, k)

    def session_ranked(self, found: DataFrame, turns: DataFrame, now: float, k: int = 10) -> DataFrame:
        """What session() found for these turns, reranked by the turns' own vectors and diversified: (query_id, pos, service_id)."""
        batch = turns.select("query_id", "user_id", "text")
        own = found.join(self.kb.select("service_id", "ord"), "service_id")
        cos = own.join(self.plain_vectors(batch).withColumnRenamed("vec", "__q"), "query_id").join(self.vectors.select("service_id", F.col("vec").alias("__v")), "service_id", "left")
        cos = cos.withColumn("cos", F.coalesce(V.dot(F.col("__q"), F.col("__v")), F.lit(0.0))).drop("__q", "__v", "rank")
        ranked = retrieve.reranked(retrieve.features(cos, batch, self.kb, self.popularity(now)))
        return retrieve.diversified(ranked.select("query_id", "rank", "rerank_score", "service_id"), self.vectors, k, "rerank_score")

    def undo_turn(self) -> DataFrame:
        """(session_id, turn_idx, query) of the recorded sessions without their last turn."""
        return H.rollback(self.facts("turns"))

    def guide(self, steps: DataFrame) -> DataFrame:
        """steps (step_id, raw) that a model wrote -> (step_id, step_text, services), with references to known services alone."""
        return A.guide_steps(steps, self.kb)

    def components(self, pairs: DataFrame) -> DataFrame:
        """pairs (query_id, text, service_id) -> (query_id, service_id, label, action, href): what to show of each service."""
        own = pairs.join(self.kb.select("service_id", "components", "decision_button", "path"), "service_id")
        picked = retrieve.pick_component(F.array_distinct(tokenize(F.col("text"))), F.col("components"), F.col("decision_button"), F.col("path"))
        return own.select("query_id", "service_id", picked.alias("c")).select("query_id", "service_id", "c.label", "c.action", "c.href")

    def execute(self, requests: DataFrame) -> DataFrame:
        """requests (service_id, name, action) with allowed: the catalog offers that action."""
        return K.whitelisted(requests, self.kb)

    def deep_search(self, batch: DataFrame, now: float, k: int = 10) -> DataFrame:
        """(query_id, id, rrf, rank, deep): the k best, reranked and diversified, fused with a second recall by expanded words where they are not sure."""
        with shared.passing(self.spark):
            batch = self._stored(batch)
            qv = self._stored(self.query_vectors(batch))
            first = self._stored(self._ranked(batch, now, k, qv).select("query_id", F.col("service_id").alias("id"), (F.col("pos") + 1).alias("rank"), "score"))
            sure = self._stored(R.confidence(first.select("query_id", "rank", "score"), F.lit("default"), F.lit(False)).select("query_id", "deep"))
            unsure = self._stored(batch.join(sure.where("deep"), "query_id", "left_semi"))
            again = self.recall(unsure, now, 30, query_vectors=qv, terms=self._stored(A.deep_terms(unsure, self.kb, self.groups)))
            return self._answered(A.deepened(first.select("query_id", "id", "rank"), sure, again.select("query_id", F.col("service_id").alias("id"), "rank"), k))

    def autocomplete(self, batch: DataFrame, now: float) -> DataFrame:
        with shared.passing(self.spark):
            return self._answered(A.autocomplete(self.recall(batch, now, 20), batch, self.kb, self.facts("clicks")))

    def suggest(self, batch: DataFrame, readings: DataFrame | None = None) -> DataFrame:
        """(query_id, suggestion); readings (char, reading) lets unknown words be told by their sound."""
        return U.suggest(batch, self.index.terms.select("term").distinct(), self.spelling, readings=readings)

    def classify(self, batch: DataFrame) -> DataFrame:
        return U.classify(batch, self.kb)

    def related(self, k: int = 3) -> DataFrame:
        """(service_id, related_id, rank). The first RELATED are worked out once for a catalog's content and stored beside its index."""
        v = self.vectors.select(F.col("service_id").alias("id"), "vec")
        near = lambda: V.top_k(v.withColumnRenamed("id", "query_id"), v, max(k, RELATED), exclude_self=True).select(F.col("query_id").alias("service_id"), F.col("id").alias("related_id"), "rank")
        with shared.passing(self.spark):
            if k > RELATED:
                return self._answered(near())
            path = shared.whole(self.spark, f"{self.root}/related/{self.version}", lambda place: near().write.parquet(place))
        return self.spark.read.parquet(path).where(F.col("rank") <= k)

    def write_log(self, path: str, since: float = 0.0) -> None:
        """Append the search log from since on to a folder of text files, one JSON object a line."""
        logs = self.searches().where(F.col("ts") >= since)
        L.json_lines(logs, "search", F.lit("search"), F.col("ts")).write.mode("append").text(path)

    def dropdown(self, users: DataFrame) -> DataFrame:
        return C.dropdown(users, self.facts("queries"), self.facts("clicks"), self.kb, self.related())

    def service(self, service_id: str) -> DataFrame:
        return self.kb.where(F.col("service_id") == service_id)

    def op_logs(self, op: str | None = None, limit: int = 50) -> DataFrame:
        return K.op_logs(self.facts("op_logs"), op, limit)

    # Logs and monitoring -------------------------------------------------------------------------------------------

    def no_click(self, since: float, limit: int | None = None) -> DataFrame:
        return L.no_click(self.searches(), since, limit)

    def slow(self, since: float, threshold_ms: float = 1000.0) -> DataFrame:
        return L.slow(self.facts("searches"), since, threshold_ms)

    def degradation(self, since: float) -> DataFrame:
        return L.degradation(self.facts("searches"), since)

    def recent_searches(self, limit: int = 50) -> DataFrame:
        return L.recent(self.searches(), limit)

    def searches(self) -> DataFrame:
        """The search log with each click put on the search that showed its service."""
        logs = self.facts("searches")
        shown = logs.select(F.col("id").alias("log_id"), F.explode("top_ids").alias("service_id")).distinct()
        late = L.backfill_clicks(logs, self.facts("clicks"), shown).select(F.col("log_id").alias("id"), F.col("clicked_sid").alias("__late"))
        return logs.join(late, "id", "left").withColumn("clicked_sid", F.coalesce("clicked_sid", "__late")).drop("__late")

    def metrics(self) -> DataFrame:
        """The search log as events: id, ts, total_ms, stages, error, cache_hit, degraded."""
        total = F.coalesce(F.try_element_at("latencies", F.lit("total")), F.lit(0.0))
        stages = F.map_filter("latencies", lambda k, _: k != "total")
        return self.facts("searches").select("id", "ts", total.alias("total_ms"), stages.alias("stages"), "error", "cache_hit", "degraded")

    def health(self) -> DataFrame:
        return M.health(self.metrics(), self.facts("external"))

    def alerts(self) -> DataFrame:
        return M.alerts(self.health(), M.consecutive_failures(self.facts("external")))

    def exposition(self) -> DataFrame:
        return M.exposition(self.health(), self.facts("external"))

    def realtime(self, now: float, window_s: float = 60.0) -> DataFrame:
        return M.realtime(self.metrics(), now, window_s)

    def watch(self, path: str, send: Callable[[dict], None] | None = None, window_s: float = 60.0, now: Callable[[], float] = time.time, every: str | None = None):
        """Start a stream over the search log that keeps its newest rows under path and hands send health and realtime figures
        after each batch; see streaming.live.watch()."""
        total = F.coalesce(F.try_element_at("latencies", F.lit("total")), F.lit(0.0))
        logs = self.spark.readStream.schema(FACTS["searches"]).parquet(f"{self.root}/searches")
        return live.watch(logs.withColumn("total_ms", total), path, send, lambda: self.facts("external"), window_s, now, every=every)

    def sql(self, text: str, **args) -> DataFrame:
        """SQL over the engine's tables by name: {kb}, {clicks}, {queries}, {feedback}; values are passed as parameters, not as text."""
        return self.spark.sql(text, args=args or None, kb=self.kb, **{f: self.facts(f) for f in FACTS})


__all__ = ["Engine", "FACTS"]
