"""The conversational engine: every step answers one message of each session given, in one distributed batch.

A catalog is prepared once (normalised, indexed, facets); sessions are rows of (sid, memory, message, turn). The loop over a
dialogue has ten turns at most, whatever the number of sessions; a step's tables are written to the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dialogue.memory import LAST_TURN, Memory
from .functions.lexicons import ASKED_AS
from .operators import analytics as A
from .operators import hybrid as H
from .operators import index as I
from .operators import questions as Q
from .operators import ranking as K
from .operators.matching import THRESHOLD, WEIGHTS
from .operators.normalize import facets, normalize
from .operators.retrieval import guarded, top
from .sources.catalog import read_catalog
from .storage import scratch_path, stored

TOP_K, LIMIT, GUARD = 10, 200, 0.4
RUNTIMES, QUESTIONS = ["official", "development"], ["safe", "shadow", "dynamic"]
_TERMS = "array<struct<field:string,values:array<string>>>"
HEARD = (
    f"qid string, memory string, turn int, current_message string, raw_context string, base_request string, structured_query string, category string, hard {_TERMS}, soft {_TERMS}, "
    f"excluded {_TERMS}, override boolean, tags array<string>, average_prior_rating double, blocked array<string>, dry int, other_used boolean, evidence boolean, legacy_query string"
)
ANSWER = "sid string, turn int, memory string, message string, ask_attribute string"


def _hear(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in HEARD.split(", ") if not c.startswith("excluded ")]
    for pdf in batches:
        rows = []
        for sid, text, message, turn in zip(pdf["sid"], pdf["memory"], pdf["message"], pdf["turn"]):
            memory = Memory.loads(text)
            memory.hear(message or "", int(turn))
            rows.append({"qid": sid, "memory": memory.dumps(), "turn": int(turn)} | memory.request(message or ""))
        yield pd.DataFrame(rows, columns=[*columns[: columns.index("soft") + 1], "excluded", *columns[columns.index("soft") + 1 :]])


def _ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for sid, turn, text, broad, policy, chosen in zip(pdf["qid"], pdf["turn"], pdf["memory"], pdf["over_general"], pdf["by_policy"], pdf["chosen"]):
            memory = Memory.loads(text)
            said, asked = memory.asks(chosen if isinstance(chosen, str) else None, bool(broad)) if policy else memory.ask(int(turn), bool(broad))
            rows.append((sid, int(turn), memory.dumps(), said, asked))
        yield pd.DataFrame(rows, columns=["sid", "turn", "memory", "message", "ask_attribute"])


class Engine:
    """runtime ``official`` keeps the baseline's products and lets the ranker reorder them; ``development`` gives the ranker's
    own. questions: ``safe`` asks by the fixed order, ``dynamic`` by the policy, ``shadow`` safe while the policy's choice is
    recorded. local ``False``: the baseline alone. vectors, encoder, dense: as in ``hybrid.retrieve``."""

    def __init__(self, spark: SparkSession, products: DataFrame | str, runtime: str = "official", questions: str = "safe", local: bool = True, hints: bool = True, threshold: float = THRESHOLD, weights: dict[str, float] = WEIGHTS,
                 limit: int = LIMIT, guard: float = GUARD, dense: str = "off", vectors: DataFrame | None = None, encoder: Callable[[DataFrame], DataFrame] | None = None, index: str | None = None):
        if runtime not in RUNTIMES or questions not in QUESTIONS or dense not in H.MODES or not 1 <= limit <= LIMIT or not 0 <= guard <= 1:
            raise ValueError("engine settings are out of their ranges")
        if not local and (dense != "off" or vectors is not None):
            raise ValueError("dense retrieval needs the local pipeline")
        self.spark, self.runtime, self.questions, self.local, self.hints = spark, runtime, questions, local, hints
        self.threshold, self.weights, self.limit, self.guard = threshold, weights, limit, float(guard)
        self.dense, self.vectors, self.encoder = dense, vectors, encoder
        whole = read_catalog(spark, products) if isinstance(products, str) else products
        self.products = stored(whole.repartition("parent_asin"), "products")  # a catalog of few files is worked on by all cores
        if index is None:
            index = scratch_path(spark, "index")
            I.build(self.products, index)
        self.index = I.Index(spark, index)
        self.popular = H.popular_hits(self.products)
        self.normalized = stored(normalize(self.products), "normalized") if local else None
        self.facets: DataFrame | None = None  # of the whole catalog, made when the policy first asks
        self.diagnostics: DataFrame | None = None

    def _checked(self, sessions: DataFrame) -> DataFrame:
        bad = sessions.filter(~F.coalesce(F.col("turn").between(1, LAST_TURN), F.lit(False)))
        if not bad.isEmpty():
            raise ValueError("turns go from 1 to 10")
        return sessions.select(F.col("sid").cast("string").alias("sid"), "memory", "message", F.col("turn").cast("int").alias("turn"))

    def respond(self, sessions: DataFrame, k: int = TOP_K) -> DataFrame:
        """One answer per row of (sid, memory, message, turn): sid, turn, memory after it, message, ask_attribute,
        recommendations (parent_asin, score; at most ``k``), fallbacks, n_candidates, over_general, route, policy_attribute,
        policy_value. ``k`` is brought between 1 and 10. sids are distinct; a null message is empty."""
        k = max(1, min(int(k), TOP_K))
        heard = stored(self._checked(sessions).mapInPandas(_hear, HEARD), "heard")
        made = A.decision(F.col("current_message"), F.col("hard"), F.col("excluded"), F.col("category"), F.col("override"))
        heard = heard.withColumn("decision", made).withColumn("route", F.col("decision.route"))
        legacy = H.legacy(heard, self.index, self.popular, k)
        if not self.local:
            done = legacy.withColumn("fallback", F.lit(None).cast("string"))
            sizes, chosen = None, None
        else:
            done, sizes, chosen = self._formal(heard, legacy, k)
        recs = done.groupBy("qid").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("id").alias("parent_asin"), "score"))), lambda r: F.struct(r["parent_asin"], r["score"])).alias("recommendations"),
            F.array_compact(F.collect_set("fallback")).alias("fallbacks"),
        )
        turn = heard.join(recs, "qid", "left")
        if sizes is not None:
            turn = turn.join(sizes, "qid", "left")
        else:
            turn = turn.withColumns({"n_candidates": F.lit(0).cast("long")})
        broad = F.coalesce(F.col("n_candidates"), F.lit(0)) >= (self.limit if self.local else 1 << 30)
        none = F.lit(None).cast("string")
        turn = turn.join(chosen, "qid", "left") if chosen is not None else turn.withColumns({"policy_attribute": none, "policy_value": F.lit(None).cast("double")})
        turn = stored(turn.withColumns({"over_general": broad, "by_policy": F.lit(self.questions == "dynamic" and self.local), "chosen": F.col("policy_attribute")}), "turn")
        said = turn.select("qid", "turn", "memory", "over_general", "by_policy", "chosen").mapInPandas(_ask, ANSWER)
        rest = turn.select(F.col("qid").alias("sid"), "recommendations", "fallbacks", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), "over_general", "route", "policy_attribute", "policy_value")
        out = said.join(rest, "sid")
        kind = "array<struct<parent_asin:string,score:double>>"
        return stored(out.withColumns({"recommendations": F.coalesce("recommendations", F.array().cast(kind)), "fallbacks": F.coalesce("fallbacks", F.array().cast("array<string>"))}), "answers")

    def _formal(self, heard: DataFrame, legacy: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
        try:
            pool, self.diagnostics = H.retrieve(heard, self.index, self.popular, max(k, self.limit), mode=self.dense, vectors=self.vectors, encoder=self.encoder)
        except H.RetrievalError:
            if self.runtime == "development":
                raise
            return legacy.withColumn("fallback", F.lit("legacy_retrieval")), heard.select("qid", F.lit(0).cast("long").alias("n_candidates")), None
        sizes = pool.groupBy("qid").agg(F.count(F.lit(1)).alias("n_candidates"))
        explained = stored(K.explain(heard, pool, self.normalized, self.threshold, self.weights), "explained")
        best = K.best_or_rrf(explained, k)
        if self.runtime == "development" and not best.filter("fallback is not null").isEmpty():
            raise K.RankingError("a request's candidates were all filtered")
        if self.runtime == "official":
            events = best.groupBy("qid").agg(F.max("fallback").alias("fallback"))
            near = guarded(legacy.select("qid", "id", "rank"), best.select("qid", "id", "rank"), F.lit(self.guard), k)
            best = top(near.select("qid", "id", F.col("blend").alias("score")), k).join(events, "qid", "left")
        return best, sizes, self._policy(heard, pool) if self.questions != "safe" else None

    def _policy(self, heard: DataFrame, pool: DataFrame) -> DataFrame:
        """(qid, policy_attribute, policy_value): what the question policy would ask, by the facets of the pool."""
        names = ["material", "feature", "color", "style", "size", "use_case", "budget", "brand"]
        if self.facets is None:
            self.facets = stored(facets(self.normalized), "facets")
        rows = pool.select("qid", F.col("id").alias("parent_asin")).join(self.facets, "parent_asin")
        long = rows.select("qid", F.explode(F.array(*(F.struct(F.lit(n).alias("attribute"), F.col(n).alias("value")) for n in names))).alias("f")).select("qid", "f.*")
        asked = F.create_map(*(x for f, a in ASKED_AS.items() for x in (F.lit(f), F.lit(a))))
        known = F.transform(F.concat("hard", "soft"), lambda t: F.element_at(asked, t["field"]))
        from .functions.text import normalized_phrase

        tags = F.transform("tags", normalized_phrase) if self.hints else F.array().cast("array<string>")
        sessions = heard.select("qid", "turn", "route", "category", known.alias("known"), "blocked", tags.alias("tags"), "dry", "other_used", "evidence")
        return Q.choose(sessions, long).select("qid", F.col("attribute").alias("policy_attribute"), F.col("value").alias("policy_value"))


class Agent:
    """One dialogue at a time over an :class:`Engine`: ``reset`` a session, then ``respond`` to its messages in turn."""

    def __init__(self, engine: Engine):
        self.engine = engine
        self._memory: dict[str, str] = {}
        self._last: dict[str, dict] = {}

    def reset(self, session_id: str, user_profile: dict | None) -> None:
        self._memory[session_id] = Memory(profile=dict(user_profile or {})).dumps()
        self._last.pop(session_id, None)

    def respond(self, session_id: str, user_message: str, turn: int, top_k: int = TOP_K) -> dict:
        if session_id not in self._memory:
            raise RuntimeError("reset a session before its first message")
        row = self.engine.spark.createDataFrame([(session_id, self._memory[session_id], user_message, turn)], "sid string, memory string, message string, turn int")
        got = self.engine.respond(row, top_k).first().asDict(recursive=True)
        self._memory[session_id], self._last[session_id] = got.pop("memory"), got
        return {k: got[k] for k in ("message", "ask_attribute", "recommendations")} | {"usage": {"prompt_tokens": 0, "completion_tokens": 0}}

    def memory(self, session_id: str) -> Memory:
        return Memory.loads(self._memory[session_id])

    def fallbacks(self, session_id: str) -> tuple[str, ...]:
        """Events of the session's last turn in which a step was replaced by a simpler one."""
        return tuple(self._last.get(session_id, {}).get("fallbacks", ()))

    def question_diagnostics(self, session_id: str) -> dict | None:
        last = self._last.get(session_id)
        return last and {k: last[k] for k in ("route", "n_candidates", "policy_attribute", "policy_value", "ask_attribute")} | {"mode": self.engine.questions}
