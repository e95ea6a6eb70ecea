"""Hybrid retrieval: route-specific queries of each request, searched at once, fused by weighted reciprocal ranks."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.embedding import query_text
from ..functions.text import LEGACY_STOP_WORDS, terms
from ..storage import stored
from .index import Index
from .retrieval import RRF_K, dense, top

# The routes of each intent with their weights, in the order in which they are added up.
BUYING = {"active_context_bm25": 1.40, "current_turn_bm25": 0.85, "category_anchor_bm25": 0.25, "structured_constraint_bm25": 0.75}
BROWSING = {"active_context_bm25": 1.10, "current_turn_bm25": 0.55, "category_anchor_bm25": 0.35, "use_case_bm25": 0.75}
LEGACY = {"legacy_query": 1.40, "current_message": 0.85, "base_request": 0.25}
DENSE, POPULAR = "dense_semantic", "popularity_fallback"
DENSE_WEIGHT, PER_ROUTE, MOST_POPULAR, MOST_LEGACY_FILL = 0.35, 120, 200, 100
MODES = ["off", "shadow", "on"]
EVIDENCE = "array<struct<place:int,route:string,rank:int,score:double,weight:double>>"


class RetrievalError(RuntimeError):
    """No candidates can be retrieved."""


def _first(*texts: Column) -> Column:
    """The first text that says something, trimmed; else the last as it is."""
    out = texts[-1]
    for t in reversed(texts[:-1]):
        out = F.when(F.trim(F.coalesce(t, F.lit(""))) != "", F.trim(t)).otherwise(out)
    return out


def _said(field: str | None = None) -> Column:
    """The values of the positive constraints, of one field or all, as words."""
    both = F.concat("hard", "soft")
    some = F.filter(both, lambda t: t["field"] == field) if field else both
    return F.array_join(F.array_distinct(F.transform(F.flatten(F.transform(some, lambda t: t["values"])), lambda v: F.replace(v, F.lit("_"), F.lit(" ")))), " ")


def plan(requests: DataFrame, dense_weight: float | None = None) -> DataFrame:
    """(qid, place, route, query, weight) of every route of each request; with ``dense_weight`` browsing requests also get
    the dense route, whose query is an embedding text."""
    active = _first(F.col("raw_context"), F.col("structured_query"), F.col("current_message"))
    category = F.coalesce(F.replace("category", F.lit("_"), F.lit(" ")), "base_request")
    anchor = F.array_join(F.array_distinct(F.filter(F.array(category, "base_request"), lambda v: v != "")), " ")
    ask = {
        "active_context_bm25": active, "current_turn_bm25": F.col("current_message"), "category_anchor_bm25": F.when(F.col("route") == "buying", category).otherwise(anchor),
        "structured_constraint_bm25": _first(F.col("structured_query"), _said()), "use_case_bm25": _first(_said("use_case"), F.col("base_request")),
    }
    spec = lambda i, r, q, w: F.struct(F.lit(i).alias("place"), F.lit(r).alias("route"), F.coalesce(q, F.lit("")).alias("query"), F.lit(float(w)).alias("weight"))
    specs = {n: [spec(i, r, ask[r], w) for i, (r, w) in enumerate(t.items())] for n, t in (("buying", BUYING), ("browsing", BROWSING))}
    if dense_weight is not None:
        specs["browsing"].append(spec(len(BROWSING), DENSE, query_text(), dense_weight))
    each = F.when(F.col("route") == "buying", F.array(*specs["buying"])).otherwise(F.array(*specs["browsing"]))
    return requests.select("qid", F.explode(each).alias("s")).select("qid", "s.*")


def usable(routes: DataFrame) -> DataFrame:
    """Routes whose query has a term."""
    return routes.filter(F.size(terms(F.col("query"), most=1)) > 0)


def _search(index: Index, routes: DataFrame, limit: int, **how) -> DataFrame:
    """(qid, id, place, route, rank, score, weight) of the best of each route."""
    key = F.struct("qid", "place").alias("qid")
    found = index.search(routes.select(key, "query"), limit, **how).select("qid.qid", "qid.place", "id", "rank", "score")
    return found.join(routes.select("qid", "place", "route", "weight"), ["qid", "place"])


def fuse(hits: DataFrame, rrf_k: float = RRF_K) -> DataFrame:
    """(qid, id, evidence, rrf): one row per candidate with what each route said, in the routes' order."""
    proof = F.array_sort(F.collect_list(F.struct("place", "route", F.col("rank").cast("int").alias("rank"), "score", "weight"))).cast(EVIDENCE)
    fused = hits.groupBy("qid", "id").agg(proof.alias("evidence"))
    return fused.withColumn("rrf", F.aggregate("evidence", F.lit(0.0), lambda s, e: s + e["weight"] / (rrf_k + e["rank"])))


def popular_hits(products: DataFrame, k: int = MOST_POPULAR) -> list[tuple[str, float]]:
    """The ``k`` most popular products, on the driver: at most ``k`` rows."""
    from .retrieval import popular

    whole = products.select("parent_asin", F.coalesce("rating_number", F.lit(0)).alias("n"), F.coalesce("average_rating", F.lit(0.0)).alias("r"))
    return [(r["id"], float(r["score"])) for r in popular(whole, "parent_asin", "n", "r", k).collect()]


def _listed(hits: list[tuple[str, float]], route: str, rrf_k: float) -> Column:
    kind = "array<struct<id:string,evidence:" + EVIDENCE + ",rrf:double>>"
    rows = [{"id": i, "evidence": [{"place": 0, "route": route, "rank": n, "score": s, "weight": 1.0}], "rrf": 1 / (rrf_k + n)} for n, (i, s) in enumerate(hits, 1)]
    return F.from_json(F.lit(json.dumps(rows)), kind)


def retrieve(requests: DataFrame, index: Index, popular: list[tuple[str, float]], limit: int = 200, per_route: int = PER_ROUTE, rrf_k: float = RRF_K,
             mode: str = "off", vectors: DataFrame | None = None, encoder: Callable[[DataFrame], DataFrame] | None = None, dense_weight: float = DENSE_WEIGHT, dense_limit: int = PER_ROUTE) -> tuple[DataFrame, DataFrame]:
    """(pool, diagnostics). pool: qid, id, evidence, rrf, rank, at most ``limit`` a request, ties by id; a request none of
    whose routes finds anything gets the popular products.

    mode ``on`` adds the dense route to browsing requests, ``shadow`` only counts what it would find. Should it fail, the
    lexical routes go on and the diagnostics name the error. vectors: (id, embedding); encoder: (qid, text) to (qid, embedding).
    diagnostics: qid, mode, attempted, returned, exclusive (found by no lexical route), contributed (in the pool), error."""
    if mode not in MODES or per_route < 1 or dense_limit < 1 or rrf_k <= 0 or not 0 <= dense_weight <= 2 or not 1 <= limit <= 200:
        raise ValueError("retrieval settings are out of their ranges")
    asks = mode != "off" and vectors is not None and encoder is not None
    routes = usable(plan(requests, dense_weight if asks else None))
    lexical = stored(_search(index, routes.filter(F.col("route") != DENSE), per_route), "hits")
    found, error = None, None
    if asks:
        try:
            found = stored(_dense(routes.filter(F.col("route") == DENSE), vectors, encoder, dense_limit, index), "dense")
        except Exception as e:  # an optional route never stops the others
            error = type(e).__name__
    hits = lexical.unionByName(found) if found is not None and mode == "on" else lexical
    fused = top(fuse(hits, rrf_k), limit, "rrf")
    if not popular and not requests.join(fused, "qid", "left_anti").isEmpty():
        raise RetrievalError("a request finds nothing and there are no popular products")
    bare = requests.select("qid").join(fused.select("qid").distinct(), "qid", "left_anti")
    rest = bare.select("qid", F.inline(_listed(popular[:limit], POPULAR, rrf_k))).withColumn("rank", F.element_at("evidence", 1)["rank"]) if popular else None
    pool = fused.select("qid", "id", "evidence", "rrf", "rank")
    pool = stored(pool if rest is None else pool.unionByName(rest.select(pool.columns)), "pool")
    return pool, _diagnostics(requests, routes, lexical, found, pool, mode, error, asks)


def _dense(routes: DataFrame, vectors: DataFrame, encoder, limit: int, index: Index) -> DataFrame:
    asked = encoder(routes.select("qid", F.col("query").alias("text"))).select("qid", "embedding")
    best = dense(vectors, asked, limit, "id", "embedding")
    return best.join(routes.select("qid", "place", "route", "weight"), "qid").select("qid", "place", "id", "rank", "score", "route", "weight")


def _diagnostics(requests: DataFrame, routes: DataFrame, lexical: DataFrame, found: DataFrame | None, pool: DataFrame, mode: str, error: str | None, asks: bool) -> DataFrame:
    tried = routes.filter(F.col("route") == DENSE).select("qid", F.lit(True).alias("attempted")) if asks else None
    out = requests.select("qid", F.lit(mode).alias("mode"))
    out = out.join(tried, "qid", "left") if tried is not None else out.withColumn("attempted", F.lit(False))
    if found is not None:
        own = found.join(lexical.select("qid", "id", F.lit(1).alias("_lexical")).distinct(), ["qid", "id"], "left")
        out = out.join(own.groupBy("qid").agg(F.count(F.lit(1)).alias("returned"), F.count_if(F.col("_lexical").isNull()).alias("exclusive")), "qid", "left")
        used = pool.filter(F.exists("evidence", lambda e: e["route"] == DENSE)).groupBy("qid").agg(F.count(F.lit(1)).alias("contributed"))
        out = out.join(used, "qid", "left")
    else:
        out = out.withColumns({c: F.lit(0).cast("long") for c in ("returned", "exclusive", "contributed")})
    return out.select("qid", "mode", F.coalesce("attempted", F.lit(False)).alias("attempted"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("returned", "exclusive", "contributed")), F.lit(error).cast("string").alias("error"))


def legacy(requests: DataFrame, index: Index, popular: list[tuple[str, float]], k: int, per_route: int = PER_ROUTE, rrf_k: float = RRF_K) -> DataFrame:
    """(qid, id, score, rank) of the baseline: three routes of plain text, filled up to ``k`` with popular products of score 0,
    the greater id first among equally popular ones."""
    spec = lambda i, c, w: F.struct(F.lit(i).alias("place"), F.lit(c).alias("route"), F.coalesce(c, F.lit("")).alias("query"), F.lit(w).alias("weight"))
    routes = requests.select("qid", F.explode(F.array(*(spec(i, c, w) for i, (c, w) in enumerate(LEGACY.items())))).alias("s")).select("qid", "s.*")
    best = stored(top(fuse(_search(index, routes, per_route, stop_words=LEGACY_STOP_WORDS), rrf_k), 3 * per_route, "rrf").select("qid", "id", F.col("rrf").alias("score"), "rank"), "legacy")
    fill = [i for i, _ in sorted(popular, key=lambda p: (p[1], p[0]), reverse=True)][:MOST_LEGACY_FILL]
    if not fill:
        return best.filter(F.col("rank") <= k)
    have = requests.select("qid").join(best.groupBy("qid").agg(F.count(F.lit(1)).alias("n")), "qid", "left").filter(F.coalesce("n", F.lit(0)) < k)
    more = have.select("qid", F.coalesce("n", F.lit(0)).alias("n"), F.posexplode(F.from_json(F.lit(json.dumps(fill)), "array<string>")).alias("at", "id"))
    more = more.join(best.select("qid", "id"), ["qid", "id"], "left_anti").select("qid", "id", F.lit(0.0).alias("score"), (F.col("n") + 1 + F.col("at")).alias("place"))
    both = best.withColumn("place", F.col("rank").cast("long")).drop("rank").unionByName(more.withColumn("place", F.col("place").cast("long")))
    return top(both.withColumn("_first", -F.col("place")), k, "_first").select("qid", "id", "score", "rank")
