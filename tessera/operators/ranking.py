"""The local ranker: filters a candidate pool by its request and orders it by weighted features, all in columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import RANK_STOP_WORDS, normalized_phrase, terms
from . import matching as M
from .normalize import document
from .retrieval import among, top

FEATURES = [f for f in M.WEIGHTS if f != "penalty"] + ["penalty"]
MOST_PROFILE = 0.03


class RankingError(ValueError):
    """A pool can't be ranked."""


def weights(**given: float) -> dict[str, float]:
    """The feature weights with ``given`` ones in place; ``penalty`` is given as a positive number."""
    unknown = set(given) - set(M.WEIGHTS)
    if unknown:
        raise ValueError(f"no such weights: {sorted(unknown)}")
    if bad := [k for k, v in given.items() if not math.isfinite(v) or v < 0]:
        raise ValueError(f"weights are finite and not negative: {bad}")
    if given.get("profile", 0) > MOST_PROFILE:
        raise ValueError(f"a profile weighs {MOST_PROFILE} at most")
    return M.WEIGHTS | {k: -v if k == "penalty" else v for k, v in given.items()}


def phrases(category: Column, hard: Column, soft: Column) -> Column:
    """Distinct normalised values of the positive constraints but prices, the category first."""
    worded = F.filter(F.concat(hard, soft), lambda t: ~t["field"].isin("price_min", "price_max"))
    each = F.concat(F.when(category.isNotNull(), F.array(category)).otherwise(F.array().cast("array<string>")), F.flatten(F.transform(worded, lambda t: t["values"])))
    return F.array_distinct(F.filter(F.transform(each, normalized_phrase), lambda p: p != ""))


def _share(found: Column, of: Column) -> Column:
    return F.when(F.size(of) > 0, F.size(found) / F.size(of)).otherwise(0.0)


def _explained(rows: DataFrame, threshold: float) -> DataFrame:
    """Matches and, but for rrf and popularity, the features of each (request, product) row."""
    rows = rows.withColumns({
        "hard_matches": M.evaluate(M.with_category(F.col("hard"), F.col("category")), False, threshold),
        "soft_matches": M.evaluate(F.col("soft"), False, threshold),
        "excluded_matches": M.evaluate(F.col("excluded"), True, threshold),
        "_document": document(),
        "_phrases": phrases(F.col("category"), F.col("hard"), F.col("soft")),
        "_asked": terms(F.when(F.trim("structured_query") != "", F.col("structured_query")).otherwise(F.col("current_message")), RANK_STOP_WORDS),
        "_liked": F.array_distinct(F.flatten(F.transform("tags", lambda t: terms(t, RANK_STOP_WORDS)))),
    })
    rows = rows.withColumns({"_words": terms(F.col("_document"), RANK_STOP_WORDS), "_marked": M.marked(F.col("_document"))})
    leaves = F.transform("leaf_categories", lambda e: e["value"])
    sure = lambda ms, share: F.transform(F.filter(ms, lambda m: m["state"] == "mismatch"), lambda m: m["confidence"] * share)
    against = F.concat(sure(F.col("hard_matches"), 1.0), sure(F.col("excluded_matches"), 1.0), sure(F.col("soft_matches"), 0.5))
    category = F.when(F.array_contains(leaves, F.col("category")), 1.0).when(F.array_contains("category_path", F.col("category")), 0.75)
    unknown = F.filter(F.concat("hard_matches", "soft_matches", "excluded_matches"), lambda m: m["state"] == "unknown")
    return rows.withColumns({
        "exact_phrase": _share(F.filter("_phrases", lambda p: F.contains("_marked", M.marked(p))), F.col("_phrases")),
        "feature_overlap": _share(F.array_intersect("_asked", "_words"), F.col("_asked")),
        "category_match": F.coalesce(category, F.lit(0.0)),
        "hard_match": M.match_ratio(M.states(F.col("hard_matches"))),
        "soft_match": M.match_ratio(M.states(F.col("soft_matches"))),
        "profile": _share(F.array_intersect("_liked", "_words"), F.col("_liked")),
        "penalty": F.coalesce(F.array_max(against), F.lit(0.0)),
        "unknowns": F.size(unknown),
        "filtered": M.decisive(F.col("hard_matches"), F.col("excluded_matches"), threshold),
    })


def explain(requests: DataFrame, pool: DataFrame, products: DataFrame, threshold: float = M.THRESHOLD, weighted: dict[str, float] = M.WEIGHTS) -> DataFrame:
    """One row per candidate: qid, id, filtered, unknowns, matches, features, score, and its rank among those that stay
    (null if it goes). A candidate that is no product is an error.

    requests: qid, category, hard, soft, excluded, structured_query, current_message, tags; pool: qid, id, rrf.
    rrf is scaled by the pool's greatest before the filter, popularity by the greatest log of those that stay."""
    products = among(products, "parent_asin", pool.select(F.col("id").alias("parent_asin")))
    both = pool.select("qid", "id", F.col("rrf").alias("raw_rrf")).join(products, F.col("id") == F.col("parent_asin"), "left")
    known = F.when(F.col("parent_asin").isNull(), F.raise_error(F.concat(F.lit("candidate is no product: "), "id")).cast("string")).otherwise(F.col("id"))
    asked = requests.select("qid", "category", "hard", "soft", "excluded", "structured_query", "current_message", "tags")
    rows = _explained(both.withColumn("id", known).join(asked, "qid"), threshold)
    by = Window.partitionBy("qid")
    rows = rows.withColumn("rrf", F.when(F.max("raw_rrf").over(by) > 0, F.col("raw_rrf") / F.max("raw_rrf").over(by)).otherwise(0.0))
    log = F.when(~F.col("filtered"), F.log1p("rating_number"))
    rows = rows.withColumn("popularity", F.when(F.max(log).over(by) > 0, F.log1p("rating_number") / F.max(log).over(by)).otherwise(0.0))
    score = sum((F.lit(weighted[f]) * F.col(f) for f in FEATURES), F.lit(0.0))
    rows = rows.withColumn("score", F.when(~F.col("filtered"), score))
    place = F.row_number().over(Window.partitionBy("qid", "filtered").orderBy(F.desc("score"), "id"))
    return rows.withColumn("rank", F.when(~F.col("filtered"), place)).select("qid", "id", "raw_rrf", "filtered", "unknowns", *FEATURES, "score", "rank", "hard_matches", "soft_matches", "excluded_matches")


def rank(requests: DataFrame, pool: DataFrame, products: DataFrame, k: int, threshold: float = M.THRESHOLD, weighted: dict[str, float] = M.WEIGHTS) -> DataFrame:
    """(qid, id, score, rank) of the k best that stay."""
    return explain(requests, pool, products, threshold, weighted).filter(F.col("rank") <= k).select("qid", "id", "score", "rank")


def counts(explained: DataFrame) -> DataFrame:
    """Of each request: candidates, those filtered, and those kept although something of them is unknown."""
    stays = ~F.col("filtered")
    return explained.groupBy("qid").agg(F.count(F.lit(1)).alias("n_candidates"), F.count_if(F.col("filtered")).alias("n_filtered"), F.count_if(stays & (F.col("unknowns") > 0)).alias("n_unknown_kept"))


def best_or_rrf(explained: DataFrame, k: int) -> DataFrame:
    """(qid, id, score, rank, fallback): the ranking, or where nothing stays the pool by rrf with the event that says so."""
    kept = explained.groupBy("qid").agg(F.count_if(~F.col("filtered")).alias("_kept"))
    rows = explained.join(kept, "qid")
    ranked = rows.filter((F.col("_kept") > 0) & (F.col("rank") <= k)).select("qid", "id", "score", "rank", F.lit(None).cast("string").alias("fallback"))
    rest = top(rows.filter("_kept = 0").select("qid", "id", F.col("raw_rrf").alias("score")), k)
    return ranked.unionByName(rest.withColumn("fallback", F.lit("rrf_ranking")))
