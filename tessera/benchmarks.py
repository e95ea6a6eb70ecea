"""Benchmarks of retrieval, of the ranker and of blends, question traces, and the catalog's whole profile."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .dialogue.grammar import parse
from .dialogue.memory import LAST_TURN
from .dialogue.state import State, apply, terms
from .engine import TOP_K, Engine
from .evaluation import STARTED, _next, _start, records, valid_recommendations, with_targets
from .operators import hybrid as H
from .operators import profiles as P
from .operators import ranking as K
from .operators.analytics import MISS_TURN
from .operators.retrieval import guarded, top
from .storage import stored

ALPHAS = [i / 10 for i in range(11)]
CARD_BUDGET = re.compile(r"budget\s+around\s+\$\s*\d", re.I)
_TERMS = "array<struct<field:string,values:array<string>>>"


def catalog_sha256(spark: SparkSession, path: str) -> str:
    """One checksum of a catalog's lines, whatever their order."""
    total = spark.read.text(path).filter(F.trim("value") != "").agg(F.sum(F.conv(F.substring(F.sha2("value", 256), 1, 15), 16, 10).cast("decimal(38,0)")).cast("string").alias("s"))
    return total.select(F.sha2(F.coalesce("s", F.lit("")), 256)).first()[0]


def requests(samples: DataFrame, products: DataFrame, mode: str = "full", parsed: bool = False) -> DataFrame:
    """Turn-one requests made of what customers say first (``initial``) or of all they want (``full``). ``parsed``: with the
    constraints that the query's grammar gives, the category from the category's own words, a budget only where the query
    names one."""
    rows = records(samples, products)
    query = "initial_query" if mode == "initial" else "oracle_query"
    route = F.when(F.col("scenario_type").isin("browsing", "boundary"), "browsing").otherwise("buying")
    base = rows.select(F.col("sample_id").alias("qid"), "scenario_type", "target", route.alias("route"), F.col(query).alias("current_message"), F.col("category").alias("base_request"))
    none = F.array().cast(_TERMS)
    if parsed:
        base = base.mapInPandas(_parsed, f"qid string, scenario_type string, target string, route string, current_message string, base_request string, category string, hard {_TERMS}, soft {_TERMS}, excluded {_TERMS}")
    else:
        base = base.withColumns({"category": F.lit(None).cast("string"), "hard": none, "soft": none, "excluded": none})
    tags = F.from_json(F.get_json_object("raw", "$.user_profile.preference_tags"), "array<string>")
    tagged = samples.select(F.col("sample_id").alias("qid"), F.coalesce(tags, F.array().cast("array<string>")).alias("tags"))
    return base.join(tagged, "qid").withColumns({"raw_context": F.col("current_message"), "structured_query": F.col("current_message")})


def _parsed(batches):
    for pdf in batches:
        out = []
        for row in pdf.itertuples(index=False):
            made = apply(State(), parse(row.current_message, State(), 1))
            category = apply(State(), parse(row.base_request, State(), 1)).category
            hard = {k: v for k, v in made.hard_constraints.items() if not k.startswith("price_") or CARD_BUDGET.search(row.current_message)}
            out.append((*row, category, terms(hard), terms(made.soft_preferences), terms(made.excluded)))
        yield pd.DataFrame(out, columns=[*pdf.columns, "category", "hard", "soft", "excluded"])


def _pools(engine: Engine, asked: DataFrame) -> DataFrame:
    return H.retrieve(asked, engine.index, engine.popular, engine.limit)[0]


def _six(value: float | None) -> float:
    return round(value or 0.0, 6)


def retrieval(engine: Engine, samples: DataFrame, mode: str = "full") -> dict:
    """Share of targets in the pool, overall and by scenario, and their ranks (201 where they are not)."""
    asked = stored(requests(samples, engine.products, mode), "requests")
    found = _pools(engine, asked).select("qid", F.col("id").alias("target"), "rank")
    ranks = stored(asked.select("qid", "scenario_type", "target").join(found, ["qid", "target"], "left"), "ranks")
    hit = F.col("rank").isNotNull().cast("int")
    recall = {r["scenario_type"]: _six(r["r"]) for r in ranks.groupBy("scenario_type").agg(F.avg(hit).alias("r")).orderBy("scenario_type").collect()}
    whole = ranks.withColumn("rank", F.coalesce("rank", F.lit(engine.limit + 1)))
    n, r, median = ranks.agg(F.count(F.lit(1)), F.avg(hit), F.percentile(F.coalesce("rank", F.lit(engine.limit + 1)), 0.5)).first()
    return {"mode": mode, "sample_count": n, "recall_at_200": {"overall": _six(r)} | recall, "target_rank": {"median": median, "p95": P.floor_percentile(whole, "rank", 0.95).first()[0]}}


def ranker(engine: Engine, samples: DataFrame) -> dict:
    """The pool's order against the ranker's, whether targets outlive the filter, and what was filtered."""
    asked = stored(requests(samples, engine.products, "full", True), "requests")
    pool = _pools(engine, asked)
    explained = stored(K.explain(asked, pool, engine.normalized, engine.threshold, engine.weights), "explained")
    before = pool.select("qid", F.col("id").alias("target"), F.col("rank").alias("rrf_rank"))
    after = explained.select("qid", F.col("id").alias("target"), F.col("rank").alias("ranker_rank"), "filtered", "hard_matches", "excluded_matches")
    both = stored(asked.select("qid", "scenario_type", "target").join(before, ["qid", "target"], "left").join(after, ["qid", "target"], "left"), "ranks")
    mrr = lambda c: F.avg(F.coalesce(1 / F.col(c), F.lit(0.0)))
    hit = lambda c: F.avg(F.coalesce(F.col(c) <= TOP_K, F.lit(False)).cast("int"))
    found = F.col("rrf_rank").isNotNull()
    row = both.agg(F.count(F.lit(1)).alias("n"), F.avg(found.cast("int")).alias("recall"), F.avg(F.when(found, F.col("ranker_rank").isNotNull().cast("int"))).alias("survival"), mrr("rrf_rank").alias("m1"), mrr("ranker_rank").alias("m2"), hit("rrf_rank").alias("h1"), hit("ranker_rank").alias("h2")).first()
    sums = K.counts(explained).agg(F.avg("n_filtered").alias("f"), F.avg("n_unknown_kept").alias("u")).first()
    each = both.groupBy("scenario_type").agg(F.count(F.lit(1)).alias("n"), mrr("rrf_rank").alias("m1"), mrr("ranker_rank").alias("m2")).orderBy("scenario_type").collect()
    against = F.filter(F.concat("hard_matches", "excluded_matches"), lambda m: m["state"] == "mismatch")
    lost = both.filter(found & F.col("ranker_rank").isNull()).select(F.col("qid").alias("sample_id"), F.col("scenario_type").alias("scenario"), "target", against.alias("mismatches")).orderBy("sample_id")
    return {
        "sample_count": row["n"], "candidate_recall_at_200": _six(row["recall"]), "target_filter_survival": _six(row["survival"]),
        "rrf": {"mrr": _six(row["m1"]), "top10_hit_rate": _six(row["h1"])}, "local_ranker": {"mrr": _six(row["m2"]), "top10_hit_rate": _six(row["h2"])},
        "scenario_mrr": {r["scenario_type"]: {"sample_count": r["n"], "rrf_mrr": _six(r["m1"]), "ranker_mrr": _six(r["m2"])} for r in each},
        "mean_filtered_count": round(sums["f"] or 0.0, 3), "mean_unknown_preserved_count": round(sums["u"] or 0.0, 3),
        "target_filter_failures": [r.asDict(recursive=True) for r in lost.toLocalIterator()],
    }


def dialogues(engine: Engine, samples: DataFrame, stop: bool) -> DataFrame:
    """Every turn of the samples' dialogues: sid, scenario_type, target, customer, turn, message, answer columns, ``ready``
    (the target counts) and ``eligible`` (the turn from which it does). ``stop``: a dialogue ends when its target is found."""
    talks = stored(with_targets(samples, engine.products).select("raw", "product", "scenario_type", "difficulty_bucket", "target").mapInPandas(_start, STARTED), "talks")
    all_turns = None
    for turn in range(1, LAST_TURN + 1):
        said = engine.respond(talks.select("sid", "memory", "message", "turn")).withColumnRenamed("memory", "kept").withColumnRenamed("message", "answer").drop("turn")
        now = F.get_json_object("customer", "$.changed") == "true"
        change = F.coalesce(F.get_json_object("customer", "$.change.turn").cast("int"), F.lit(1))
        both = talks.join(said, "sid").withColumns({"ready": now, "eligible": F.when(F.col("scenario_type") == "intent_override", change).otherwise(1)})
        place = F.array_position(valid_recommendations(F.col("recommendations")), F.col("target")).cast("int")
        both = stored(both.withColumn("place", F.when(F.col("ready") & (place > 0), place)), "turns")
        all_turns = both if all_turns is None else all_turns.unionByName(both)
        if turn == LAST_TURN:
            break
        rest = both.filter("place is null") if stop else both
        talks = stored(rest.select("sid", "scenario_type", "difficulty_bucket", "target", "customer", F.col("kept").alias("memory"), "turn", "ask_attribute").mapInPandas(_next, STARTED), "talks")
        if talks.isEmpty():
            break
    return all_turns


def _scores(first: DataFrame) -> dict:
    row = first.agg(F.avg(F.col("turn").isNotNull().cast("int")).alias("hit"), F.avg(F.coalesce(1 / F.col("place"), F.lit(0.0))).alias("mrr"), F.avg(F.coalesce("turn", F.lit(MISS_TURN))).alias("mttc")).first()
    if row["mttc"] is None:
        return {"hit_rate_at_10": 0.0, "mrr": 0.0, "mttc": None, "technical_score": 0.0}
    efficiency = max(0.0, min(1.0, (11.0 - row["mttc"]) / 10.0))
    return {"hit_rate_at_10": _six(row["hit"]), "mrr": _six(row["mrr"]), "mttc": _six(row["mttc"]), "technical_score": _six(0.5 * row["hit"] + 0.3 * row["mrr"] + 0.2 * efficiency)}


def first_hits(turns: DataFrame, place: Column) -> DataFrame:
    """(sid, scenario_type, turn, place) of the first eligible turn in which ``place`` is not null; nulls where none is."""
    hit = (F.col("turn") >= F.col("eligible")) & place.isNotNull()
    best = F.min(F.when(hit, F.struct(F.col("turn").alias("turn"), place.alias("place"))))
    return turns.groupBy("sid", "scenario_type").agg(best.alias("b")).select("sid", "scenario_type", "b.turn", "b.place")


def ablation(engine: Engine, samples: DataFrame, alphas: list[float] = ALPHAS) -> dict:
    """The metrics that blends of the baseline's and the engine's order would have, by weight of the latter, and of the
    engine's own order, over dialogues of ten turns."""
    turns = stored(dialogues(engine, samples, False), "dialogues")
    key = F.concat_ws("\u0001", "sid", "turn").alias("qid")
    given = turns.select(key, F.posexplode("recommendations").alias("at", "r")).select("qid", F.col("r.parent_asin").alias("id"), (F.col("at") + 1).alias("rank"))
    asked = turns.select(key, *(F.get_json_object("kept", f"$.{c}").alias(c) for c in ("base_request",)), F.col("message").alias("current_message"), _context(F.col("kept")).alias("legacy_query"))
    legacy = H.legacy(asked, engine.index, engine.popular, TOP_K)
    target = turns.select(key, "sid", "scenario_type", "turn", "eligible", F.col("target").alias("id"))
    out = {}
    for name, ranked in [*((f"legacy_set_alpha_{a:.1f}", top(guarded(legacy.select("qid", "id", "rank"), given, F.lit(a), TOP_K).withColumn("score", F.col("blend")), TOP_K)) for a in alphas), ("formal", given)]:
        placed = target.join(ranked.select("qid", "id", "rank"), ["qid", "id"], "left")
        first = stored(first_hits(placed, F.col("rank")), "first")
        out[name] = {"overall": _scores(first), "intent_override": _scores(first.filter("scenario_type = 'intent_override'"))}
    return out


def _context(memory: Column) -> Column:
    from .dialogue.memory import Memory

    @F.pandas_udf("string")
    def context(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: Memory.loads(t).legacy_query())

    return context(memory)


def trace(engine: Engine, samples: DataFrame) -> list[dict]:
    """What was said, asked and found in every turn, by session; for a look at a few samples."""
    turns = dialogues(engine, samples, True)
    columns = ["turn", F.col("message").alias("user_message"), F.col("ask_attribute").alias("applied_attribute"), F.col("policy_attribute").alias("policy_choice"), "policy_value", F.col("answer").alias("question"), "route", F.col("n_candidates").alias("candidate_count"), F.col("place").alias("target_rank")]
    each = turns.groupBy("sid", "scenario_type", "target").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("turns")).orderBy("sid")
    out = []
    for r in each.toLocalIterator():
        t = [x.asDict() for x in r["turns"]]
        out.append({
            "sample_id": r["sid"], "scenario_type": r["scenario_type"], "target": r["target"], "applied_question_order": [x["applied_attribute"] for x in t],
            "policy_question_order": [x["policy_choice"] for x in t], "first_hit_turn": next((x["turn"] for x in t if x["target_rank"]), None), "turns": t,
        })
    return out


def profile(spark: SparkSession, products: DataFrame, samples: DataFrame) -> dict[str, DataFrame]:
    """The tables of a catalog's and its sessions' profile by heading."""
    from .operators import analytics as A
    from .operators.index import Index, build
    from .storage import scratch_path

    products = stored(products, "products")
    common, depth = P.categories(products, F.col("categories"))
    counted, targets = P.sessions(samples, products)
    path = scratch_path(spark, "plain-index")
    build(products, path, stem=False)
    ranks = P.bm25_profile(Index(spark, path), samples, products)
    return {
        "Missing values": A.missing(products.select(*P.FIELDS)), "Types": P.types(products), "Keys": P.keys(products, "parent_asin"), "Titles": P.titles(products, F.col("title")),
        "Prices": P.prices(products, F.col("price"), F.coalesce(F.col("price_kind") == "string", F.lit(False))), "Price summary": A.numeric_summary(products.select(F.when(F.col("price_kind") == "number", F.col("price").try_cast("double")).alias("price")), "price"),
        "Ratings": P.ratings(products, F.col("average_rating"), F.col("rating_number")), "Common categories": common, "Category depth": depth, "Detail keys": P.detail_keys(products, F.col("details")),
        "Search coverage": P.coverage(products, P.SEARCHED), "Sessions": counted, "Targets": targets, "Target coverage": P.target_coverage(samples, products), "Hidden constraints": P.hidden_constraints(P.wishes(samples, products)),
        "First-message ranks": ranks["initial"], "Oracle ranks": ranks["oracle"], "Field ablation": ranks["ablation"],
    }

