"""The closed loop: simulated customers against the engine, all sessions of a turn at once; its metrics and report."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dialogue.customer import Customer
from .dialogue.memory import LAST_TURN, Memory
from .engine import TOP_K, Engine
from .operators.analytics import MISS_TURN
from .operators.retrieval import among
from .sources.catalog import read_lenient, read_objects
from .storage import stored

SAMPLE = "sample_id string, scenario_type string, difficulty_bucket string, ground_truth struct<parent_asin:string>"
STARTED = "sid string, scenario_type string, difficulty_bucket string, target string, customer string, memory string, message string, turn int"


def read_samples(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(raw, sample_id, scenario_type, difficulty_bucket, target) of a JSONL file of sessions."""
    rows = read_objects(spark, path, SAMPLE) if strict else read_lenient(spark, path, SAMPLE)[0]
    return rows.select("raw", "sample_id", "scenario_type", "difficulty_bucket", F.col("ground_truth.parent_asin").alias("target"))


def with_targets(samples: DataFrame, products: DataFrame) -> DataFrame:
    """``samples`` beside the ``product`` line of their target; a target that is no product is an error."""
    lines = among(products.select(F.col("parent_asin").alias("target"), F.col("raw").alias("product")), "target", samples.select("target"))
    found = samples.join(lines, "target", "left")
    return found.withColumn("product", F.when(F.col("product").isNull(), F.raise_error(F.concat(F.lit("target is no product: "), F.coalesce("target", F.lit("null")))).cast("string")).otherwise(F.col("product")))


def missing_targets(samples: DataFrame, products: DataFrame) -> DataFrame:
    return samples.join(products.select(F.col("parent_asin").alias("target")), "target", "left_anti")


def records(samples: DataFrame, products: DataFrame) -> DataFrame:
    """sample_id, scenario_type, difficulty_bucket, target, category, initial_query (what the customer says first) and
    oracle_query (everything that they want at once)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            people = [Customer.of(json.loads(s), json.loads(p)) for s, p in zip(pdf["raw"], pdf["product"])]
            out = pdf[["sample_id", "scenario_type", "difficulty_bucket", "target"]].copy()
            out["category"], out["oracle_query"] = [c.category for c in people], [c.oracle() for c in people]
            out["initial_query"] = [c.begin() for c in people]
            yield out

    kind = "sample_id string, scenario_type string, difficulty_bucket string, target string, category string, oracle_query string, initial_query string"
    return with_targets(samples, products).select("raw", "product", "sample_id", "scenario_type", "difficulty_bucket", "target").mapInPandas(run, kind)


def _start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for raw, product, scenario, difficulty, target in zip(pdf["raw"], pdf["product"], pdf["scenario_type"], pdf["difficulty_bucket"], pdf["target"]):
            sample = json.loads(raw)
            customer = Customer.of(sample, json.loads(product))
            said = customer.begin()
            out.append((sample["sample_id"], scenario, difficulty, target, customer.dumps(), Memory(profile=sample.get("user_profile") or {}).dumps(), said, 1))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in STARTED.split(", ")])


def _next(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for row in pdf.itertuples(index=False):
            customer = Customer.loads(row.customer)
            said = customer.answer(int(row.turn), row.ask_attribute)
            out.append((row.sid, row.scenario_type, row.difficulty_bucket, row.target, customer.dumps(), row.memory, said, int(row.turn) + 1))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in STARTED.split(", ")])


def valid_recommendations(recs, k: int = TOP_K):
    """The first ``k`` distinct ids that say something."""
    ids = F.transform(recs, lambda r: F.trim(r["parent_asin"]))
    return F.slice(F.array_distinct(F.filter(ids, lambda i: F.coalesce(i != "", F.lit(False)))), 1, k)


def evaluate(engine: Engine, samples: DataFrame, turns: int = LAST_TURN) -> DataFrame:
    """One row per sample: sample_id, scenario_type, difficulty_bucket, hit, first_hit_turn, best_rank, reciprocal_rank.

    A session ends when its target is among the first ten, for override sessions only once the customer has changed their
    mind; a target that is no product is an error."""
    spark = engine.spark
    columns = ["sid", "scenario_type", "difficulty_bucket", "turn", "place"]
    done = spark.createDataFrame([], "sid string, scenario_type string, difficulty_bucket string, turn int, place int")
    talks = stored(with_targets(samples, engine.products).select("raw", "product", "scenario_type", "difficulty_bucket", "target").mapInPandas(_start, STARTED), "talks")
    for turn in range(1, turns + 1):
        answers = engine.respond(talks.select("sid", "memory", "message", "turn")).select("sid", F.col("memory").alias("kept"), "ask_attribute", "recommendations")
        both = talks.join(answers, "sid")
        ready = F.get_json_object("customer", "$.changed") == "true"
        place = F.array_position(valid_recommendations(F.col("recommendations")), F.col("target")).cast("int")
        both = stored(both.withColumn("place", F.when(ready & (place > 0), place)), "heard")
        last = turn == turns
        ended = both if last else both.filter("place is not null")
        done = stored(done.unionByName(ended.select(*columns)), "done")
        if last:
            break
        rest = both.filter("place is null").select("sid", "scenario_type", "difficulty_bucket", "target", "customer", F.col("kept").alias("memory"), "turn", "ask_attribute")
        talks = stored(rest.mapInPandas(_next, STARTED), "talks")
        if talks.isEmpty():
            break
    hit = F.col("place").isNotNull()
    return done.select(F.col("sid").alias("sample_id"), "scenario_type", "difficulty_bucket", hit.alias("hit"), F.when(hit, F.col("turn")).alias("first_hit_turn"), F.col("place").alias("best_rank"), F.when(hit, 1 / F.col("place")).otherwise(0.0).alias("reciprocal_rank"))


def _summary(row) -> dict:
    if not row or not row["n"]:
        return {"sample_count": 0, "hit_rate_at_10": 0.0, "mrr": 0.0, "mttc": None}
    return {"sample_count": row["n"], "hit_rate_at_10": round(row["hit"], 6), "mrr": round(row["mrr"], 6), "mttc": round(row["mttc"], 6)}


def report(sessions: DataFrame, with_sessions: bool = True) -> dict:
    """The metrics of :func:`evaluate`'s rows, rounded half to even at six places; the score is made of rounded metrics."""
    sums = [F.count(F.lit(1)).alias("n"), F.avg(F.col("hit").cast("int")).alias("hit"), F.avg("reciprocal_rank").alias("mrr"), F.avg(F.coalesce("first_hit_turn", F.lit(MISS_TURN))).alias("mttc")]
    overall = _summary(sessions.agg(*sums).first())
    each = {r["scenario_type"]: _summary(r) for r in sessions.groupBy("scenario_type").agg(*sums).orderBy("scenario_type").collect()}
    efficiency = max(0.0, min(1.0, (11.0 - overall["mttc"]) / 10.0)) if overall["mttc"] is not None else 0.0
    score = 0.5 * overall["hit_rate_at_10"] + 0.3 * overall["mrr"] + 0.2 * efficiency
    out = overall | {"efficiency": round(efficiency, 6), "recommended_technical_score": round(score, 6), "reported_token_usage": {"prompt_tokens": 0, "completion_tokens": 0, "total_tokens": 0}, "scenario_metrics": each}
    if with_sessions:
        out["sessions"] = [r.asDict() for r in sessions.drop("difficulty_bucket").orderBy("sample_id").toLocalIterator()]
    return out
