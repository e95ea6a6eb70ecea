"""Catalog and session profiles, question scoring, evaluation metrics."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_empty
from ..storage import stored

MISS_TURN = 11
# The language that tells buying from browsing.
BROWSING = r"\b(?:still exploring|ideas?|not sure|open to|something for|just browsing)\b"
STRONG = r"\b(?:must|only|under|below|no more than|at most|exactly)\b"
WEAK = r"\b(?:looking for|need|want)\b"


def missing(df: DataFrame) -> DataFrame:
    """(field, missing, rate) of every column in one scan; a null rate of an empty table."""
    sums = (F.coalesce(F.sum(is_empty(F.col(f"`{c}`"), t).cast("long")), F.lit(0)).alias(f"c{i}") for i, (c, t) in enumerate(df.dtypes))
    counts = df.agg(F.count(F.lit(1)).alias("n"), *sums)
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"c{i}").alias("missing")) for i, c in enumerate(df.columns)))).alias("x")
    return counts.select("n", each).select("x.field", "x.missing", (F.col("x.missing") / F.nullif(F.col("n"), F.lit(0))).alias("rate"))


def duplicates(df: DataFrame, key: Column) -> DataFrame:
    """distinct keys, keys found twice or more, rows with such a key."""
    n = df.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.count(F.lit(1)).alias("distinct_keys"), F.count_if(F.col("n") > 1).alias("repeated_keys"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("repeated_rows"))


def values_at(df: DataFrame, column: str, places: Callable[[int], dict[str, int]]) -> tuple[int, DataFrame]:
    """(n, row): the values at some places (from 0) of a column in order, nulls left out. ``places``: of n, by name.

    Distinct values are counted, ordered by ranges and their running counts searched, so no task sorts all values."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    parts = stored(counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()), "values")
    sums = parts.groupBy("part").agg(F.sum("c").alias("s"))
    before = sums.select("part", (F.sum("s").over(Window.orderBy("part")) - F.col("s")).alias("before"))
    run = parts.join(F.broadcast(before), "part").withColumn("upto", F.col("before") + F.sum("c").over(Window.partitionBy("part").orderBy("v")))
    n = parts.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    return n, run.agg(F.min("v").alias("least"), F.max("v").alias("most"), *(F.min(F.when(F.col("upto") > p, F.col("v"))).alias(k) for k, p in places(n).items()))


def numeric_summary(df: DataFrame, column: str) -> DataFrame:
    """count, min, quartiles and p95 by linear interpolation, max; nulls are left out, of none all but the count are null."""
    shares = {"p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}
    at = lambda n: {f"{k}_{e}": f(p * (n - 1)) for k, p in shares.items() for e, f in (("low", math.floor), ("high", math.ceil))}
    n, row = values_at(df, column, at)
    between = lambda k, p: F.col(f"{k}_low") + (F.col(f"{k}_high") - F.col(f"{k}_low")) * F.lit(p * (n - 1) - math.floor(p * (n - 1)))
    return row.select(F.lit(n).cast("long").alias("n"), "least", *(between(k, p).cast("double").alias(k) for k, p in shares.items()), "most")


def most_common(df: DataFrame, value: Column, k: int) -> DataFrame:
    return df.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)


def coverage(df: DataFrame, segments: list[str], flag: Column) -> DataFrame:
    """Rate of ``flag`` over all rows, each segment column and their combination (one grouping-sets pass)."""
    return df.groupingSets([[F.col(s) for s in x] for x in ([], *([s] for s in segments), segments)], *segments).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(flag).alias("covered"), F.grouping_id().cast("int").alias("level")
    ).withColumn("rate", F.col("covered") / F.col("n"))


def best_evidence(evidence: DataFrame, keys: list[str]) -> DataFrame:
    """The source of greatest confidence of each value; the first ordinal wins ties."""
    best = F.max_by(F.struct("source", "confidence"), F.struct("confidence", -F.col("ordinal")))
    return evidence.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.source", "b.confidence")


def facet_scores(facets: DataFrame) -> DataFrame:
    """(attribute, value) rows to normalized entropy, coverage and expected reduction of each attribute; 0 below two values."""
    n = facets.groupBy("attribute", "value").agg(F.count(F.lit(1)).alias("n"))
    known = F.when(F.col("value").isNotNull(), F.col("n"))
    per = n.groupBy("attribute").agg(F.sum("n").alias("total"), F.coalesce(F.sum(known), F.lit(0)).alias("seen"), F.count("value").alias("k"), F.max(known).alias("most"), F.sum(known * F.log("n")).alias("nlogn"))
    entropy = (F.log("seen") - F.col("nlogn") / F.col("seen")) / F.log("k")
    two = F.col("k") >= 2
    pick = lambda c: F.when(two, c).otherwise(F.lit(0.0))
    return per.select("attribute", pick(entropy).alias("entropy"), (F.col("seen") / F.col("total")).alias("coverage"), pick(1 - F.col("most") / F.col("seen")).alias("reduction"))


def _says(message: Column, ascii: bool) -> list[Column]:
    """Whether a message has browsing, strong and weak buying language; a null one has none. ``ascii``: as in SQL, words end at
    whatever is not of A-Z, a-z, 0-9 and ``_``; else at no letter of any script, so that ``underätzt`` does not say ``under``."""
    low = F.lower(F.translate(message, "İ", "i") if ascii else message)
    edge = lambda p: "(?<![A-Za-z0-9_])" + p.removeprefix(r"\b").removesuffix(r"\b") + "(?![A-Za-z0-9_])" if ascii else p
    return [F.coalesce(low.rlike(edge(p)), F.lit(False)) for p in (BROWSING, STRONG, WEAK)]


def route(message: Column, hard: Column, excluded: Column, category: Column, ascii: bool = False) -> tuple[Column, Column]:
    """(route, confidence) of a turn. hard, excluded: whether there are such constraints; category: or null; ascii: as in ``_says``."""
    browsing, strong, weak = _says(message, ascii)
    known = category.isNotNull() & (category != "")
    signals = 1 + weak.cast("int")
    name = F.when(hard | excluded | strong, "buying").when(browsing, "browsing").when(known & (signals <= 2), "browsing").when(weak & known, "buying").otherwise("browsing")
    sure = F.when(hard | excluded, 0.9).when(strong, 0.78).when(browsing, 0.88).when(known & (signals <= 2), 0.72).when(weak & known, 0.65).otherwise(0.6)
    return name, sure


def decision(message: Column, hard: Column, excluded: Column, category: Column, override: Column, ascii: bool = False) -> Column:
    """(route, confidence, signals, reason, override) of a turn. hard, excluded: arrays of terms; ascii: as in ``_says``."""
    browsing, strong, weak = _says(message, ascii)
    fields = F.transform(hard, lambda t: t["field"])
    name, sure = route(message, F.size(hard) > 0, F.size(excluded) > 0, category, ascii)
    # The language of the signals, as in route.
    seen = [
        ("has_hard_constraint", F.size(hard) > 0), ("has_budget", F.arrays_overlap(fields, F.array(F.lit("price_min"), F.lit("price_max")))),
        ("has_size", F.array_contains(fields, "size")), ("has_exclusion", F.size(excluded) > 0),
        ("strong_buying_language", strong), ("browsing_language", browsing), ("weak_buying_language", weak),
        ("has_category", F.coalesce(category != "", F.lit(False))),
    ]
    signals = F.array_compact(F.array(*(F.when(c, F.lit(s)) for s, c in seen)))
    why = (
        F.when(sure.isin(0.9, 0.78), "a firm demand or an exclusion asks for precise retrieval").when(sure == 0.88, "the customer says that they are exploring")
        .when(sure == 0.72, "only a category is known").when(sure == 0.65, "a category and the wish to buy").otherwise("nothing tells of a firm intent")
    )
    return F.struct(name.alias("route"), sure.alias("confidence"), signals.alias("signals"), why.alias("reason"), F.coalesce(override, F.lit(False)).alias("override"))


def metrics(sessions: DataFrame, segment: str | None = None) -> DataFrame:
    """(hit, rank, turn) rows to hit@10, MRR, turns to conversion (a miss counts 11), efficiency and technical score."""
    hit = F.col("rank").isNotNull() & (F.col("rank") <= 10)
    base = [F.count(F.lit(1)).alias("n"), F.avg(hit.cast("int")).alias("hit"), F.avg(F.when(hit, 1 / F.col("rank")).otherwise(0.0)).alias("mrr"), F.avg(F.when(hit, F.col("turn")).otherwise(MISS_TURN)).alias("mttc")]
    out = (sessions.groupBy(segment) if segment else sessions).agg(*base)
    out = out.withColumn("efficiency", F.least(F.greatest((11 - F.col("mttc")) / 10, F.lit(0.0)), F.lit(1.0)))
    return out.withColumn("technical", 0.5 * F.col("hit") + 0.3 * F.col("mrr") + 0.2 * F.col("efficiency"))


def dry_rounds(turns: DataFrame, key: str, order: list[str], changed: Column) -> DataFrame:
    """``turns`` with ``dry``, turns since something last changed, 0 on a change; it takes the place of a column of that name."""
    names = [n for n in (f"_{i}" for i in range(len(turns.columns) + 2)) if n not in turns.columns]
    change, island = names[:2]
    past = Window.partitionBy(key).orderBy(*order)
    marked = turns.withColumn(change, F.coalesce(changed, F.lit(False)))
    marked = marked.withColumn(island, F.sum(F.col(change).cast("int")).over(past.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    n = F.row_number().over(Window.partitionBy(key, island).orderBy(*order))
    return marked.withColumn("dry", F.when(F.col(island) == 0, n).otherwise(n - 1)).drop(change, island)
