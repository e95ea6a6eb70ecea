"""Three-state constraint matching and the feature ranker."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constraints import match_category
from ..functions.text import let, normalized_phrase

THRESHOLD = 0.85
# Weights of the ranker's features.
WEIGHTS = {"rrf": 1.00, "exact_phrase": 0.35, "feature_overlap": 0.25, "category_match": 0.25, "hard_match": 0.25, "soft_match": 0.15, "popularity": 0.03, "profile": 0.03, "penalty": -0.80}


def match_value(observed: Column, confidence: Column, wanted: Column, excluded: bool = False, threshold: float = THRESHOLD) -> Column:
    """match, mismatch or unknown of one observed value (null: not observed) against an array of wanted ones."""
    hit = F.array_contains(wanted, observed)
    if excluded:
        state = F.when(hit, F.when(confidence >= threshold, "mismatch").otherwise("unknown")).when(confidence < threshold, "unknown").otherwise("match")
    else:
        state = F.when(hit, "match").when(confidence < threshold, "unknown").otherwise("mismatch")
    return F.when(observed.isNull(), "unknown").otherwise(state)


def match_price(price: Column, low: Column, high: Column) -> Column:
    """Bounds are inclusive; a null bound is open, a null price unknown."""
    inside = F.coalesce(price >= low, F.lit(True)) & F.coalesce(price <= high, F.lit(True))
    return F.when(price.isNull(), "unknown").when(inside, "match").otherwise("mismatch")


def should_filter(states: list[tuple[Column, Column]], threshold: float = THRESHOLD) -> Column:
    """Any hard or excluded mismatch of enough confidence."""
    out = F.lit(False)
    for state, confidence in states:
        out = out | ((state == "mismatch") & (confidence >= threshold))
    return out


def match_ratio(states: Column) -> Column:
    """Matches among decided states, 0 if none is decided."""
    decided = F.size(F.filter(states, lambda s: s != "unknown"))
    return F.coalesce(F.size(F.filter(states, lambda s: s == "match")) / F.nullif(decided, F.lit(0)), F.lit(0.0))


def overlap(query: Column, doc: Column) -> Column:
    """Share of the query's distinct tokens that the document has."""
    return F.coalesce(F.size(F.array_intersect(query, doc)) / F.nullif(F.size(query), F.lit(0)), F.lit(0.0))


def rank(pool: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """``pool`` (qid, id, rrf, popularity, filtered and the other features) without filtered rows, scored and ranked.
    rrf is scaled by the pool's greatest, popularity as log1p by the survivors' greatest."""
    by = Window.partitionBy("qid")
    scaled = pool.withColumn("rrf", F.coalesce(F.col("rrf") / F.nullif(F.max("rrf").over(by), F.lit(0.0)), F.lit(0.0))).filter(~F.col("filtered"))
    log = F.log1p("popularity")
    scaled = scaled.withColumn("popularity", F.coalesce(log / F.nullif(F.max(log).over(by), F.lit(0.0)), F.lit(0.0)))
    score = sum((F.lit(w) * F.col(c) for c, w in weights.items() if c in pool.columns), F.lit(0.0))
    return scaled.withColumn("score", score).withColumn("rank", F.row_number().over(by.orderBy(F.desc("score"), "id")))


# Terms of a request: array<struct<field, values>>. Products: the columns of operators.normalize.
OBSERVED = {"audience": "audiences", "material": "materials", "color": "colors", "brand": "brands", "size": "sizes", "style": "styles"}
# How sure a feature named in a text is.
FEATURE_CONFIDENCE = 0.75


def threshold_of(value: float) -> float:
    """A checked threshold."""
    if not 0.0 <= value <= 1.0:
        raise ValueError("a threshold is a share")
    return value


def marked(phrase: Column) -> Column:
    """A text whose word borders are marked, so that a plain search finds whole words only."""
    return F.regexp_replace(phrase, "(?<=[a-z0-9])(?![a-z0-9])|(?<![a-z0-9])(?=[a-z0-9])", "\u0001")


def phrase_in(text: Column, phrase: Column) -> Column:
    """Whether a normalised text holds a normalised phrase as whole words."""
    return (phrase != "") & F.contains(marked(text), marked(phrase))


def match_values(observed: Column, wanted: Column, excluded: bool, threshold: float = THRESHOLD) -> Column:
    """(state, confidence) of observed (value, confidence) pairs against wanted values: the surest that matches decides,
    and if none does the surest of all."""
    sure = lambda a: F.array_max(F.transform(a, lambda o: o["confidence"]))

    def decided(x: Column) -> Column:
        hit, most = x["hit"], x["most"]
        yes = F.when(hit >= threshold, "mismatch").otherwise("unknown") if excluded else F.lit("match")
        no = F.when(most < threshold, "unknown").otherwise("match" if excluded else "mismatch")
        return _match(F.when(most.isNull(), "unknown").when(hit.isNotNull(), yes).otherwise(no), F.coalesce(hit, most, F.lit(0.0)))

    return let(F.struct(sure(F.filter(observed, lambda o: F.array_contains(wanted, o["value"]))).alias("hit"), sure(observed).alias("most")), decided)


def _match(state: Column, sure: Column) -> Column:
    return F.struct(state.alias("state"), sure.cast("double").alias("confidence"))


def match_features(features: Column, wanted: Column, excluded: bool) -> Column:
    """(state, confidence): a feature text is never sure enough to be a mismatch."""
    each = lambda words: F.transform(words, lambda w: marked(normalized_phrase(w)))
    hit = let(each(F.filter(wanted, lambda w: normalized_phrase(w) != "")), lambda ws: F.exists(each(features), lambda f: F.exists(ws, lambda w: F.contains(f, w))))
    state = F.lit("unknown") if excluded else F.when(hit, "match").otherwise("unknown")
    return _match(state, F.when(F.size(features) > 0, FEATURE_CONFIDENCE).otherwise(0.0))


def match_bound(field: Column, wanted: Column, price: Column) -> Column:
    bound = F.get(wanted, F.size(wanted) - 1).try_cast("double")
    inside = F.when(field == "price_min", price["value"] >= bound).otherwise(price["value"] <= bound)
    state = F.when(price.isNull(), "unknown").when(inside, "match").otherwise("mismatch")
    return _match(state, F.coalesce(price["confidence"], F.lit(0.0)))


def evaluate(terms: Column, excluded: bool = False, threshold: float = THRESHOLD, product: str = "") -> Column:
    """(field, expected, state, confidence, reason) of each term against the product in the row."""
    threshold_of(threshold)
    col = lambda c: F.col(f"{product}{c}")

    leaves = F.transform(col("leaf_categories"), lambda e: e["value"])
    leaf_sure = F.array_max(F.transform(col("leaf_categories"), lambda e: e["confidence"]))

    def one(t: Column) -> Column:
        field, wanted = t["field"], F.array_distinct(t["values"])
        found = F.raise_error(F.concat(F.lit("no such field: "), field)).cast("struct<state:string,confidence:double>")
        found = F.when(field.isin(list(OBSERVED)), match_values(_observed(field, col), wanted, excluded, threshold)).otherwise(found)
        found = F.when(field.isin("feature", "use_case"), match_features(col("features"), wanted, excluded)).otherwise(found)
        found = F.when(field == "category", _match(*match_category(wanted, leaves, col("category_path"), leaf_sure, excluded))).otherwise(found)
        found = F.when(field.isin("price_min", "price_max"), match_bound(field, wanted, col("price"))).otherwise(found)
        why = lambda s: F.concat(F.when(s == "unknown", "nothing sure is known of the ").when(s == "match", "the product fits the ").otherwise("the product conflicts with the "), F.lit("excluded " if excluded else "wanted "), field)
        return let(found, lambda m: F.struct(field.alias("field"), wanted.alias("expected"), m["state"].alias("state"), m["confidence"].alias("confidence"), why(m["state"]).alias("reason")))

    return F.transform(terms, one)


def _observed(field: Column, col: Callable[[str], Column]) -> Column:
    """What the product is known to be in a field."""
    out = F.lit(None).cast("array<struct<value:string,source:string,confidence:double>>")
    for name, column in OBSERVED.items():
        out = F.when(field == name, col(column)).otherwise(out)
    return out


def with_category(hard: Column, category: Column) -> Column:
    """Hard terms, the category first if there is one and no term names it."""
    own = F.array(F.struct(F.lit("category").alias("field"), F.array(category).alias("values")))
    return F.when(category.isNull() | F.exists(hard, lambda t: t["field"] == "category"), hard).otherwise(F.concat(own, hard))


def decisive(hard: Column, excluded: Column, threshold: float = THRESHOLD) -> Column:
    """Whether a product goes: a hard or excluded term conflicts surely enough."""
    return F.exists(F.concat(hard, excluded), lambda m: (m["state"] == "mismatch") & (m["confidence"] >= threshold))


def states(matches: Column) -> Column:
    return F.transform(matches, lambda m: m["state"])
