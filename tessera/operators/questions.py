"""The question policy: which attribute to ask next, by route and by the pool's facets."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Relevance of each attribute by route, in the order that breaks ties.
RELEVANCE = {
    "buying": {"material": 1.15, "feature": 1.05, "color": 0.95, "style": 0.85, "size": 0.55, "use_case": 0.75, "budget": 1.30, "brand": 0.35},
    "browsing": {"use_case": 1.35, "feature": 1.30, "style": 1.15, "material": 1.00, "color": 0.90, "size": 0.35, "budget": 0.80, "brand": 0.30},
}
# The attribute that each tag of a profile hints at.
TAGS = {
    "brand": "brand", "budget": "budget", "color": "color", "comfort": "feature", "durability": "feature", "feature": "feature",
    "fit": "style", "material": "material", "occasion": "use_case", "price": "budget", "size": "size", "style": "style",
    "use case": "use_case", "value": "budget", "warmth": "feature", "weather": "feature",
}
HINT, LAST_TURN, DRY = 1.08, 10, 2


def facet_values(facets: DataFrame) -> DataFrame:
    """(qid, attribute, value) rows of pools to (qid, attribute, gain): entropy by coverage by expected
    reduction, 0 below two values. Null, empty and ``unknown`` values are not observed."""
    seen = F.when(~F.coalesce(F.col("value").isin("", "unknown"), F.lit(False)), F.col("value"))
    n = facets.select("qid", "attribute", seen.alias("value")).groupBy("qid", "attribute", "value").agg(F.count(F.lit(1)).alias("n"))
    known = F.when(F.col("value").isNotNull(), F.col("n"))
    per = n.groupBy("qid", "attribute").agg(
        F.sum("n").alias("total"), F.sum(known).alias("seen"), F.count("value").alias("k"), F.max(known).alias("most"), F.sum(known * F.log("n")).alias("nlogn")
    )
    gain = (F.log("seen") - F.col("nlogn") / F.col("seen")) / F.log("k") * (F.col("seen") / F.col("total")) * (1 - F.col("most") / F.col("seen"))
    return per.select("qid", "attribute", F.when(F.col("k") >= 2, gain).otherwise(0.0).alias("gain"))


def _hinted(tags: Column) -> Column:
    names = F.create_map(*chain.from_iterable((F.lit(t), F.lit(a)) for t, a in TAGS.items()))
    known = F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda t: t.isin(list(TAGS)))
    return F.transform(known, lambda t: F.element_at(names, t))


def choose(sessions: DataFrame, facets: DataFrame) -> DataFrame:
    """(qid, attribute, value) of the next question; a null attribute ends the questions.

    sessions: qid, turn, route, category, known, blocked, tags (arrays), dry, other_used, and maybe evidence, whether
    the request names a product although its category is not known. In order: nothing from the
    last turn on; the category if it is not known; ``other`` once after two dry rounds; the open attribute of the
    greatest relevance x gain (x 1.08 where the profile hints at it), ties in the route's order."""
    ask = lambda a: ~F.array_contains("blocked", a)
    evidence = F.coalesce("evidence", F.lit(False)) if "evidence" in sessions.columns else F.lit(False)
    early = (
        F.when(F.col("turn") >= LAST_TURN, "none").when(F.col("category").isNull() & ~evidence & ask("category"), "category")
        .when((F.col("dry") >= DRY) & ~F.col("other_used") & ask("other"), "other")
    )
    known = sessions.withColumn("early", early)
    rows = [(r, a, i, w) for r, t in RELEVANCE.items() for i, (a, w) in enumerate(t.items())]
    table = F.array(*(F.struct(F.lit(r).alias("route"), F.lit(a).alias("attribute"), F.lit(i).alias("place"), F.lit(w).alias("weight")) for r, a, i, w in rows))
    free = F.filter(table, lambda x: (x["route"] == F.col("route")) & ~F.array_contains("known", x["attribute"]) & ~F.array_contains("blocked", x["attribute"]))
    each = known.filter("early is null").select("qid", _hinted(F.col("tags")).alias("hints"), F.explode(free).alias("x")).select("qid", "hints", "x.attribute", "x.place", "x.weight")
    score = F.col("weight") * F.coalesce("gain", F.lit(0.0)) * F.when(F.array_contains("hints", F.col("attribute")), HINT).otherwise(1.0)
    scored = each.join(facet_values(facets), ["qid", "attribute"], "left").withColumn("value", F.round(score, 6))
    best = scored.groupBy("qid").agg(F.min_by(F.struct("attribute", "value"), F.struct(-F.col("value"), F.col("place"))).alias("best"))
    attribute = F.when(F.col("early").isNull(), F.col("best.attribute")).when(F.col("early") != "none", F.col("early"))
    return known.join(best, "qid", "left").select("qid", attribute.alias("attribute"), F.col("best.value").alias("value"))
