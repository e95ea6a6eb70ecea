"""Catalog normalisation: what each product is known to be, from which field, and how surely."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicons import AUDIENCES, canonical_column, known_values, plain
from ..functions.text import let, normalized_phrase
from ..sources.catalog import priced

# How sure a field is, and the details that state an attribute outright.
CONFIDENCE = {"details": 0.95, "categories": 0.85, "store": 0.85, "features": 0.75, "title": 0.65, "description": 0.50}
DETAILS = {"material": ["Material", "Fabric Type"], "color": ["Color"], "audience": ["Department"], "brand": ["Brand"], "size": ["Size"], "style": ["Style"]}
TEXTS = ["features", "title", "description"]
COLUMNS = {"category": "leaf_categories", "audience": "audiences", "material": "materials", "color": "colors", "brand": "brands", "size": "sizes", "style": "styles"}
_NONE = "array<struct<value:string,source:string,confidence:double>>"


def _nfkc(products: DataFrame) -> DataFrame:
    """Texts that phrases are made of in NFKC; only rows that are not ASCII are worked on in Python."""
    import unicodedata

    @F.pandas_udf("string")
    def normal(lines: pd.Series) -> pd.Series:
        return lines.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")

    parts = F.struct("features", "categories", "details", "store")
    kind = products.select(parts.alias("p")).schema["p"].dataType.simpleString()
    line = F.to_json(parts, {"ignoreNullFields": "false"})
    again = F.from_json(normal(F.when(line.rlike(r"[^\x00-\x7F]"), line)), kind)
    rows = products.withColumn("nfkc", again)
    return rows.withColumn("nfkc", F.coalesce("nfkc", parts))


def _value(value: Column, source: str | Column, confidence: float) -> Column:
    return F.struct(value.alias("value"), (F.lit(source) if isinstance(source, str) else source).alias("source"), F.lit(confidence).alias("confidence"))


def _values(values: Column, source: str, confidence: float) -> Column:
    return F.transform(values, lambda v: _value(v, source, confidence))


def _given(value: Column, made: Column) -> Column:
    """``made`` where ``value`` says something, else nothing."""
    return F.when(F.coalesce(value != "", F.lit(False)), made).otherwise(F.array().cast(_NONE))


def _detail(names: list[str]) -> Column:
    """The first detail of one of these names that holds something."""
    wanted = [plain(n) for n in names]
    entries = F.filter(F.map_entries("nfkc.details"), lambda e: normalized_phrase(e["key"]).isin(wanted) & F.coalesce(e["value"] != "", F.lit(False)))
    return F.get(entries, 0)["value"]


def ordered(evidence: Column) -> Column:
    """Each value once, by its first and so surest evidence; the surest first, then by value."""

    def once(all_: Column) -> Column:
        found = F.transform(all_, lambda e: e["value"])
        return F.filter(all_, lambda e, i: (e["value"] != "") & (F.array_position(found, e["value"]) == i + 1))

    first = let(evidence, once)
    keyed = F.array_sort(F.transform(first, lambda e: F.struct((-e["confidence"]).alias("k"), e["value"].alias("value"), e["source"].alias("source"))))
    return F.transform(keyed, lambda e: F.struct(e["value"].alias("value"), e["source"].alias("source"), (-e["k"]).alias("confidence")))


def normalize(products: DataFrame) -> DataFrame:
    """One row per product of :func:`read_catalog`: parent_asin, category_path, arrays of (value, source, confidence) for
    leaf_categories, audiences, materials, colors, brands, sizes and styles, price likewise or null, features (phrases
    and canonical tags), average_rating (0 to 5) and rating_number (0 or more). Null fields say nothing."""
    empty = F.array().cast("array<string>")
    rows = _nfkc(priced(products).withColumn("_id", F.col("parent_asin")))
    text = {f: F.array_join(F.coalesce(f, empty), " \n ") if f != "title" else F.coalesce(f, F.lit("")) for f in TEXTS}
    rows = rows.withColumns({f"text_{f}": t for f, t in text.items()} | {f"detail_{a}": _detail(n) for a, n in DETAILS.items()} | {"maker": _detail(["Manufacturer"])})
    path = F.coalesce("nfkc.categories", empty)
    leaf = F.get(path, F.size(path) - 1)
    in_texts = lambda field: [_values(known_values(F.col(f"text_{f}"), field), f, CONFIDENCE[f]) for f in TEXTS]
    stated = lambda a: [_given(F.col(f"detail_{a}"), F.array(_value(canonical_column(a, normalized_phrase(F.col(f"detail_{a}"))), f"details:{DETAILS[a][0]}", CONFIDENCE["details"])))]
    parts = lambda a: [_values(known_values(F.col(f"detail_{a}"), a), f"details:{DETAILS[a][0]}", CONFIDENCE["details"])]
    by_path = F.filter(F.transform(path, normalized_phrase), lambda p: p.isin(sorted({plain(a) for a in AUDIENCES})))
    store = F.coalesce(F.when(F.col("nfkc.store") != "", F.col("nfkc.store")), F.col("maker"))
    evidence = {
        "category": [
            _given(leaf, F.array(_value(canonical_column("category", normalized_phrase(leaf)), "categories:leaf", CONFIDENCE["categories"]))),
            F.when(F.size(path) == 0, _values(known_values(F.col("title"), "category"), "title", CONFIDENCE["title"])).otherwise(F.array().cast(_NONE)),
        ],
        "audience": [*stated("audience"), *parts("audience"), _values(F.transform(by_path, lambda p: canonical_column("audience", p)), "categories:path", CONFIDENCE["categories"]), *in_texts("audience")],
        "material": [*stated("material"), *parts("material"), *in_texts("material")],
        "color": [*stated("color"), *parts("color"), *in_texts("color")],
        "brand": [*stated("brand"), _given(store, F.array(_value(normalized_phrase(store), "store", CONFIDENCE["store"])))],
        "size": stated("size"),
        "style": stated("style"),
    }
    tags = [known_values(F.col(f"text_{f}"), a) for f in TEXTS for a in ("feature", "use_case")]
    phrases = F.filter(F.transform(F.coalesce("nfkc.features", empty), normalized_phrase), lambda p: F.coalesce(p != "", F.lit(False)))
    rating = F.coalesce(F.when(~F.isnan("average_rating"), F.col("average_rating")), F.lit(0.0))
    return rows.select(
        F.trim("_id").alias("parent_asin"),
        F.transform(F.filter(F.transform(path, normalized_phrase), lambda p: p != ""), lambda p: canonical_column("category", p)).alias("category_path"),
        *(ordered(F.concat(*e)).alias(COLUMNS[a]) for a, e in evidence.items()),
        F.when(F.col("price_value").isNotNull(), F.struct(F.col("price_value").alias("value"), F.concat(F.lit("price:"), "price_kind").alias("source"), F.col("price_confidence").alias("confidence"))).alias("price"),
        F.array_sort(F.array_distinct(reduce(F.concat, [phrases, *tags]))).alias("features"),
        F.least(F.greatest(rating, F.lit(0.0)), F.lit(5.0)).alias("average_rating"),
        F.greatest(F.coalesce("rating_number", F.lit(0)), F.lit(0)).cast("long").alias("rating_number"),
    )


def document(p: str = "") -> Column:
    """The normalised text that a product is ranked by: its path, attributes and features."""
    col = lambda c: F.col(f"{p}{c}")
    spaced = lambda a: F.transform(a, lambda v: F.replace(v, F.lit("_"), F.lit(" ")))
    attributes = [spaced(F.transform(col(c), lambda e: e["value"])) for c in COLUMNS.values()]
    return normalized_phrase(F.array_join(F.concat(spaced(col("category_path")), *attributes, col("features")), " "))


def facets(products: DataFrame) -> DataFrame:
    """parent_asin and one text or null for each attribute that a question may be about."""
    named = lambda c: F.array_sort(F.array_distinct(F.transform(F.filter(c, lambda e: e["confidence"] >= 0.50), lambda e: e["value"])))
    searched = normalized_phrase(F.array_join(F.concat("features", "category_path"), " "))
    one = lambda a: F.when(F.size(a) > 0, F.array_join(a, "|"))
    price = F.col("price.value")
    bucket = F.when(price < 25, "under_25").when(price < 50, "25_50").when(price < 100, "50_100").when(price < 200, "100_200").when(price >= 200, "200_plus")
    return products.select(
        "parent_asin", *(one(named(F.col(COLUMNS[a]))).alias(a) for a in ("material", "color", "style", "size", "brand")),
        *(one(named_in(searched, a)).alias(a) for a in ("feature", "use_case")), bucket.alias("budget"),
    )


def named_in(phrase: Column, field: str) -> Column:
    """Canonical values any of whose aliases stands in a normalised phrase, also inside a longer alias; by length of the
    alias, the longest first."""
    from ..functions.lexicons import ALIASES

    order = sorted(ALIASES[field], key=lambda a: (-len(plain(a)), a))
    table = F.array(*(F.struct(F.lit(rf"(?<![a-z0-9]){plain(a)}(?![a-z0-9])").alias("pattern"), F.lit(ALIASES[field][a]).alias("value")) for a in order))
    return let(phrase, lambda p: F.array_distinct(F.transform(F.filter(table, lambda t: F.rlike(p, t["pattern"])), lambda t: t["value"])))


def build_stats(normalized: DataFrame, seconds: float) -> dict:
    """Products and seconds of a build; peak memory is Spark's to report."""
    n = normalized.count()
    return {"product_count": n, "elapsed_ms": round(seconds * 1000, 3), "products_per_second": round(n / seconds, 1) if seconds > 0 else None}
