"""Profiles of a catalog, of its sessions and of how well search finds their targets. Each part is a small table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..evaluation import records
from ..functions.constraints import kind
from ..functions.lexicons import ATTRIBUTES
from ..functions.text import LEGACY_STOP_WORDS, is_empty, normalized_title
from . import analytics as A
from .index import WEIGHTS, Index

# The fields of a product, those that search reads and those whose coverage is compared.
FIELDS = ["parent_asin", "title", "features", "description", "price", "categories", "details", "average_rating", "rating_number", "store"]
SEARCHED = ["title", "categories", "features", "details", "store", "description"]
COMPARED = ["title", "features", "description", "price", "categories", "details", "store"]
ABLATED = ["title", "categories", "features", "details"]
ID = "^[A-Z0-9]{10}$"
MOST_TERMS, RANK_LIMIT = 40, 100


def types(raw: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """(field, type, n) of the JSON lines in ``raw``: null (or absent), boolean, integer, number, string, array, object."""
    v = F.try_parse_json("raw")
    name = lambda f: F.schema_of_variant(F.try_variant_get(v, f"$.{f}", "variant"))
    simple = lambda k: (
        F.when(k.isNull() | k.isin("VOID", "NULL"), "null").when(k == "BOOLEAN", "boolean").when(k == "BIGINT", "integer").when(k.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "number")
        .when(k == "STRING", "string").when(k.startswith("ARRAY"), "array").when(k.startswith("OBJECT"), "object").otherwise("other")
    )
    each = raw.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), simple(name(f)).alias("type")) for f in fields or FIELDS))).alias("x"))
    return each.groupBy("x.field", "x.type").agg(F.count(F.lit(1)).alias("n"))


def keys(df: DataFrame, id_col: str, pattern: str = ID) -> DataFrame:
    """Distinct keys, keys found twice or more, rows beyond a key's first, rows whose key has another form; null is empty."""
    n = df.groupBy(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    twice = (F.col("n") > 1) & (F.col("k") != "")
    return n.agg(
        F.count(F.lit(1)).alias("unique_count"), F.count_if(twice).alias("duplicate_key_count"), F.coalesce(F.sum(F.when(twice, F.col("n") - 1)), F.lit(0)).alias("duplicate_row_count"),
        F.coalesce(F.sum(F.when(~F.col("k").rlike(pattern), F.col("n"))), F.lit(0)).alias("invalid_format_count"),
    )


def titles(df: DataFrame, title: Column) -> DataFrame:
    """Distinct normalised titles, rows that share theirs, and their share of all rows; empty titles don't count."""
    n = df.groupBy(F.coalesce(normalized_title(title), F.lit("")).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    said = F.col("t") != ""
    shared = F.coalesce(F.sum(F.when(said & (F.col("n") > 1), F.col("n"))), F.lit(0))
    return n.agg(F.count_if(said).alias("distinct_titles"), shared.alias("repeated_rows"), (shared / F.nullif(F.sum("n"), F.lit(0))).alias("repeated_rate"))


def prices(df: DataFrame, price: Column, is_text: Column) -> DataFrame:
    """How prices are given: numbers, their share, texts, texts that hold one number (also after ``from``), others, numbers of
    zero or less, and above 1000. ``price`` is text, ``is_text`` whether it was given as text."""
    number = F.when(~is_text, price.try_cast("double"))
    text = is_text & price.isNotNull()
    good = text & F.rlike(F.trim(price), F.lit(r"(?i)^(?:from\s+)?\d+(?:\.\d+)?$"))
    n = F.count(F.lit(1))
    return df.agg(
        F.count(number).alias("numeric_count"), (F.count(number) / F.nullif(n, F.lit(0))).alias("numeric_coverage_rate"), F.count_if(text).alias("string_count"),
        F.count_if(good).alias("parseable_string_count"), F.count_if(text & ~good).alias("invalid_string_count"), F.count_if(number <= 0).alias("non_positive_count"), F.count_if(number > 1000).alias("above_1000_count"),
    )


def ratings(df: DataFrame, rating: Column, number: Column) -> DataFrame:
    """Ratings that are no number from 0 to 5, counts that are none from 0 on, counts of 0."""
    return df.agg(
        F.count_if(~F.coalesce(rating.between(0, 5), F.lit(False))).alias("invalid_average_rating_count"), F.count_if(~F.coalesce(number >= 0, F.lit(False))).alias("invalid_rating_number_count"),
        F.count_if(number == 0).alias("zero_rating_number_count"),
    )


def categories(df: DataFrame, path: Column, k: int = 15) -> tuple[DataFrame, DataFrame]:
    """(value, n, level) of the ``k`` most common categories and leaves, and one row: distinct categories, distinct leaves,
    least, mean and greatest depth of paths that hold something."""
    clean = F.filter(F.transform(F.coalesce(path, F.array().cast("array<string>")), F.trim), lambda v: v != "")
    rows = df.select(clean.alias("p")).filter(F.size("p") > 0)
    leaf = F.element_at("p", -1)
    every = rows.select(F.explode("p").alias("v"))
    common = A.most_common(every, F.col("v"), k).withColumn("level", F.lit("all")).unionByName(A.most_common(rows, leaf, k).withColumn("level", F.lit("leaf")))
    n = every.groupBy("v").agg(F.lit(0).alias("leaf")).select("v", "leaf").unionByName(rows.groupBy(leaf.alias("v")).agg(F.lit(1).alias("leaf")).select("v", "leaf"))
    distinct = n.agg(F.count_if(F.col("leaf") == 0).alias("distinct_categories"), F.count_if(F.col("leaf") == 1).alias("distinct_leaves"))
    depth = rows.agg(F.min(F.size("p")).alias("least_depth"), F.avg(F.size("p")).alias("mean_depth"), F.max(F.size("p")).alias("most_depth"))
    return common, distinct.join(F.broadcast(depth), F.lit(True), "left")


def detail_keys(df: DataFrame, details: Column, k: int = 20) -> DataFrame:
    """The ``k`` most common keys of a map."""
    return A.most_common(df.select(F.explode(F.map_keys(details)).alias("key")), F.col("key"), k)


def coverage(df: DataFrame, fields: list[str], label: str = "field") -> DataFrame:
    """(field, populated, rate) of each field and of ``any`` of them, in one pass."""
    kinds = dict(df.dtypes)
    full = {f: ~is_empty(F.col(f), kinds[f]) for f in fields}
    some = F.lit(False)
    for c in full.values():
        some = some | c
    counts = df.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(c).alias(f) for f, c in full.items()), F.count_if(some).alias("any"))
    each = F.explode(F.array(*(F.struct(F.lit(f).alias(label), F.col(f).alias("populated")) for f in [*fields, "any"]))).alias("x")
    return counts.select("n", each).select(f"x.{label}", "x.populated", (F.col("x.populated") / F.nullif(F.col("n"), F.lit(0))).alias("rate"))


def target_coverage(samples: DataFrame, products: DataFrame, segments: list[str] = ["scenario_type", "difficulty_bucket"], fields: list[str] = COMPARED) -> DataFrame:  # noqa: B006
    """How often each field is populated in the samples' targets, of all and of each segment, against the whole catalog:
    segment, value, field, n, populated, rate, catalog_rate, points (percentage points above), multiple (null where the
    catalog has none)."""
    kinds = dict(products.dtypes)
    flags = products.select(F.col("parent_asin").alias("target"), *((~is_empty(F.col(f), kinds[f])).alias(f) for f in fields))
    base = flags.agg(*(F.avg(F.col(f).cast("int")).alias(f) for f in fields))
    both = samples.select("target", *segments).join(flags, "target")
    sums = [F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(f)).alias(f) for f in fields)]
    parts = [both.agg(*sums).select(F.lit("overall").alias("segment"), F.lit("all").alias("value"), "n", *fields)]
    parts += [both.groupBy(F.coalesce(s, F.lit("missing")).alias("value")).agg(*sums).select(F.lit(s).alias("segment"), "value", "n", *fields) for s in segments]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    long = lambda df, name, *keep: df.select(*keep, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias(name)) for f in fields))).alias("x")).select(*keep, "x.field", f"x.{name}")
    rated = long(out, "populated", "segment", "value", "n").join(F.broadcast(long(base, "catalog_rate")), "field")
    rate = F.col("populated") / F.nullif(F.col("n"), F.lit(0))
    return rated.select("segment", "value", "field", "n", "populated", rate.alias("rate"), "catalog_rate", ((rate - F.col("catalog_rate")) * 100).alias("points"), (rate / F.nullif(F.col("catalog_rate"), F.lit(0.0))).alias("multiple"))


def sessions(samples: DataFrame, products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segment, value, n) by scenario, difficulty and both, and one row: samples, distinct targets, targets that are no product."""
    named = samples.select(*(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("missing")).alias(c) for c in ("scenario_type", "difficulty_bucket")), F.coalesce("target", F.lit("")).alias("target"))
    s, d = F.col("scenario_type"), F.col("difficulty_bucket")
    each = F.array(F.struct(F.lit("scenario").alias("segment"), s.alias("value")), F.struct(F.lit("difficulty").alias("segment"), d.alias("value")), F.struct(F.lit("both").alias("segment"), F.concat_ws("/", s, d).alias("value")))
    counted = named.select(F.explode(each).alias("x")).groupBy("x.segment", "x.value").agg(F.count(F.lit(1)).alias("n"))
    known = products.select(F.col("parent_asin").alias("target"), F.lit(True).alias("_known")).dropDuplicates(["target"])
    per = named.groupBy("target").agg(F.count(F.lit(1)).alias("n")).join(known, "target", "left")
    return counted, per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("distinct_targets"), F.coalesce(F.sum(F.when(F.col("_known").isNull(), F.col("n"))), F.lit(0)).alias("missing_targets"))


def hidden_constraints(cards: DataFrame) -> DataFrame:
    """(by, value, n) of the wishes in ``cards`` (scenario_type, difficulty_bucket, role, text, source): by kind, source, role,
    source and kind, and kind in each scenario and difficulty."""
    k = kind(F.col("text"))
    row = lambda by, v: F.struct(F.lit(by).alias("by"), v.alias("value"))
    each = F.array(
        row("kind", k), row("source", F.col("source")), row("role", F.col("role")), row("source_kind", F.concat_ws("/", "source", k)),
        row("scenario_kind", F.concat_ws("/", "scenario_type", k)), row("difficulty_kind", F.concat_ws("/", "difficulty_bucket", k)),
    )
    return cards.select(F.explode(each).alias("x")).groupBy("x.by", "x.value").agg(F.count(F.lit(1)).alias("n"))


def wishes(samples: DataFrame, products: DataFrame) -> DataFrame:
    """(sample_id, scenario_type, difficulty_bucket, role, text, source) of every wish of the intent cards that the samples'
    targets give."""
    import json

    import pandas as pd

    from ..dialogue.customer import sourced_card
    from ..evaluation import with_targets

    def run(batches):
        for pdf in batches:
            out = []
            for sid, scenario, difficulty, product in zip(pdf["sample_id"], pdf["scenario_type"], pdf["difficulty_bucket"], pdf["product"]):
                card = sourced_card(json.loads(product))
                out += [(sid, scenario, difficulty, role, w["value"], w["source"]) for role, key in (("hard", "hard_constraints"), ("soft", "soft_preferences")) for w in card[key]]
            yield pd.DataFrame(out, columns=["sample_id", "scenario_type", "difficulty_bucket", "role", "text", "source"])

    kinds = "sample_id string, scenario_type string, difficulty_bucket string, role string, text string, source string"
    return with_targets(samples, products).select("sample_id", "scenario_type", "difficulty_bucket", "product").mapInPandas(run, kinds)


def rank_summary(ranks: DataFrame, segments: list[str] | None = None, rank: str = "rank") -> DataFrame:
    """Of ranks (null: not found): n, shares in the first 10, 50, 100 and 1000, mean reciprocal rank, median of those found,
    how many were not found."""
    r = F.col(rank)
    share = lambda k: F.avg(F.coalesce(r <= k, F.lit(False)).cast("int")).alias(f"top_{k}_rate")
    out = [F.count(F.lit(1)).alias("n"), *(share(k) for k in (10, 50, 100, 1000)), F.avg(F.coalesce(1 / r, F.lit(0.0))).alias("mrr"), F.percentile(r, 0.5).alias("median_found_rank"), F.count_if(r.isNull()).alias("not_found")]
    return ranks.groupBy(*(segments or [])).agg(*out)


def by_segment(ranks: DataFrame, segments: list[str] = ["scenario_type", "difficulty_bucket"], rank: str = "rank") -> DataFrame:  # noqa: B006
    """:func:`rank_summary` of all rows and of each segment's values."""
    out = rank_summary(ranks, None, rank).select(F.lit("overall").alias("segment"), F.lit("all").alias("value"), "*")
    for s in segments:
        out = out.unionByName(rank_summary(ranks, [s], rank).withColumnRenamed(s, "value").select(F.lit(s).alias("segment"), "*"))
    return out


def field_sets() -> dict[str, list[str]]:
    """All searched fields, each of the ablated ones alone, and all without it."""
    return {"all_fields": SEARCHED} | {f"only_{f}": [f] for f in ABLATED} | {f"without_{f}": [x for x in SEARCHED if x != f] for f in ABLATED}


def bm25_profile(index: Index, samples: DataFrame, products: DataFrame, limit: int = RANK_LIMIT) -> dict[str, DataFrame]:
    """How search ranks the samples' targets: ``initial`` (what customers say first) and ``oracle`` (all they want) by
    segment, ``ablation`` of the oracle by fields, ``sessions`` with both ranks."""
    from ..storage import stored

    rows = stored(records(samples, products), "records")
    keep = ["sample_id", "scenario_type", "difficulty_bucket"]

    def ranked(query: str, fields: list[str] | None = None) -> DataFrame:
        asked = rows.select(F.col("sample_id").alias("qid"), F.col(query).alias("query"))
        goals = rows.select(F.col("sample_id").alias("qid"), "target")
        found = index.exact_rank(asked, goals, limit, weights=WEIGHTS, fields=fields, stop_words=LEGACY_STOP_WORDS, most=MOST_TERMS)
        return stored(rows.select(*keep, "target").join(found.select(F.col("qid").alias("sample_id"), "rank"), "sample_id", "left"), "ranks")

    first, whole, ablation = ranked("initial_query"), ranked("oracle_query"), None
    for name, fields in field_sets().items():
        one = rank_summary(whole if name == "all_fields" else ranked("oracle_query", fields)).withColumn("fields", F.lit(name))
        ablation = one if ablation is None else ablation.unionByName(one)
    both = first.select(*keep, F.col("rank").alias("initial_rank")).join(whole.select("sample_id", F.col("rank").alias("oracle_rank")), "sample_id")
    return {"initial": by_segment(first), "oracle": by_segment(whole), "ablation": ablation, "sessions": both}


def floor_percentile(df: DataFrame, column: str, p: float) -> DataFrame:
    """The value at place ``floor(p * (n - 1))`` of the ordered values; one row, null of none."""
    return A.values_at(df, column, lambda n: {"at": math.floor(p * (n - 1))})[1].select(F.col("at").alias(column))


def round_percentile(df: DataFrame, column: str, p: float) -> DataFrame:
    """The value at place ``round(p * (n - 1))``, halves to even."""
    return A.values_at(df, column, lambda n: {"at": min(n - 1, round(p * (n - 1)))})[1].select(F.col("at").alias(column))


def dense_summary(diagnostics: DataFrame) -> DataFrame:
    """Of dense diagnostics: turns, attempted ones, those with an error, mean returned, exclusive and contributed counts."""
    tried = F.col("attempted")
    mean = lambda c: F.coalesce(F.bround(F.avg(F.when(tried, F.col(c))), 3), F.lit(0.0)).alias(f"mean_{c}")
    return diagnostics.agg(F.count(F.lit(1)).alias("turns_observed"), F.count_if(tried).alias("attempted_turns"), F.count_if(tried & F.col("error").isNotNull()).alias("error_turns"), *map(mean, ("returned", "exclusive", "contributed")))


def fallback_counts(answers: DataFrame) -> DataFrame:
    return answers.select(F.explode("fallbacks").alias("event")).groupBy("event").agg(F.count(F.lit(1)).alias("n"))


def compared(result: dict, baseline: dict | None) -> dict | None:
    """Which metrics of two reports differ."""
    if baseline is None:
        return None
    named = ["sample_count", "hit_rate_at_10", "mrr", "mttc", "recommended_technical_score", "scenario_metrics", "sessions"]
    other = [k for k in named if result.get(k) != baseline.get(k)]
    return {"exact_match": not other, "different_fields": other}


def unknown_attributes(names: DataFrame, column: str) -> DataFrame:
    """Rows whose attribute is none that can be asked about."""
    return names.filter(~F.coalesce(F.col(column).isin(ATTRIBUTES), F.lit(False)))
