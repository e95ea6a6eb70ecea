"""Texts that products and queries are embedded by."""

from __future__ import annotations

import html

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

SCHEMA_VERSION = "product-query-text-v1"
# Details that are told, in order, with their labels.
DETAILS = {
    "material": "material", "fabric type": "fabric", "color": "color", "department": "department", "style": "style", "fit type": "fit",
    "sole material": "sole", "outer material": "outer material", "closure type": "closure", "neck style": "neck", "sleeve type": "sleeve", "occasion": "occasion",
}
UNTOLD = ["price_min", "price_max", "size"]


def unescaped(text: Column) -> Column:
    """HTML character references as their characters: decimal ones and the usual names. ``&amp;`` is last, so that nothing
    is undone twice; rarer names stay."""
    usual = ["quot", "apos", "nbsp", "copy", "reg", "trade", "deg", "lt", "gt", "ndash", "mdash", "lsquo", "rsquo", "ldquo", "rdquo", "bull", "hellip", "eacute", "egrave", "agrave", "ccedil", "uuml", "ouml", "auml", "szlig", "frac12", "frac14", "times", "euro", "pound"]
    out = text
    for name in usual:
        out = F.replace(out, F.lit(f"&{name};"), F.lit(html.unescape(f"&{name};")))
    number = lambda p: F.regexp_extract(p, r"^&#([0-9]+);$", 1)
    char = lambda p: F.when(F.rlike(p, F.lit("^&#[0-9]+;$")), F.decode(F.unhex(F.lpad(F.hex(number(p).cast("long")), 8, "0")), "UTF-32")).otherwise(p)
    numeric = lambda t: F.array_join(F.transform(F.regexp_extract_all(t, F.lit(r"&#[0-9]{1,7};|[^&]+|&"), F.lit(0)), lambda p: char(p)), "")
    return F.replace(let(out, lambda t: F.when(t.rlike(r"&#[0-9]{1,7};"), numeric(t)).otherwise(t)), F.lit("&amp;"), F.lit("&"))


def clean(text: Column, limit: int | None = None) -> Column:
    """Without tags, white space squeezed, edges without ``,.;|`` and spaces; null is empty."""
    plain = let(F.coalesce(text.cast("string"), F.lit("")), lambda t: F.when(F.contains(t, F.lit("&")), unescaped(t)).otherwise(t))
    bare = F.regexp_replace(plain, "<[^>]+>", " ")
    out = F.regexp_replace(F.regexp_replace(bare, r"[\s  -    　]+", " "), r"^[ ,.;|]+|[ ,.;|]+$", "")
    return F.rtrim(F.substring(out, 1, limit)) if limit else out


def _told(values: Column) -> Column:
    return F.array_distinct(F.filter(values, lambda v: v != ""))


def _part(label: str, text: Column) -> Column:
    return let(text, lambda t: F.when(t != "", F.concat(F.lit(f"{label}: "), t, F.lit("."))))


def product_text(p: str = "") -> Column:
    """Title, the last four categories, six features, eight details and the description of a product of ``read_catalog``."""
    col = lambda c: F.col(f"{p}{c}")
    none = F.array().cast("array<string>")
    title = clean(col("title"), 200)
    parts = _told(F.flatten(F.transform(F.coalesce(col("categories"), none), lambda c: F.transform(F.split(c, ","), lambda x: clean(x)))))
    path = let(parts, lambda p: F.slice(p, F.greatest(F.size(p) - 3, F.lit(1)), F.lit(4)))
    features = F.slice(_told(F.transform(F.coalesce(col("features"), none), lambda f: clean(f, 160))), 1, 6)
    entry = lambda e: F.struct(F.lower(clean(e["key"])).alias("key"), clean(e["value"], 120).alias("value"))
    known = F.filter(F.transform(F.map_entries(F.coalesce(col("details"), F.create_map().cast("map<string,string>"))), lambda e: entry(e)), lambda e: e["key"].isin(list(DETAILS)))
    table = F.array(*(F.struct(F.lit(k).alias("key"), F.lit(v).alias("label")) for k, v in DETAILS.items()))

    def told(entries: Column) -> Column:
        last = lambda d: F.get(F.filter(entries, lambda e: e["key"] == d["key"]), F.size(F.filter(entries, lambda e: e["key"] == d["key"])) - 1)["value"]
        return F.transform(table, lambda d: F.concat(d["label"], F.lit(" "), F.nullif(last(d), F.lit(""))))

    details = F.slice(F.array_compact(let(known, told)), 1, 8)
    text = clean(F.array_join(F.filter(F.transform(F.coalesce(col("description"), none), lambda x: clean(x)), lambda d: d != ""), " "), 350)
    return F.concat_ws(
        " ", _part("Product", title), _part("Category", F.array_join(path, " > ")), _part("Features", F.array_join(features, "; ")), _part("Details", F.array_join(details, "; ")), _part("Description", text),
    )


def _values(terms: Column, field: str | None = None) -> Column:
    some = F.filter(terms, lambda t: ~t["field"].isin(UNTOLD) & (t["field"] == field if field else F.lit(True)))
    return _told(F.transform(F.flatten(F.transform(some, lambda t: t["values"])), lambda v: F.replace(clean(v), F.lit("_"), F.lit(" "))))


def redacted(text: Column, words: Column) -> Column:
    """``text`` without the excluded ``words``, the longest first."""
    longest = F.array_sort(words, lambda a, b: F.length(b) - F.length(a))
    quoted = lambda w: F.concat(F.lit(r"(?i)(?<![a-z0-9])\Q"), w, F.lit(r"\E(?![a-z0-9])"))
    return clean(F.aggregate(longest, text, lambda t, w: F.regexp_replace(t, quoted(w), F.lit(" "))))


def query_text() -> Column:
    """What a request (category, soft, excluded, raw_context, current_message) is looking for, without hard numbers and
    excluded words."""
    use, soft = _values(F.col("soft"), "use_case"), _values(F.col("soft"))
    rest = F.array_except(soft, use)
    raw = clean(redacted(F.when(F.trim("raw_context") != "", F.trim("raw_context")).otherwise(F.col("current_message")), _values(F.col("excluded"))), 500)
    return F.concat_ws(
        " ", F.when(F.col("category").isNotNull(), F.concat(F.lit("Looking for "), F.replace("category", F.lit("_"), F.lit(" ")), F.lit("."))),
        _part("Use", F.array_join(use, "; ")), _part("Preferences", F.array_join(rest, "; ")), _part("Request", raw),
    )
