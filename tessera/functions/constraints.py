"""Constraint phrases: cleaning, kinds, category families, the fixed question order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of constraints with the substrings that name them, in order; the first kind wins.
KINDS = [
    ("material", "cotton polyester nylon leather wool spandex silk rayon fabric"),
    ("color", "color black white blue red pink green"),
    ("size", "size sizing width wide narrow"),
    ("style", "department style fit sleeve neck"),
    ("use_case", "hiking running gym winter outdoor work"),
]
BUDGET = r"budget|(?:\$|<=|under)\s*\d"
# Category families, likewise.
FAMILIES = [
    ("footwear", "shoe sneaker boot sandal slipper footwear"),
    ("jewelry", "jewelry earring necklace bracelet ring pendant"),
    ("clothing", "shirt t_shirt top tee tank camisole dress jacket coat sweater hoodie pant jean short skirt sock underwear bra swim legging clothing"),
    ("accessories", "bag belt hat cap accessor wallet scarf"),
    ("watches", "watch"),
]
ROOTS = ["clothing", "clothing shoes & jewelry", "clothing, shoes & jewelry"]
QUESTION_ORDER = "material feature color style size use_case budget brand other".split()


def _first(low: Column, table: list[tuple[str, str]], otherwise: Column) -> Column:
    """The first name of ``table`` one of whose substrings the text holds."""
    return reduce(lambda out, row: F.when(low.rlike("|".join(row[1].split())), row[0]).otherwise(out), reversed(table), otherwise)


def kind(text: Column) -> Column:
    """budget, material, color, size, style, use_case or feature; null is a feature."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(low.rlike(BUDGET), "budget").otherwise(_first(low, KINDS, F.lit("feature")))


def family(category: Column) -> Column:
    """The category's family, or null."""
    return _first(F.replace(F.lower(category), F.lit(" "), F.lit("_")), FAMILIES, F.lit(None).cast("string"))


def cleaned(text: Column, limit: int = 180) -> Column:
    """White space squeezed, edges without `` -;,.``, at most ``limit`` characters."""
    squeezed = F.regexp_replace(text, r"\s+", " ")
    return F.rtrim(F.substring(F.regexp_replace(squeezed, r"^[ \-;,.]+|[ \-;,.]+$", ""), 1, limit))


def coarse_category(path: Column) -> Column:
    """The last two parts of a category path without its generic roots; ``clothing item`` if none is left."""
    parts = F.transform(F.flatten(F.transform(F.coalesce(path, F.array().cast("array<string>")), lambda p: F.split(p, ","))), F.trim)
    good = F.filter(parts, lambda p: (p != "") & ~F.lower(p).isin(ROOTS))
    last = F.slice(good, F.greatest(F.size(good) - 1, F.lit(1)), F.lit(2))
    return F.when(F.size(good) > 0, F.array_join(last, " ")).otherwise("clothing item")


def match_category(wanted: Column, leaves: Column, path: Column, confidence: Column, excluded: bool = False) -> tuple[Column, Column]:
    """(state, confidence): a leaf or path element that is wanted matches; another family is a mismatch, the same
    or an unmapped one unknown at .5."""
    families = lambda a: F.filter(F.transform(a, family), lambda f: f.isNotNull())
    bare = (F.size(leaves) == 0) & (F.size(path) == 0)
    same = F.arrays_overlap(wanted, F.concat(leaves, path))
    want, have = families(wanted), families(leaves)
    open_ = (F.size(want) == 0) | (F.size(have) == 0) | F.arrays_overlap(want, have)
    yes, no = ("mismatch", "match") if excluded else ("match", "mismatch")
    state = F.when(bare, "unknown").when(same, yes).when(open_, "unknown").otherwise(no)
    sure = F.when(bare, 0.0).when(~same & open_, 0.5).otherwise(F.coalesce(confidence, F.lit(0.85)))
    return state, sure


def safe_question(asked: Column, no_preference: Column, mentioned: Column) -> Column:
    """The first attribute not asked, declined or mentioned (a mentioned feature may be asked); null if none is left."""
    closed = F.concat(asked, no_preference, F.array_remove(mentioned, "feature"))
    return F.get(F.array_except(F.array(*map(F.lit, QUESTION_ORDER)), closed), 0)
