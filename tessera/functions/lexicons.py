"""The shopping vocabulary: fields of a request, alias tables, canonical values, and their lookup."""

from __future__ import annotations

import math
import re
import unicodedata
from functools import cache
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fields of a request with the strength they take unless a message says otherwise, and the
# attribute that a question about them names.
STRENGTH = {
    "category": "hard", "audience": "hard", "price_min": "hard", "price_max": "hard", "color": "soft", "material": "soft",
    "brand": "soft", "size": "hard", "style": "soft", "use_case": "soft", "feature": "soft",
}
ASKED_AS = {f: {"audience": "category", "price_min": "budget", "price_max": "budget"}.get(f, f) for f in STRENGTH}
ATTRIBUTES = ["category", "material", "color", "size", "style", "brand", "budget", "feature", "use_case", "other"]
ONE_VALUE = ["category", "price_min", "price_max"]

# Alias and canonical value of each field.
AUDIENCES = {
    "woman": "women", "women": "women", "womens": "women", "women's": "women", "female": "women", "ladies": "women",
    "man": "men", "men": "men", "mens": "men", "men's": "men", "male": "men", "girl": "girls", "girls": "girls", "boy": "boys", "boys": "boys",
    "baby girl": "baby_girls", "baby girls": "baby_girls", "baby boy": "baby_boys", "baby boys": "baby_boys",
    "unisex": "unisex_adult", "unisex adult": "unisex_adult", "unisex child": "unisex_child", "unisex kids": "unisex_child",
}
COLORS = {
    "black": "black", "white": "white", "blue": "blue", "navy": "navy", "navy blue": "navy", "red": "red", "pink": "pink", "green": "green",
    "brown": "brown", "gray": "gray", "grey": "gray", "purple": "purple", "yellow": "yellow", "orange": "orange", "beige": "beige",
    "gold": "gold", "silver": "silver", "multi": "multicolor", "multicolour": "multicolor", "multicolor": "multicolor",
    "multicolored": "multicolor", "multicoloured": "multicolor",
}
MATERIALS = {
    "cotton": "cotton", "100% cotton": "cotton", "poly": "polyester", "polyester": "polyester", "nylon": "nylon", "leather": "leather",
    "genuine leather": "leather", "faux leather": "faux_leather", "synthetic leather": "faux_leather", "wool": "wool", "spandex": "spandex",
    "silk": "silk", "rayon": "rayon", "linen": "linen", "denim": "denim", "acrylic": "acrylic", "rubber": "rubber", "mesh": "mesh",
    "fleece": "fleece", "suede": "suede", "stainless steel": "stainless_steel", "sterling silver": "sterling_silver",
}
CATEGORIES = {
    "running shoe": "running_shoes", "running shoes": "running_shoes", "road running": "running_shoes", "trainer": "sneakers", "trainers": "sneakers",
    "sneaker": "sneakers", "sneakers": "sneakers", "fashion sneakers": "sneakers", "boot": "boots", "boots": "boots", "winter boot": "winter_boots",
    "winter boots": "winter_boots", "sandal": "sandals", "sandals": "sandals", "slipper": "slippers", "slippers": "slippers",
    "t shirt": "t_shirts", "t shirts": "t_shirts", "tee": "t_shirts", "tees": "t_shirts", "dress": "dresses", "dresses": "dresses",
    "jacket": "jackets", "jackets": "jackets", "winter jacket": "winter_jackets", "winter jackets": "winter_jackets", "jean": "jeans", "jeans": "jeans",
    "legging": "leggings", "leggings": "leggings", "hoodie": "hoodies", "hoodies": "hoodies", "watch": "watches", "watches": "watches",
    "wrist watches": "watches", "earring": "earrings", "earrings": "earrings", "necklace": "necklaces", "necklaces": "necklaces",
}
USE_CASES = {
    "run": "running", "running": "running", "walk": "walking", "walking": "walking", "hike": "hiking", "hiking": "hiking", "gym": "gym", "workout": "gym",
    "work": "work", "office": "work", "travel": "travel", "travelling": "travel", "traveling": "travel", "wedding": "wedding",
    "outdoor": "outdoor", "outdoors": "outdoor", "winter": "winter", "summer": "summer",
}
FEATURES = {
    "water proof": "waterproof", "waterproof": "waterproof", "water resistant": "water_resistant", "light weight": "lightweight",
    "lightweight": "lightweight", "breathable": "breathable", "warm": "warm", "insulated": "insulated", "durable": "durable",
    "comfortable": "comfortable", "comfort": "comfortable", "hypoallergenic": "hypoallergenic",
}
ALIASES = {"audience": AUDIENCES, "color": COLORS, "material": MATERIALS, "category": CATEGORIES, "use_case": USE_CASES, "feature": FEATURES}


def plain(value: object) -> str:
    """NFKC, lower case, ``_`` and ``-`` as spaces, only a-z, 0-9, ``&``, ``+``, ``'``; one space between."""
    low = unicodedata.normalize("NFKC", str(value)).lower().translate({ord("_"): " ", ord("-"): " "})
    return " ".join(re.sub(r"[^a-z0-9&+' ]", " ", low).split())


@cache
def _by_phrase(field: str) -> dict[str, str]:
    return {plain(alias): canonical for alias, canonical in ALIASES[field].items()}


def canonical(field: str, value: object) -> str | int | float:
    """The one spelling of a value; prices are numbers (whole ones ints), unknown words stay."""
    if field not in STRENGTH:
        raise ValueError(f"no such field: {field}")
    if field.startswith("price_"):
        try:
            number = math.nan if isinstance(value, bool) else float(value)
        except (TypeError, ValueError):
            number = math.nan
        if not number >= 0:
            raise ValueError(f"{field} is no price: {value!r}")
        return int(number) if number == int(number) else number
    words = plain(value)
    if field in ALIASES:
        return _by_phrase(field).get(words, words.replace(" ", "_"))
    return words.upper() if field == "size" else words


def canonical_column(field: str, phrase: Column) -> Column:
    """:func:`canonical` of text whose normalised ``phrase`` is given."""
    if field in ALIASES:
        names = F.create_map(*chain.from_iterable((F.lit(a), F.lit(c)) for a, c in _by_phrase(field).items()))
        return F.coalesce(F.element_at(names, phrase), F.replace(phrase, F.lit(" "), F.lit("_")))
    return F.upper(phrase) if field == "size" else phrase


def either(field: str, gap: str) -> str:
    """A pattern of all aliases, the longest first; ``gap`` stands between their words."""
    words = sorted(_by_phrase(field), key=lambda p: (-len(p), p))
    return r"(?<![a-z0-9])(?:" + "|".join(gap.join(map(re.escape, p.split())) for p in words) + r")(?![a-z0-9])"


def known_values(text: Column, field: str) -> Column:
    """Distinct canonical values named in a text, in order; longer aliases win where several begin, and leather
    within faux or synthetic leather is none."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(either(field, r"[\s_-]+")), F.lit(0))
    phrase = lambda a: F.regexp_replace(a, r"[\s_-]+", " ")
    return F.array_distinct(F.transform(found, lambda a: canonical_column(field, phrase(a))))
