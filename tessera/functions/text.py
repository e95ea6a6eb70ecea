"""Text expressions: tokens, phrases, titles, prices, budgets. All are built-in columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words of retrieval, of the baseline and of ranking; they differ on purpose.
STOP_WORDS = "a about an and are as at be but by do does for from have i in is it me my need of on or please some that the this to want with would you your".split()
LEGACY_STOP_WORDS = "a about additional an and are as at be but by closest do does for found from have here i in is it key looking matches matters me my need not of on options or please preference requirement right some that the these this those to use want what with would you your".split()
RANK_STOP_WORDS = "a an and are as at be but by for from have i in is it me my need of on or please some that the this to under want with would you your".split()


def let(value: Column, made: Callable[[Column], Column]) -> Column:
    """``made(value)`` with the value worked out once, however often ``made`` names it; the plan stays small."""
    return F.element_at(F.transform(F.array(value), lambda v: made(v)), 1)


def tokens(text: Column) -> Column:
    """Runs of a-z and 0-9, lower-cased; null has none."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), F.array().cast("array<string>"))


def terms(text: Column, stop_words: list[str] = STOP_WORDS, most: int | None = None) -> Column:
    """Distinct tokens of two characters or more in order, without stop words; the first ``most``."""
    words = F.array_distinct(F.filter(tokens(text), lambda t: (F.length(t) > 1) & ~t.isin(stop_words)))
    return F.slice(words, 1, most) if most else words


def normalized_title(text: Column) -> Column:
    return F.array_join(tokens(text), " ")


def normalized_phrase(text: Column) -> Column:
    """Lower case, ``_`` and ``-`` as spaces, only a-z, 0-9, ``&``, ``+``, ``'``; one space between. ASCII input
    (Spark has no built-in NFKC)."""
    plain = F.regexp_replace(F.lower(F.trim(text)), "[_-]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9&+' ]", " "), " +", " "))


def parsed_price(text: Column) -> Column:
    """Of ``12``, ``$ 12.50``; null for anything else, such as ``from $9``."""
    return F.regexp_extract(text, r"^\s*\$?\s*([0-9]+(?:\.[0-9]{1,2})?)\s*$", 1).try_cast("double")


def price_bucket(price: Column) -> Column:
    out = F.lit(None).cast("string")
    for most, name in reversed([(25, "<25"), (50, "<50"), (100, "<100"), (200, "<200"), (None, "200+")]):
        out = F.when(price.isNotNull(), name) if most is None else F.when(price < most, name).otherwise(out)
    return out


_NUMBER = r"\$?\s*([0-9]+(?:\.[0-9]+)?)"


def budget(text: Column) -> tuple[Column, Column]:
    """(price_min, price_max) a message asks for; of several forms the first of: between, maximum, minimum, ``budget to``."""
    low = F.lower(text)
    got = lambda p, i: F.regexp_extract(low, p, i).try_cast("double")
    between = rf"\bbetween\s+{_NUMBER}\s+and\s+{_NUMBER}"
    most = rf"\b(?:under|below|less\s+than|up\s+to|no\s+more\s+than)\s+{_NUMBER}"
    least = rf"\b(?:at\s+least|over|more\s+than)\s+{_NUMBER}"
    to = rf"\bbudget\s+(?:is\s+)?(?:now\s+)?to\s+{_NUMBER}"
    both, top = low.rlike(between), low.rlike(most)
    only_least = ~both & ~top & low.rlike(least)
    price_min = F.when(both, got(between, 1)).when(only_least, got(least, 1))
    price_max = F.when(both, got(between, 2)).when(top, got(most, 1)).when(~only_least, got(to, 1))
    return price_min, price_max


def is_empty(c: Column, kind: str) -> Column:
    """Null, empty string, empty array or map."""
    return c.isNull() | (c == "" if kind == "string" else F.size(c) == 0 if kind.startswith(("array", "map")) else F.lit(False))
