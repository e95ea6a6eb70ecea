"""Unicode and stemming analysis, run once for each distinct word and not for each occurrence."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import normalized_phrase

# Suffix rules of Porter's algorithm (1980, with its author's later "bli" and "logi").
STEP_2 = "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log"
STEP_3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
STEP_4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize sion tion"

_CONS, _VOWEL = "(?:[bcdfghjklmnpqrstvwxz]|(?<=[aeiou])y|^y)", "(?:[aeiou]|(?<![aeiou])(?<!^)y)"
_VC = re.compile(f"{_VOWEL}+{_CONS}+")
_HAS_VOWEL = re.compile(_VOWEL)
_CVC = re.compile(f"{_CONS}{_VOWEL}[bcdfghjklmnpqrstvz]$")
_DOUBLE = re.compile(r"([bcdfghjkmnpqrtvwxy])\1$")


def _rules(spec: str) -> list[tuple[str, str]]:
    pairs = [(r.partition(":")[0], r.partition(":")[2]) for r in spec.split()]
    return sorted(pairs, key=lambda p: -len(p[0]))


_TWO, _THREE, _FOUR = _rules(STEP_2), _rules(STEP_3), _rules(STEP_4)


def _measure(stem: str) -> int:
    return len(_VC.findall(stem))


def _swap(word: str, rules: list[tuple[str, str]], least: int) -> str:
    """The longest suffix decides, whether or not its condition holds."""
    for suffix, other in rules:
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + other if _measure(stem) > least else word
    return word


def porter(word: str) -> str:
    """Porter's stem of a lower-case word. Words under three letters or over 64 stay."""
    if not 3 <= len(word) <= 64:
        return word
    if word.endswith("s") and not word.endswith("ss"):
        word = word[:-2] if word.endswith(("sses", "ies")) else word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix):
                stem = word[: -len(suffix)]
                if _HAS_VOWEL.search(stem):
                    if stem.endswith(("at", "bl", "iz")):
                        word = stem + "e"
                    elif _DOUBLE.search(stem):
                        word = stem[:-1]
                    else:
                        word = stem + "e" if _measure(stem) == 1 and _CVC.search(stem) else stem
                break
    if word.endswith("y") and _HAS_VOWEL.search(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, _TWO, 0), _THREE, 0)
    for suffix, _ in _FOUR:
        if word.endswith(suffix):
            stem = word[:-3] if suffix in ("sion", "tion") else word[: -len(suffix)]
            word = stem if _measure(stem) > 1 else word
            break
    if word.endswith("e"):
        m = _measure(word[:-1])
        word = word[:-1] if m > 1 or (m == 1 and not _CVC.search(word[:-1])) else word
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


def folded(text: str) -> str:
    """Lower case without diacritics."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


def stems(vocabulary: DataFrame, word_col: str = "word") -> DataFrame:
    """(word, stem) of every distinct word, folded and stemmed; null words go."""

    @F.pandas_udf("string")
    def stem(words: pd.Series) -> pd.Series:
        return words.map(lambda w: porter(folded(w)))

    distinct = vocabulary.select(F.col(word_col).alias("word")).filter("word is not null").distinct()
    return distinct.withColumn("stem", stem("word"))


def words(text: Column) -> Column:
    """Runs of letters, marks and digits of any script, lower-cased; null has none."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0)), F.array().cast("array<string>"))


def nfkc(text: Column) -> Column:
    """NFKC of a text; only texts that are not ASCII reach Python."""

    @F.pandas_udf("string")
    def normal(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")

    wide = text.rlike(r"[^\x00-\x7F]")
    return F.when(wide, normal(F.when(wide, text))).otherwise(text)


def phrase(text: Column) -> Column:
    """``normalized_phrase`` of the NFKC form."""
    return normalized_phrase(nfkc(text))


def folded_column(word: Column) -> Column:
    """:func:`folded` of a column; only words that are not ASCII reach Python."""

    @F.pandas_udf("string")
    def fold(words: pd.Series) -> pd.Series:
        return words.map(folded, na_action="ignore")

    wide = word.rlike(r"[^\x00-\x7F]")
    return F.when(wide, fold(F.when(wide, word))).otherwise(F.lower(word))
