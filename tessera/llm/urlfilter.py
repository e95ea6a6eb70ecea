"""URL filters by a Bloom filter cascade, with built-in functions only.

The universe holds every key that will be asked: the distinct hosts of the corpus. Level
1 encodes the listed keys; level 2 those unlisted keys that pass level 1 by mistake;
level 3 the listed keys that pass level 2, and so on until no key passes by mistake. A
key's answer is the parity of the first level that it fails, exact for all keys of the
universe, and needs no join: the bit arrays reach the executors as scalar subqueries.

A level holds ``BITS_PER_KEY`` bits for each key it encodes, so a cascade grows with the
list alone. A level has at most ``MAX_BITS`` bits (64 MB); larger lists are split by a hash
of the key into several cascades. Each executor holds all of their levels.
Levels are written to the shared folder, and lost executors read them again.

Null urls and urls without ``://`` have an empty host and path; an empty list blocks
nothing. Repeated rows get equal verdicts. Extra columns of ``pages`` are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

BITS_PER_KEY, HASHES, MAX_BITS = 12, 6, 1 << 29
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed values: (text, verdict) of the rules; a rule is a host and a path.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
#: A host is listed if one of its labels is here.
LISTED_LABELS = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: what follows the first ``://``, up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased;
    path: from there up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.substring_index(F.substring_index(F.when(at > 0, F.substr(url, at + 3)), "#", 1), "?", 1)
    host = F.substring_index(rest, "/", 1)
    path = F.substr(rest, F.length(host) + 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, or nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        at, _, rest = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + rest)
        text, verdict = F.when(fits, rule).otherwise(text), F.when(fits, says).otherwise(verdict)
    return text, verdict


@dataclass(frozen=True)
class Level:
    bits: int
    seed: int
    table: DataFrame  # one row: words array<bigint>
    part: int = 0  # of the cascade, by ``_part`` of its keys
    parts: int = 1


def _place(key: Column, level_bits: int, seed: int, k: int) -> Column:
    """The k-th bit of a key."""
    return F.pmod(F.xxhash64(F.lit(HASHES * seed + k), key), F.lit(level_bits).cast("long"))


def _part(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(-1), key), F.lit(parts).cast("long"))


def _bits(count: int) -> int:
    return max(64, -(-BITS_PER_KEY * count // 64) * 64)


def _build(keys: DataFrame, count: int, seed: int, part: int, parts: int) -> Level:
    bits = _bits(count)
    spark = keys.sparkSession
    places = keys.select(F.explode(F.array(*(_place(F.col("key"), bits, seed, k) for k in range(HASHES)))).alias("p"))
    ones = places.select(F.expr("p div 64").alias("word"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("v"))
    zeros = spark.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("v"))
    words = ones.unionByName(zeros).groupBy("word").agg(F.bit_or("v").alias("v"))
    row = words.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "v"))), lambda x: x["v"]).alias("words"))
    return Level(bits, seed, stored(row, "bloom"), part, parts)


def _passes(key: Column, level: Level) -> Column:
    words, out = level.table.select("words").scalar(), F.lit(True)
    for k in range(HASHES):
        p = _place(key, level.bits, level.seed, k)
        out = out & (F.getbit(F.get(words, F.shiftright(p, 6).cast("int")), p.bitwiseAND(63).cast("int")) == 1)
    return out


def cascade(universe: DataFrame) -> list[Level]:
    """``universe``: distinct (key, listed) of all keys that will be asked. As many cascades, by a hash of the key, as
    keep each level within ``MAX_BITS``."""
    universe = stored(universe, "universe")
    parts = -(-_bits(universe.filter("listed").count()) // MAX_BITS)
    while True:
        levels: list[Level] = []
        for part in range(parts):
            some = universe.filter(_part(F.col("key"), parts) == part) if parts > 1 else universe
            if (own := _cascade(some, part, parts)) is None:
                break
            levels += own
        else:
            return levels
        parts = parts * 5 // 4 + 1


def _cascade(universe: DataFrame, part: int, parts: int) -> list[Level] | None:
    """None if a level would need more than ``MAX_BITS``."""
    levels: list[Level] = []
    inside, outside = universe.filter("listed").select("key"), universe.filter("not listed").select("key")
    count = inside.count()
    while count:
        if _bits(count) > MAX_BITS:
            return None
        level = _build(inside, count, 2 * len(levels) + 1, part, parts)
        levels.append(level)
        wrong = stored(outside.filter(_passes(F.col("key"), level)), "wrong")
        inside, outside, count = wrong, inside, wrong.count()
    return levels


def member(key: Column, levels: list[Level]) -> Column:
    """Whether a key of the universe is listed: it is if it fails first at an even level of its cascade, or at none of an
    odd number."""
    parts = levels[0].parts if levels else 1
    each = [_member(key, [x for x in levels if x.part == part]) for part in range(parts)]
    answer = each[0]
    for part in range(1, parts):
        answer = F.when(_part(key, parts) == part, each[part]).otherwise(answer)
    return answer


def _member(key: Column, levels: list[Level]) -> Column:
    answer = F.lit(len(levels) % 2 == 1)
    for i in range(len(levels) - 1, -1, -1):
        answer = F.when(_passes(key, levels[i]), answer).otherwise(F.lit(i % 2 == 1))
    return answer


def listed_by_label(host: Column, labels: list[str] = LISTED_LABELS) -> Column:
    return F.arrays_overlap(F.split(host, r"\."), F.array(*map(F.lit, labels)))


def judge(pages: DataFrame, url_col: str = "url", listed=listed_by_label) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``, which take the place of columns of these names.
    ``listed``: the list, as a table of hosts (``host``) or as an expression of a host column."""
    host, path = host_and_path(F.col(url_col))
    rows = pages.withColumns({"host": host, "path": path})
    universe = rows.groupBy(F.col("host").alias("key")).agg(F.first(F.lit(True)).alias("_")).select("key")
    if isinstance(listed, DataFrame):
        marks = listed.select(F.translate("host", UPPER, LOWER).alias("key"), F.lit(True).alias("listed")).filter("key is not null").distinct()
        universe = stored(universe.join(marks, "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed")), "universe")
    else:
        universe = universe.withColumn("listed", listed(F.col("key")))
    levels = cascade(universe)
    rule, says = rule_of(F.col("host"), F.col("path"))
    method = F.when(member(F.col("host"), levels), "block").otherwise("allow")
    return rows.withColumns({"rule": rule, "verdict": F.coalesce(says, method)})
