"""What requests, pools and rankings must hold to, checked in one pass each, and their JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicons import ATTRIBUTES

VERSION = "1.0"
MOST_TURN, MOST_LIMIT = 10, 200


class ContractError(ValueError):
    """Rows break a contract."""


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(c) == "", F.lit(True))


def _repeats(c: Column) -> Column:
    return F.size(F.array_distinct(c)) < F.size(c)


def _bad_terms(c: str) -> Column:
    """A repeated field, a term without values, a blank or repeated value."""
    fields = F.transform(F.col(c), lambda t: t["field"])
    bad = F.exists(F.col(c), lambda t: (F.size(t["values"]) == 0) | _repeats(t["values"]) | F.exists(t["values"], lambda v: F.coalesce(F.trim(v) == "", F.lit(True))) | F.coalesce(F.trim(t["field"]) == "", F.lit(True)))
    return _repeats(fields) | bad


def _found(df: DataFrame, rules: dict[str, Column]) -> dict[str, int]:
    row = df.agg(*(F.count_if(F.coalesce(c, F.lit(True))).alias(r) for r, c in rules.items())).first()
    return {r: n for r, n in row.asDict().items() if n}


def check_requests(requests: DataFrame) -> dict[str, int]:
    """How many rows break each rule of a search request; rules that all rows keep are left out."""
    rules = {
        "qid": _blank("qid"), "turn": ~F.col("turn").between(1, MOST_TURN), "current_message": _blank("current_message"), "route": ~F.col("route").isin("buying", "browsing"),
        "texts": F.col("raw_context").isNull() | F.col("base_request").isNull() | F.col("structured_query").isNull(), "category": F.coalesce(F.trim("category") == "", F.lit(False)),
        **{g: _bad_terms(g) for g in ("hard", "soft", "excluded")}, "tags": _repeats(F.col("tags")) | F.exists("tags", lambda t: F.trim(t) == ""),
        "average_prior_rating": F.coalesce(~F.col("average_prior_rating").between(0, 5), F.lit(False)),
        "blocked": F.exists("blocked", lambda a: ~a.isin(ATTRIBUTES)),
    }
    return _found(requests, rules) | _repeated(requests, ["qid"])


def _repeated(df: DataFrame, keys: list[str]) -> dict[str, int]:
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").count()
    return {"repeated": n} if n else {}


def check_pool(pool: DataFrame, limit: int = MOST_LIMIT) -> dict[str, int]:
    """The same of candidates: evidence from distinct routes with ranks from 1, a score that is not negative, at most
    ``limit`` distinct ids a request."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rules = {
        "id": _blank("id"), "evidence": (F.size("evidence") == 0) | _repeats(F.transform("evidence", lambda e: e["route"])) | F.exists("evidence", lambda e: (e["rank"] < 1) | F.coalesce(~finite(e["score"]), F.lit(False))),
        "rrf": ~finite(F.col("rrf")) | (F.col("rrf") < 0),
    }
    more = pool.groupBy("qid").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).count()
    return _found(pool, rules) | _repeated(pool, ["qid", "id"]) | ({"limit": more} if more else {})


def check_ranking(explained: DataFrame, features: list[str]) -> dict[str, int]:
    """The same of a ranking: every feature is a share, those that stay have a finite score and ranks without gaps."""
    stays = ~F.col("filtered")
    rules = {f: ~F.col(f).between(0, 1) for f in features} | {"score": stays & (F.col("score").isNull() | F.isnan("score")), "filtered": F.col("filtered") & F.col("rank").isNotNull()}
    gaps = explained.filter(stays).groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("r")).filter("n <> r").count()
    return _found(explained, rules) | _repeated(explained, ["qid", "id"]) | ({"gaps": gaps} if gaps else {})


def require(found: dict[str, int], what: str) -> None:
    if found:
        raise ContractError(f"{what}: {found}")


def as_json(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(json): one object per row, null fields kept, with the contract's version."""
    return df.select(F.to_json(F.struct(F.lit(VERSION).alias("contract_version"), *(columns or df.columns)), {"ignoreNullFields": "false"}).alias("json"))
