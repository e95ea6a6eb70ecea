"""JSONL product catalogs and sessions: a strict reader that names the bad line, and a lenient one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import parsed_price

SCHEMA = "parent_asin string, title string, features array<string>, description array<string>, price string, categories array<string>, details map<string,string>, average_rating double, rating_number bigint, store string"


class CatalogError(ValueError):
    """A line of a catalog can't be used."""


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """(value, at) of all lines; ``at`` has the partition in its high bits and the line's place there in the low ones."""
    return spark.read.text(path).select("value", F.monotonically_increasing_id().alias("at"))


def _line(lines: DataFrame, at: int) -> int:
    """The line number, from 1, of a place in one file: lines of earlier partitions and those before it in its own."""
    before = lines.filter(F.shiftright("at", 33) < (at >> 33)).count()
    return before + (at & ((1 << 33) - 1)) + 1


def _fault(top: Column) -> Column:
    """What is wrong with a line, or null; a blank line is skipped."""
    blank = F.trim("value") == ""
    return F.when(blank, None).when(top.isNull(), "is not JSON").when(~top.startswith("OBJECT"), "is not an object")


def _checked(spark: SparkSession, path: str, fault: Column) -> DataFrame:
    """Lines that are not blank, after a pass that stops at the first with a fault."""
    lines = _numbered(spark, path)
    bad = lines.select("at", fault.alias("fault")).filter("fault is not null").agg(F.min_by("fault", "at"), F.min("at")).first()
    if bad[0] is not None:
        raise CatalogError(f"line {_line(lines, bad[1])} {bad[0]}")
    return lines.filter(F.trim("value") != "").select("value")


def _top() -> Column:
    return F.schema_of_variant(F.try_parse_json("value"))


def read_objects(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """``raw`` and, with a schema, its columns of every line of a JSONL file; blank lines are skipped, any other line that
    is no JSON object is an error with its number."""
    lines = _checked(spark, path, _fault(_top())).withColumnRenamed("value", "raw")
    return lines if schema is None else lines.select("raw", F.from_json("raw", schema).alias("o")).select("raw", "o.*")


def read_lenient(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, int]:
    """(objects, lines left out): lines that are no JSON object are left out and counted."""
    lines = _numbered(spark, path).filter(F.trim("value") != "").withColumn("fault", _fault(_top()))
    good = lines.filter("fault is null").select(F.col("value").alias("raw"), F.from_json("value", schema).alias("o")).select("raw", "o.*")
    return good, lines.filter("fault is not null").count()


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Products of a JSONL file with ``price_kind`` (number, string or null) and their ``raw`` line. Blank lines are
    skipped; a line that is no object, a missing id and a repeated id are an error, with the line's number but for the last."""
    asin = F.trim(F.coalesce(F.get_json_object("value", "$.parent_asin"), F.lit("")))
    lines = _checked(spark, path, F.coalesce(_fault(_top()), F.when((F.trim("value") != "") & (asin == ""), "has no parent_asin")))
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json("value"), "$.price", "variant"))
    rows = lines.select(F.col("value").alias("raw"), F.from_json("value", SCHEMA).alias("p"), kind.alias("k"))
    whole = rows.select("p.*", F.when(F.col("k") == "STRING", "string").when(F.col("k").rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), "number").alias("price_kind"), "raw")
    whole = whole.withColumn("parent_asin", F.trim("parent_asin"))
    if twice := whole.groupBy("parent_asin").count().filter("count > 1").limit(1).collect():
        raise CatalogError(f"duplicate parent_asin {twice[0][0]}")
    return whole


def priced(products: DataFrame) -> DataFrame:
    """``products`` with ``price_value`` and its confidence: .95 for numbers, .90 for price strings, else null."""
    number = F.col("price").try_cast("double")
    finite = (number >= 0) & (number < float("inf"))
    value = F.when((F.col("price_kind") == "number") & finite, number).when(F.col("price_kind") == "string", parsed_price(F.col("price")))
    sure = F.when(value.isNotNull(), F.when(F.col("price_kind") == "number", 0.95).otherwise(0.90))
    return products.withColumns({"price_value": value, "price_confidence": sure})


def coverage_projection(products: DataFrame) -> DataFrame:
    """(id, categories): what a session needs of a catalog to name a product's category and to know its ids."""
    return products.select(F.col("parent_asin").alias("id"), F.coalesce("categories", F.array().cast("array<string>")).alias("categories"))
