"""Dense vectors as Parquet with a manifest, which is written last and so marks a whole table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION, SIMILARITY = "1.0.0", "dot_product"
NAMES = ["model_id", "model_revision", "catalog_sha256"]


class VectorsError(ValueError):
    """A vector table or its manifest can't be used."""


def _digest(vectors: DataFrame) -> tuple[int, int, int | None, int | None, str]:
    """rows, distinct ids, least and greatest dimension, checksum that does not depend on the order of rows."""
    size = F.coalesce(F.size("embedding"), F.lit(-1))
    sums = F.sum(F.xxhash64("id", "embedding").cast("decimal(38,0)"))
    return tuple(vectors.agg(F.count(F.lit(1)), F.count_distinct("id"), F.min(size), F.max(size), F.coalesce(sums, F.lit(0)).cast("string")).first())


def _manifest(spark: SparkSession, path: str):
    return spark.read.text(f"{path}/manifest", wholetext=True)


def write_vectors(vectors: DataFrame, path: str, **names: str) -> None:
    """Write (id, embedding) as unit vectors below ``path``, which must not exist. Null, empty, zero and non-finite
    vectors and repeated ids are an error; no manifest is written then. names: ``NAMES``."""
    if missing := [n for n in NAMES if not names.get(n)]:
        raise VectorsError(f"manifest needs {missing}")
    spark = vectors.sparkSession
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    good = F.coalesce(square > 0, F.lit(False)) & ~F.isnan(square) & (square < float("inf")) & F.col("id").isNotNull()
    unit = F.transform("v", lambda x: (x / F.sqrt(square)).cast("float"))
    rows = vectors.select("id", F.col("embedding").cast("array<double>").alias("v"))
    rows.select("id", F.when(good, unit).otherwise(F.raise_error(F.lit("a vector is null, zero or not finite")).cast("array<float>")).alias("embedding")).write.mode("error").parquet(f"{path}/vectors")
    n, ids, low, high, checksum = _digest(spark.read.parquet(f"{path}/vectors"))
    if not n or n != ids or low != high:
        raise VectorsError("vectors need rows, distinct ids and one dimension")
    fields = {"schema_version": SCHEMA_VERSION, "rows": n, "dimension": low, "normalized": True, "similarity": SIMILARITY, "checksum": checksum, "id": rows.schema["id"].dataType.simpleString(), **{k: names[k] for k in NAMES}}
    spark.range(1, numPartitions=1).select(F.lit(json.dumps(fields, sort_keys=True)).alias("value")).write.mode("error").text(f"{path}/manifest")


def read_vectors(spark: SparkSession, path: str, catalog_sha256: str | None = None) -> DataFrame:
    """The vectors of ``path`` after a check of the manifest, of rows, ids, dimension and checksum, and of the catalog."""
    try:
        meta = json.loads(_manifest(spark, path).first()[0])
        version, similarity, normalized = meta["schema_version"], meta["similarity"], meta["normalized"]
        want = (meta["rows"], meta["rows"], meta["dimension"], meta["dimension"], meta["checksum"])
        names, kind = [meta[n] for n in NAMES], meta["id"]
    except Exception as error:  # an unreadable path has many errors
        raise VectorsError(f"no valid manifest below {path}") from error
    if (version, similarity, normalized) != (SCHEMA_VERSION, SIMILARITY, True) or not all(names):
        raise VectorsError("the manifest is of another kind")
    if catalog_sha256 is not None and catalog_sha256 != meta["catalog_sha256"]:
        raise VectorsError("the vectors belong to another catalog")
    vectors = spark.read.schema(f"id {kind}, embedding array<float>").parquet(f"{path}/vectors")
    try:
        found = _digest(vectors)
    except Exception as error:  # a foreign or broken file
        raise VectorsError(f"the vectors below {path} can't be read") from error
    if found != want:
        raise VectorsError("the vectors are not those of the manifest")
    return vectors


def vectors_error(spark: SparkSession, path: str, catalog_sha256: str | None = None) -> str | None:
    """The kind of the error that keeps the vectors below ``path`` from being used, or null."""
    try:
        read_vectors(spark, path, catalog_sha256)
    except Exception as error:
        return type(error).__name__
    return None


def optional_vectors(spark: SparkSession, path: str | None, catalog_sha256: str | None = None) -> tuple[str, DataFrame | None]:
    """("on", vectors), or ("off", None) where there are none that can be used: nothing that is wrong with vectors stops
    the rest."""
    try:
        return ("on", read_vectors(spark, path, catalog_sha256)) if path else ("off", None)
    except Exception:  # an optional route never stops the others
        return "off", None


def validate_vectors(vectors: DataFrame) -> dict[str, int]:
    """What a table of (id, embedding) has wrong, in one pass: null ids, null, empty, zero or non-finite vectors, vectors that
    are not of unit length, and how many dimensions there are."""
    square = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x)
    bad = ~(F.coalesce(square > 0, F.lit(False)) & ~F.isnan(square) & (square < float("inf")))
    row = vectors.agg(
        F.count_if(F.col("id").isNull()).alias("null_ids"), F.count_if(bad).alias("unusable"), F.count_if(~bad & (F.abs(F.sqrt(square) - 1) > 1e-3)).alias("not_unit"),
        F.count_distinct(F.coalesce(F.size("embedding"), F.lit(-1))).alias("dimensions"), F.count(F.lit(1)).alias("rows"),
    ).first()
    return row.asDict()
