"""Sharding along a Hilbert curve, with built-in functions only.

Each metadata dimension is cut into ``2**bits`` ranges at its own quantiles; the cell's
index on the Hilbert curve orders the rows, and the order is cut into runs of equal
count. Neighbouring cells share a shard, so each shard spans a small box of every
dimension and readers prune files by any of them.

Law ``rows``: shard counts are at most one apart. The rank of a row is the count of the
cells before it, of the blocks before it in its cell, and its row number in its block.
A cell of many rows is split by a hash of the id into a block for each ``BLOCK_ROWS`` rows, so
no window sorts a whole cell; the table of blocks that is broadcast has one row for each of them
and ``2**(dims * bits)`` cells at most. Only ids, dimensions and cells are shuffled, never texts.

Strings are cut at quantiles of their whole values, by counts of distinct ones; numbers and times
by approximate quantiles. Nulls sort before all values of a dimension. Equal texts lie in one cell
if their metadata is equal too; the law may still part them. Equal rows get neighbouring slots in
either order. An empty table gives no rows. Extra columns are kept; ``cell``, ``shard`` and ``slot`` take
the place of columns of these names. Reading ``rows`` twice should be cheap: pass a stored table.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored


@cache
def curve(dims: int, bits: int) -> list[int]:
    """The Hilbert index of every cell, cells in row-major order (Skilling's transform)."""
    out = []
    for cell in range(1 << dims * bits):
        x = [cell >> bits * (dims - 1 - d) & (1 << bits) - 1 for d in range(dims)]
        q = 1 << bits - 1
        while q > 1:
            for i in range(dims):
                if x[i] & q:
                    x[0] ^= q - 1
                else:
                    t = (x[0] ^ x[i]) & (q - 1)
                    x[0] ^= t
                    x[i] ^= t
            q >>= 1
        for i in range(1, dims):
            x[i] ^= x[i - 1]
        t, q = 0, 1 << bits - 1
        while q > 1:
            if x[-1] & q:
                t ^= q - 1
            q >>= 1
        x = [v ^ t for v in x]
        index = 0
        for b in range(bits - 1, -1, -1):
            for v in x:
                index = index << 1 | v >> b & 1
        out.append(index)
    return out


#: rows of a block
BLOCK_ROWS = 1 << 20


def string_cuts(rows: DataFrame, column: str, n: int) -> list[str]:
    """``n - 1`` values that cut the column's values into ``n`` even parts: distinct values are counted, ordered by ranges,
    and their running counts searched."""
    counts = rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    parts = stored(counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()), "values")
    sums = parts.groupBy("part").agg(F.sum("c").alias("s"))
    before = sums.select("part", (F.sum("s").over(Window.orderBy("part")) - F.col("s")).alias("before"), F.sum("s").over(Window.partitionBy()).alias("total"))
    run = parts.join(F.broadcast(before), "part").withColumn("upto", F.col("before") + F.sum("c").over(Window.partitionBy("part").orderBy("v")))
    found = run.agg(*(F.min(F.when(F.col("upto") * n > F.col("total") * i, F.col("v"))).alias(f"q{i}") for i in range(1, n))).first()
    return [v for v in found if v is not None]


def cells(rows: DataFrame, dims: list[str], bits: int = 4) -> Column:
    """The curve index of a row by its columns ``dims``. Cut points are quantiles over all rows; they are
    ``dims * (2**bits - 1)`` values."""
    if len(dims) * bits > 15:
        raise ValueError("at most 15 bits together")
    parts, cell = 1 << bits, F.lit(0)
    steps = [i / parts for i in range(1, parts)]
    for c in dims:
        if rows.schema[c].dataType.simpleString() == "string":
            value, cuts = F.col(c), string_cuts(rows, c, parts)
        else:
            value = F.col(c).cast("double")
            cuts = rows.agg(F.percentile_approx(value, steps, 10_000)).first()[0] or []
        q = F.lit(0)
        for cut in cuts:
            q = q + F.coalesce(value >= F.lit(cut), F.lit(False)).cast("int")
        cell = cell * parts + q
    return F.element_at(F.array(*map(F.lit, curve(len(dims), bits))), cell + 1)


def assign(rows: DataFrame, dims: dict[str, Column], id_col: str, tie: Column, n_shards: int, bits: int = 4, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` with ``cell``, ``shard`` and ``slot`` (gapless from 0 in a shard). ``tie`` orders rows of one id."""
    own = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"), F.col(id_col).alias("id"), tie.alias("tie"), *(c.alias(f"d{i}") for i, c in enumerate(dims.values())))
    at = own.withColumn("cell", cells(own, [f"d{i}" for i in range(len(dims))], bits))
    sizes = at.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
    at = at.join(F.broadcast(sizes), "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    counts = stored(at.groupBy("cell", "block").agg(F.count(F.lit(1)).alias("n")), "blocks")
    per_cell = counts.groupBy("cell").agg(F.sum("n").alias("n"))
    before = per_cell.select("cell", (F.sum("n").over(Window.orderBy("cell")) - F.col("n")).alias("first"), F.sum("n").over(Window.partitionBy()).alias("total"))
    begins = counts.join(F.broadcast(before), "cell").select("cell", "block", "total", (F.col("first") + F.sum("n").over(Window.partitionBy("cell").orderBy("block")) - F.col("n")).alias("begin"))
    ranked = at.withColumn("place", F.row_number().over(Window.partitionBy("cell", "block").orderBy("id", "tie")))
    out = ranked.join(F.broadcast(begins), ["cell", "block"]).withColumn("rank", F.col("begin") + F.col("place") - 1)
    out = out.withColumn("shard", F.expr(f"cast(rank * {n_shards} div total as int)"))
    out = out.withColumn("slot", F.expr(f"rank - (shard * total + {n_shards - 1}) div {n_shards}"))
    kept = [F.col("row").getField(c).alias(c) for c in rows.columns if c not in ("cell", "shard", "slot")]
    return out.select(*kept, "cell", "shard", "slot")


def write(sharded: DataFrame, path: str) -> None:
    """A folder of files for each shard, rows in order of their slots."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("error").parquet(path)


def prune_stats(sharded: DataFrame, columns: list[str]) -> DataFrame:
    """Least and greatest value of each column in each shard: what file pruning goes by."""
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), *(f(c).alias(f"{f.__name__}_{c}") for c in columns for f in (F.min, F.max)))
