"""BM25 over fielded text, rank fusion, guarded rerank, popularity, dense top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import terms, tokens
from ..storage import stored

K1, B, RRF_K, ABSENT_RANK = 1.2, 0.75, 60, 201
#: terms of all queries that are looked for before anything is exploded; more are joined
MOST_LITERALS = 10_000


def search(docs: DataFrame, queries: DataFrame, weights: dict[str, float], id_col: str, fields: list[str] | None = None, most_terms: int = 60) -> DataFrame:
    """(qid, id, score) of all documents that hold a term of a query; greater is better. ``fields``: those that may hit;
    lengths count all of ``weights``. For a few queries of a corpus that is not indexed: texts are read once, into a table of
    lengths and of the queries' terms alone; ``index`` has the stored form. Null texts have no words, null queries no rows."""
    asked = queries.select("qid", F.explode(terms(F.col("query"), most=most_terms)).alias("term"))
    wanted = asked.select("term").distinct()
    some = [r[0] for r in wanted.limit(MOST_LITERALS + 1).collect()]
    is_asked = (lambda t: t.isin(some)) if len(some) <= MOST_LITERALS else (lambda t: F.lit(True))
    words = docs.select(F.col(id_col).alias("id"), *(tokens(F.col(f)).alias(f"w{i}") for i, f in enumerate(weights)))
    place = {f: i for i, f in enumerate(weights)}
    part = lambda f: F.transform(F.filter(f"w{place[f]}", is_asked), lambda t: F.struct(t.alias("term"), F.lit(float(weights[f])).alias("w")))
    size = sum((F.size(f"w{i}") for i in range(len(weights))), F.lit(0))
    found = stored(words.select("id", size.alias("n"), F.concat(*(part(f) for f in fields or weights)).alias("p")), "found")
    totals = found.agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("mean")).first()
    each = found.select("id", "n", F.explode("p").alias("p")).select("id", "n", "p.term", "p.w")
    each = each if len(some) <= MOST_LITERALS else each.join(_queries(wanted), "term")
    freq = each.groupBy("id", "n", "term").agg(F.sum("w").alias("f"))
    rate = lambda df: F.greatest(F.log((F.lit(totals["docs"]) - df + 0.5) / (df + 0.5)), F.lit(1e-6))
    idf = stored(freq.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", rate(F.col("df")).alias("idf")), "idf")
    gain = F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("n") / F.lit(totals["mean"])))
    return freq.join(_queries(idf), "term").join(_queries(asked), "term").groupBy("qid", "id").agg(F.sum(gain).alias("score"))


def _queries(df: DataFrame, most: int = 100_000) -> DataFrame:
    """Query-side tables are broadcast if they are counted to be small."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def among(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """``rows`` whose ``key`` is in ``wanted`` (one column of that name), if these are counted to be few; else all rows."""
    few = wanted.distinct()
    return rows.join(F.broadcast(few), key, "left_semi") if few.limit(MOST_LITERALS + 1).count() <= MOST_LITERALS else rows


def top(scored: DataFrame, k: int, by: str = "score", partition: str = "qid") -> DataFrame:
    """The k best of each query, ties by id, with ``rank``."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(partition).orderBy(F.desc(by), "id"))).filter(F.col("rank") <= k)


def fuse(routes: list[tuple[DataFrame, float]], k: int, rrf_k: int = RRF_K) -> DataFrame:
    """Weighted reciprocal rank fusion of (qid, id, rank) routes. One column per route keeps the order of additions."""
    tagged = [r.select("qid", "id", F.lit(i).alias("route"), "rank") for i, (r, _) in enumerate(routes)]
    long = tagged[0]
    for t in tagged[1:]:
        long = long.unionByName(t)
    first = [F.min(F.when(F.col("route") == i, F.col("rank"))).alias(f"rank_{i}") for i in range(len(routes))]
    wide = long.groupBy("qid", "id").agg(*first)
    score = sum((F.coalesce(F.lit(w) / (rrf_k + F.col(f"rank_{i}")), F.lit(0.0)) for i, (_, w) in enumerate(routes)), F.lit(0.0))
    return top(wide.withColumn("rrf", score), k, "rrf")


def guarded(legacy: DataFrame, formal: DataFrame, alpha: Column, formal_k: int = 10) -> DataFrame:
    """The legacy set (qid, id, rank) reordered by ``(1 - alpha) / legacy + alpha / formal``; ids outside the formal top take rank 201."""
    rank = F.coalesce("formal_rank", F.lit(ABSENT_RANK))
    near = formal.filter(F.col("rank") <= formal_k).select("qid", "id", F.col("rank").alias("formal_rank"))
    both = legacy.select("qid", "id", F.col("rank").alias("legacy_rank")).join(near, ["qid", "id"], "left")
    return both.withColumn("formal_rank", rank).withColumn("blend", (1 - alpha) / F.col("legacy_rank") + alpha / F.col("formal_rank"))


def popular(items: DataFrame, id_col: str, count_col: str, rating_col: str, k: int, places: int | None = None) -> DataFrame:
    """The k greatest ``count * max(rating, 0.1)``, the larger id at the border; ordered by score, then id. ``places``: those
    to which scores are rounded, before they are compared."""
    score = F.col(count_col) * F.greatest(F.col(rating_col), F.lit(0.1))
    scored = items.select(F.col(id_col).alias("id"), (score if places is None else F.round(score, places)).alias("score"))
    return scored.orderBy(F.desc("score"), F.desc("id")).limit(k).orderBy(F.desc("score"), "id")


def dense(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 1000) -> DataFrame:
    """(qid, id, score, rank): greatest dot products, compared to 12 places, ties by id. ``block`` queries at a time go to the
    executors, and the vectors are scanned once for each block; a task returns the k best it has seen of each query.
    A vector that is null or holds one has null scores, which come last."""
    each = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    asked = queries.select("qid", F.col(vector_col).cast("array<double>").alias("q")).toArrow().combine_chunks()
    kinds = f"qid {queries.schema['qid'].dataType.simpleString()}, id {each.schema['id'].dataType.simpleString()}, score double"
    out = None
    for a in range(0, max(len(asked), 1), block):
        part = asked.slice(a, block)
        found = each.mapInArrow(_best(part.column("qid").combine_chunks(), _matrix(part.column("q").combine_chunks()), k), kinds)
        out = found if out is None else out.unionAll(found)
    return top(out, k)


def _matrix(lists: pa.Array) -> np.ndarray:
    """A row for each list, of NaN where it is null."""
    size = pc.list_value_length(lists).drop_null().unique().to_pylist()
    if len(size) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(size)}")
    out = np.full((len(lists), size[0] if size else 0), np.nan)
    out[lists.is_valid().to_numpy(zero_copy_only=False)] = pc.list_flatten(lists).to_numpy(zero_copy_only=False).reshape(-1, out.shape[1])
    return out


def _best(qids: pa.Array, asked: np.ndarray, k: int, rows: int = 2048):
    """For mapInArrow: (qid, id, score) of the k best of each query in a task's vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, ids, score = np.zeros(0, np.int64), None, np.zeros(0)
        for batch in batches:
            for a in range(0, batch.num_rows, rows):
                some = batch.slice(a, rows)
                v = _matrix(some.column(1))
                empty = not v.shape[1] or not asked.shape[1]
                if not empty and v.shape[1] != asked.shape[1]:
                    raise ValueError(f"vectors of different lengths: {sorted((v.shape[1], asked.shape[1]))}")
                s = np.full((len(asked), len(v)), np.nan) if empty else asked @ v.T
                s = np.where(np.isnan(s), -np.inf, np.round(s, 12) + 0.0)
                least = np.partition(s, -k, axis=1)[:, -k:].min(1, keepdims=True) if len(v) > k else -np.inf
                r, at = np.nonzero(s >= least)
                new = some.column(0).take(pa.array(at))
                row, score, ids = np.append(row, r), np.append(score, s[r, at]), new if ids is None else pa.concat_arrays([ids, new])
                order = np.lexsort((pc.rank(ids, tiebreaker="dense").to_numpy(), -score, row))
                begin = np.searchsorted(row[order], np.arange(len(asked)))
                order = order[np.arange(len(order)) - begin[row[order]] < k]
                row, score, ids = row[order], score[order], ids.take(pa.array(order))
        if ids is not None:
            yield pa.RecordBatch.from_arrays([qids.take(pa.array(row)), ids, pa.array(score, mask=np.isneginf(score))], names=["qid", "id", "score"])

    return run
