"""Language identification by nearest centroid.

A text is its hashed counts of letter n-grams (1 to 3 letters, borders as spaces), as
``log(1 + tf) * idf`` of unit length. Each language has several centroids, clustered by
spherical k-means; a text takes the language of the centroid of the greatest cosine, and is
rejected where its distance is beyond that centroid's radius, learned from the sample.

Fitting reads a bounded sample of labelled rows: at most ``SAMPLE`` texts over all languages,
at most ``PER_LANGUAGE`` of one, those of the smallest id hash; idf and centroids come from it.
Predicting reads every whole text once, without a shuffle; a task holds one batch and a
matrix of ``ROWS`` texts.

Null texts and texts without a letter are ``und`` with score 0, as is every text where nothing
was labelled. Equal cosines take the language first in order. Repeated rows are predicted
alike; rows with a null label or text teach nothing; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

BITS, SAMPLE, PER_LANGUAGE, CLUSTERS, ROWS, MAX_LANGUAGES = 13, 4096, 400, 4, 128, 256
SIZE = 1 << BITS
_M = np.uint64(0x9E3779B97F4A7C15)


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def counts(text: str | None) -> np.ndarray | None:
    """Counts of hashed n-grams, or None for a text without a letter."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return None
    edge = np.ones(len(points), bool)
    edge[1:] = letter[:-1]
    c = np.where(letter, points, 32)[letter | edge].astype(np.uint64)
    c = np.concatenate([[np.uint64(32)], c, [np.uint64(32)]])
    two = c[:-1] * np.uint64(0x110000) + c[1:]
    three = two[:-1] * np.uint64(0x110000) + c[2:]
    shift = np.uint64(64 - BITS)
    return np.bincount(np.concatenate([(x * _M + s) * _M >> shift for x, s in ((c, np.uint64(1)), (two, np.uint64(2)), (three, np.uint64(3)))]).astype(np.int64), minlength=SIZE)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


@dataclass(frozen=True)
class Model:
    names: list[str]  # of each centroid
    centroids: np.ndarray
    radius: np.ndarray  # largest distance that is not rejected
    idf: np.ndarray

    def vectors(self, rows: list[np.ndarray]) -> np.ndarray:
        return _unit(np.log1p(np.stack(rows)).astype(np.float32) * self.idf)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Nearest language, cosine, and whether it is rejected."""
        names, score, far = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
        got = [(i, c) for i, t in enumerate(texts) if (c := counts(t)) is not None] if self.names else []
        for a in range(0, len(got), ROWS):
            part = got[a : a + ROWS]
            cosine = self.vectors([c for _, c in part]) @ self.centroids.T
            for (i, _), best, row in zip(part, cosine.argmax(1).tolist(), cosine):
                names[i], score[i], far[i] = self.names[best], min(max(float(row[best]), 0.0), 1.0), bool(1 - row[best] > self.radius[best])
        return names, score, far


def cluster(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Centroids of unit rows by spherical k-means, begun at the mean's nearest row, then the farthest ones."""
    centers = [x[int((x @ x.mean(0)).argmax())]]
    while len(centers) < min(k, len(x)):
        near = np.max(x @ np.stack(centers).T, axis=1)
        centers.append(x[int(near.argmin())])
    c = np.stack(centers)
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        new = _unit(np.stack([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))]))
        if np.allclose(new, c):
            break
        c = new
    return c


def fit(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", clusters: int = CLUSTERS) -> Model:
    """Learn from the rows of ``docs`` with a label and a text."""
    keys = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.xxhash64(id_col).alias("h"))
    sizes = dict(keys.groupBy("lang").agg(F.count(F.lit(1))).limit(MAX_LANGUAGES + 1).collect())
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    most = min(PER_LANGUAGE, SAMPLE // max(len(sizes), 1))
    # by the hash alone a language is thinned to some four times what is wanted, before anything is shuffled
    share = F.lit(1.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, min(1.0, 4 * most / n)).otherwise(share)
    keys = keys.filter(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30))
    keys = keys.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))).filter(F.col("r") <= most)
    sample = stored(keys.select("id", "lang").distinct(), "sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [c for c in map(counts, batch.column(1).to_pylist())]
            raw = [None if c is None else np.minimum(c, 65535).astype(np.uint16).tobytes() for c in made]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["lang", "raw"])

    picked = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), ["id", "lang"])  # at most SAMPLE rows
    rows = sorted((r["lang"], bytes(r["raw"])) for r in picked.select("lang", "text").mapInArrow(run, "lang string, raw binary").collect() if r["raw"] is not None)
    if not rows:
        return Model([], np.zeros((0, SIZE), np.float32), np.zeros(0), np.ones(SIZE, np.float32))
    raw = np.stack([np.frombuffer(b, np.uint16) for _, b in rows])
    idf = (np.log((1 + len(raw)) / (1 + (raw > 0).sum(0))) + 1).astype(np.float32)
    x = _unit(np.log1p(raw).astype(np.float32) * idf)
    labels = np.array([lang for lang, _ in rows])
    names, centroids, radius = [], [], []
    for lang in sorted(set(labels.tolist())):
        own = x[labels == lang]
        c = cluster(own, clusters)
        cosine = own @ c.T
        near = cosine.argmax(1)
        for j in range(len(c)):
            names.append(lang)
            centroids.append(c[j])
            distance = 1 - cosine[near == j, j]
            radius.append(min(1.0, 1.25 * float(distance.max()) if len(distance) else 1.0))
    return Model(names, np.stack(centroids).astype(np.float32), np.array(radius), idf)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``lang`` (``und`` where rejected), ``nearest``, ``score`` (cosine) and ``rejected``, for every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                names, score, far = model.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names), pa.array(score, pa.float64()), pa.array(far)], names=["id", "nearest", "score", "rejected"])

    made = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, nearest string, score double, rejected boolean")
    return made.select(F.col("id").alias(id_col), F.when(F.col("rejected"), "und").otherwise(F.col("nearest")).alias("lang"), "nearest", "score", "rejected")


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2
