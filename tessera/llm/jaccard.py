"""N-gram Jaccard join by prefix filters under several global token orders.

A text's set is its distinct word n-grams, as 64-bit hashes. Texts of equal sets form a
class; only classes are joined. Sets of sizes a and b reach similarity t only if they
overlap in at least ``ceil(t * max(a, b))`` tokens, so under any global order of tokens their
first ``n - ceil(t * n) + 1`` must share one. A pair of classes is verified only if it passes this
filter under each of three orders:

* order A, rarest first, ties by hash: tokens are shuffled as compact blobs by hash range and
  counted in numpy; a token of one class alone goes, as it can only stand first. A class
  with fewer shared tokens than the overlap asks for has no partner and goes, before any
  pair is made; twice, since each round lowers the counts. Passages that many texts share
  end last in this order, so they make no candidates. Two sets meet only where, were it
  their first common token, those from it on could still make up the overlap;
* orders B and C, by two hashes: the prefixes are kept beside the sets as 32-bit numbers, and pairs
  whose prefixes are disjoint under either order go before a whole set is moved.

What passes all orders is verified by intersecting whole sets.

Components are exact, yet never all pairs of a group are made. Each round compares the members
of a token's group with a few centers, classes of no component yet before others; members that
link join the center's component, centers leave the group, and a group within one component is
done. The number of centers doubles by round up to ``CENTERS``. Only the labels that new links
connect take part in connected components (large and small stars on written tables).

Hot tokens: a token of many classes in one flush of a task (``HOT``) is spread over all buckets, and a
marker keeps its own bucket's count right; a bucket beyond ``HELD`` tokens streams those known to
be shared. Both may repeat a (token, class), so those rows, and only those, are made distinct
afterwards. Memory: a task holds a bucket of about ``BUCKET`` tokens, ``HELD`` at most besides the distinct ones,
or a batch of ``PAIR_ROWS`` pairs of sets; the number of buckets follows the input. Hashes have 64 bits: the
odds that any two of 10**9 classes are taken for one are 3 %, those of a wrong link far lower.

Null texts and texts without words have empty sets and are linked with nothing. Texts of
fewer than n words have one token, their whole sequence. Equal rows share a component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of, lean, release, slices, stored, text_buffers
from .hashing import Q, Texts, U, mix, ngram

CHUNK, BUCKET, FLUSH, BROADCAST_ROWS = 1 << 20, 1 << 19, 1 << 19, 500_000
#: tokens of a bucket that are sorted at once; a token is hot in a flush with so many classes of it, and one in so many of the flush's
HELD, HOT, HOT_SHARE = 1 << 23, 16, 256
#: centers of a group in a round, at most
CENTERS = 64
#: tasks that merge buckets, at most; beyond it a task takes several, one after the other
PARTITIONS = 1 << 14
#: rows of a batch that Python gets: texts, pairs of sets
TEXT_ROWS, PAIR_ROWS = 1000, 256
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def token_sets(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a run of texts: tokens ascending in each text, where each text's begin, their counts, class hashes."""
    t = Texts(LOWER[data], off)
    words = t.words()
    own = t.per_doc(t.doc)
    first = np.concatenate([[0], np.cumsum(own)])
    at = np.arange(max(len(words) - n + 1, 0))
    whole = t.doc[at] == t.doc[at + n - 1]
    grams = mix(ngram(words, n) + U(n), 11)[whole]
    doc = t.doc[at[whole]]
    short = np.flatnonzero((own > 0) & (own < n))
    if len(short):
        rolled = own[short].astype(U)
        for k in range(n - 1):
            has = own[short] > k
            rolled[has] += words[first[short[has]] + k] * U(pow(Q, k, 1 << 64))
        grams, doc = np.concatenate([grams, mix(rolled, 11)]), np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        grams, doc = grams[order], doc[order]
    ends = np.cumsum(np.bincount(doc, minlength=t.n))
    a = 0
    for b in ends.tolist():
        if b - a > 1:
            grams[a:b].sort()
        a = b
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    grams, doc = grams[new], doc[new]
    size = np.bincount(doc, minlength=t.n)
    start = np.concatenate([[0], np.cumsum(size)])
    sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(grams, 13))])
    classes = mix((sums[start[1:]] - sums[start[:-1]]) ^ size.astype(U), 17)
    return grams, start, size, classes


def _least(size: np.ndarray, percent: int) -> np.ndarray:
    return (percent * size + 99) // 100


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))


def classify(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(key, id, size, class) of every row; key: hash of id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_buffers(batch.column(2))
            for a, b in slices(off, CHUNK):
                _, _, size, classes = token_sets(data[off[a] : off[b]], off[a : b + 1] - off[a], n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(size, pa.int64()), pa.array(classes.view(np.int64))], names=["key", "id", "size", "class"])

    kind = docs.schema[id_col].dataType.simpleString()
    return _texts(docs, id_col, text_col).mapInArrow(lean(run), f"key long, id {kind}, size long, class long")


def _planes(tok: np.ndarray) -> bytes:
    return np.ascontiguousarray(tok.view(np.uint8).reshape(-1, 8).T).tobytes()


def _blob(bucket: int, hot: bool, tok: np.ndarray, cls: np.ndarray, size: np.ndarray) -> tuple:
    some, first, at = np.unique(cls, return_index=True, return_inverse=True)
    return bucket, hot, _planes(tok), at.astype(np.uint16 if len(some) < 65536 else np.uint32).tobytes(), some.tobytes(), size[first].astype(np.uint32).tobytes()


def _postings(planes: bytes, at: bytes, some: bytes, size: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    tok = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view(U).ravel()
    classes = np.frombuffer(some, U)
    where = np.frombuffer(at, np.uint16 if len(classes) < 65536 else np.uint32)
    return tok, classes[where], np.frombuffer(size, np.uint32)[where]


class Bucket:
    """The tokens of one hash range. A posting of size 0 marks a token that is hot elsewhere."""

    def __init__(self):
        self.held: list[tuple[np.ndarray, ...]] = []
        self.count, self.known, self.over = 0, np.zeros(0, U), False

    def add(self, part: tuple[np.ndarray, ...]) -> Iterator[tuple[np.ndarray, ...]]:
        self.held.append(part)
        self.count += len(part[0])
        if self.count > HELD:
            self.over = True
            yield self.flush()

    def flush(self) -> tuple[np.ndarray, ...]:
        """(token, class, size, again) of tokens known to have two classes or more; tokens of one stay held."""
        tok, c, s = (np.concatenate(x) for x in zip(*self.held))
        more = self._shared(tok)
        if not self.over:  # tokens alone go before the slower sort
            tok, c, s = tok[more], c[more], s[more]
        order = np.lexsort((c, tok))
        tok, c, s = tok[order], c[order], s[order]
        new = np.ones(len(tok), bool)
        new[1:] = (tok[1:] != tok[:-1]) | (c[1:] != c[:-1])
        tok, c, s = tok[new], c[new], s[new]
        more = self._shared(tok)
        marked = s == 0
        again = np.isin(tok, tok[marked]) | self.over
        out = more & ~marked
        rest = ~more
        self.held, self.count = [(tok[rest], c[rest], s[rest])], int(rest.sum())
        if self.over:
            self.known = np.union1d(self.known, tok[more])
        return tok[out], c[out], s[out], again[out]

    def _shared(self, tok: np.ndarray) -> np.ndarray:
        order = np.argsort(tok, kind="stable")
        sorted_ = tok[order]
        same = sorted_[1:] == sorted_[:-1]
        more = np.zeros(len(tok), bool)
        more[1:] |= same
        more[:-1] |= same
        out = np.empty(len(tok), bool)
        out[order] = more
        return out | np.isin(tok, self.known) if len(self.known) else out


def shared_tokens(docs: DataFrame, n: int, percent: int, bits: int, id_col: str, text_col: str) -> DataFrame:
    """(token, class, size, again): tokens that two classes or more have. Rows of ``again`` may be repeated."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seen: set[int] = set()
        held: list[tuple[np.ndarray, ...]] = []
        shift = U(64 - bits)
        turn = TaskContext.get().partitionId() * 7919

        def flush() -> pa.RecordBatch:
            nonlocal turn
            tok, cls, size = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(tok, kind="stable")
            tok, cls, size = tok[order], cls[order], size[order]
            begin = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
            run = np.diff(np.concatenate([begin, [len(tok)]]))
            long = run >= max(HOT, len(np.unique(cls)) // HOT_SHARE)
            rows = []
            if long.any():
                hot = np.repeat(long, run)
                rows.append(_blob(turn % (1 << bits), True, tok[hot], cls[hot], size[hot]))
                turn += 1
                marks = tok[begin[long]]
                tok, cls, size = np.concatenate([tok[~hot], marks]), np.concatenate([cls[~hot], np.zeros(len(marks), U)]), np.concatenate([size[~hot], np.zeros(len(marks), size.dtype)])
                order = np.argsort(tok, kind="stable")
                tok, cls, size = tok[order], cls[order], size[order]
            bucket = (tok >> shift).astype(np.int64)
            cut = np.flatnonzero(np.diff(bucket)) + 1
            rows += [_blob(int(bucket[a]), False, tok[a:b], cls[a:b], size[a:b]) for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(tok)])]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.bool_(), *[pa.binary()] * 4))], names=["bucket", "hot", "tokens", "at", "classes", "sizes"])

        count = 0
        for batch in batches:
            data, off = text_buffers(batch.column(2))
            for a, b in slices(off, CHUNK):
                grams, start, size, classes = token_sets(data[off[a] : off[b]], off[a : b + 1] - off[a], n)
                fresh = np.zeros(len(size), bool)
                for i, c in enumerate(classes.tolist()):
                    if size[i] and c not in seen:
                        fresh[i] = True
                        seen.add(c)
                if len(seen) > 200_000:
                    seen.clear()
                doc = np.repeat(np.arange(len(size)), size)
                keep = fresh[doc]
                held.append((grams[keep], classes[doc[keep]], size[doc[keep]]))
                count += int(keep.sum())
                if count >= FLUSH:
                    yield flush()
                    count = 0
        if count:
            yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(tok: np.ndarray, c: np.ndarray, s: np.ndarray, again: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(tok.view(np.int64)), pa.array(c.view(np.int64)), pa.array(s.astype(np.int64)), pa.array(again)], names=["token", "class", "size", "again"])

        now, bucket = None, Bucket()
        for batch in batches:
            for number, hot, *blob in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if number != now:
                    if bucket.held:
                        yield made(*bucket.flush())
                        release()
                    now, bucket = number, Bucket()
                part = _postings(*blob)
                if hot:
                    yield made(*part, np.ones(len(part[0]), bool))
                else:
                    for out in bucket.add(part):
                        yield made(*out)
        if bucket.held:
            yield made(*bucket.flush())

    blobs = _texts(docs, id_col, text_col).mapInArrow(lean(emit), "bucket int, hot boolean, tokens binary, at binary, classes binary, sizes binary")
    # buckets are even hash ranges: hashing them again would lay several into one task
    blobs = blobs.repartitionById(min(1 << bits, PARTITIONS), F.col("bucket")).sortWithinPartitions("bucket")
    return blobs.mapInArrow(lean(merge), "token long, class long, size long, again boolean")


def rare_prefixes(shared: DataFrame, percent: int) -> DataFrame:
    """(token, class, size, rest, own): of each class that can have a partner, its prefix under order A.
    rest: how many tokens that other classes have too it holds from this one on; own: how many that none has.
    Two sets whose first common token this is overlap in ``rest`` at most, so a class leaves groups that
    hold no partner of a size to match."""
    least = F.expr(f"({percent} * size + 99) div 100")
    rows = shared.filter("not again").drop("again").unionByName(shared.filter("again").select("token", "class", "size").dropDuplicates(["token", "class"]))
    for _ in range(2):
        have = rows.groupBy("class").agg(F.count(F.lit(1)).alias("have"), F.first("size").alias("size"))
        rows = rows.drop("have").join(have.filter(F.col("have") >= least).select("class", "have"), "class")
        df = rows.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
        rows = stored(rows.drop("df").join(df, "token"), "shared")
    have = rows.groupBy("class").agg(F.count(F.lit(1)).alias("have"), F.first("size").alias("size")).filter(F.col("have") >= least)
    rows = rows.drop("have").join(have.select("class", "have"), "class")
    rank = F.row_number().over(Window.partitionBy("class").orderBy("df", "token"))
    rows = rows.withColumn("rank", rank).filter(F.col("rank") <= F.col("have") - least + 1)
    rows = rows.select("token", "class", "size", (F.col("have") - F.col("rank") + 1).alias("rest"), (F.col("size") - F.col("have")).alias("own"))
    rows = stored(rows, "prefixes")
    for _ in range(2):
        group = rows.groupBy("token").agg(F.min("size").alias("smallest"), F.count(F.lit(1)).alias("members")).filter("members > 1")
        other = F.greatest(F.col("smallest"), least)
        rows = rows.join(group, "token").filter((100 + percent) * F.col("rest") >= percent * (F.col("size") + other)).select("token", "class", "size", "rest", "own")
    return stored(rows, "prefixes")


def intersected(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of (a, b) pairs those whose prefixes share a token under order B and one under order C."""
    heads = lambda c, x, y: sets.select(F.col("class").alias(c), F.col("prefix_b").alias(x), F.col("prefix_c").alias(y))
    wide = pairs.join(heads("a", "ab", "ac"), "a").join(heads("b", "bb", "bc"), "b")
    return wide.filter(F.arrays_overlap("ab", "bb") & F.arrays_overlap("ac", "bc")).select("a", "b")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of (a, b) pairs those whose whole sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, known = [], None, None
            for i, (a, x, y) in enumerate(zip(batch.column("a").to_pylist(), batch.column("x"), batch.column("y"))):
                if a != last:
                    last, known = a, np.frombuffer(x.as_buffer(), U)
                y = np.frombuffer(y.as_buffer(), U)
                both = len(np.intersect1d(known, y, True))
                if 100 * both >= percent * (len(known) + len(y) - both):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    wide = pairs.join(sets.select(F.col("class").alias("b"), F.col("tokens").alias("y")), "b")
    wide = wide.join(sets.select(F.col("class").alias("a"), F.col("tokens").alias("x")), "a")
    return wide.select("a", "b", "x", "y").mapInArrow(lean(run), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(class, label) of all ends of ``edges`` (a, b): label is the least of the component."""
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        now = stored(small, "edges")
        new = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if new == state:
            break
        state = new
    return now.select(F.col("u").alias("class"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("class"), F.col("v").alias("label")).distinct())


def _small(df: DataFrame) -> DataFrame:
    """A stored table, marked for broadcast if it is counted to be small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def whole_sets(docs: DataFrame, reps: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(class, tokens, prefix_b, prefix_c) of the rows of ``reps`` (key): tokens in order B, prefixes as 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_buffers(batch.column(2))
            for a, b in slices(off, CHUNK):
                grams, start, size, classes = token_sets(data[off[a] : off[b]], off[a : b + 1] - off[a], n)
                first = np.where(size > 0, size - _least(size, percent) + 1, 0)
                other, heads_b, heads_c = mix(grams, 2), [], []
                for i in range(b - a):
                    own = slice(start[i], start[i + 1])
                    heads_b.append(grams[own][: first[i]])
                    heads_c.append(np.sort(other[own])[: first[i]])
                at = pa.array(np.concatenate([[0], np.cumsum(first)]).astype(np.int32))
                prefix = lambda heads: pa.ListArray.from_arrays(at, pa.array((np.concatenate(heads) >> U(20)).astype(np.uint32).view(np.int32)))
                tokens = pa.array([grams[start[i] : start[i + 1]].tobytes() for i in range(b - a)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(classes.view(np.int64)), tokens, prefix(heads_b), prefix(heads_c)], names=["class", "tokens", "prefix_b", "prefix_c"])

    return _texts(docs, id_col, text_col).join(_small(reps), "key", "left_semi").mapInArrow(lean(run), "class long, tokens binary, prefix_b array<int>, prefix_c array<int>").dropDuplicates(["class"])


def relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(class, label) after new links (a, b): only labels that they connect take part in the components."""
    end = lambda c: labels.select(F.col("class").alias(c), F.col("label").alias("l" + c))
    named = links.join(end("a"), "a", "left").join(end("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    met = stored(components(named.filter("a <> b").distinct()), "met")
    moved = labels.join(_small(met.select(F.col("class").alias("label"), F.col("label").alias("new"))), "label", "left").select("class", F.coalesce("new", "label").alias("label"))
    return stored(moved.unionByName(met.join(labels, "class", "left_anti").select("class", "label")), "labels")


def link(docs: DataFrame, rows: DataFrame, prefixes: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(class, label) of every class with a partner."""
    spark = docs.sparkSession
    reps = rows.join(prefixes.select("class").distinct(), "class", "left_semi").groupBy("class").agg(F.min("key").alias("key")).select("key")
    with batches_of(spark, TEXT_ROWS):
        sets = stored(whole_sets(docs, stored(reps, "reps"), n, percent, id_col, text_col), "sets")
    left, labels, centers = prefixes, spark.range(0).select(F.col("id").alias("class"), F.col("id").alias("label")), 1
    while True:
        named = left.join(labels, "class", "left").withColumn("label", F.coalesce("label", "class"))
        some = named.groupBy("token", F.pmod(F.xxhash64("class"), F.lit(centers)).alias("part")).agg(
            F.min(F.struct((F.col("label") != F.col("class")).alias("later"), "own", "class", "label", "size", "rest")).alias("center"), F.min("label").alias("low"), F.max("label").alias("high")
        )
        group = some.groupBy("token").agg(F.collect_list("center").alias("centers"), (F.min("low") != F.max("high")).alias("open")).filter("open").drop("open")

        def fits(c):
            """Another component; sizes allow the similarity, and so do the tokens from this on, which holds for the first that two sets share."""
            near = 100 * F.least("size", c["size"]) >= percent * F.greatest("size", c["size"])
            apart = (c["label"] != F.col("label")) & (~F.exists("centers", lambda x: x["class"] == F.col("class")) | (c["class"] < F.col("class")))
            return apart & near & ((100 + percent) * F.least("rest", c["rest"]) >= percent * (F.col("size") + c["size"]))

        near = F.transform(F.filter("centers", fits), lambda c: c["class"]).alias("near")
        named = stored(named.join(group, "token").select("token", "class", "size", "rest", "own", F.exists("centers", lambda x: x["class"] == F.col("class")).alias("center"), near), "groups")
        n_rows, n_pairs = named.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("near")), F.lit(0))).first()
        if n_pairs:
            pairs = named.select(F.explode("near").alias("x"), "class").select(F.least("x", "class").alias("a"), F.greatest("x", "class").alias("b")).distinct()
            with batches_of(spark, PAIR_ROWS):
                links = stored(verify(intersected(pairs, sets), sets, percent), "links")
            labels = labels if links.isEmpty() else relabel(labels, links)
        if not n_rows:
            return labels
        left, centers = named.filter("not center").select("token", "class", "size", "rest", "own"), min(2 * centers, CENTERS)


def join(docs: DataFrame, n: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, key (hash of id and text), size of its set, group, component
    (the smallest id reachable by links of at least ``percent`` / 100)."""
    with batches_of(docs.sparkSession, TEXT_ROWS):
        rows = stored(classify(docs, n, id_col, text_col), "classes")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    bits = max(4, int(total // BUCKET).bit_length())
    with batches_of(docs.sparkSession, TEXT_ROWS):
        tokens = stored(shared_tokens(docs, n, percent, bits, id_col, text_col), "tokens")
    prefixes = rare_prefixes(tokens, percent)
    labels = link(docs, rows, prefixes, n, percent, id_col, text_col)
    named = rows.join(labels, "class", "left").withColumn("label", F.coalesce("label", "class"))
    least = stored(named.filter("size > 0").groupBy("label").agg(F.min("id").alias("least")), "least")
    out = named.join(least, "label", "left")
    return out.select(F.col("id").alias(id_col), "key", "size", F.col("label").alias("group"), F.when(F.col("size") > 0, F.col("least")).otherwise(F.col("id")).alias("component"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, that of the smallest id; rows without words all stay.
    Extra columns stay as they are, whatever their names."""
    key = next(k for k in map("_key{}".format, range(len(docs.columns) + 1)) if k not in docs.columns)
    found = stored(join(docs, n, percent, id_col, text_col).filter("size > 0"), "joined")
    first = stored(found.groupBy("group").agg(F.min(F.struct(F.col(id_col).alias("id"), "key")).alias("first")), "first")
    named = found.join(first, "group")
    gone = stored(named.filter(F.col("key") != F.col("first.key")).select(F.col("key").alias(key)).distinct(), "gone")
    twice = stored(named.filter(F.col("key") == F.col("first.key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("key").alias(key)), "twice")
    left = docs.withColumn(key, F.xxhash64(F.col(id_col), F.col(text_col))).join(_small(gone), key, "left_anti")
    if not twice.isEmpty():  # equal rows
        left = left.join(_small(twice), key, "left_anti").unionByName(left.join(_small(twice), key, "left_semi").dropDuplicates([key]))
    return left.select(*(F.col(f"`{c}`") for c in docs.columns))
