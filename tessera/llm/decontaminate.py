"""Benchmark decontamination over a distributed positional inverted index, built-in functions only.

The index is a written table of postings ``(doc, pos, term)`` over all rows of the training
table. Since the test phrases are known, it holds the terms that occur in them; their
vocabulary is broadcast only below ``BROADCAST_ROWS`` rows and joined by a shuffle beyond.
A document's last word is always in, so the index also knows every length.

A phrase is looked up from its rarest terms: the postings of the rarest one, moved back by
the term's offset, give start positions; they are intersected with the equally adjusted
postings of the second rarest. What is left is read again in the texts and compared word by
word, so matches are exact. Rarity is the term's count over the whole index.

Costs follow the corpus: one tokenising pass, one row for each posting of a test term, and
one row for each posting of a phrase's rarest term. No list of a term or phrase is
collected; only the candidates of one document meet in one row.

Null and empty texts have no words and no matches; a benchmark item without words is never
found. Equal rows are judged alike, rows that share an id but not a text apart. Extra
columns are ignored; either table may be empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

BROADCAST_ROWS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = "".join(map(chr, [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def words(text: Column) -> Column:
    """A-Z lower-cased; runs of digits, letters a-z and non-ASCII characters."""
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER + SEPARATORS, LOWER + " " * len(SEPARATORS))
    return F.array_remove(F.split(plain, " "), "")


def _small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it is counted to be within the limit."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def windows(items: DataFrame, item_col: str, text_col: str, n: int) -> DataFrame:
    """Distinct (item, phrase, n_words, win): n consecutive words, or all words of a shorter item."""
    w = items.select(F.col(item_col).alias("item"), words(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    w = w.withColumn("n", F.least(F.size("w"), F.lit(n)))
    w = w.withColumn("at", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)))
    phrase = F.array_join(F.slice("w", F.col("at"), F.col("n")), " ")
    return w.select("item", phrase.alias("phrase"), F.col("n").alias("n_words")).distinct().withColumn("win", F.xxhash64("phrase"))


def doc_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


class PositionalIndex:
    """Postings of ``vocabulary`` (``term`` strings) over ``docs``, in a written table."""

    def __init__(self, docs: DataFrame, vocabulary: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        self.docs, self.id_col, self.text_col = docs, id_col, text_col
        self.terms = stored(vocabulary.select("term").distinct().withColumn("tid", F.xxhash64("term")), "terms")
        w = docs.select(doc_key(id_col, text_col).alias("doc"), words(F.col(text_col)).alias("w"))
        each = w.select("doc", F.size("w").alias("n"), F.posexplode("w").alias("pos", "term"))
        last = F.col("pos") == F.col("n") - 1
        kept = each.join(_small(self.terms), "term", "left").filter(F.col("tid").isNotNull() | last)
        self.postings = stored(kept.select("doc", "pos", "tid", last.alias("last")), "postings")

    def lengths(self) -> DataFrame:
        return self.postings.filter("last").groupBy("doc").agg((F.max("pos") + 1).alias("n_words"))

    def counts(self) -> DataFrame:
        return self.postings.filter("tid is not null").groupBy("tid").agg(F.count(F.lit(1)).alias("df"))

    def probes(self, phrases: DataFrame) -> DataFrame:
        """For each ``win`` whose terms all occur: its two rarest terms and their offsets."""
        terms = phrases.select("win", "n_words", F.posexplode(F.split("phrase", " ")).alias("off", "term"))
        known = terms.withColumn("tid", F.xxhash64("term")).join(self.counts(), "tid")
        order = Window.partitionBy("win").orderBy("df", "off")
        ranked = known.select("win", "n_words", "off", "tid", F.row_number().over(order).alias("r"), F.count(F.lit(1)).over(Window.partitionBy("win")).alias("n"))
        pick = lambda c, r: F.max(F.when(F.col("r") == r, F.col(c)))
        return ranked.filter("n = n_words and r <= 2").groupBy("win", "n_words").agg(
            pick("tid", 1).alias("tid"), pick("off", 1).alias("off"), pick("tid", 2).alias("tid2"), pick("off", 2).alias("off2")
        )

    def candidates(self, phrases: DataFrame, slop: int = 0) -> DataFrame:
        """Distinct (doc, win, start) where the two rarest terms of a phrase stand at their
        offsets, the second up to ``slop`` words aside."""
        probes = stored(self.probes(phrases), "probes")
        first = self.postings.select("doc", "pos", "tid").join(_small(probes), "tid")
        first = first.withColumn("start", F.col("pos") - F.col("off"))
        if not slop:
            first = first.filter("start >= 0")
        alone = first.filter("tid2 is null").select("doc", "win", "start")
        aside = F.explode(F.sequence(F.lit(-slop), F.lit(slop))) if slop else F.lit(0)
        want = first.filter("tid2 is not null").select("doc", "win", "start", F.col("tid2").alias("tid"), (F.col("start") + F.col("off2")).alias("p2"), aside.alias("aside"))
        want = want.select("doc", "win", "start", "tid", (F.col("p2") + F.col("aside")).alias("pos"))
        seconds = probes.select(F.col("tid2").alias("tid")).filter("tid is not null").distinct()
        second = self.postings.select("doc", "pos", "tid").join(_small(seconds), "tid", "left_semi").distinct()
        return want.join(second, ["doc", "tid", "pos"], "left_semi").select("doc", "win", "start").unionByName(alone).distinct()

    def _read_again(self, phrases: DataFrame, slop: int) -> DataFrame:
        """Documents with candidates: their words ``w`` and candidates ``c``."""
        texts = phrases.select("win", "phrase", "n_words").distinct()
        found = self.candidates(phrases, slop).join(_small(texts), "win")
        grouped = stored(found.groupBy("doc").agg(F.collect_list(F.struct("win", "phrase", "n_words", "start")).alias("c")), "candidates")
        docs = self.docs.select(doc_key(self.id_col, self.text_col).alias("doc"), F.col(self.text_col).alias("_text"))
        hit = docs.join(_small(grouped.select("doc"), 50_000), "doc", "left_semi").dropDuplicates(["doc"])
        return hit.select("doc", words(F.col("_text")).alias("w")).join(grouped, "doc")

    def phrase_matches(self, phrases: DataFrame) -> DataFrame:
        """(doc, n_hit, wins): words inside any occurrence, and the phrases that occur."""
        same = lambda c: F.array_join(F.slice(F.col("w"), c["start"] + 1, c["n_words"]), " ") == c["phrase"]
        got = self._read_again(phrases, 0).select("doc", F.filter("c", same).alias("c")).filter(F.size("c") > 0)
        inside = F.flatten(F.transform("c", lambda c: F.sequence(c["start"], c["start"] + c["n_words"] - 1)))
        return got.select("doc", F.size(F.array_distinct(inside)).cast("long").alias("n_hit"), F.array_distinct(F.transform("c", lambda c: c["win"])).alias("wins"))

    def proximity_matches(self, phrases: DataFrame, slop: int) -> DataFrame:
        """(doc, win): phrases all of whose words stand, in any order, within the phrase's length
        and ``slop`` more words on either side of a place where its two rarest terms keep their
        distance up to ``slop``. Phrase matches are among them."""

        def near(c: Column) -> Column:
            a = F.greatest(c["start"] - slop, F.lit(0))
            around = F.slice(F.col("w"), a + 1, c["start"] + c["n_words"] + slop - a)
            return F.size(F.array_except(F.split(c["phrase"], " "), around)) == 0

        got = self._read_again(phrases, slop).select("doc", F.filter("c", near).alias("c"))
        return got.select("doc", F.explode(F.array_distinct(F.transform("c", lambda c: c["win"]))).alias("win"))


def contamination(docs: DataFrame, items: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, doc (its key), n_words, n_hit, items (sorted as strings)."""
    found = stored(windows(items, item_col, item_text_col, n), "windows")
    vocabulary = found.select(F.explode(F.split("phrase", " ")).alias("term"))
    index = PositionalIndex(docs, vocabulary, id_col, text_col)
    hits = stored(index.phrase_matches(found.select("win", "phrase", "n_words").distinct()), "hits")
    of_item = found.select("win", "item").distinct()
    named = hits.select("doc", F.explode("wins").alias("win")).join(_small(of_item), "win")
    named = named.groupBy("doc").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    per_doc = index.lengths().join(hits.select("doc", "n_hit"), "doc", "left").join(named, "doc", "left")
    rows = docs.select(F.col(id_col), doc_key(id_col, text_col).alias("doc"))
    return rows.join(per_doc, "doc", "left").select(
        id_col, "doc", F.coalesce(F.col("n_words").cast("long"), F.lit(0)).alias("n_words"), F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def clean(docs: DataFrame, items: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without any window of an item, all columns as they are, whatever their names."""
    key = next(k for k in map("_doc{}".format, range(len(docs.columns) + 1)) if k not in docs.columns)
    found = contamination(docs, items, n, id_col, text_col).filter("n_hit > 0").select(F.col("doc").alias(key)).distinct()
    bad = stored(found, "contaminated")
    return docs.withColumn(key, doc_key(id_col, text_col)).join(_small(bad), key, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
