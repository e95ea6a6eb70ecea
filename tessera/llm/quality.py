"""Quality rules by repetition coverage.

Rolling hashes of word n-grams of several lengths measure how many characters of a
text's words stand inside n-grams found twice or more in it, and inside repeated lines.
A text is rejected when a share is above its limit. Reads each text once, in one pass,
without a shuffle; memory is bounded by ``CHUNK`` bytes of text, or the longest text.

Nulls and empty texts have no words, fail the base rule and are not kept. Repeated rows
are judged alike, each on its own; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, slices, text_buffers
from .hashing import Q, SPACE, Texts, U, mix, ngram, repeated

CHUNK = 1 << 20


@dataclass(frozen=True)
class Limits:
    """Largest shares that are kept; ``ngrams``: of word characters inside repeated n-grams, by n."""

    min_words: int = 10
    repeat_percent: int = 20
    ngrams: dict[int, float] = field(default_factory=lambda: {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10})
    lines: float = 0.30
    line_chars: float = 0.20


SYMBOL = np.zeros(256, bool)
SYMBOL[[*b"#*$%&|<>"]] = True


def _lines(t: Texts) -> tuple[np.ndarray, ...]:
    """Of lines with a word: text, repeats an earlier one, characters; and lines of each text."""
    some = t.off[:-1] < t.off[1:]
    cuts = np.flatnonzero(t.data == 10)
    start = np.sort(np.concatenate([t.off[:-1][some], cuts[~np.isin(cuts + 1, t.off[1:])] + 1])) if t.n else cuts
    own = np.searchsorted(t.off, start, "right") - 1
    end = np.minimum(np.append(start[1:], len(t.data)), t.off[own + 1])
    end = end - (t.data[np.maximum(end - 1, 0)] == 10)
    end = np.maximum(end, start)
    full = np.zeros(len(t.data) + 1, np.int64)
    np.cumsum(~SPACE[t.data], out=full[1:])
    word = full[end] > full[start]
    start, end, own = start[word], end[word], own[word]
    keys = t.spans(start, end) ^ mix(own.astype(U), 3)
    order = np.lexsort((start, keys))
    again = np.zeros(len(keys), bool)
    again[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return own, again, t.points[end] - t.points[start]


def measure(data: np.ndarray, off: np.ndarray, lengths: list[int]) -> dict[str, np.ndarray]:
    """Counts for each text of a run; the first of ``lengths`` is the base's five."""
    t = Texts(data, off)
    out = {"n_words": t.per_doc(t.doc), "word_chars": t.per_doc(t.doc, t.chars)}
    sym = np.zeros(len(data) + 1, np.int64)
    np.cumsum(SYMBOL[data], out=sym[1:])
    out["n_symbols"] = sym[off[1:]] - sym[off[:-1]]
    own, again, chars = _lines(t)
    out["n_lines"], out["line_chars"] = t.per_doc(own), t.per_doc(own, chars)
    out["n_dup_lines"], out["dup_line_chars"] = t.per_doc(own[again]), t.per_doc(own[again], chars[again])
    words, salt = t.words(), mix(t.doc.astype(U), 5)
    at, have = np.arange(len(words)), 0
    rolled = np.zeros(0, U)
    for n in lengths:
        if not have:
            rolled, at = ngram(words, n), at[: max(len(words) - n + 1, 0)]
        else:  # an n-gram repeats only where a shorter one at its place does
            at, rolled = at[rep], rolled[rep]
            fits = at + n <= len(words)
            at, rolled = at[fits], rolled[fits]
            for k in range(have, n):
                rolled = rolled + words[at + k] * U(pow(Q, k, 1 << 64))
        own = t.doc[at] == t.doc[at + n - 1]
        at, rolled, have = at[own], rolled[own], n
        rep = repeated(rolled ^ salt[at])
        hit = at[rep]
        cover = np.zeros(len(words) + 1, np.int32)
        cover[hit] += 1
        np.subtract.at(cover, hit + n, 1) if len(hit) < 64 else cover.__isub__(np.bincount(hit + n, minlength=len(cover)).astype(np.int32))
        covered = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
        out[f"repeat_words_{n}"] = t.per_doc(t.doc[covered])
        out[f"repeat_chars_{n}"] = t.per_doc(t.doc[covered], t.chars[covered])
    return out


def _share(part: str, whole: str) -> Column:
    return F.coalesce(F.col(part) / F.nullif(F.col(whole), F.lit(0)), F.lit(0.0))


def _measured(docs: DataFrame, id_col: str, text_col: str, limits: Limits) -> DataFrame:
    lengths = sorted({5, *limits.ngrams})
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "dup_line_chars", "line_chars", "repeat_words_5", *(f"repeat_chars_{n}" for n in lengths)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_buffers(batch.column(1))
            for a, b in slices(off, CHUNK):
                got = measure(data[off[a] : off[b]], off[a : b + 1] - off[a], lengths)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(got[c], pa.int64()) for c in counts)], names=["id", *counts])

    kind = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in counts)])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), kind)


def _verdict(limits: Limits) -> tuple[Column, Column]:
    """Failed by the base rule; kept."""
    words, repeat = F.col("n_words"), F.col("repeat_words_5")
    failed = (words < limits.min_words) | (100 * repeat > limits.repeat_percent * words)
    bad = (_share("n_dup_lines", "n_lines") > limits.lines) | (_share("dup_line_chars", "line_chars") > limits.line_chars)
    for n, most in limits.ngrams.items():
        bad = bad | (_share(f"repeat_chars_{n}", "word_chars") > most)
    return failed, ~failed & ~bad


def kept(docs: DataFrame, limits: Limits = Limits(), text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col))
    return _measured(rows, "row", text_col, limits).filter(_verdict(limits)[1]).select("id.*")


def rules(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, the counts, ``base_failed`` and ``kept``."""
    failed, keep = _verdict(limits)
    return _measured(docs, id_col, text_col, limits).select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", F.col("repeat_words_5").alias("n_repeat_words"),
        failed.alias("base_failed"), keep.alias("kept"),
        _share("dup_line_chars", "line_chars").alias("dup_line_char_share"),
        *(_share(f"repeat_chars_{n}", "word_chars").alias(f"repeat_char_share_{n}") for n in limits.ngrams),
    )
