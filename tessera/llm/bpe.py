"""SentencePiece (BPE) encoding and decoding with seeded merge-dropout.

A text gets a space before it, spaces become ``▁``, and characters are merged by an
agenda: the best-scored pair whose joint string is a piece merges first, the leftmost of
equals. Under dropout a popped candidate is skipped when a hash of its span, keyed by (seed,
row id, word's place in the text), is below ``dropout``: every occurrence of a word is decided
on its own. The same seed gives the same segmentation on any cluster, another seed another one.
What no piece covers becomes byte pieces, so decoding returns every text exactly, a literal
``▁`` included (it goes as bytes).

Words (and parts of them between which no piece reaches) are independent. Which pieces a word gives
depends only on the candidates that were skipped, so each Python worker keeps a tree of them: a
node is a word and its skips so far, with the candidates that come next if none is skipped and the ids that they
lead to. An occurrence hashes a node's candidates and goes on to the child of the first one skipped. What is met for the first
time and once in a chunk is merged on its own, without a node. New nodes, and the words without one, are made many at a
time in lockstep; ``CACHE`` nodes and those of one chunk are kept at most. No shuffle; memory is one batch.

Null texts have null ids and decode to null; empty texts have no ids. Repeated rows are
encoded alike; all other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, slices, text_buffers

SPACE, CACHE, LONG, CHUNK, ROWS, NEVER = "▁", 100_000, 48, 1 << 20, 4096, 1 << 40
_MASK = (1 << 64) - 1
_MIX = np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id; scores of the mergeable ones; ids of the 256 bytes."""

    pieces: list[str]
    scores: dict[str, float]
    ids: dict[str, int]
    byte_ids: list[int]

    def words(self) -> re.Pattern[str]:
        """Parts of a text that no merge can join: no piece goes on from a character to a space after it,
        nor from any other character to one of ``marks``."""
        marks = {c for c in map(chr, range(33, 127)) if not c.isalnum()}
        follows = {(x, y) for p in self.scores for x, y in zip(p, p[1:]) if x != SPACE}
        while wrong := {y for x, y in follows if y in marks and x not in marks}:
            marks -= wrong
        some = re.escape("".join(sorted(marks)))
        return re.compile(f"{SPACE}*[{some}]*[^{some}{SPACE}]+|{SPACE}*[{some}]+|{SPACE}+" if marks else f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        plain = [i for i in range(len(pieces)) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        if any(re.search(f"[^{SPACE}]{SPACE}", pieces[i]) for i in plain):
            raise ValueError("pieces may not go over a word's end")
        at = {p: i for i, p in enumerate(pieces)}
        return cls(pieces, {pieces[i]: model.get_score(i) for i in plain}, {pieces[i]: i for i in plain}, [at[f"<0x{b:02X}>"] for b in range(256)])


def segment(word: str, scores: dict[str, float], key: int = 0, least: int = 0) -> list[str]:
    """Agenda merging of one word. A candidate is skipped if its 64-bit hash under ``key`` is below ``least``."""
    n = len(word)
    end = list(range(1, n + 1))  # of the symbol that begins there; 0: merged away
    before = list(range(-1, n - 1))
    heap = [(-s, i, i + 1, i + 2) for i in range(n - 1) if (s := scores.get(word[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, a, b, c = heappop(heap)
        if end[a] != b or end[b] != c:
            continue
        if least:
            if ((key ^ a << 42 ^ b << 21 ^ c) * 0xD6E8FEB86659FD93 & _MASK) < least:
                continue
        end[a], end[b] = c, 0
        if c < n:
            before[c] = a
            if (s := scores.get(word[a : end[c]])) is not None:
                heappush(heap, (-s, a, c, end[c]))
        p = before[a]
        if p >= 0 and (s := scores.get(word[p:c])) is not None:
            heappush(heap, (-s, p, a, c))
    out, at = [], 0
    while at < n:
        out.append(word[at : end[at]])
        at = end[at]
    return out


class Lockstep:
    """``segment`` for many words at once, in numpy: a row holds a word, and every round takes
    each row's best candidate. Characters outside all pieces are a symbol that joins nothing."""

    def __init__(self, vocabulary: Vocabulary):
        scores = vocabulary.scores
        names = [*scores, *sorted({c for p in scores for c in p} - scores.keys())]
        at = {p: i for i, p in enumerate(names)}
        self.ids = np.array([vocabulary.ids.get(p, -1) for p in names], np.int32)
        self.ids = np.append(self.ids, np.int32(-1))  # of characters outside all pieces
        self.n = len(names) + 1
        self.bytes = np.array(vocabulary.byte_ids, np.int32)
        # equal scores have equal ranks
        rank = dict(zip(scores, np.unique([-s for s in scores.values()], return_inverse=True)[1].tolist()))
        pairs = sorted((at[x] * self.n + at[y], at[p], rank[p]) for p in scores for k in range(1, len(p)) if (x := p[:k]) in at and (y := p[k:]) in at)
        self.keys, self.joint, self.rank = np.array(pairs or [(-1, 0, 0)], np.int64).T.copy()
        chars = [(ord(p), i) for p, i in at.items() if len(p) == 1]
        self.char = np.full(max((c for c, _ in chars), default=0) + 2, self.n - 1, np.int64)
        for c, i in chars:
            self.char[c] = i

    def look(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece and rank of joint symbols; rank ``NEVER`` where they are none."""
        key = x * self.n + y
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return self.joint[i], np.where(self.keys[i] == key, self.rank[i], NEVER)

    def run(self, words: list[str], keys: np.ndarray, least: int) -> list[bytes]:
        """Ids of each word."""
        out = [b""] * len(words)
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(size) - size
        order = np.argsort(size, kind="stable")
        for a in range(0, len(order), ROWS):
            some = order[a : a + ROWS]
            own = keys[some]
            flat, count = self._rows(points, start[some], size[some], lambda live, code: (own[live] ^ code) * _MIX < np.uint64(least) if least else None)
            raw, end = flat.tobytes(), (4 * np.cumsum(count)).tolist()
            for i, x, y in zip(some.tolist(), [0, *end], end):
                out[i] = raw[x:y]
        return out

    def nodes(self, words: list[str], skips: list[tuple[int, ...]]) -> tuple[np.ndarray, ...]:
        """Order in which the words are given back, ids and their counts, and the candidates popped after the last of
        a word's ``skips`` and their counts."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(size) - size
        order = np.argsort(size, kind="stable")
        made = []
        for a in range(0, len(order), ROWS):
            some = order[a : a + ROWS]
            own = [skips[i] for i in some.tolist()]
            left = np.fromiter(map(len, own), np.int64, len(own))
            table = np.zeros((len(own), int(left.max())), np.uint64)  # 0 is no candidate
            table[np.arange(table.shape[1]) < left[:, None]] = np.fromiter(chain.from_iterable(own), np.uint64, int(left.sum()))
            rows, codes = [], []

            def skip(live: np.ndarray, code: np.ndarray, table=table, left=left, rows=rows, codes=codes) -> np.ndarray | None:
                if not table.shape[1]:
                    rows.append(live)
                    codes.append(code)
                    return None
                out = (table[live] == code[:, None]).any(1)
                after = left[live] == 0
                rows.append(live[after])
                codes.append(code[after])
                left[live[out]] -= 1
                return out

            ids, count = self._rows(points, start[some], size[some], skip)
            row, code = np.concatenate([np.zeros(0, np.int64), *rows]), np.concatenate([np.zeros(0, np.uint64), *codes])
            made.append((ids, count, code[np.argsort(row, kind="stable")], np.bincount(row, minlength=len(some))))
        return order, *map(np.concatenate, zip(*made))

    def _spelled(self, ids: np.ndarray, points: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their rows, characters without a piece (-1) as bytes."""
        bare = ids < 0
        if not bare.any():
            return ids, row
        some, at = np.unique(points[bare], return_inverse=True)
        raw = [chr(c).encode() for c in some.tolist()]
        table = np.array([list(r.ljust(4, b"\0")) for r in raw])
        count = np.ones(len(ids), np.int64)
        count[bare] = np.array([len(r) for r in raw])[at]
        which = np.zeros(len(ids), np.int64)
        which[bare] = at
        token = np.repeat(np.arange(len(ids)), count)
        place = np.arange(len(token)) - (np.cumsum(count) - count)[token]
        out, spell = ids[token], bare[token]
        out[spell] = self.bytes[table[which[token[spell]], place[spell]]]
        return out, row[token]

    def _rows(self, points: np.ndarray, start: np.ndarray, size: np.ndarray, skipped) -> tuple[np.ndarray, np.ndarray]:
        rows, width = len(size), int(size.max())
        place = np.arange(width)
        inside = place < size[:, None]
        points = points[np.where(inside, start[:, None] + place, 0)]
        symbol = self.char[np.minimum(points, len(self.char) - 1)]
        end = np.tile(place + 1, (rows, 1))  # as in ``segment``
        before = np.tile(place - 1, (rows, 1))
        joint, rank = np.zeros((rows, width), np.int64), np.full((rows, width), NEVER, np.int64)
        if width > 1:
            joint[:, :-1], rank[:, :-1] = self.look(symbol[:, :-1], symbol[:, 1:])
            rank[:, :-1][~inside[:, 1:]] = NEVER
        live = np.arange(rows)
        while len(live):
            a = rank[live].argmin(1)
            more = rank[live, a] < NEVER
            live, a = live[more], a[more]
            b = end[live, a]
            c = end[live, b]
            go = live
            skip = skipped(live, (a << 42 ^ b << 21 ^ c).astype(np.uint64))
            if skip is not None:
                merge = ~skip
                rank[live[skip], a[skip]] = NEVER
                go, a, b, c = live[merge], a[merge], b[merge], c[merge]
            now = joint[go, a]
            symbol[go, a], end[go, a], end[go, b], rank[go, a], rank[go, b] = now, c, 0, NEVER, NEVER
            r = c < size[go]
            row, left, right = go[r], a[r], c[r]
            before[row, right] = left
            joint[row, left], rank[row, left] = self.look(now[r], symbol[row, right])
            p = before[go, a]
            r = p >= 0
            row, left = go[r], p[r]
            joint[row, left], rank[row, left] = self.look(symbol[row, left], now[r])
        whole = inside & (end > 0)
        ids, row = self._spelled(self.ids[symbol[whole]], points[whole], np.nonzero(whole)[0])
        return ids, np.bincount(row, minlength=rows)


class Runs:
    """Runs of a flat array; more are added at the end."""

    def __init__(self, kind: type):
        self.flat, self.end = np.zeros(0, kind), np.zeros(1, np.int64)

    def add(self, flat: np.ndarray, count: np.ndarray) -> None:
        self.flat = np.concatenate([self.flat, flat])
        self.end = np.concatenate([self.end, self.end[-1] + np.cumsum(count)])

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs of ``which`` one after another, and their lengths."""
        start, count = self.end[which], self.end[which + 1] - self.end[which]
        return self.flat[np.arange(count.sum()) + np.repeat(start - (np.cumsum(count) - count), count)], count

    def keep(self, which: np.ndarray) -> None:
        self.flat, count = self.take(which)
        self.end = np.concatenate([np.zeros(1, np.int64), np.cumsum(count)])


@dataclass
class Coder:
    vocabulary: Vocabulary
    seed: int = 0
    dropout: float = 0.0
    #: node of a word without skips; key None: a literal ``▁``
    root: dict[str | None, int] = field(default_factory=dict)
    #: node by its parent's number * 64 + place of the skip among the parent's candidates
    child: dict[int, int] = field(default_factory=dict)
    #: hashes of words and keys of ``child`` that were met once
    seen: set[int] = field(default_factory=set)

    def __post_init__(self) -> None:
        self.least = int(self.dropout * (1 << 64))
        self.words = self.vocabulary.words()
        self.lockstep = Lockstep(self.vocabulary)
        v = self.vocabulary
        self.raw = [p.replace(SPACE, " ").encode() for p in v.pieces]
        for b, i in enumerate(v.byte_ids):
            self.raw[i] = bytes([b])
        #: of each node: ids, candidates, word and skips, key in ``child`` (-1: a root), uses
        self.ids, self.steps, self.made, self.link, self.uses = Runs(np.int32), Runs(np.uint64), [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._add([(None, ())], [-1], np.array([v.byte_ids[b] for b in SPACE.encode()], np.int32), np.array([3]), np.zeros(0, np.uint64), np.zeros(1, np.int64))

    def _add(self, made: list, link: list[int], ids: np.ndarray, n_ids: np.ndarray, steps: np.ndarray, n_steps: np.ndarray) -> None:
        for n, ((word, _), via) in enumerate(zip(made, link), len(self.made)):
            if via < 0:
                self.root[word] = n
            else:
                self.child[via] = n
        self.made += made
        self.link, self.uses = np.append(self.link, np.array(link, np.int64)), np.append(self.uses, np.zeros(len(made), np.int64))
        self.ids.add(ids, n_ids)
        self.steps.add(steps, n_steps)

    def _split(self, text: str) -> list[str | None]:
        if not text:
            return []
        out: list[str | None] = []
        for k, part in enumerate(text.split(SPACE)):
            if k:
                out.append(None)
            part = part.replace(" ", SPACE)
            out += self.words.findall(part if k else SPACE + part)
        return out

    def _learn(self, made: list[tuple[str, tuple[int, ...]]], link: list[int]) -> None:
        """Nodes of words under skips."""
        if made:
            order, *found = self.lockstep.nodes([w for w, _ in made], [s for _, s in made])
            self._add([made[i] for i in order.tolist()], [link[i] for i in order.tolist()], *found)

    def _trim(self) -> None:
        """The most used nodes stay, half of ``CACHE`` at most, and their parents, which are used as often at least."""
        if len(self.seen) > CACHE:
            self.seen.clear()
        if len(self.made) <= CACHE:
            return
        self.seen.clear()
        self.uses[0] = 1 << 62  # the literal mark
        often = max(2, int(np.partition(self.uses, -(CACHE // 2))[-(CACHE // 2)]) + 1)
        which = np.flatnonzero(self.uses >= often)
        now = np.full(len(self.made), -1)
        now[which] = np.arange(len(which))
        link = self.link[which]
        self.link = np.where(link < 0, -1, now[link >> 6] << 6 | link & 63)
        self.made, self.uses = [self.made[i] for i in which.tolist()], self.uses[which] >> 1
        self.ids.keep(which)
        self.steps.keep(which)
        self.root = {w: i for i, ((w, _), via) in enumerate(zip(self.made, self.link.tolist())) if via < 0}
        self.child = {via: i for i, via in enumerate(self.link.tolist()) if via >= 0}

    def _again(self, key: int, count: int) -> bool:
        """Whether this is worth a node: met more than once."""
        if count > 1 or key in self.seen:
            return True
        self.seen.add(key)
        return False

    def _walk(self, node: np.ndarray, keys: np.ndarray) -> None:
        """Every occurrence at a node goes on to the node where none of its candidates is skipped; -1 if that has none."""
        some = np.flatnonzero(node >= 0)
        while len(some):
            codes, count = self.steps.take(node[some])
            row = np.repeat(np.arange(len(some)), count)
            low = np.flatnonzero((keys[some][row] ^ codes) * _MIX < np.uint64(self.least))
            first = low[np.append(True, row[low][1:] != row[low][:-1])] if len(low) else low
            place = first - (np.cumsum(count) - count)[row[first]]
            some = some[row[first]]
            links, at, met = np.unique(node[some] << 6 | place, return_inverse=True, return_counts=True)
            new = [x for x, n in zip(links.tolist(), met.tolist()) if x not in self.child and self._again(x, n)]
            steps, end = self.steps.flat, self.steps.end
            self._learn([(w, (*skips, int(steps[end[x >> 6] + (x & 63)]))) for x in new for w, skips in (self.made[x >> 6],)], new)
            kids = np.fromiter(map(self.child.get, links.tolist(), repeat(-1)), np.int64, len(links))
            node[some] = kids[at]
            some = some[node[some] >= 0]
            self.uses += np.bincount(node[some], minlength=len(self.uses))

    def _apart(self, words: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of single occurrences one after another, and their counts."""
        out = [b""] * len(words)
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        if short:
            for i, raw in zip(short, self.lockstep.run([words[i] for i in short], keys[short], self.least)):
                out[i] = raw
        v, kept = self.vocabulary, {}
        for i, w in enumerate(words):
            if len(w) > LONG:
                at = w, int(keys[i])
                if at not in kept:
                    kept[at] = b"".join(struct.pack("<i", x) for p in segment(w, v.scores, at[1], self.least) for x in ([v.ids[p]] if p in v.ids else [v.byte_ids[b] for b in p.encode()]))
                out[i] = kept[at]
        return np.frombuffer(b"".join(out), "<i4"), np.fromiter(map(len, out), np.int64, len(out)) // 4

    def encode_all(self, texts: list[str], keys: list[int]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers. ``keys``: 64 bits of each text's row."""
        split = [self._split(t) for t in texts]
        size = np.fromiter(map(len, split), np.int64, len(split))
        words = list(chain.from_iterable(split))
        node = np.fromiter(map(self.root.get, words, repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(node < 0).tolist()
        new = [w for w, n in Counter([words[i] for i in unknown]).items() if len(w) <= LONG and self._again(hash(w), n)]
        self._learn([(w, ()) for w in new], [-1] * len(new))
        node[unknown] = [self.root.get(words[i], -1) for i in unknown]
        self.uses += np.bincount(node[node >= 0], minlength=len(self.uses))
        own = occurrences(np.array(keys, np.uint64), size) if self.least else np.zeros(len(words), np.uint64)
        if self.least:
            self._walk(node, own)
        apart = np.flatnonzero(node < 0)
        node[apart] = len(self.made) + np.arange(len(apart))
        ids = Runs(np.int32)
        ids.flat, ids.end = self.ids.flat, self.ids.end
        ids.add(*self._apart([words[i] for i in apart.tolist()], own[apart]))
        flat, count = ids.take(node)
        raw = flat.astype("<i4", copy=False).tobytes()
        end = (4 * np.concatenate([np.zeros(1, np.int64), np.cumsum(count)])[np.cumsum(size)]).tolist()
        self._trim()
        return [raw[x:y] for x, y in zip([0, *end], end)]

    def encode(self, text: str, key: int = 0) -> bytes:
        return self.encode_all([text], [key])[0]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<i4").tolist())).decode()[1:]


_KEPT: dict[tuple, Coder] = {}


def _kept(coder: Coder) -> Coder:
    """This worker's coder of the same settings, with what it has cached."""
    key = coder.seed, coder.dropout, zlib.crc32(repr([(p, coder.vocabulary.scores.get(p)) for p in coder.vocabulary.pieces]).encode())
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = coder
    return _KEPT[key]


def occurrences(keys: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64 bits for each word of each text, from its text's and its place (the finaliser of SplitMix64)."""
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    x = np.repeat(keys, size) + (place + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def encode(docs: DataFrame, path: str, seed: int = 0, dropout: float = 0.1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and ``ids`` (array of int) of every row. ``path``: the model file, read on the driver."""
    return _run(docs, Coder(Vocabulary.load(path), seed, dropout), id_col, text_col, "ids array<int>", lambda c, raw, ids: (np.frombuffer(ids, "<i4"),), [pa.list_(pa.int32())])


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """Id and ``text`` of every row of ``ids``."""
    coder = Coder(Vocabulary.load(path))
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else coder.decode(np.asarray(x, "<i4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return encoded.select(F.col(id_col).alias("id"), "ids").mapInArrow(lean(run), f"id {kind}, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, seed: int = 0, dropout: float = 0.1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, decode its ids: n_tokens, ids_sha256 (of 32-bit little-endian ids), decoded_sha256, lossless."""

    def both(c: Coder, raw: bytes, ids: bytes) -> tuple:
        back = c.decode(ids).encode()
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest(), back == raw

    kinds = [pa.int64(), pa.string(), pa.string(), pa.bool_()]
    return _run(docs, Coder(Vocabulary.load(path), seed, dropout), id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string, lossless boolean", both, kinds)


def _run(docs: DataFrame, coder: Coder, id_col: str, text_col: str, schema: str, each, kinds: list) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", *(x.split()[0] for x in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch], coder: Coder = coder) -> Iterator[pa.RecordBatch]:
        coder = _kept(coder)
        for batch in batches:
            keys, valid = batch.column(0).to_pylist(), batch.column(1).is_valid().to_pylist()
            data, off = text_buffers(batch.column(1))
            for a, b in slices(off, CHUNK):
                raw = [data[off[i] : off[i + 1]].tobytes() for i in range(a, b)]
                ids = coder.encode_all([r.decode() for r in raw], [xxhash.xxh64_intdigest(str(k), coder.seed & _MASK) for k in keys[a:b]])
                got = [each(coder, r, x) if v else (None,) * len(kinds) for r, x, v in zip(raw, ids, valid[a:b])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(list(c), t) for c, t in zip(zip(*got), kinds))], names=names)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), f"id {kind}, {schema}").withColumnRenamed("id", id_col)
