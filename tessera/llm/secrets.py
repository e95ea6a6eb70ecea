"""Secret scans: keyword automaton, anchored expressions near its hits, checksums.

An Aho-Corasick automaton runs over each whole text once; expressions are tried only
where a keyword stands, anchored there. Kinds without a keyword (long hex runs) are
prefiltered by a byte map and a search. Kinds that embed a checksum count only when it
holds: ``github`` and ``npm`` (base-62 CRC-32 in the last six characters), ``xprv``
(base-58 with a double SHA-256). No shuffle; one batch of texts is in memory at a time.

Offsets are code points, ends exclusive. Null and empty texts have no spans. Spans of
different kinds may overlap; those of one kind never do. Repeated rows are scanned alike.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, slices, text_buffers

CHUNK = 2 << 20
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
#: Kinds in order; the base's come first.
KINDS = ["assign", "access", "hex", "github", "npm", "xprv"]
BASE = 3
#: Keyword, kind, whether its letters may be in either case.
KEYWORDS = [
    ("password", "assign", True), ("passwd", "assign", True), ("secret", "assign", True), ("token", "assign", True), ("apikey", "assign", True), ("api_key", "assign", True),
    ("AKIA", "access", False), ("ghp_", "github", False), ("gho_", "github", False), ("ghu_", "github", False), ("ghs_", "github", False), ("ghr_", "github", False),
    ("npm_", "npm", False), ("xprv", "xprv", False),
]
#: The expression of each kind, and of the group whose length counts, the least.
PATTERNS = {
    "assign": (re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 1, 8),
    "access": (re.compile(rb"(AKIA[A-Z0-9]+)"), 1, 16),
    "github": (re.compile(rb"(gh[opsur]_[A-Za-z0-9]{36})(?![A-Za-z0-9])"), 1, 40),
    "npm": (re.compile(rb"(npm_[A-Za-z0-9]{36})(?![A-Za-z0-9])"), 1, 40),
    "xprv": (re.compile(rb"(xprv[1-9A-HJ-NP-Za-km-z]{107})(?![0-9A-Za-z])"), 1, 111),
}
HEX = re.compile(rb"[0-9a-f]{32,}")
HEX_MAP = bytes(49 if x in b"0123456789abcdef" else 48 for x in range(256))


def crc_base62(token: bytes) -> bool:
    """The last six characters are the CRC-32 of those after the prefix, in base 62."""
    body, tail = token[4:-6], token[-6:].decode()
    value, digits = zlib.crc32(body), ""
    for _ in range(6):
        value, d = divmod(value, 62)
        digits = BASE62[d] + digits
    return digits == tail


def base58check(token: bytes) -> bool:
    """The last four of its 82 bytes begin the double SHA-256 of the others."""
    value = 0
    for ch in token.decode():
        value = value * 58 + BASE58.index(ch)
    if value.bit_length() > 82 * 8:
        return False
    raw = value.to_bytes(82, "big")
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


CHECKS: dict[str, Callable[[bytes], bool]] = {"github": crc_base62, "npm": crc_base62, "xprv": base58check}


@cache
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, kind, _ in KEYWORDS:
        found.add_word(word.lower(), (len(word), kind))
    found.make_automaton()
    return found


def scan(text: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans of a UTF-8 text, by start, then kind."""
    return _points(text, _scan(text, automaton()))


def _scan(text: bytes, words) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) in bytes."""
    spans = []
    free = dict.fromkeys(KINDS, 0)
    hits = sorted((end + 1 - n, kind) for end, (n, kind) in words.iter(text.lower().decode("latin-1")))
    for at, kind in hits:
        if at < free[kind]:
            continue
        pattern, group, least = PATTERNS[kind]
        m = pattern.match(text, at)
        if m is None:
            continue
        check = CHECKS.get(kind)
        if check is None or check(m[group]):
            free[kind] = m.end()
            if len(m[group]) >= least:
                spans.append((m.start(), KINDS.index(kind), m.end()))
    if b"1" * 32 in text.translate(HEX_MAP):
        spans += [(m.start(), KINDS.index("hex"), m.end()) for m in HEX.finditer(text)]
    spans.sort()
    return spans


def _points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[str, int, int]]:
    if text.isascii():
        return [(KINDS[k], a, b) for a, k, b in spans]
    out, at, points = [], 0, 0
    for a, k, b in spans:
        points += len(text[at:a].decode())
        at = a
        out.append((KINDS[k], points, points + b - a))  # the patterns are ASCII
    return out


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and ``spans``: array of (kind, start, end), one row per row of ``docs``."""
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_buffers(batch.column(1))
            for a, b in slices(off, CHUNK):
                found = [[dict(zip(("kind", "start", "end"), s)) for s in scan(data[off[i] : off[i + 1]].tobytes())] for i in range(a, b)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(found, span)], names=["id", "spans"])

    return (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
        .mapInArrow(lean(run), f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")
        .withColumnRenamed("id", id_col)
    )


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span, overlapping ones together, replaced by ``<SECRET>``; all
    columns and rows stay, null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = automaton()
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = batch.column(at)
            new = None
            data, off = text_buffers(texts)
            for i in range(len(texts)):
                text = data[off[i] : off[i + 1]].tobytes()
                if spans := _scan(text, words):
                    new = texts.to_pylist() if new is None else new
                    parts, end = [], 0
                    for a, _, b in spans:
                        if a >= end:
                            parts += [text[end:a], b"<SECRET>"]
                        end = max(end, b)
                    new[i] = b"".join([*parts, text[end:]]).decode()
            yield batch if new is None else batch.set_column(at, batch.schema.field(at), pa.array(new, texts.type))

    return docs.mapInArrow(lean(run), docs.schema)


def listed(spans: F.Column) -> F.Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
