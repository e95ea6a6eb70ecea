"""WARC archives with one Zstandard frame per record and the dictionary in a skippable frame.

Writing: payloads of at least ``REVISIT_BYTES`` bytes that are equal share one response, that
of the smallest id; the others become revisits of it. The choice is made over (id, digest)
rows. The table of repeated digests is broadcast if it is counted to be small, so payloads stay
where they are; else payloads are shuffled once, salted by ``SALT_ROWS`` rows, so that a digest of a
third of all rows is not one task. Each task streams records into archives of about ``ARCHIVE_BYTES``; a file's
name has the task attempt, and only files in the committed manifest are read, so a lost
executor leaves no doubtful archive.

Reading: the dictionary comes from the leading skippable frame (raw or compressed); frames
are found by walking their block headers, each must hold exactly one record, and headers,
lengths and digests are validated. Memory is one buffer and the largest record.

The dictionary is trained on at most ``SAMPLES`` payload heads of ``SAMPLE_BYTES`` bytes.

Null payloads are empty; null urls write no WARC-Target-URI; control characters in a url are
percent-encoded. Rows that share an id keep a record each. An empty table gives no archive.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch_path, stored
from .decontaminate import _small

SKIPPABLE, ZSTD, DICTIONARY = 0x184D2A5D, b"\x28\xb5\x2f\xfd", b"\x37\xa4\x30\xec"
REVISIT_BYTES, ARCHIVE_BYTES, SAMPLES, SAMPLE_BYTES, DICT_BYTES, SALT_ROWS = 100, 32 << 20, 256, 8192, 32 << 10, 1 << 20
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
URN = "<urn:page:{}>"
#: tasks of a read, at most; a task then takes several archives, one after the other
MOST_TASKS = 20_000


def record(kind: str, page: int | None, url: str | None, payload: bytes, digest: str, size: int, refers: int | None, date: str) -> bytes:
    block = HTTP + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {URN.format(page)}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {URN.format(refers)}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The one record of a frame; ValueError where a header, length or digest is wrong."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("not a WARC record")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name:
            raise ValueError(f"bad header line {line!r}")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"no {name}")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("Content-Length does not match the frame")
    http, gap, payload = rest[:-4].partition(b"\r\n\r\n")
    if not gap or not http.startswith(b"HTTP/"):
        raise ValueError("no HTTP header")
    kind, digest = fields["warc-type"], fields.get("warc-payload-digest", "")
    if kind not in ("response", "revisit") or not re.fullmatch("sha256:[0-9a-f]{64}", digest):
        raise ValueError("bad type or digest")
    if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest[7:] or fields.get("x-payload-length", str(len(payload))) != str(len(payload))):
        raise ValueError("the payload does not match its digest or length")
    if kind == "revisit" and (payload or "warc-refers-to" not in fields or not fields.get("x-payload-length", "").isdigit()):
        raise ValueError("bad revisit")
    return fields | {"payload": payload, "digest": digest[7:]}


def frame_end(buf: bytes | bytearray, at: int) -> int:
    """Where the Zstandard frame at ``at`` ends, or -1 if the buffer ends first."""
    if len(buf) < at + 5:
        return -1
    if buf[at : at + 4] != ZSTD:
        raise ValueError("no Zstandard frame")
    flags = buf[at + 4]
    single = flags >> 5 & 1
    at += 5 + (0 if single else 1) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
    while True:
        if len(buf) < at + 3:
            return -1
        head = int.from_bytes(buf[at : at + 3], "little")
        at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            at += 4 * (flags >> 2 & 1)
            return at if len(buf) >= at else -1


def frames(stream, step: int = 4 << 20) -> Iterator[bytes]:
    """Decoded frames of an archive, one at a time."""
    import zstandard

    buf, at, book, first = bytearray(), 0, None, True
    while True:
        if len(buf) - at >= 8 and int.from_bytes(buf[at : at + 4], "little") >> 4 == SKIPPABLE >> 4:
            size = int.from_bytes(buf[at + 4 : at + 8], "little")
            end = at + 8 + size if len(buf) >= at + 8 + size else -1
            if end > 0:
                if first and int.from_bytes(buf[at : at + 4], "little") == SKIPPABLE:
                    raw = bytes(buf[at + 8 : end])
                    if raw[:4] == ZSTD:
                        raw = zstandard.ZstdDecompressor().decompress(raw)
                    if raw[:4] != DICTIONARY:
                        raise ValueError("the leading frame holds no dictionary")
                    book = zstandard.ZstdCompressionDict(raw)
                at, first = end, False
                decoder = zstandard.ZstdDecompressor(dict_data=book)
                continue
        elif len(buf) - at >= 8:
            end = frame_end(buf, at)
            if end > 0:
                if first:
                    decoder, first = zstandard.ZstdDecompressor(), False
                yield decoder.decompressobj().decompress(bytes(buf[at:end]))
                at = end
                continue
        more = stream.read(step)
        if not more:
            if at != len(buf):
                raise ValueError("the archive ends inside a frame")
            return
        buf = buf[at:] + more
        at = 0


def train(samples: list[bytes]) -> bytes:
    """A dictionary, or nothing where the samples are too few for one."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes() if len(samples) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def _file_system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write archives below ``folder``; the committed manifest: path, n_records, n_bytes."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("size"))
    # heads are picked by a hash of the digest, thinned before any head is moved; equal payloads count once
    n = rows.filter("size > 0").count()
    key = F.xxhash64("digest")
    some = rows.filter((F.col("size") > 0) & (F.pmod(key, F.lit(1 << 30)) < int(min(1.0, 4 * SAMPLES / max(n, 1)) * (1 << 30)))).groupBy(key.alias("key")).agg(F.first(F.substring("payload", 1, SAMPLE_BYTES)).alias("head"))
    book = train([bytes(r["head"]) for r in some.orderBy("key").limit(SAMPLES).collect()])
    firsts = rows.filter(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    salts = 1 + n // SALT_ROWS
    salted = _small(stored(firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), "firsts"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).join(salted, ["digest", "salt"], "left")
    rows = rows.select("id", "url", "payload", "digest", "size", F.when(F.col("first") != F.col("id"), F.col("first")).alias("refers"))
    fs, base = _file_system(folder)
    fs.create_dir(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, base = _file_system(folder)
        encoder = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(book) if book else None, write_checksum=True)
        lead = zstandard.ZstdCompressor().compress(book) if book else b""
        out, name, n, size, k = None, "", 0, 0, 0
        done = []

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                done.append((name, n, size))
                out = None

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name = f"{base}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{k:03d}.warc.zst"
                    out, n, size, k = fs.open_output_stream(name), 0, 0, k + 1
                    if book:
                        size += out.write(struct.pack("<II", SKIPPABLE, len(lead)) + lead)
                kind = "response" if row["refers"] is None else "revisit"
                size += out.write(encoder.compress(record(kind, row["id"], row["url"], row["payload"], row["digest"], row["size"], row["refers"], date)))
                n += 1
                if size >= ARCHIVE_BYTES:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*done)) or [[], [], []], (pa.string(), pa.int64(), pa.int64()))], names=["path", "n_records", "n_bytes"])

    manifest = folder + "/manifest"
    rows.mapInArrow(run, "path string, n_records long, n_bytes long").write.mode("error").parquet(manifest)
    return spark.read.schema("path string, n_records long, n_bytes long").parquet(manifest)


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """All records of the archives that the manifest names, validated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _file_system(folder)
        number = lambda urn: None if urn is None or (x := urn.removeprefix("<urn:page:").removesuffix(">")) == "None" else int(x)
        kinds = {"id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())], names=list(kinds))

        for batch in batches:
            for path, n in zip(batch.column("path").to_pylist(), batch.column("n_records").to_pylist()):
                rows, size, seen = [], 0, 0
                with fs.open_input_stream(path) as stream:
                    for raw in frames(stream):
                        r = parse(raw)
                        rows.append((number(r["warc-record-id"]), r.get("warc-target-uri"), r["warc-type"], int(r["x-payload-length"]) if "x-payload-length" in r else len(r["payload"]), r["digest"], number(r.get("warc-refers-to")), r["payload"]))
                        size, seen = size + len(raw), seen + 1
                        if size > 8 << 20:
                            yield made(rows)
                            rows, size = [], 0
                if seen != n:
                    raise ValueError(f"{path} has {seen} records, the manifest {n}")
                if rows:
                    yield made(rows)

    # round robin by a given count: each archive gets a task of its own, which adaptive execution leaves alone
    return manifest.repartition(max(1, min(manifest.count(), MOST_TASKS))).mapInArrow(run, "id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def round_trip(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Write ``pages`` into the shared folder and read the archives back."""
    folder = scratch_path(pages.sparkSession, "warc")
    return read(write(pages, folder, id_col), folder).withColumnRenamed("id", id_col)
