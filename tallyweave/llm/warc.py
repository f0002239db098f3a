"""Web archives (WARC 1.0): written from pages with revisit records, and read back by verified boundary chains.

Writing: one record a page.  Of the pages with equal payloads the one with the smallest
page_id is a response, the others are revisits without a payload.  Spark's text
writer ends each record with the two line breaks that the format asks for, so
archives are committed like any other output.

Reading: the files are cut at every occurrence of the magic line, in payloads too.  A task follows its part of a file and emits, for each such candidate, where the
next record must begin by the candidate's own header.  Only candidates that are reached from the
start of the file are records: pointers are jumped inside each part, then
between parts.  Parts of a file may be read by different tasks.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyweave.llm.common import is_empty, stored, with_types

MAGIC = b"WARC/1.0\r\n"
BREAK = b"\r\n\r\n"
DATE = "2000-01-01T00:00:00Z"
URN = "urn:page:"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 SHA-1: each 40 bits of the digest are eight letters."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def plan_records(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html (never null), payload_bytes, payload_digest, record_type, refers_to.

    Payloads of fewer than ``least`` bytes are all responses.  Rows that repeat
    the smallest page_id with the same payload are responses too; a null page_id
    comes after all others.
    """
    pages = with_types(pages, page_id="bigint", url="string", html="string").withColumn("html", F.coalesce("html", F.lit("")))
    pages = pages.withColumn("payload_bytes", F.octet_length("html").cast("long"))
    pages = pages.withColumn("payload_digest", base32_sha1(F.col("html").cast("binary")))
    shared = pages.filter(F.col("payload_bytes") >= least).groupBy("payload_digest")
    shared = shared.agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    shared = stored(shared, "shared-payloads")  # two stored sides: the join of a frequent payload can be split
    joined = pages.join(shared, "payload_digest", "left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select(
        "page_id",
        "url",
        "html",
        "payload_bytes",
        "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first_id")).alias("refers_to"),
    )


def _one_line(url: Column) -> Column:
    return F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20\x7f]", "%20")


def write_archives(records: DataFrame, path: str, compression: str = "gzip", most: int = 10_000) -> None:
    """One archive for each task and at most ``most`` records, below ``path``."""
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    response = F.col("record_type") == "response"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), number("payload_bytes"), F.lit("\r\n\r\n"))
    block = F.when(response, F.concat(http, "html")).otherwise(F.lit(""))
    refers = F.concat(
        F.lit(f"WARC-Refers-To: <{URN}"),
        number("refers_to"),
        F.lit(">\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"),
    )
    head = F.concat(
        F.lit(MAGIC.decode() + "WARC-Type: "),
        F.col("record_type"),
        F.lit(f"\r\nWARC-Record-ID: <{URN}"),
        number("page_id"),
        F.lit(f">\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "),
        _one_line(F.col("url")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.col("payload_digest"),
        F.lit("\r\nX-Payload-Bytes: "),
        number("payload_bytes"),
        F.lit("\r\n"),
        F.when(response, F.lit("")).otherwise(refers),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit("\r\n\r\n"),
    )
    text = records.select(F.concat(head, block).alias("value"))
    text.write.option("lineSep", BREAK.decode()).option("compression", compression).option("maxRecordsPerFile", most).text(path)


CHUNK = (
    "file string, part bigint, at bigint, size bigint, bytes bigint, head bigint, length bigint, exit bigint, record_type string, "
    "record_id string, refers string, url string, declared_bytes bigint, declared_digest string, payload_bytes bigint, payload_digest string"
)
KINDS = dict(f.split() for f in CHUNK.split(", "))


def parse_head(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def payload_of(block: bytes) -> bytes:
    """The part of an HTTP message after its head."""
    at = block.find(BREAK)
    return block[at + len(BREAK) :] if at >= 0 else block


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def candidate(content: bytes) -> dict:
    """What the bytes after a magic line say if they begin a record; the payload's digest if they hold all of it."""
    end = content.find(BREAK)
    fields = parse_head(content[:end]) if end >= 0 else {}
    length = fields.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        return {}
    head, length = end + len(BREAK), int(length)
    size = fields.get("x-payload-bytes", "")
    row = {
        "head": head,
        "length": length,
        "record_type": fields.get("warc-type"),
        "record_id": fields.get("warc-record-id"),
        "refers": fields.get("warc-refers-to"),
        "url": fields.get("warc-target-uri"),
        "declared_bytes": int(size) if size.isascii() and size.isdigit() else None,
        "declared_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None,
    }
    if head + length <= len(content):
        payload = payload_of(content[head : head + length])
        row |= {"payload_bytes": len(payload), "payload_digest": digest_of(payload)}
    return row


def local_next(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Index of the candidate that begins at ``after`` (-1: none here); ``at`` ascends."""
    found = np.minimum(np.searchsorted(at, after), len(at) - 1)
    return np.where(at[found] == after, found, -1)


def exits(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Where the chain from each candidate leaves this part, by pointer jumping."""
    step, last = local_next(at, after), np.arange(len(at))
    while (step >= 0).any():
        moving = step >= 0
        last[moving] = last[step[moving]]
        step[moving] = step[step[moving]]
    return after[last]


def reached_from(at: np.ndarray, after: np.ndarray, entry: int) -> np.ndarray:
    """Candidates on the chain that enters at offset ``entry``, by pointer jumping."""
    hit = at == entry
    step = local_next(at, after)
    while True:
        to = step[hit]
        to = to[to >= 0]
        grown = hit.copy()
        grown[to] = True
        if (grown == hit).all():
            return hit
        hit, moving = grown, step >= 0
        step = np.where(moving, step[np.maximum(step, 0)], -1)


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """file, part, value: the bytes between magic lines, in file order within each part."""
    lines = spark.read.option("lineSep", MAGIC.decode()).option("recursiveFileLookup", "true").text(path)
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").cast("long").alias("part")]
    return lines.select(*place, F.col("value").cast("binary").alias("value"))


def _walk(batches):
    """(file, part, offset in the part, value) of each chunk, in order."""
    now, at = None, 0
    for batch in batches:
        files, parts, values = (batch.column(c) for c in ("file", "part", "value"))
        for i in range(batch.num_rows):
            key = files[i].as_py(), parts[i].as_py()
            if key != now:
                now, at = key, 0
            value = values[i].as_buffer()
            value = value.to_pybytes() if value is not None else b""
            yield *key, at, value
            at += len(value) + len(MAGIC)


def _scan(batches):
    """Candidates of each part with their exits, once the part is over."""
    schema = pa.schema([(n, pa.string() if k == "string" else pa.int64()) for n, k in KINDS.items()])
    rows, now = [], None

    def finished():
        good = [r for r in rows if r["head"] is not None]
        if good:
            # offsets of the magic lines, as records point at these
            at = np.array([r["at"] - len(MAGIC) for r in good])
            after = np.array([r["at"] + r["head"] + r["length"] + len(BREAK) for r in good])
            for r, e in zip(good, exits(at, after).tolist()):
                r["exit"] = e
        return pa.RecordBatch.from_pylist(rows, schema=schema)

    for file, part, at, value in _walk(batches):
        if (file, part) != now:
            if rows:
                yield finished()
            rows, now = [], (file, part)
        row = dict.fromkeys(KINDS) | {"file": file, "part": part, "at": at, "size": len(value), "bytes": len(value) + len(MAGIC)}
        if part or at:  # what stands before the first magic line of a file follows none
            row |= candidate(value)
        rows.append(row)
    if rows:
        yield finished()


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record that the chain from its file's start reaches.

    file, offset, record_type, record_id, url, refers, payload_bytes,
    payload_digest; of a revisit, the last two are those that its header states.
    Bytes after a record whose successor is missing belong to no record.
    """
    seen = stored(chunks(spark, path).mapInArrow(_scan, CHUNK), "record-candidates")
    sizes = seen.groupBy("file", "part").agg(F.sum("bytes").alias("bytes"))
    before = W.partitionBy("file").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = stored(sizes.select("file", "part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base")), "parts")
    found = seen.filter("head is not null").join(bases, ["file", "part"])
    found = found.withColumn("start", F.col("base") + F.col("at") - len(MAGIC))

    jumps = found.select("file", "start", (F.col("base") + F.col("exit")).alias("to"))
    jumps = stored(jumps.join(jumps.select("file", F.col("start").alias("to")), ["file", "to"], "left_semi"), "jumps")
    entries = bases.filter("part = 0").select("file", F.lit(0).cast("long").alias("start"))
    while True:
        new = entries.join(jumps, ["file", "start"]).select("file", F.col("to").alias("start"))
        new = stored(new.join(entries, ["file", "start"], "left_anti").distinct(), "entries")
        if is_empty(new):
            break
        entries = stored(entries.union(new), "entries")
        twice = jumps.join(jumps.select("file", F.col("start").alias("to"), F.col("to").alias("next")), ["file", "to"])
        jumps = stored(twice.select("file", "start", F.col("next").alias("to")), "jumps")

    # each part is entered at one place at most; a part is as large as one read task
    doors = found.select("file", "part", "start", "base").join(entries, ["file", "start"], "left_semi")
    doors = doors.select("file", "part", (F.col("start") - F.col("base")).alias("entry"))
    inner = found.join(doors, ["file", "part"])

    def mark(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        at = table.column("at").to_numpy() - len(MAGIC)
        after = at + len(MAGIC) + table.column("head").to_numpy() + table.column("length").to_numpy() + len(BREAK)
        return table.filter(pa.array(reached_from(at, after, table.column("entry")[0].as_py())))

    records = stored(inner.groupBy("file", "part").applyInArrow(mark, inner.schema), "records")
    torn = records.filter("payload_bytes is null").select("file", "start", "head", "length")
    if not is_empty(torn):
        mended = _mended(spark, path, bases, torn)
        records = records.join(mended, ["file", "start"], "left")
        records = records.withColumns({c: F.coalesce(c, f"mended_{c}") for c in ("payload_bytes", "payload_digest")})
    revisit = F.col("record_type") == "revisit"
    return records.select(
        "file",
        F.col("start").alias("offset"),
        "record_type",
        "record_id",
        "url",
        "refers",
        F.when(revisit, F.col("declared_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("declared_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
    )


def _mended(spark: SparkSession, path: str, bases: DataFrame, torn: DataFrame) -> DataFrame:
    """Payload size and digest of records whose blocks hold magic lines, from the chunks that they span."""

    def place(batches):
        for file, part, at, value in _walk(batches):
            yield pa.RecordBatch.from_pylist([{"file": file, "part": part, "at": at, "value": value}], schema=PLACED)

    placed = chunks(spark, path).mapInArrow(place, "file string, part bigint, at bigint, value binary").join(bases, ["file", "part"])
    placed = placed.select("file", (F.col("base") + F.col("at")).alias("at"), "value")
    # ``begin``: first byte after the record's magic line
    spans = torn.withColumn("begin", F.col("start") + len(MAGIC)).withColumn("end", F.expr("begin + head + length"))
    own = placed.join(spans, "file").filter((F.col("at") >= F.col("begin")) & (F.col("at") <= F.col("end")))  # at the end: the magic line before it is inside

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        head, length = (table.column(c)[0].as_py() for c in ("head", "length"))
        block = MAGIC.join(table.column("value").to_pylist())[head : head + length]
        payload = payload_of(block)
        whole = len(block) == length
        return pa.table(
            {
                "file": table.column("file")[:1],
                "start": table.column("start")[:1],
                "mended_payload_bytes": pa.array([len(payload) if whole else None], pa.int64()),
                "mended_payload_digest": pa.array([digest_of(payload) if whole else None], pa.string()),
            }
        )

    schema = "file string, start bigint, mended_payload_bytes bigint, mended_payload_digest string"
    return own.groupBy("file", "start").applyInArrow(join, schema)


PLACED = pa.schema([("file", pa.string()), ("part", pa.int64()), ("at", pa.int64()), ("value", pa.binary())])


def page_number(record_id: Column) -> Column:
    """The page_id of a record id that this module wrote; null for any other."""
    return F.regexp_extract(record_id, f"^<{URN}(-?[0-9]+)>$", 1).try_cast("long")
