"""Secrets: fixed patterns, and how many repositories and owners hold a string, over the whole corpus.

One scan finds the patterns' spans and every candidate string: the values of those
spans, and bare tokens with letters and digits.  Candidates are aggregated by
hash: distinct repositories, distinct owners, and whether a pattern names the
string as a credential anywhere.  A string that several owners hold is a widely copied
example; one that few owners hold and that looks random is taken for live.  Two
kinds of bare tokens are added to the patterns' spans:

* ``reuse``: the value of some live-looking ``assign`` or ``access`` span, standing elsewhere without its name;
* ``bare``: a long token of mixed letters and digits that no pattern knows.

A string that more than a thousandth of all occurrences share goes through a
broadcast join (there are fewer than a thousand such strings), all others through a
shuffle, so no hot string lands in one task.
"""

from __future__ import annotations

import re
from hashlib import blake2b

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import arrow_map, slices, stored, with_types

SLICE = 1 << 20
KINDS = ("assign", "access", "hex")
ADDED = ("reuse", "bare")
MOST_OWNERS = 2  # a string with more owners is an example
HOT = 1000  # a string with more than this part of all occurrences is hot

# Fixed patterns.  The guards before runs change no match; they keep long runs linear.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST_VALUE = 12

RUN = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{12,}")
EDGE = "+/_.=-"
PLAIN = re.compile(r"[A-Za-z0-9+=_-]{20,}")
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
DIGITS = re.compile(r"[0-9]+")
LETTER = re.compile(r"[A-Za-z]")


def named_values(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value) of the patterns' spans, by start and kind; offsets are code points."""
    found = []
    low = text.lower()
    if any(n in low for n in NAMES):
        found += [(0, m.start(), m.end(), m.group(1)) for m in ASSIGN.finditer(text) if len(m.group(1)) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(1, m.start(), m.end(), m.group()) for m in ACCESS.finditer(text)]
    found += [(2, m.start(), m.end(), m.group()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda f: (f[1], f[0]))


def live_looking(value: str) -> bool:
    """At least 8 different characters, a digit and a letter among them: no placeholder of repeated or plain characters."""
    return len(set(value)) >= 8 and bool(DIGITS.search(value)) and bool(LETTER.search(value))


def random_looking(token: str) -> bool:
    """At least 20 characters, 10 different ones, digits in 4 places, no slash or dot, and not the form of a UUID."""
    return bool(PLAIN.fullmatch(token)) and len(set(token)) >= 10 and len(DIGITS.findall(token)) >= 4 and bool(LETTER.search(token)) and not UUID.fullmatch(token)


def bare_tokens(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str]]:
    """(start, end, token) of tokens of 12 or more characters with a digit and a letter that touch no base span; marks around them are left off."""
    out, at, reached = [], 0, 0
    for m in RUN.finditer(text):
        token = m.group().lstrip(EDGE)
        start = m.end() - len(token)
        token = token.rstrip(EDGE)
        end = start + len(token)
        if len(token) < LEAST_VALUE or not DIGITS.search(token) or not LETTER.search(token):
            continue
        # both lists ascend; the furthest end of the spans that begin before the token's end tells whether one touches it
        while at < len(base) and base[at][1] < end:
            reached = max(reached, base[at][2])
            at += 1
        if reached <= start:
            out.append((start, end, token))
    return out


def _hash(value: str) -> bytes:
    return blake2b(value.strip(EDGE).encode(), digest_size=16).digest()


CANDIDATE = "kind int, start int, end int, hash binary, live boolean"


def scan(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The columns of ``carry`` with base (kind, start, end) and candidates (kind 0 to 2 for the base spans' values, 3 for bare tokens) of each row."""

    def one(batch):
        for part in slices(batch, "text", SLICE):
            base, candidates = [], []
            for text in part.column("text"):
                text = text.as_py() or ""
                own = named_values(text)
                base.append([{"start": a, "kind": k, "end": b} for k, a, b, _ in own])
                rows = [{"kind": k, "start": a, "end": b, "hash": _hash(v), "live": live_looking(v)} for k, a, b, v in own]
                rows += [{"kind": 3, "start": a, "end": b, "hash": _hash(t), "live": random_looking(t)} for a, b, t in bare_tokens(text, own)]
                candidates.append(rows)
            yield {n: part.column(n) for n in carry} | {"base": base, "candidates": candidates}

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in carry)
    return arrow_map(docs, one, f"{fields}, base array<struct<start:int,kind:int,end:int>>, candidates array<struct<{CANDIDATE.replace(' ', ':').replace(',:', ',')}>>")


def ownership(occurrences: DataFrame) -> DataFrame:
    """hash, n (occurrences), n_repositories, n_owners, named (a live-looking value of an assign or access span somewhere).

    ``occurrences``: hash, owner, repository, kind, live.  Counting goes by
    (hash, owner, repository), then (hash, owner), then hash, each with partial sums, so a
    string in a third of all documents is a few rows a task.  A null owner or repository is one more.
    """
    named = F.max((F.col("kind") < 2) & F.col("live")).alias("named")
    held = occurrences.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"), named)
    owners = held.groupBy("hash", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("n_repositories"), F.max("named").alias("named"))
    return owners.groupBy("hash").agg(
        F.sum("n").alias("n"), F.sum("n_repositories").alias("n_repositories"), F.count("*").alias("n_owners"), F.max("named").alias("named")
    )


def find(docs: DataFrame, repository: str = "doc_id", owner: str = "source", most_owners: int = MOST_OWNERS, carry: dict[str, str] | None = None) -> DataFrame:
    """doc_id and the columns of ``carry`` of every row, with base and spans (start, kind, end; by start and kind), n_live and n_examples.

    ``repository`` and ``owner`` name the columns that say where a row comes from;
    a missing column is null.  Spans of any kind count as live if their string looks
    random and has at most ``most_owners`` owners, as examples if it has more.
    Null and empty texts have no spans.  Repeated rows are rows of their own with the same spans;
    as they share repository and owner, they make no string more widely held.
    """
    carry = carry or {}
    have = {n.lower(): f"`{n}`" for n in docs.columns}
    side = [F.col(have[n.lower()]).cast("string").alias(a) if n.lower() in have else F.lit(None).cast("string").alias(a) for a, n in (("_repository", repository), ("_owner", owner))]
    typed = with_types(docs.select("*", *side), **({"doc_id": "bigint", "text": "string", "_repository": "string", "_owner": "string"} | carry))
    keep = ["doc_id", "_repository", "_owner", *carry]
    scanned = stored(scan(typed, keep).withColumn("_row", F.monotonically_increasing_id()), "secret-candidates")

    found = scanned.filter(F.size("candidates") > 0).select("_row", F.col("_owner").alias("owner"), F.col("_repository").alias("repository"), F.inline("candidates"))
    known = stored(ownership(found), "secret-owners")
    total = known.agg(F.sum("n")).first()[0] or 0
    hot = known.filter(F.col("n") * HOT > total).select("hash", "n_owners", "named")
    hot = F.broadcast(hot)  # fewer than HOT rows, as each has more than that part of the total
    occurrence = found.select("_row", "kind", "start", "end", "hash", "live")
    rest = occurrence.join(hot, "hash", "left_anti").join(known.select("hash", "n_owners", "named"), "hash")
    judged = occurrence.join(hot, "hash").unionByName(rest)

    own = F.col("n_owners") <= most_owners
    added = (F.col("kind") == 3) & own & (F.col("named") | F.col("live"))
    live = own & F.when(F.col("kind") == 3, added).otherwise(F.col("live"))
    span = F.struct("start", F.when(F.col("named"), 3).otherwise(4).alias("kind"), "end")
    # one row a document, its own spans only
    by_row = judged.filter((F.col("kind") < 3) | added).groupBy("_row").agg(
        F.collect_list(F.when(added, span)).alias("added"),
        F.sum(live.cast("long")).alias("n_live"),
        F.sum((~own & (F.col("kind") < 3)).cast("long")).alias("n_examples"),
    )
    joined = scanned.drop("candidates", "_repository", "_owner").join(by_row, "_row", "left")
    spans = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    counts = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("n_live", "n_examples")]
    return joined.select("doc_id", *carry, "base", spans.alias("spans"), *counts)


def listed(spans: str) -> F.Column:
    """kind:start:end of the spans in order, joined by commas."""
    names = F.array(*[F.lit(k) for k in (*KINDS, *ADDED)])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def number(kind: int) -> F.Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
