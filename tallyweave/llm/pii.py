"""Personal data: fixed patterns, and a skip-chain conditional random field that adds what they miss.

The field's nodes are the tokens of a text that hold a digit or an at sign.  A
node's own potential comes from its form; neighbours in the text share a chain
potential, and distant tokens of the same number or the same address share a skip
potential (Sutton and McCallum, 2004).  Credentials are a label of their own, seeded by the patterns
of the secret scan where the value looks random.  A number may be spread over neighbouring
tokens and a phone number may lack its first digits; all occurrences are linked to the
first one, so any two are two links apart.  Loopy sum-product messages run over all
nodes of many texts at once.  Weights come from pseudo-likelihood over all documents, with the patterns' own
spans as labels: Spark counts how often each form stands beside each neighbours' labels, and
the fit reads the counts.  So a number that the patterns accept in one place
speaks for its other, differently written occurrences.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import arrow_map, arrow_stream, slices, with_types
from tallyweave.llm.secrets import live_looking, named_values
from tallyweave.llm.words import sums, text_bytes

SLICE = 1 << 20
BLOCK = 1 << 15  # links whose messages are computed at a time
CONFIGURATIONS = 1 << 16  # kinds of token and surroundings, the most frequent ones, whose counts the weights are fitted to
ROUNDS, STEPS, RATE, DECAY = 10, 300, 0.5, 1e-3
KINDS = ("email", "ip", "card", "phone")
LABELS = (*KINDS, "secret")  # the last one is found by the method only
SECRET = len(KINDS)

# Fixed patterns.  The guards before digits and the possessive repeats change no match; they keep long digit runs linear.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"[^\s]+")
DIGITS = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    total += sum(2 * int(d) - 9 * (d > "4") for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str):
    """Leftmost matches without overlap, from one at sign to the next."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL.match(text, start - 1):
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            yield start, match.end()
            done = match.end()
        at = text.find("@", max(at + 1, done))


def digits_of(text: str) -> str:
    return "".join(DIGITS.findall(text))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind and start; offsets are code points."""
    found = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            found.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = digits_of(m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 9 <= len(digits_of(m.group())) <= 15:
            found.append((3, m.start(), m.end()))
    return found


def disjoint(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the places that the spans cover together."""
    starts, ends = [], []
    for _, a, b in sorted(spans, key=lambda s: s[1:]):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def touched(places: tuple[list[int], list[int]], a: int, b: int) -> bool:
    k = bisect_left(places[0], b) - 1
    return k >= 0 and places[1][k] > a


def seeds(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Values of credentials that look random, apart from the base spans and from each other."""
    out, covered, done = [], None, 0
    for kind, _, end, value in named_values(text):
        start = end - len(value)
        if start < done or not (kind == 1 or live_looking(value)):
            continue
        covered = covered or disjoint(base)
        if not touched(covered, start, end):
            out.append((SECRET, start, end))
            done = end
    return out


class Nodes(NamedTuple):
    span: list[tuple[int, int]]  # core of each token
    form: list[list[int]]  # feature numbers
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]


N_FORMS = 43


def forms(token: str) -> list[int]:
    """What a token looks like, as feature numbers below N_FORMS; its digits' values count only in the check sum."""
    digits = digits_of(token)
    n, rest = len(digits), DIGITS.sub("", token)
    parts = token.split(".")
    out = [0, 1 + min(n, 20)]
    marks = (
        "@" in token,
        "@" in token and "." in token.partition("@")[2],
        token[:1] == "+",
        "(" in token or ")" in token,
        "-" in token,
        len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts),
        rest == "",
        any(c.isalpha() for c in rest),
        13 <= n <= 19 and luhn(digits),
        all(c in "-().+" for c in rest),
        len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts),
        bool(re.fullmatch(r"\(?[0-9]{2,4}\)?", token)),
        bool(re.fullmatch(r"[0-9]{3,4}-[0-9]{3,4}", token)),
        "=" in token or '"' in token,
        len(token) >= 16 and n >= 2 and len(rest) >= 4 and rest.isalnum(),
        len(token) >= 16 and set(token.lower()) <= set("0123456789abcdef") and rest != "",
        token[:4] == "AKIA",
    )
    return out + [22 + k for k, m in enumerate(marks) if m]


def core(text: str, start: int, end: int) -> tuple[int, int]:
    """The token without punctuation around it."""
    while end > start and not (text[end - 1].isalnum() or text[end - 1] == ")" and "(" in text[start:end]):
        end -= 1
    while start < end and not (text[start].isalnum() or text[start] in "+("):
        start += 1
    return start, end


MOST_PARTS = 5  # tokens that one number is spread over
PART = re.compile(r"[+(]?[0-9][0-9().-]*")


def number_keys(parts: list[str]) -> list[str]:
    """What the number in these tokens, read together, is called elsewhere: its digits, or a phone number's last 10 or 7.

    The last digits count only where each token holds some of them, so that the
    tokens before them stay with the longer key.
    """
    joined = "".join(parts)
    n, least = len(joined), 4 if len(parts) == 1 else 7
    keys = [joined] if n >= least and (len(parts) == 1 or n <= 19) else []
    return keys + [joined[-k:] for k in (10, 7) if k < n <= 15 and n - len(parts[0]) < k]


def nodes_of(text: str) -> Nodes:
    spans, form, chain, skip, hub, before = [], [], [], {}, {}, -2
    open_parts: list[str] = []  # digits of the tokens just before that may begin the number that the next one goes on with
    for number, m in enumerate(TOKEN.finditer(text)):
        token = m.group()
        if not ("@" in token or DIGITS.search(token)):
            continue
        a, b = core(text, *m.span())
        if a == b:
            continue
        i = len(spans)
        spans.append((a, b))
        form.append(forms(text[a:b]))
        if number == before + 1:
            chain.append((i - 1, i))
        else:
            open_parts = []
        before = number
        token = text[a:b]
        digits = digits_of(token)
        if "@" in token:
            keys = [(1, token.lower())]
            open_parts = []
        else:
            part = bool(PART.fullmatch(token))
            # a plus sign begins a number, and a mark before a token parts it from the one before
            if not part or token[0] == "+" or a > m.start():
                open_parts = []
            open_parts = [*open_parts[1 - MOST_PARTS :], digits]
            keys = [(n, key) for n in range(1, len(open_parts) + 1) for key in number_keys(open_parts[-n:])]
            if not part or b < m.end():
                open_parts = []
        # each token of an occurrence is linked to the last one of the first occurrence: as many links as tokens, not their square
        for n, key in keys:
            if key not in hub:
                hub[key] = i, n
                continue
            centre, size = hub[key]
            if centre <= i - n and size > 1:
                skip |= dict.fromkeys((k, centre) for k in range(centre - size + 1, centre))
                hub[key] = centre, 1
            if centre <= i - n:
                skip |= dict.fromkeys((centre, k) for k in range(i - n + 1, i + 1))
    return Nodes(spans, form, chain, list(skip))


def labels_of(nodes: Nodes, base: list[tuple[int, int, int]]) -> list[int]:
    """0 for none, else 1 + kind, of tokens whose core lies in a span, or holds a credential."""
    out, starts = [0] * len(nodes.span), [a for a, _ in nodes.span]
    for kind, start, end in base:
        i = bisect_left(starts, start)
        if kind == SECRET and i and nodes.span[i - 1][1] > start:
            i -= 1
        while i < len(starts) and starts[i] < end:
            if nodes.span[i][1] <= end or kind == SECRET:
                out[i] = 1 + kind
            i += 1
    return out


class Field(NamedTuple):
    unary: np.ndarray  # forms x labels
    chain: np.ndarray  # labels x labels
    skip: np.ndarray  # labels: weight of agreeing on each


N_LABELS = 1 + len(LABELS)


def form_matrix(form: list[list[int]]) -> np.ndarray:
    out = np.zeros((len(form), N_FORMS))
    for i, own in enumerate(form):
        out[i, own] = 1
    return out


def pairs(links: list) -> np.ndarray:
    return np.array(links, np.int64).reshape(-1, 2)


def surroundings(nodes: Nodes, label: list[int]) -> list[bytes]:
    """For each node its label, the labels before and after it (0 for none, else 1 + label), the links to each label (at most 255) and its forms, as bytes."""
    before, after = [0] * len(label), [0] * len(label)
    for x, y in nodes.chain:
        before[y], after[x] = 1 + label[x], 1 + label[y]
    friends = [bytearray(N_LABELS) for _ in label]
    for x, y in nodes.skip:
        friends[x][label[y]] = min(255, friends[x][label[y]] + 1)
        friends[y][label[x]] = min(255, friends[y][label[x]] + 1)
    return [bytes((own, b, a)) + f + bytes(form) for own, b, a, f, form in zip(label, before, after, friends, nodes.form)]


def fit(configurations: list[bytes], counts: list[int]) -> Field:
    """Weights by gradient steps on the pseudo-likelihood: each label given its neighbours' true ones, configurations weighed by their counts."""
    n = len(configurations)
    x, one = np.zeros((n, N_FORMS)), np.eye(N_LABELS)
    head = np.array([list(c[: 3 + N_LABELS]) for c in configurations], np.int64).reshape(n, 3 + N_LABELS)
    for i, c in enumerate(configurations):
        x[i, list(c[3 + N_LABELS :])] = 1
    beside = np.concatenate([np.zeros((1, N_LABELS)), one])
    truth, before, after, friends = one[head[:, 0]], beside[head[:, 1]], beside[head[:, 2]], head[:, 3:].astype(float)
    share = np.array(counts, float).reshape(n, 1)
    share /= max(share.sum(), 1)
    w, c, s = np.zeros((N_FORMS, N_LABELS)), np.zeros((N_LABELS, N_LABELS)), np.zeros(N_LABELS)
    for _ in range(STEPS if n else 0):
        score = x @ w + before @ c + after @ c.T + friends * s
        p = np.exp(score - score.max(1, keepdims=True))
        error = (truth - p / p.sum(1, keepdims=True)) * share
        w += RATE * (x.T @ error * 4 - DECAY * w)
        c += RATE * (before.T @ error + error.T @ after - DECAY * c)
        s = np.maximum(0, s + RATE * ((friends * error).sum(0) * 4 - DECAY * s))
    return Field(w, c, s)


def beliefs(field: Field, form: list[list[int]], chain: list, skip: list) -> np.ndarray:
    """Marginal of each label at each node after a fixed number of damped sum-product rounds."""
    unary = form_matrix(form) @ field.unary
    links = np.concatenate([pairs(chain), pairs(skip)])
    if len(links):
        agree = np.diag(field.skip)
        source = np.concatenate([links[:, 0], links[:, 1]])
        target = np.concatenate([links[:, 1], links[:, 0]])
        at = np.cumsum([0, len(chain), len(skip), len(chain), len(skip)])
        potential = list(zip(at[:-1], at[1:], (field.chain, agree, field.chain.T, agree)))  # source label x target label
        message = np.zeros((len(source), N_LABELS))
        for _ in range(ROUNDS):
            total = unary.copy()
            np.add.at(total, target, message)
            new = np.empty_like(message)
            for first, last, matrix in potential:
                for low in range(first, last, BLOCK):
                    part = slice(low, min(low + BLOCK, last))
                    back = np.arange(part.start, part.stop)
                    back += len(links) if first < len(links) else -len(links)
                    inner = (total[source[part]] - message[back])[:, :, None] + matrix
                    top = inner.max(1)
                    new[part] = top + np.log(np.exp(inner - top[:, None, :]).sum(1))
            message = 0.5 * message + 0.5 * (new - new.max(1, keepdims=True))
        np.add.at(unary, target, message)
    p = np.exp(unary - unary.max(1, keepdims=True)) if len(unary) else unary
    return p / p.sum(1, keepdims=True) if len(p) else p


def added_spans(text: str, nodes: Nodes, belief: np.ndarray, base: list[tuple[int, int, int]], least: float = 0.5) -> list[tuple[int, int, int]]:
    """Spans of tokens that the field labels and no base span touches, if they can be of that kind at all."""
    label = np.where(belief.max(1) >= least, belief.argmax(1), 0)
    joined, covered = {b: a for a, b in nodes.chain}, disjoint(base)
    runs: list[list] = []
    for i, (a, b) in enumerate(nodes.span):
        if not label[i] or touched(covered, a, b):
            continue
        # the parts of a phone number may be tokens of their own
        if label[i] == 4 and runs and runs[-1][0] == 3 and runs[-1][3] == joined.get(i):
            runs[-1][2:] = [b, i]
        else:
            runs.append([label[i] - 1, a, b, i])
    out = []
    for kind, a, b, _ in runs:
        token, digits = text[a:b], digits_of(text[a:b])
        right = (
            bool(re.search(r"[^@]@[^@]", token)),
            len(token.split(".")) == 4 and len(digits) >= 4,
            13 <= len(digits) <= 19,
            7 <= len(digits) <= 15,
            len(token) >= 16 and live_looking(token),
        )
        if right[kind]:
            out.append((int(kind), a, b))
    return out


def _texts(part) -> list[tuple[int, str]]:
    """Rows whose text has a digit, an at sign or the start of an access key; no other text can hold a span."""
    buffer, at = text_bytes(part.column("text"))
    hits = sums(((buffer >= 48) & (buffer <= 57)) | (buffer == 64), at) > 0
    hits |= pc.fill_null(pc.match_substring(part.column("text"), "AKIA"), False).to_numpy(zero_copy_only=False)
    return [(int(i), part.column("text")[int(i)].as_py()) for i in np.flatnonzero(hits)]


def learn(docs: DataFrame, configurations: int = CONFIGURATIONS) -> Field:
    """A field fitted to all documents: to the counts of its tokens' forms and neighbours' labels.

    The driver receives one row for each of the ``configurations`` most frequent
    combinations, however many documents there are.
    """

    def one(batches):
        counts: Counter = Counter()
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                for _, text in _texts(part):
                    nodes, base = nodes_of(text), base_spans(text)
                    counts.update(surroundings(nodes, labels_of(nodes, base + seeds(text, base))))
                if len(counts) > 4 * CONFIGURATIONS:
                    yield {"configuration": list(counts.keys()), "n": list(counts.values())}
                    counts.clear()
        yield {"configuration": list(counts.keys()), "n": list(counts.values())}

    rows = arrow_stream(with_types(docs, text="string"), one, "configuration binary, n bigint").groupBy("configuration").agg(F.sum("n").alias("n"))
    rows = rows.orderBy(F.desc("n"), "configuration").limit(configurations).toArrow()
    return fit(rows.column("configuration").to_pylist(), rows.column("n").to_pylist())


def found_in(part, field: Field) -> tuple[list, list]:
    """Base spans and all spans, sorted, of each text of a batch."""
    base: list = [[] for _ in range(part.num_rows)]
    every: list = [[] for _ in range(part.num_rows)]
    form, chain, skip, kept = [], [], [], []
    for i, text in _texts(part):
        base[i] = base_spans(text)
        nodes = nodes_of(text)
        kept.append((i, text, nodes, len(form)))
        chain += [(len(form) + a, len(form) + b) for a, b in nodes.chain]
        skip += [(len(form) + a, len(form) + b) for a, b in nodes.skip]
        form += nodes.form
    belief = beliefs(field, form, chain, skip)
    for i, text, nodes, first in kept:
        known = base[i] + seeds(text, base[i])
        more = added_spans(text, nodes, belief[first : first + len(nodes.span)], known)
        every[i] = sorted(known + more)
    return base, every


def as_rows(spans: list[list[tuple]]) -> list[list[dict]]:
    return [[{"kind": LABELS[k], "start": a, "end": b} for k, a, b in own] for own in spans]


def find(docs: DataFrame, field: Field, carry: dict[str, str] | None = None) -> DataFrame:
    """doc_id, text and the columns of ``carry`` of every row of ``docs``, with base and spans (kind, start, end; by kind and start).

    Null and empty texts have no spans; repeated rows have the same ones; a text of any length takes time in proportion to it.
    """
    carry = carry or {}
    docs = with_types(docs, doc_id="bigint", text="string", **carry)

    def one(batch):
        for part in slices(batch, "text", SLICE):
            base, every = found_in(part, field)
            yield {n: part.column(n) for n in ("doc_id", "text", *carry)} | {"base": as_rows(base), "spans": as_rows(every)}

    kept = "".join(f", {n} {k}" for n, k in carry.items())
    return arrow_map(docs, one, f"doc_id bigint, text string{kept}, base array<struct<kind:string,start:int,end:int>>, spans array<struct<kind:string,start:int,end:int>>")


def find_and_mask(docs: DataFrame, field: Field, carry: dict[str, str] | None = None) -> DataFrame:
    """doc_id, the columns of ``carry`` and the text of every row of ``docs`` with what :func:`find` finds replaced by its kind.

    Equal to ``mask(find(docs, field, carry), carry)``, with one Python worker a task in place of two.
    """
    carry = carry or {}
    docs = with_types(docs, doc_id="bigint", text="string", **carry)

    def one(batch):
        for part in slices(batch, "text", SLICE):
            spans = as_rows(found_in(part, field)[1])
            texts = part.column("text").to_pylist()
            yield {n: part.column(n) for n in ("doc_id", *carry)} | {"text": [masked(t, s) if s else t for t, s in zip(texts, spans)]}

    kept = "".join(f", {n} {k}" for n, k in carry.items())
    return arrow_map(docs, one, f"doc_id bigint{kept}, text string")


def masked(text: str, spans: list[dict]) -> str:
    """The text with each span's kind in its place; spans that overlap are one place."""
    out, done = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= done:
            out += [text[done : s["start"]], f"<{s['kind'].upper()}>"]
        done = max(done, s["end"])
    return "".join([*out, text[done:]])


def mask(found: DataFrame, carry: dict[str, str] | None = None) -> DataFrame:
    """``find``'s rows with the spans replaced by their kinds."""
    names = ["doc_id", *(carry or {})]

    def one(batch):
        spans, texts = batch.column("spans").to_pylist(), batch.column("text").to_pylist()
        yield {n: batch.column(n) for n in names} | {"text": [masked(t, s) if s else t for t, s in zip(texts, spans)]}

    kept = "".join(f", {n} {k}" for n, k in (carry or {}).items())
    return arrow_map(found.select(*names, "text", "spans"), one, f"doc_id bigint{kept}, text string")


def listed(spans: str) -> F.Column:
    """kind:start:end of the spans in order, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
