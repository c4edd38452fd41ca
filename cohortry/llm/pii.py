"""Personal data: labelers vote on candidate spans, expectation-maximisation weighs them, and a span classifier is trained on that."""

from __future__ import annotations

import ipaddress
import re
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from itertools import accumulate
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortry.llm.common import slices, written

KINDS = ("email", "ip", "card", "phone")
#: A candidate that the base rules don't have becomes a span from this probability on.
THRESHOLD = 0.9
#: The classifier is fitted on at most so many spans for each kind and pattern of votes (those of least hash), and has so many features.
SAMPLED, FEATURES = 128, 1 << 12

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Candidates that the base rules miss: a number without its country, an address that spells its signs out.
_BARE_PHONE = re.compile(r"(?<![0-9+(])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9])")
_SPELT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]{2,24}){1,4}(?![A-Za-z0-9-])")
#: A card of 13 to 19 digits, in one piece or in groups with one separator; an address with bracketed or spelt dots; one of version 6.
_LOOSE_CARD = re.compile(
    r"(?<![0-9A-Za-z])(?<![0-9][./_-])(?:[0-9]{4}([ ./_-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?:\1[0-9]{1,3})?|[0-9]{4}([ ./_-])[0-9]{6}\2[0-9]{4,5}"
    r"|[0-9]{13,19})(?![0-9A-Za-z])(?![./_-][0-9])"
)
_DOT = r" ?(?:\[\.\]|\(\.\)|[\[(](?:dot|DOT)[\])]) ?|\.| dot "
_LOOSE_IP = re.compile(rf"(?<![0-9A-Za-z.])[0-9]{{1,3}}(?:(?:{_DOT})[0-9]{{1,3}}){{3}}(?![0-9A-Za-z])")
_SIX = re.compile(r"(?<![\w:.])[0-9A-Fa-f]{1,4}:[0-9A-Fa-f:]{2,34}(?![\w:])")

#: Gazetteers: last labels of domains, first digits of card issuers, calling codes.
DOMAINS = "com net org edu gov io co uk de fr es it nl eu us info biz ca au ch at be se no dk pl".split()
ISSUERS = ("4", "51", "52", "53", "54", "55", "2", "34", "37", "6011", "65")
CALLING = "1 7 20 27 30 31 32 33 34 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92".split()
#: Words near a span that speak for its kind, and words that speak against any.
FOR = {
    "email": {"mail", "email", "contact", "write", "address"}, "ip": {"ip", "address", "host", "server", "login", "from"},
    "card": {"card", "credit", "visa", "mastercard", "payment", "debit"}, "phone": {"call", "phone", "tel", "mobile", "fax", "dial", "whatsapp"},
}
AGAINST = {"order", "isbn", "version", "serial", "invoice", "sku", "part", "release", "section", "figure", "total"}


def _email_matches(text: str) -> list[tuple[int, int]]:
    """Every match ends its local part at an @, so it is enough to look left and right of each: linear in the text."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        # the run of local characters before the @, not before the last match or the last @
        begin = at
        while begin > last and _LOCAL.match(text, begin - 1, begin) and text[begin - 1] != "@":
            begin -= 1
        found = _DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            out.append((begin, found.end()))
            last = found.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", max(at + 1, last))
    return out


def _ip_matches(text: str) -> list[tuple[int, int]]:
    """A run of numbers with dots holds one match for each four numbers."""
    out = []
    for run in _DOTTED.finditer(text):
        parts = run.group().split(".")
        begin = run.start()
        for i in range(0, len(parts) - 3, 4):
            end = begin + sum(map(len, parts[i : i + 4])) + 3
            if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in parts[i : i + 4]):
                out.append((begin, end))
            begin = end + 1
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start, in code points."""
    out = [("email", *x) for x in _email_matches(text)]
    out += [("ip", *x) for x in _ip_matches(text)]
    for m in _CARD.finditer(text):
        digits = _digits(m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m.group())) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans like those of the kinds that base spans don't touch."""
    loose = [("phone", m.start(), m.end()) for m in _BARE_PHONE.finditer(text)]
    if "at" in text:
        loose += [("email", m.start(), m.end()) for m in _SPELT.finditer(text)]
    loose += [("card", m.start(), m.end()) for m in _LOOSE_CARD.finditer(text)]
    loose += [("ip", m.start(), m.end()) for m in _LOOSE_IP.finditer(text)]
    if ":" in text:
        loose += [("ip", m.start(), m.end()) for m in _SIX.finditer(text) if m.group().count(":") > 1 and re.search("[0-9]", m.group())]
    taken = sorted((a, b) for _, a, b in base)
    starts, reach = [a for a, _ in taken], [0, *accumulate((b for _, b in taken), max)]
    return [x for x in loose if reach[bisect_left(starts, x[2])] <= x[1]]


def _address(span: str) -> bool:
    """Whether the span is an address once its dots are written as such."""
    if ":" in span:
        try:
            return bool(ipaddress.IPv6Address(span))
        except ValueError:
            return False
    return _ip_matches(plain := re.sub(_DOT, ".", span)) == [(0, len(plain))]


def votes(text: str, kind: str, start: int, end: int, strict: bool) -> tuple[int, int, int, int]:
    """What the labelers say: 1 for, 0 against, -1 nothing. Rule, gazetteer, context, shape.

    The rule is the base regex; for a candidate card it is Luhn's sum, for a candidate address its numbers, however they are separated.
    """
    span = text[start:end]
    digits = _digits(span)
    if kind == "email":
        listed = re.split(r"[.\s)\]]", span.lower())[-1] in DOMAINS
        shape = 1 if re.match(r"[A-Za-z0-9]", span) else 0
    elif kind == "ip":
        strict = strict or _address(span)
        first = re.split(r"[^0-9A-Fa-f]", span)[0]
        listed = first[:1] in ("2", "3") and len(first) == 4 if ":" in span else first.lstrip("0") not in ("", "127", "255")
        shape = 0 if text[start - 1 : start] in (".", "v") or text[end : end + 2][:1] == "." and text[end + 1 : end + 2].isdigit() else 1
    elif kind == "card":
        listed = digits.startswith(ISSUERS)
        strict = strict or luhn(digits)
        own = {"34": (15,), "37": (15,), "36": (14,), "38": (14,)}.get(digits[:2], (13, 16, 19) if digits[:1] == "4" else (16,))
        shape = 1 if len(digits) in own else 0
    else:
        code = span.startswith("+")
        listed = any(digits.startswith(c) for c in CALLING) if code else digits[:1] not in ("0", "1")
        shape = 1 if len(digits) in (10, 11, 12) else 0
    near = set(re.findall(r"[a-z]+", (text[max(0, start - 40) : start] + " " + text[end : end + 20]).lower()))
    context = 1 if near & FOR[kind] else 0 if near & AGAINST else -1
    return (1 if strict else 0, int(listed), context, shape)


def features(text: str, kind: str, start: int, end: int, vote: tuple) -> list[int]:
    """Numbers of the features of a span: its votes, runs of three in its shape, the characters beside it and the words around it.

    The first number stands for all spans; shapes write digits as 0 and letters as a or A.
    """
    shape = "^" + re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", text[start:end][:80]))) + "$"
    before = re.findall(r"[^\W_]+", text[max(0, start - 40) : start].lower())[-2:][::-1]
    after = re.findall(r"[^\W_]+", text[end : end + 40].lower())[:2]
    names = [f"vote {j} {x}" for j, x in enumerate(vote) if x >= 0] + [f"shape {g}" for g in {shape[i : i + 3] for i in range(len(shape) - 2)}]
    names += [f"left {j} {w}" for j, w in enumerate(before)] + [f"right {j} {w}" for j, w in enumerate(after)]
    names += [f"beside {text[start - 1 : start]}|{text[end : end + 1]}", f"digits {len(_digits(text[start:end]))}"]
    return [0, *sorted({1 + crc32(x.encode()) % (FEATURES - 1) for x in names})]


#: Spans of which a task remembers what it found out, by the span and the 40 characters on either side.
REMEMBERED = 1 << 14


def remembered(known: dict, text: str, kind: str, start: int, end: int, strict: bool, find: Callable) -> object:
    """``find(text, kind, start, end, strict)``, which looks at a span and 40 characters on either side; logs repeat those."""
    key = (kind, strict, text[max(0, start - 40) : start], text[start:end], text[end : end + 40])
    if key not in known:
        if len(known) >= REMEMBERED:
            known.clear()
        known[key] = find(text, kind, start, end, strict)
    return known[key]


def patterns(docs: DataFrame, text: str = "text") -> tuple[list[tuple], list[tuple]]:
    """(kind, votes, number) over all spans and candidates of all documents, at most 96 rows, counted by Spark; and of each of these at
    most SAMPLED spans as (kind, votes, features): those whose surroundings have the least hash, equal ones once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, int] = {}
        sample: dict[tuple, dict[int, list[int]]] = {}
        last: dict[tuple, int] = {}
        known: dict = {}
        for batch in slices(batches, "text"):
            for one in batch.column("text").to_pylist():
                if not one:
                    continue
                base = base_spans(one)
                for strict, spans in ((True, base), (False, candidates(one, base))):
                    for kind, a, b in spans:
                        vote = remembered(known, one, kind, a, b, strict, votes)
                        key = (kind, *vote)
                        counts[key] = counts.get(key, 0) + 1
                        draw = crc32(one[max(0, a - 40) : b + 40].encode())
                        if draw < last.get(key, 1 << 32) and draw not in (held := sample.setdefault(key, {})):
                            held[draw] = features(one, kind, a, b, vote)
                            if len(held) > SAMPLED:
                                del held[max(held)]
                            if len(held) == SAMPLED:
                                last[key] = max(held)
        rows = [(*k, n, None, None) for k, n in counts.items()] + [(*k, 0, draw, f) for k, held in sample.items() for draw, f in held.items()]
        kinds = [pa.string(), *[pa.int32()] * 4, pa.int64(), pa.int64(), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [*key_names, "n", "draw", "features"])

    key_names = ["kind", "v0", "v1", "v2", "v3"]
    rows = docs.select(F.col(text).alias("text")).mapInArrow(run, "kind string, v0 int, v1 int, v2 int, v3 int, n long, draw long, features array<int>")
    rows = written(rows, "votes")
    counted = rows.where("draw is null").groupBy(*key_names).agg(F.sum("n").alias("n"))
    drawn = rows.where("draw is not null").groupBy(*key_names, "draw").agg(F.min("features").alias("features"))
    drawn = drawn.withColumn("rank", F.row_number().over(Window.partitionBy(*key_names).orderBy("draw"))).where(F.col("rank") <= SAMPLED)
    return sorted(tuple(r) for r in counted.collect()), sorted(tuple(r) for r in drawn.select(*key_names, "features").collect())


def em(v: np.ndarray, n: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, float]:
    """Reliabilities of labelers with two classes (Dawid and Skene): chances to vote 1 given true and false, and the share of true.

    Starts from the majority vote; counts are smoothed by one, so that a labeler that never errs isn't taken as infallible.
    """
    said, yes = v >= 0, v == 1
    post = np.clip((yes & said).sum(axis=1) / np.maximum(said.sum(axis=1), 1), 0.05, 0.95)
    for _ in range(rounds):
        w1, w0 = n * post, n * (1 - post)
        right = ((w1[:, None] * (yes & said)).sum(axis=0) + 1) / ((w1[:, None] * said).sum(axis=0) + 2)
        wrong = ((w0[:, None] * (yes & said)).sum(axis=0) + 1) / ((w0[:, None] * said).sum(axis=0) + 2)
        share = (w1.sum() + 1) / (n.sum() + 2)
        l1, l0 = np.log(share), np.log(1 - share)
        a = l1 + (said * np.where(yes, np.log(right), np.log(1 - right))).sum(axis=1)
        b = l0 + (said * np.where(yes, np.log(wrong), np.log(1 - wrong))).sum(axis=1)
        post = 1 / (1 + np.exp(np.clip(b - a, -50, 50)))
    return right, wrong, post


def train(counted: list[tuple], drawn: list[tuple], rounds: int = 200) -> dict[str, np.ndarray]:
    """For each kind the weights of a logistic classifier of spans, fitted on the posteriors that expectation-maximisation gives.

    A pattern of votes counts by the logarithm of its number, so that rare ones are fitted, too; rows of a pattern share its weight.
    """
    model = {}
    for kind in KINDS:
        own = [r for r in counted if r[0] == kind]
        rows = [r for r in drawn if r[0] == kind]
        if not own:
            continue
        n = np.array([float(r[5]) for r in own])
        post = dict(zip([r[1:5] for r in own], em(np.array([r[1:5] for r in own]), n)[2]))
        shared = {r[1:5]: np.log2(1 + r[5]) for r in own}
        held = {v: sum(r[1:5] == v for r in rows) for v in shared}
        owner = np.repeat(np.arange(len(rows)), [len(r[5]) for r in rows])
        column = np.concatenate([r[5] for r in rows])
        want, weight = np.array([post[r[1:5]] for r in rows]), np.array([shared[r[1:5]] / held[r[1:5]] for r in rows])
        w, seen = np.zeros(FEATURES), np.full(FEATURES, 1e-8)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, w[column], len(rows)), -30, 30)))
            slope = np.bincount(column, (weight * (p - want))[owner], FEATURES) + 1e-3 * w
            seen += slope * slope
            w -= 0.5 * slope / np.sqrt(seen)
        model[kind] = w
    return model


def spans(text: str, model: dict[str, np.ndarray], known: dict | None = None) -> tuple[list, list]:
    """Base spans, and all spans: base ones stay, candidates are added if the classifier is sure. ``known`` is what it remembers."""

    def sure(text: str, kind: str, a: int, b: int, strict: bool) -> bool:
        z = model[kind][features(text, kind, a, b, votes(text, kind, a, b, strict))].sum()
        return bool(1 / (1 + np.exp(-np.clip(z, -30, 30))) >= THRESHOLD)

    base, known = base_spans(text), {} if known is None else known
    added, places = [], []
    for kind, a, b in candidates(text, base):
        if kind in model and remembered(known, text, kind, a, b, False, sure):
            at = bisect_left(places, (b,))
            # places don't overlap, so that only the last one that begins before this one's end can meet it
            if not at or places[at - 1][1] <= a:
                insort(places, (a, b))
                added.append((kind, a, b))
    return base, sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1]))


def spans_text(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` for each row; counts and digest are of base spans.

    Two passes over the texts: votes are counted by pattern for the whole corpus and some spans of each pattern are kept, the classifier
    is trained on those and the posteriors of their patterns, then each text is searched. Null text counts as empty. Repeated rows are searched each; null ids are kept; empty in, empty out.
    """
    import hashlib

    model = train(*patterns(docs, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in slices(batches, "text"):
            found = [spans(t or "", model, known) for t in batch.column("text").to_pylist()]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
            digests = [hashlib.sha256(spans_text(base).encode()).hexdigest() for base, _ in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *counts, pa.array(digests, pa.string()), pa.array([spans_text(x) for _, x in found], pa.string())],
                ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    chosen = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return chosen.mapInArrow(run, f"id {dict(chosen.dtypes)['id']}, {counts}, base_sha256 string, spans string").withColumnRenamed("id", doc_id)


def masked(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with each span (or run of overlapping ones) replaced by its kind in angle brackets."""
    out, last = [], 0
    for kind, a, b in sorted(found, key=lambda s: (s[1], -s[2])):
        if a >= last:
            out += [text[last:a], f"<{kind.upper()}>"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def mask_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with spans masked in ``text``; other columns, and null texts, as they are."""
    model = train(*patterns(docs, text))

    @F.pandas_udf("string")
    def masking(column: pd.Series) -> pd.Series:
        known: dict = {}
        return column.map(lambda t: masked(t, spans(t, model, known)[1]), na_action="ignore")

    return docs.withColumn(text, masking(F.col(text)))
