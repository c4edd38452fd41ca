"""Alignment of two tokenizers: common ends of their tokens cut both id lists into groups, and counts of linked ids."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, compress, count, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import slices, written

#: A single space before a visible character: both tokenizers begin a token there, whatever stands around it (``Pair`` checks that).
CUT, BEGINS, BLANK = re.compile(r"(?<=[^ ▁]) (?=[!-~\w])"), re.compile(r"[!-~\w]"), " ▁"
#: Distinct pieces of text that a task keeps for one turn or two (longer ones than KEPT_CHARS aren't kept), pieces that are encoded as
#: one text, and characters of a text that a task looks at at once.
KEPT, KEPT_CHARS, CHUNK, STEP = 100_000, 64, 100, 1 << 20
SPACE = "▁"


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves, the rest follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Pair:
    """Two vocabularies, read on the driver, with the bytes of each id and the code of each pair of ids that can be linked.

    Tokens that end together are the one a suffix of the other, so that vocabularies alone bound the pairs: a token has at most as
    many suffixes as bytes. ``codes`` holds ``a * len(b_bytes) + b`` of all such pairs in order.
    """

    a_json: str
    b_model: bytes
    a_bytes: list[bytes | None]
    b_bytes: list[bytes | None]
    codes: np.ndarray


def load_pair(a_path: str, b_path: str) -> Pair:
    """``a_path``: a byte-level tokenizer of the tokenizers library; ``b_path``: a sentencepiece model with byte fallback.

    Texts are cut at spaces before they are encoded, so the vocabularies must allow it: no token of B has a space after another
    character, B doesn't rewrite texts, and A splits by the byte-level pattern.
    """
    import json

    import sentencepiece

    with open(a_path, encoding="utf-8") as file:
        a_json = file.read()
    with open(b_path, "rb") as file:
        b_model = file.read()
    spec, letters = json.loads(a_json), _byte_letters()
    if spec["pre_tokenizer"].get("type") != "ByteLevel" or not spec["pre_tokenizer"].get("use_regex") or spec["normalizer"]:
        raise ValueError("A must split by the byte-level pattern and leave texts as they are")
    special = {t["id"] for t in spec["added_tokens"]}
    vocab = spec["model"]["vocab"]
    a_bytes: list[bytes | None] = [None] * (1 + max([*vocab.values(), *special]))
    for word, i in vocab.items():
        a_bytes[i] = None if i in special else bytes(letters[c] for c in word)
    b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
    b_bytes: list[bytes | None] = []
    for i in range(b.get_piece_size()):
        piece = b.id_to_piece(i)
        b_bytes.append(None if b.is_control(i) or b.is_unknown(i) else bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace(SPACE, " ").encode())
    if any(x and b" " in x.lstrip(b" ") for x in b_bytes) or b.encode("a", out_type=str)[0][0] != SPACE or b.normalize("ﬁ  ²") != f"{SPACE}ﬁ{SPACE * 2}²":
        raise ValueError("B must begin tokens at spaces, add one in front and leave texts as they are")
    return Pair(a_json, b_model, a_bytes, b_bytes, _codes(a_bytes, b_bytes))


def _codes(a_bytes: list[bytes | None], b_bytes: list[bytes | None]) -> np.ndarray:
    by_a: dict[bytes, list[int]] = {}
    by_b: dict[bytes, list[int]] = {}
    for known, listed in ((by_a, a_bytes), (by_b, b_bytes)):
        for i, x in enumerate(listed):
            if x:
                known.setdefault(x, []).append(i)
    found = [(i, j) for i, x in enumerate(a_bytes) if x for k in range(len(x)) for j in by_b.get(x[k:], ())]
    found += [(i, j) for j, x in enumerate(b_bytes) if x for k in range(1, len(x)) for i in by_a.get(x[k:], ())]
    return np.unique(np.array([i * len(b_bytes) + j for i, j in found], np.int64))


#: What is known of pieces of text, a row each: its groups as text, the places of its links (32 bits each), and its numbers of tokens.
#: All are null where the tokens of a side don't spell it.
KNOWN = pa.schema([("groups", pa.large_string()), ("links", pa.large_binary()), ("n_a", pa.int64()), ("n_b", pa.int64())])
NOTHING = pa.RecordBatch.from_pylist([], KNOWN)


def _starts(counts: np.ndarray) -> np.ndarray:
    """The n + 1 bounds of runs of so many."""
    return np.concatenate([[0], np.cumsum(counts)])


def _pieces(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """What ``CUT`` splits the texts into, one after the other, and the n + 1 bounds of each text's pieces; no text is empty."""
    coded = [t.encode() for t in texts]
    # two spaces between texts: neither of them is a cut, nor is a space at a text's begin or end
    data = np.frombuffer(b"  ".join([b"  ", *coded, b"  "]), np.uint8)
    size = np.array([len(c) for c in coded], np.int64)
    begins = 4 + _starts(size + 2)[:-1]
    space = np.flatnonzero(data[4:-4] == 0x20) + 4
    after = data[space + 1]
    cut = (data[space - 1] != 0x20) & (after > 0x20) & (after != 0x7F)
    cut &= (data[space - 1] != 0x81) | (data[space - 2] != 0x96) | (data[space - 3] != 0xE2)  # the bytes of BLANK's other character
    high = np.flatnonzero(cut & (after >= 0x80))
    if len(high):
        four = np.stack([data[space[high] + k] for k in range(1, 5)], axis=1).view(np.uint32).ravel()
        kinds, which = np.unique(four, return_inverse=True)
        cut[high] = np.array([BEGINS.match(k.tobytes().decode(errors="ignore")) is not None for k in kinds])[which]
    space = space[cut]
    first, last = np.sort(np.concatenate([begins, space + 1])), np.sort(np.concatenate([begins + size, space]))
    inside = np.ones(len(data), bool)
    inside[space] = False
    for at in (begins + size, begins + size + 1):
        inside[at] = False
    inside[:4] = inside[-4:] = False
    offsets = _starts(last - first)
    made = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    return made, np.append(np.searchsorted(first, begins), len(first))


class Aligner:
    """Both tokenizers in a task, and what they gave for pieces of text seen lately."""

    def __init__(self, pair: Pair):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.pair = pair
        # rows of pieces asked for since the last turn, and before it: words that come often are never forgotten
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self.young_rows = self.old_rows = NOTHING
        self.a = Tokenizer.from_str(pair.a_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pair.b_model)
        self.a_bytes, self.b_bytes = ([x or b"" for x in listed] for listed in (pair.a_bytes, pair.b_bytes))
        self.a_size, self.b_size = (np.array([len(x) for x in listed], np.int64) for listed in (self.a_bytes, self.b_bytes))
        ids = [str(i).encode() for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        width = len(ids[-1])
        self.digits = np.frombuffer(b"".join([x.rjust(width, b"\0") for x in ids]), np.uint8).reshape(-1, width)
        self.n_digits = np.array([len(x) for x in ids], np.int64)

    def _aligned(self, chunks: list[list[str]]) -> pa.RecordBatch:
        """What the pieces of the chunks give, in order; a chunk is encoded as one text, its pieces joined by spaces.

        A chunk whose tokens don't spell it is encoded again piece by piece; such a piece gives nulls.
        """
        texts = [" ".join(c) for c in chunks]
        a = [x.ids for x in self.a.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)]
        b = self.b.encode(texts, num_threads=1)
        spelt = [
            b"".join(map(self.a_bytes.__getitem__, x)) == f" {t}".encode() == b"".join(map(self.b_bytes.__getitem__, y)) for t, x, y in zip(texts, a, b)
        ]
        made = self._groups([p for c in compress(chunks, spelt) for p in c], compress(a, spelt), compress(b, spelt))
        if all(spelt):
            return made
        again = [[p] for c, good in zip(chunks, spelt) if not good and len(c) > 1 for p in c]
        good_at, again_at = count(), count(made.num_rows)
        at = [next(good_at) if good else next(again_at) if len(c) > 1 else None for c, good in zip(chunks, spelt) for _ in c]
        return pa.concat_batches([made, self._aligned(again)] if again else [made]).take(pa.array(at, pa.int64()))

    def _groups(self, pieces: list[str], a_ids: Iterable[list[int]], b_ids: Iterable[list[int]]) -> pa.RecordBatch:
        """A row for each piece, of ids that spell all pieces, each after a space."""
        if not pieces:
            return NOTHING
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64) for ids in (a_ids, b_ids))
        end_a, end_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        ends_a, ends_b = np.zeros(end_a[-1] + 1, bool), np.zeros(end_a[-1] + 1, bool)
        ends_a[end_a] = ends_b[end_b] = True
        # no token is empty, so that one of each side ends at a common end
        common_a, common_b = ends_b[end_a], ends_a[end_b]
        last_a, last_b = np.flatnonzero(common_a), np.flatnonzero(common_b)
        places = np.searchsorted(self.pair.codes, a[last_a] * len(self.b_bytes) + b[last_b]).astype("<i4")
        stops = np.searchsorted(end_a[last_a], np.cumsum([len(p.encode()) + 1 for p in pieces])) + 1
        # the ids of both sides in the order of the groups, as digits, each with the mark after it; none after a piece
        at_a = np.arange(len(a)) + np.append(0, last_b + 1)[np.cumsum(common_a) - common_a]
        at_b = np.arange(len(b)) + last_a[np.cumsum(common_b) - common_b] + 1
        ids, width = np.empty(len(a) + len(b), np.int64), self.digits.shape[1]
        ids[at_a], ids[at_b] = a, b
        text = np.empty((len(ids), width + 1), np.uint8)
        text[:, :width], text[:, width] = self.digits[ids], ord(",")
        final = at_b[last_b]
        text[at_a[last_a], width], text[final, width] = ord("|"), ord(";")
        final = final[stops - 1]
        text[final, width] = 0
        bounds = np.append(0, np.cumsum(self.n_digits[ids] + (text[:, width] != 0))[final])
        groups = pa.Array.from_buffers(pa.large_string(), len(pieces), [None, pa.py_buffer(bounds), pa.py_buffer(text[text != 0])])
        links = pa.Array.from_buffers(pa.large_binary(), len(pieces), [None, pa.py_buffer(np.append(0, 4 * stops)), pa.py_buffer(places)])
        n_a, n_b = (pa.array(np.diff(last[stops - 1], prepend=-1)) for last in (last_a, last_b))
        return pa.RecordBatch.from_arrays([groups, links, n_a, n_b], schema=KNOWN)

    def learn(self, pieces: list[str]) -> pa.RecordBatch:
        """What is known of distinct pieces, in order; new ones are encoded together."""
        n_young = self.young_rows.num_rows
        at = np.fromiter(map(self.young.get, pieces, repeat(-1)), np.int64, len(pieces))
        missed = np.flatnonzero(at < 0)
        older = np.fromiter((self.old.get(pieces[i], -1) for i in missed), np.int64, len(missed))
        new, odd = [], []  # odd: the first or last piece of a text: another beside it could change its tokens
        for i in missed[older < 0]:
            p = pieces[i]
            (new if BEGINS.match(p) and p[-1] not in BLANK else odd).append(i)
        words = [pieces[i] for i in new]
        made = self._aligned([words[i : i + CHUNK] for i in range(0, len(words), CHUNK)] + [[pieces[i]] for i in odd]) if new or odd else NOTHING
        at[missed] = older + n_young
        at[new + odd] = np.arange(len(new) + len(odd)) + n_young + self.old_rows.num_rows
        known = pa.concat_batches([self.young_rows, self.old_rows, made]).take(pa.array(at))
        kept = [i for i in missed if len(pieces[i]) <= KEPT_CHARS]
        self.young.update(zip([pieces[i] for i in kept], count(n_young)))
        self.young_rows = pa.concat_batches([self.young_rows, known.take(pa.array(kept, pa.int64()))])
        if len(self.young) > KEPT:
            self.old, self.old_rows, self.young, self.young_rows = self.young, self.young_rows, {}, NOTHING
        return known

    def texts(self, texts: list[str | None]) -> pa.RecordBatch:
        """The same for whole texts; one without tokens has none of anything."""
        short = [i for i, t in enumerate(texts) if t and len(t) <= STEP]
        long = [i for i, t in enumerate(texts) if t and len(t) > STEP]
        made = pa.concat_batches([self._short([texts[i] for i in short]), *(self._long(texts[i]) for i in long)])
        place = dict(zip(short + long, count()))
        made = made.take(pa.array([place.get(i) for i in range(len(texts))], pa.int64()))
        return pa.RecordBatch.from_arrays([pc.fill_null(c, none) for c, none in zip(made.columns, ("", b"", 0, 0))], schema=KNOWN)

    def _short(self, texts: list[str]) -> pa.RecordBatch:
        if not texts:
            return NOTHING
        pieces, bounds = _pieces(texts)
        pieces = pieces.dictionary_encode()
        known = self.learn(pieces.dictionary.to_numpy(zero_copy_only=False).tolist()).take(pieces.indices)
        # a text with a piece that isn't spelt is null as a whole
        bounds = bounds.astype(np.int32)
        groups, links = (pc.binary_join(pa.ListArray.from_arrays(bounds, known.column(c)), pa.scalar(mark, KNOWN.field(c).type)) for c, mark in (("groups", ";"), ("links", b"")))
        unspelt = groups.is_null().to_numpy(zero_copy_only=False)
        n_a, n_b = (np.add.reduceat(pc.fill_null(known.column(c), 0).to_numpy(), bounds[:-1]) for c in ("n_a", "n_b"))
        return pa.RecordBatch.from_arrays([groups, links, pa.array(n_a, mask=unspelt), pa.array(n_b, mask=unspelt)], schema=KNOWN)

    def _long(self, text: str) -> pa.RecordBatch:
        """A long text in steps, of each of which only what it gives is held."""
        parts, begin = [], 0
        while begin < len(text):
            cut = CUT.search(text, begin + STEP)
            end = cut.start() if cut else len(text)
            part = self._short([text[begin:end]]).to_pylist()[0]
            if part["groups"] is None:
                return pa.RecordBatch.from_pylist([{}], KNOWN)
            parts.append(part)
            begin = end + 1
        row = {c: mark.join([p[c] for p in parts]) for c, mark in (("groups", ";"), ("links", b""))} | {c: sum([p[c] for p in parts]) for c in ("n_a", "n_b")}
        return pa.RecordBatch.from_pylist([row], KNOWN)


def align(docs: DataFrame, pair: Pair, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, groups, links`` for each row.

    A encodes a space and the text, B the text. Cumulative ends of the tokens of each side are marked; the common ends cut both id
    lists into ``groups`` (``a1,a2|b1;a3|b2,b3``). In each group the last token of A and the last of B end together:
    they are linked; ``links`` has the places of these pairs in ``pair.codes``, 32 bits each. Pieces between spaces are encoded once a
    task. Null and empty texts, and texts that the tokens of a side don't spell, have no tokens: zeros and empty columns. Texts of any
    length; repeated rows are aligned each; null ids are kept; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(pair)
        for batch in slices(batches, "text"):
            rows = aligner.texts(batch.column("text").to_pylist())
            groups, links, n_a, n_b = rows.columns
            n_groups = pc.divide(pc.binary_length(links), 4)
            yield pa.RecordBatch.from_arrays([batch.column("id"), n_a, n_b, n_groups, groups.cast(pa.string()), links.cast(pa.binary())], ["id", "n_a", "n_b", "n_groups", "groups", "links"])

    chosen = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    made = chosen.mapInArrow(run, f"id {dict(chosen.dtypes)['id']}, n_a long, n_b long, n_groups long, groups string, links binary")
    return made.withColumnRenamed("id", doc_id)


def _places(links: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All links of a column in one array, and the n + 1 bounds of its rows."""
    links = links.cast(pa.large_binary())
    bounds = np.frombuffer(links.buffers()[1], np.int64, len(links) + 1, links.offset * 8) // 4
    if bounds[-1] == bounds[0]:
        return np.zeros(0, "<i4"), bounds - bounds[0]
    return np.frombuffer(links.buffers()[2], "<i4", bounds[-1] - bounds[0], 4 * bounds[0]), bounds - bounds[0]


def pair_counts(aligned: DataFrame, pair: Pair) -> DataFrame:
    """``a, b, n``: how many links hold each pair of ids; a task sends each pair once."""
    size, width = len(pair.codes), len(pair.b_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in slices(batches, "links"):
            places, _ = _places(batch.column("links"))
            if len(places) > size // 8:
                total += np.bincount(places, minlength=size)
            else:
                place, n = np.unique(places, return_counts=True)
                total[place] += n
        place = np.flatnonzero(total).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total[place])], ["place", "n"])

    counted = aligned.select("links").mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n"))
    codes = pair.codes

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = codes[batch.column("place").to_numpy()]
            yield pa.RecordBatch.from_arrays([pa.array(code // width), pa.array(code % width), batch.column("n")], ["a", "b", "n"])

    return counted.mapInArrow(named, "a long, b long, n long")


def score(aligned: DataFrame, counts: DataFrame, pair: Pair) -> DataFrame:
    """``aligned`` without ``links``, with ``n_links``, ``n_best`` (links whose pair is the most frequent of its B id, ties included)
    and ``count_sum`` (counts of the pairs of all links).

    ``counts`` has at most a row for each code of the vocabularies (their size bounds what reaches the driver and the tasks).
    """
    found = counts.toPandas()
    n, width = np.zeros(len(pair.codes), np.int64), len(pair.b_bytes)
    n[np.searchsorted(pair.codes, found["a"].to_numpy(np.int64) * width + found["b"].to_numpy(np.int64))] = found["n"].to_numpy(np.int64)
    highest = np.zeros(width, np.int64)
    np.maximum.at(highest, pair.codes % width, n)
    best = n == highest[pair.codes % width]
    kept = [c for c in aligned.columns if c != "links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "links"):
            places, bounds = _places(batch.column("links"))
            sums = [np.diff(bounds), *(np.diff(_starts(x[places])[bounds]) for x in (best, n))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *map(pa.array, sums)], [*kept, "n_links", "n_best", "count_sum"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in aligned.dtypes if c != "links")
    return aligned.mapInArrow(run, f"{kinds}, n_links long, n_best long, count_sum long")


def align_digests(docs: DataFrame, pair: Pair, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Alignment of a corpus with a digest in place of the groups: each text is encoded once, links are kept in the shared folder."""
    made = align(docs, pair, doc_id, text)
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("").alias("groups_sha256")
    made = written(made.select(doc_id, "n_a", "n_b", "n_groups", digest, "links"), "aligned")
    return score(made, pair_counts(made, pair), pair)
