"""WARC archives: records written as gzip members, and a splittable reader that finds members in byte ranges."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from uuid import NAMESPACE_URL, uuid5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortry.llm.common import bit_filter, passes, written

#: The first bytes of a gzip member; what follows in a record's header is checked after that.
MAGIC = b"\x1f\x8b\x08"
MIN_PAYLOAD = 0
DATE = "2024-01-01T00:00:00Z"

#: Bytes that are read at once.
STEP = 4 << 20
_LEFT = ", file string, begin long, place long, starts boolean, raw binary"
_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target string, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(block: bytes) -> bytes:
    """A gzip member that ends in a zero byte: that is the high byte of the length, unless the block has 16 MB or more; an empty
    member follows then, which every reader skips."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = packer.compress(block) + packer.flush()
    if out[-1]:
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        out += packer.compress(b"") + packer.flush()
    return out


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit that refers to the response with an equal one."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Date: {DATE}", "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{sha1}", f"X-Payload-Length: {len(payload)}", f"Content-Length: {len(block)}",
    ]
    # every record has an id; one without a page is named after what it holds
    name = f"page:{page_id}" if page_id is not None else f"uuid:{uuid5(NAMESPACE_URL, f'{sha1} {url}')}"
    head.append(f"WARC-Record-ID: <urn:{name}>")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict | None:
    """A record from its bytes; None if they aren't one."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"WARC/"):
        return None
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in x)
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    number = lambda name: int(fields[name][10:-1]) if fields.get(name, "").startswith("<urn:page:") else None
    revisit = fields["WARC-Type"] == "revisit"
    return {
        "page_id": number("WARC-Record-ID"), "payload_bytes": int(fields["X-Payload-Length"]) if revisit else len(payload),
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else digest(payload), "record_type": fields["WARC-Type"],
        "refers_to": number("WARC-Refers-To"), "target": fields.get("WARC-Target-URI"), "payload": None if revisit else payload,
    }


def write_warc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write a record for each row to archives in the folder ``path``, of any file system that Spark writes to.

    Of records with equal payloads of MIN_PAYLOAD bytes or more, that with the least id is the response and others are revisits. Only
    rows whose digest passes a filter of the repeated ones are shuffled with their payload; copies of hot payloads are split by adaptive
    execution. Null html is an empty payload. Rows with a null id are responses (their record id is made of digest and URL); rows
    that repeat the least id are responses each.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    equal = rows.where(F.octet_length("payload") >= MIN_PAYLOAD).groupBy(F.col("sha1").alias("__sha1")).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    equal = equal.where("n > 1 and first is not null").drop("n")
    equal = written(equal, "repeated")
    bits = bit_filter(equal.select(F.xxhash64("__sha1").alias("h")))

    @F.pandas_udf("boolean")
    def repeated(h: pd.Series) -> pd.Series:
        return pd.Series(passes(bits, h.to_numpy(np.int64).view(np.uint64)))

    alone = rows.where(~repeated(F.xxhash64("sha1"))).select("id", "url", "payload", F.lit(None).cast("long").alias("first"))
    rows = rows.where(repeated(F.xxhash64("sha1"))).join(equal, F.col("sha1") == F.col("__sha1"), "left")
    rows = rows.select("id", "url", "payload", F.when(F.col("first") < F.col("id"), F.col("first")).alias("first")).unionByName(alone)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256).to_pylist()
                made = [member(record(r["id"], r["url"], r["payload"], digest(r["payload"]), r["first"]))[:-1] for r in part]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["member"])

    # a text file of bytes; each member's last byte, zero, is the separator of lines
    lines = rows.mapInArrow(run, "member binary").select(F.expr("cast(member as string)").alias("value"))
    lines.write.option("lineSep", "\0").text(path)


def _starts_record(raw: bytes) -> bool:
    """Whether bytes from a magic on decode to the beginning of a WARC record, or are an empty member."""
    if len(raw) < 10 or raw[3] & 0xE0:
        return False
    inflate = zlib.decompressobj(31)
    try:
        head = inflate.decompress(raw, 5)
    except zlib.error:
        return False
    return head == b"WARC/" or (head == b"" and inflate.eof)


class Joiner:
    """Puts pieces between magics together to members. Pieces come in the order of the file; a magic may stand inside a member.

    A piece is inflated once, as it comes: the state of the inflation is kept for the open member.
    """

    def __init__(self) -> None:
        self._begin(None)

    def _begin(self, pieces: list[bytes] | None) -> None:
        self.pieces, self.out, self.inflate, self.rest, self.broken = pieces, [], None, b"", False

    @property
    def open(self) -> bytes | None:
        """The bytes of the member that isn't whole yet."""
        return None if self.pieces is None else b"".join(self.pieces)

    def _feed(self, raw: bytes) -> None:
        """Inflate what came; the bytes may hold several members, or end in one."""
        raw, self.rest = self.rest + raw, b""
        while raw and not self.broken:
            if self.inflate is None:
                if len(raw) < 10:
                    self.rest = raw
                    return
                if not raw.startswith(MAGIC) or raw[3] & 0xE0:
                    self.broken = True
                    return
                self.inflate = zlib.decompressobj(31)
            try:
                self.out.append(self.inflate.decompress(raw))
            except zlib.error:
                self.broken = True
                return
            raw = self.inflate.unused_data
            if self.inflate.eof:
                self.inflate = None

    def add(self, piece: bytes) -> dict | None:
        """The record that ends with this piece, if one does. A piece that begins no record belongs to the open one."""
        raw = MAGIC + piece
        if self.pieces is None or _starts_record(raw):
            self._begin([])
        self.pieces.append(raw)
        self._feed(raw)
        if self.broken or self.inflate is not None or self.rest:
            return None
        whole = b"".join(self.out)
        self._begin(None)
        return parse(whole) if whole else None


def _columns(rows: list[dict]) -> list[pa.Array]:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    return [pa.array([r[n] for r in rows], k) for n, k in zip(["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target", "payload"], kinds)]


def _plain_pieces(spark: SparkSession, path: str) -> DataFrame:
    """``piece, file, begin``: what stands between magics, in ranges of files, read by Spark as lines whose separator is the magic."""
    pieces = spark.read.option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    return pieces.select(F.col("value").cast("binary").alias("piece"), F.input_file_name().alias("file"), F.input_file_block_start().alias("begin"))


def range_pieces(read: Callable[[int, int], bytes], begin: int, end: int, step: int = STEP) -> Iterator[bytes]:
    """The pieces whose magic begins in ``[begin, end)``, the last one whole; ``read(at, n)`` gives the bytes of a file from a place on."""
    at, held, started, seen = begin, bytearray(), False, 0
    while True:
        raw = read(at, step)
        at += len(raw)
        held += raw
        # held begins at this place of the file, in a piece if one has started
        base, first = at - len(held), 0
        low = max(0, seen - len(MAGIC) + 1)
        while (found := held.find(MAGIC, low)) >= 0:
            if started:
                yield bytes(held[first:found])
            if base + found >= end:
                return
            started, low = True, found + len(MAGIC)
            first = low
        if not raw:
            if started:
                yield bytes(held[first:])
            return
        if not started:
            first = max(0, len(held) - len(MAGIC) + 1)
            if base + first >= end:
                return
        del held[:first]
        seen = len(held)


def _zipped_pieces(spark: SparkSession, files: list[tuple[str, int]], split: int) -> DataFrame:
    """The same of archives named ``.gz``, which Spark's readers would inflate whole: ranges are dealt to tasks, which open the files by Arrow."""
    ranges = [(f, b, min(n, b + split)) for f, n in files for b in range(0, n, split)]
    table = spark.createDataFrame(ranges, "file string, begin long, until long")
    table = table.repartitionByRange(min(len(ranges), 10_000), "file", "begin").sortWithinPartitions("file", "begin")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for file, begin, until in zip(*(batch.column(c).to_pylist() for c in ("file", "begin", "until"))):
                system, path = fs.FileSystem.from_uri(file)
                with system.open_input_file(path) as handle:
                    held, size = [], 0
                    for piece in range_pieces(lambda at, n: handle.read_at(n, at), begin, until):
                        held.append(piece)
                        size += len(piece)
                        if size > STEP or len(held) >= 1024:
                            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary()), pa.array([file] * len(held)), pa.array([begin] * len(held), pa.int64())], ["piece", "file", "begin"])
                            held, size = [], 0
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary()), pa.array([file] * len(held), pa.string()), pa.array([begin] * len(held), pa.int64())], ["piece", "file", "begin"])

    return table.mapInArrow(run, "piece binary, file string, begin long")


def _archives(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Address and length of each file under a path."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    found, out = target.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(target, True), []
    while found.hasNext():
        status = found.next()
        if not status.getPath().getName().startswith((".", "_")):
            out.append((re.sub("^file:/+", "file:///", status.getPath().toUri().toString()), status.getLen()))
    return sorted(out)


def read_warc(spark: SparkSession, path: str, split: int = 64 << 20) -> DataFrame:
    """Records of all archives under ``path``: ``page_id, payload_bytes, payload_digest, record_type, refers_to, target, payload``.

    Files are cut in byte ranges; each is read from its first gzip magic to the end of the member that begins last in it. Spark does so
    as it reads lines, with the magic as the separator; archives named ``.gz``, which it would inflate instead, are cut in ranges of
    ``split`` bytes that tasks open by Arrow (on file systems that Arrow knows). A magic may also stand inside a member by chance: a
    piece counts as a member's beginning only if it inflates to the head of a WARC record, else it continues the member before it.
    Members that such a magic cuts at the edge of a range are put together afterwards, each from its own pieces. Length and digest of a
    response are those of what was read. An empty folder, and archives without records, give no rows.
    """
    files = _archives(spark, path)
    zipped, plain = [f for f in files if f[0].endswith(".gz") and f[1]], [f for f in files if not f[0].endswith(".gz")]
    parts = [_plain_pieces(spark, path if not zipped else [f for f, _ in plain])] if plain else []
    parts += [_zipped_pieces(spark, zipped, split)] if zipped else []
    if not parts:
        return spark.createDataFrame([], _READ)
    whole = [_joined(p) for p in parts]
    return whole[0] if len(whole) == 1 else whole[0].unionByName(whole[1])


def _joined(pieces: DataFrame) -> DataFrame:
    """The records of pieces, which stand in the order of their files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joiner, at, place = Joiner(), None, 0

        def rest(where: tuple, raw: bytes | None, n: int, starts: bool) -> dict:
            return {"file": where[0], "begin": where[1], "place": n, "starts": starts, "raw": raw}

        def out(rows: list[dict], left: list[dict]) -> pa.RecordBatch:
            empty = dict.fromkeys(["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target", "payload"])
            kinds = (("file", pa.string()), ("begin", pa.int64()), ("place", pa.int64()), ("starts", pa.bool_()), ("raw", pa.binary()))
            parts = [pa.array([None] * len(rows) + [x[c] for x in left], k) for c, k in kinds]
            return pa.RecordBatch.from_arrays(_columns(rows + [empty] * len(left)) + parts, [f.split()[0] for f in (_READ + _LEFT).split(", ")])

        for batch in batches:
            rows, left = [], []
            for piece, file, begin in zip(*(batch.column(c).to_pylist() for c in ("piece", "file", "begin"))):
                if (file, begin) != at:
                    if at is not None and joiner.open is not None:
                        left.append(rest(at, joiner.open, place, True))
                    joiner, at, place = Joiner(), (file, begin), 0
                    if begin == 0 and not piece:
                        continue  # what stands before the file's first magic
                place += 1
                if joiner.pieces is None and not _starts_record(MAGIC + piece):
                    left.append(rest(at, MAGIC + piece, place, False))
                    continue
                got = joiner.add(piece)
                if got:
                    rows.append(got)
                if len(rows) >= 256:
                    yield out(rows, left)
                    rows, left = [], []
            if rows or left:
                yield out(rows, left)
        if at is not None and joiner.open is not None:
            yield out([], [rest(at, joiner.open, place, True)])

    read = pieces.mapInArrow(run, _READ + _LEFT)
    names = [f.split()[0] for f in _READ.split(", ")]

    def mend(pdf: pd.DataFrame) -> pd.DataFrame:
        """A cut member: its beginning, and all that follows until it is whole."""
        joiner, rows = Joiner(), []
        for raw in pdf.sort_values(["begin", "place"])["raw"]:
            got = joiner.add(raw[len(MAGIC) :])
            if got:
                rows.append(got)
        return pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})

    whole = read.where("file is null").select(*names)
    cut = read.where("file is not null").select("file", "begin", "place", "starts", "raw")
    # a member's pieces: from one that starts a member to the next that does; only places are ordered, not bytes
    order = Window.partitionBy("file").orderBy("begin", "place").rowsBetween(Window.unboundedPreceding, 0)
    chains = cut.select("file", "begin", "place", F.sum(F.col("starts").cast("int")).over(order).alias("chain"))
    mended = cut.join(chains, ["file", "begin", "place"]).groupBy("file", "chain").applyInPandas(mend, _READ)
    return whole.unionByName(mended)
