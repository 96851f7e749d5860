"""PDF files as a source: their bytes, what can be told without rendering them, and the shards of an OCR job over their pages.

Spark lists and reads the files (binaryFile, as a table or as a stream whose checkpoint remembers what was read); bytes stay on
the executors. The number of pages is read from a file's own cross-reference structure.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import MAX_PAGES
from ..functions.providers import ocr_job
from ..operators.pages import SHARD_SCHEMA

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
_TOKEN = re.compile(rb"[\x00\t\n\f\r ]*(?:%[^\r\n]*[\x00\t\n\f\r ]*)*(<<|>>|\[|\]|\((?:[^()\\]|\\[\s\S]|\((?:[^()\\]|\\[\s\S])*\))*\)|<[0-9A-Fa-f\s]*>|/[^\x00\t\n\f\r ()<>\[\]{}/%]*|[+-]?\d*\.?\d+|[A-Za-z]+)")
_REF = re.compile(rb"[\x00\t\n\f\r ]+(\d+)[\x00\t\n\f\r ]+R(?![A-Za-z])")


class Unreadable(ValueError):
    """The file's structure can't be read."""


def _value(data: bytes, at: int):
    """(value, end) of the object at a place: names as bytes, references as (number,), dictionaries, lists, numbers; other tokens
    as they are."""
    m = _TOKEN.match(data, at)
    if not m:
        raise Unreadable(f"no object at byte {at}")
    t, at = m[1], m.end()
    if t == b"<<":
        out = {}
        while True:
            name, at = _value(data, at)
            if name == b">>":
                return out, at
            out[name], at = _value(data, at)
    if t == b"[":
        items = []
        while True:
            x, at = _value(data, at)
            if x == b"]":
                return items, at
            items.append(x)
    if re.fullmatch(rb"[+-]?\d+", t):
        ref = _REF.match(data, at)
        return ((int(t),), ref.end()) if ref else (int(t), at)
    return t, at


def _stream(data: bytes, head: dict, at: int, objects: Objects) -> bytes:
    """The decoded bytes of a stream whose dictionary ends at a place."""
    start = re.compile(rb"\s*stream\r?\n").match(data, at)
    if not start:
        raise Unreadable(f"no stream at byte {at}")
    size = objects.get(head.get(b"/Length"))
    raw = data[start.end() : start.end() + size]
    if head.get(b"/Filter") in (b"/FlateDecode", [b"/FlateDecode"]):
        raw = zlib.decompressobj().decompress(raw)
    elif b"/Filter" in head:
        raise Unreadable("a stream of another filter")
    parms = head.get(b"/DecodeParms") or {}
    parms = parms[0] if isinstance(parms, list) else parms
    return _unpredicted(raw, parms.get(b"/Columns", 1)) if parms.get(b"/Predictor", 1) >= 10 else raw


def _unpredicted(raw: bytes, wide: int) -> bytes:
    """Rows of bytes that are told as differences to what is left of and above them."""
    out, above = bytearray(), bytes(wide)
    for i in range(0, len(raw) - wide, wide + 1):
        how, row = raw[i], bytearray(raw[i + 1 : i + 1 + wide])
        for k in range(wide):
            a, b, c = (row[k - 1] if k else 0), above[k], (above[k - 1] if k else 0)
            nearest = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            row[k] = (row[k] + (0, a, b, (a + b) // 2, nearest)[how]) & 255
        out += row
        above = row
    return bytes(out)


class Objects:
    """A file's objects by number, found through its cross-reference tables and streams, the newest first."""

    def __init__(self, data: bytes) -> None:
        self.data, self.places, self.trailer = data, {}, {}
        found = [int(m[1]) for m in re.finditer(rb"startxref\s+(\d+)", data)]
        if not found:
            raise Unreadable("no cross-reference")
        todo, seen = [found[-1]], set()
        while todo:
            at = todo.pop(0)
            if at in seen or not 0 <= at < len(data):
                continue
            seen.add(at)
            head = self._table(at) if data[at : at + 4] == b"xref" else self._stream(at)
            for k, v in head.items():
                self.trailer.setdefault(k, v)
            todo += [head[k] for k in (b"/XRefStm", b"/Prev") if isinstance(head.get(k), int)]

    def _table(self, at: int) -> dict:
        at += 4
        part = re.compile(rb"\s*(\d+) (\d+)\s*?\r?\n?(?=\s*\d{10})|\s*(\d+) 0(?=\s)")
        while m := part.match(self.data, at):
            at = m.end()
            for i in range(int(m[2] or 0)):
                row = re.compile(rb"\s*(\d{10}) (\d{5}) ([nf])").match(self.data, at)
                if not row:
                    raise Unreadable("a cross-reference that ends early")
                if row[3] == b"n":
                    self.places.setdefault(int(m[1]) + i, (int(row[1]), None))
                at = row.end()
        m = re.compile(rb"\s*trailer").match(self.data, at)
        if not m:
            raise Unreadable("no trailer")
        return _value(self.data, m.end())[0]

    def _stream(self, at: int) -> dict:
        head, body = self._object(at)
        a, b, c = head[b"/W"]
        index = head.get(b"/Index", [0, head[b"/Size"]])
        numbers = [n for s, k in zip(index[::2], index[1::2]) for n in range(s, s + k)]
        for i, n in enumerate(numbers):
            row = body[i * (a + b + c) : (i + 1) * (a + b + c)]
            kind = int.from_bytes(row[:a], "big") if a else 1
            x, y = int.from_bytes(row[a : a + b], "big"), int.from_bytes(row[a + b :], "big")
            if kind == 1:
                self.places.setdefault(n, (x, None))
            elif kind == 2:
                self.places.setdefault(n, (x, y))  # the y-th in the stream of objects x
        return head

    def _object(self, at: int):
        m = re.compile(rb"\s*\d+\s+\d+\s+obj").match(self.data, at)
        if not m:
            raise Unreadable(f"no object at byte {at}")
        head, end = _value(self.data, m.end())
        is_stream = isinstance(head, dict) and re.compile(rb"\s*stream\r?\n").match(self.data, end)
        return head, _stream(self.data, head, end, self) if is_stream else None

    def get(self, x):
        """What a value is, or refers to."""
        if not isinstance(x, tuple):
            return x
        if x[0] not in self.places:
            raise Unreadable(f"object {x[0]} is missing")
        at, inner = self.places[x[0]]
        if inner is None:
            return self._object(at)[0]
        head, body = self._object(self.places[at][0])
        starts = [int(n) for n in body[: head[b"/First"]].split()][1::2]
        return _value(body, head[b"/First"] + starts[inner])[0]


def page_count(data: bytes) -> int:
    """The pages of a PDF file. A file that is encrypted or whose structure can't be read is an error."""
    try:
        objects = Objects(data)
        if b"/Encrypt" in objects.trailer:
            raise Unreadable("the file is encrypted")
        n = objects.get(objects.get(objects.get(objects.trailer[b"/Root"])[b"/Pages"])[b"/Count"])
    except Unreadable:
        raise
    except (LookupError, TypeError, ValueError, AttributeError, RecursionError, zlib.error) as e:
        raise Unreadable(f"the file's structure can't be read: {type(e).__name__}: {e}") from e
    if not isinstance(n, int) or n < 0:
        raise Unreadable("the file doesn't say how many pages it has")
    return n


def counted_pages(content: Column) -> Column:
    """page_count of files, and what is wrong with those that have none."""

    @F.pandas_udf("struct<page_count:int,problem:string>")
    def run(contents: pd.Series) -> pd.DataFrame:
        out = []
        for data in contents:
            try:
                out.append((page_count(bytes(data)), None))
            except Unreadable as e:
                out.append((None, str(e)))
        return pd.DataFrame(out, columns=["page_count", "problem"])

    return run(content)


def files(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """(path, content) of the PDF files below a folder; as a stream, of those that come."""
    reader = spark.readStream.schema(FILE_SCHEMA) if stream else spark.read
    return reader.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", True).load(path).select("path", "content")


def described(raw: DataFrame) -> DataFrame:
    """files with size, sha256, has_magic, page_count and problem."""
    facts = counted_pages(F.col("content"))
    out = raw.withColumn("size", F.octet_length("content").cast("long")).withColumn("sha256", F.sha2("content", 256)).withColumn("has_magic", F.coalesce(F.substring("content", 1, 5) == F.lit(b"%PDF-"), F.lit(False)))
    return out.withColumn("facts", facts).select(*out.columns, "facts.page_count", "facts.problem")


def recognised(documents: DataFrame, ocr: Callable[[bytes, int, int], dict], each: int = MAX_PAGES) -> DataFrame:
    """OCR shards (document_id, shard_index, text, pages) of documents (document_id, content, page_count): ``ocr`` is called once
    for each range of at most ``each`` pages, with the file's bytes and the first and last page, and gives a payload with text
    and pages. A document without any output is an error. Ranges are dealt over tasks one by one; a document's bytes go with each
    of its ranges. What comes out is to be written before it is used twice (see plans.flows.ingested)."""

    def read(asked: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = []
                for r in pdf.itertuples(index=False):
                    payload = ocr(bytes(r.content), int(r.first), int(r.last))
                    if payload:
                        rows.append((r.document_id, r.shard_index, payload.get("text"), payload.get("pages") or []))
                yield pd.DataFrame(rows, columns=["document_id", "shard_index", "text", "pages"])

        kind = dict(documents.dtypes)["document_id"]
        dealt = asked.select("document_id", "shard_index", "first", "last", "content").repartition(F.xxhash64("document_id", "shard_index"))
        return dealt.mapInPandas(run, f"document_id {kind}, shard_index int, {SHARD_SCHEMA}")

    return ocr_job(documents.select("document_id", "content", "page_count"), read, each)
