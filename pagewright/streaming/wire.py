"""A model's answer from bytes to events, as one stream: pieces in any order, cut anywhere, also inside a character."""

from __future__ import annotations

import codecs
import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..constants import NO_ANSWER
from .answers import CLOSED_MS, IDLE_MS, AnswerExtractor
from .state import Timers, stateful, type_of

_STATE = "next long, tail binary, line string, buffer string, inside boolean, closed boolean, raw string, over boolean, n long"
_NEW = (0, b"", "", "", False, False, "", False, 0)


def delta(line: str) -> str | None:
    """The content of a ``data: `` line; None for [DONE], "" for any other line."""
    if not line.startswith("data: "):
        return ""
    body = line[6:].strip()
    if body == "[DONE]":
        return None
    try:
        said = json.loads(body)["choices"][0]["delta"]["content"]
    except (ValueError, LookupError, TypeError):
        return ""
    return said if isinstance(said, str) else ""


def final_answer(raw: str) -> str:
    """What the whole answer says: its answer field, read strictly or as far as it can be read; else a fixed text."""
    try:
        body = json.loads(raw)
        answer = body["answer"] if isinstance(body["answer"], str) and isinstance(body["citations"], list) else None
    except (ValueError, LookupError, TypeError):
        answer = None
    return (AnswerExtractor().feed(raw) if answer is None else answer).strip() or NO_ANSWER


class Wire(StatefulProcessor):
    """One conversation's stream: pieces that came too early, the bytes of a character that isn't whole, the line that isn't
    ended, and the answer's extractor. What was read is emitted by lines, so nothing depends on the cuts."""

    def init(self, handle) -> None:
        self.state = handle.getValueState("state", _STATE)
        self.early = handle.getMapState("early", "seq long", "piece binary, error string, last boolean")
        self.timers = Timers(handle)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        was = self.state.get()
        fresh = was is None
        seq, tail, line, buffer, inside, closed, raw, over, n = _NEW if fresh else was
        known = {}
        for _, seqs, sizes, joined, error, last in rows:
            at = 0
            for s, size in zip(seqs, sizes):
                if s is not None and s >= seq:
                    known.setdefault(s, (joined[at : at + size], error, last))
                at += size
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        decoder.setstate((bytes(tail), 0))
        extractor, out = AnswerExtractor(buffer, inside, closed), []
        if fresh:
            out.append(("meta", json.dumps({"conversationId": str(key[0])})))
        if not over:
            ready, error, last = [], None, False
            while error is None and not last:
                if seq in known:
                    piece, error, last = known.pop(seq)
                elif not fresh and self.early.containsKey((seq,)):
                    piece, error, last = self.early.getValue((seq,))
                    self.early.removeKey((seq,))
                else:
                    break
                seq += 1
                if error is None:
                    ready.append(bytes(piece))
            last = last and error is None
            *lines, line = (line + decoder.decode(b"".join(ready), last)).split("\n")
            for whole in lines:
                said = delta(whole)
                if said is None:
                    last = True
                    break
                raw += said
                token = extractor.feed(said)
                if token:
                    out.append(("token", token))
            if last:
                content = final_answer(raw)
                if not extractor.closed:
                    out.append(("token", content))
                out.append(("done", content))
            elif error is not None:
                out.append(("error", error))
            over = last or error is not None
        if over:
            known, line, raw = {}, "", ""
            if not fresh:
                self.early.clear()
            extractor = AnswerExtractor(closed=True)
        for s, p in known.items():
            self.early.updateValue((s,), p)
        self.state.update((seq, decoder.getstate()[0], line, extractor.buffer, extractor.inside, extractor.closed, raw, over, n + len(out)))
        self.timers.set("silent", timerValues.getCurrentProcessingTimeInMs() + (CLOSED_MS if over else IDLE_MS))
        if out:
            types, payloads = map(list, zip(*out))
            yield Row(conv_id=key[0], first=n, types=types, payloads=payloads)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.timers.fired(expiredTimerInfo.getExpiryTimeInMs()):
            self.state.clear()
            self.early.clear()
        return iter(())

    def close(self) -> None:
        pass


def side_by_side(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for those pieces of a batch that have a conversation, an error, and whether it's the last in common: their bytes joined
    in the order of the batch. Pieces are small, and each row costs a stateful stream more than what is in it."""
    for batch in batches:
        piece = pc.fill_null(batch["piece"], b"")
        t = pa.table({c: batch[c] for c in ("conv_id", "error", "last", "seq")} | {"size": pc.binary_length(piece).cast("int32"), "piece": piece})
        found = t.group_by(["conv_id", "error", "last"], use_threads=False).aggregate([("seq", "list"), ("size", "list"), ("piece", "list")])
        out = {"conv_id": found["conv_id"], "seqs": found["seq_list"], "sizes": found["size_list"], "joined": pc.binary_join(found["piece_list"], b"")}
        yield from pa.table(out | {c: found[c] for c in ("error", "last")}).to_batches()


def answer_events(pieces: DataFrame) -> DataFrame:
    """(conv_id, seq, type, payload) of a stream or table of pieces (conv_id, seq from 0, piece binary, error string, last boolean).

    meta comes first, then a token for each line that adds to the answer, then one end: done with the whole answer, at [DONE] or after the piece
    that is the last, or error with what a piece says went wrong. An answer that couldn't be told while it came is one token before
    its done. Pieces are read in the order of seq; those that come early wait, those that come again are ignored, and nothing follows
    the end. A conversation that ended is remembered for CLOSED_MS, one that fell silent for IDLE_MS.
    """
    stateful(pieces.sparkSession)
    rows = pieces.select("conv_id", F.col("seq").cast("long").alias("seq"), F.col("piece").cast("binary").alias("piece"), F.col("error").cast("string").alias("error"), F.coalesce("last", F.lit(False)).alias("last"))
    key = type_of(pieces, "conv_id")
    rows = rows.mapInArrow(side_by_side, f"conv_id {key}, seqs array<long>, sizes array<int>, joined binary, error string, last boolean")
    schema = f"conv_id {key}, first long, types array<string>, payloads array<string>"
    told = rows.groupBy("conv_id").transformWithState(Wire(), schema, "append", "ProcessingTime")
    each = told.select("conv_id", "first", F.posexplode(F.arrays_zip("types", "payloads")).alias("n", "e"))
    return each.select("conv_id", (F.col("first") + F.col("n")).alias("seq"), F.col("e.types").alias("type"), F.col("e.payloads").alias("payload"))
