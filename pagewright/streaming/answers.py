"""Incremental decoding of structured answers that arrive in pieces, as a batch fold and as a stateful stream."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.grounding import extract_answer

_OPEN = re.compile(r'"answer"\s*:\s*"')
# how far the end of a piece may be the beginning of the field
_MAYBE = re.compile(r'"(?:a(?:n(?:s(?:w(?:e(?:r(?:"\s*(?::\s*)?)?)?)?)?)?)?)?$')
_TOKEN = re.compile(r'\\([\s\S])|([^"\\]+)|(")')
_PLAIN = {"n": "\n", "t": "\t", "r": "\r"}
CLOSED_MS, IDLE_MS = 60 * 60 * 1000, 24 * 60 * 60 * 1000  # how long a finished or a silent conversation is remembered


class AnswerExtractor:
    """Text of the first answer field, emitted as it comes. The result doesn't depend on where the input is cut: a backslash
    at the end of a piece waits for the next one. Unknown escapes lose their backslash. Only what may still matter is kept."""

    def __init__(self, buffer: str = "", inside: bool = False, closed: bool = False) -> None:
        self.buffer, self.inside, self.closed = buffer, inside, closed

    def feed(self, piece: str) -> str:
        if self.closed:
            return ""
        text = self.buffer + piece
        if not self.inside:
            field = _OPEN.search(text)
            if field is None:
                rest = _MAYBE.search(text)
                self.buffer = rest[0] if rest else ""
                return ""
            self.inside, text = True, text[field.end() :]
        if '"' not in text and "\\" not in text:
            self.buffer = ""
            return text
        out, end = [], 0
        for token in _TOKEN.finditer(text):
            escaped, plain, quote = token.groups()
            end = token.end()
            if quote:
                self.closed = True
                break
            out.append(plain or _PLAIN.get(escaped, escaped))
        self.buffer = "" if self.closed else text[end:]  # a lone backslash
        return "".join(out)


def framed(pieces: DataFrame, by: list[str], order: str, piece: str = "piece") -> DataFrame:
    """(by..., line_no, line) of texts that are cut anywhere: each line that was ended. A line may span pieces. What is put in a
    stream's order are the counts of line ends; texts come together by line."""
    ends = F.split(F.coalesce(F.col(piece), F.lit("")), "\n")
    whole = Window.partitionBy(*by)
    before = whole.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    counted = pieces.select(*by, F.col(order).alias("_at"), ends.alias("_parts"), (F.size(ends) - 1).alias("_n"), F.col(order))
    counted = counted.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("_all", F.sum("_n").over(whole))
    parts = counted.select(*by, "_at", "_before", "_all", F.posexplode("_parts").alias("_pos", "_part")).withColumn("line_no", F.col("_before") + F.col("_pos")).where(F.col("line_no") < F.col("_all"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_pos", "_part"))), lambda p: p["_part"]), "")
    return parts.groupBy(*by, "line_no").agg(text.alias("line"))


def sse_deltas(lines: DataFrame, line: str = "line", by: list[str] | None = None, order: str | None = None) -> DataFrame:
    """lines with delta: the content of ``data: `` lines; [DONE], other lines and bad JSON have none. With an order, nothing of
    a stream (by...) is decoded from its first [DONE] on."""
    body = F.when(F.col(line).startswith("data: "), F.trim(F.substring(F.col(line), 7, 1 << 30)))
    content = F.get_json_object(F.to_json(F.try_parse_json(body)), "$.choices[0].delta.content")
    done = F.coalesce(body == "[DONE]", F.lit(False))
    if order is None:
        return lines.withColumn("done", done).withColumn("delta", F.when(body != "[DONE]", content))
    end = F.min(F.when(done, F.col(order))).over(Window.partitionBy(*(by or [])))
    ended = F.coalesce(F.col(order) >= end, F.lit(False))
    return lines.withColumn("_ended", ended).withColumn("delta", F.when(~F.col("_ended"), content)).withColumnRenamed("_ended", "done")


_OUT = "conv_id long, seq long, token string, closed boolean"
_STATE = "buffer string, inside boolean, closed boolean, seq long"


def streamed_answers(deltas: DataFrame) -> DataFrame:
    """A stream of (conv_id, seq, delta) to answer tokens. A conversation's state is what isn't decoded yet. Pieces of one
    trigger are put in the order of seq; a trigger must not overtake another. A finished conversation is remembered for
    CLOSED_MS, so that late pieces don't begin it again, and one that fell silent for IDLE_MS; then its state goes."""

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=["conv_id", "seq", "token", "closed"])
            return
        buffer, inside, closed, n = state.get if state.exists else ("", False, False, 0)
        x = AnswerExtractor(buffer, inside, closed)
        rows = []
        for pdf in sorted((p for b in batches for p in b[["seq", "delta"]].itertuples(index=False)), key=lambda p: p.seq):
            token = x.feed(pdf.delta or "")
            if token:
                rows.append((key[0], n, token, x.closed))
                n += 1
        state.update((x.buffer, x.inside, x.closed, n))
        state.setTimeoutDuration(CLOSED_MS if x.closed else IDLE_MS)
        yield pd.DataFrame(rows, columns=["conv_id", "seq", "token", "closed"])

    return deltas.groupBy("conv_id").applyInPandasWithState(run, _OUT, _STATE, "append", "ProcessingTimeTimeout")


def folded_answers(deltas: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., answer) of answers (by..., seq, delta), by default one for each conv_id: the pieces put together in order, and
    their answer field read by built-in functions. An answer, not a conversation, is held in a row."""
    by = by or ["conv_id"]
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "delta"))), lambda p: F.coalesce(p["delta"], F.lit(""))), "")
    return deltas.groupBy(*by).agg(whole.alias("j")).select(*by, F.coalesce(extract_answer(F.col("j")), F.lit("")).alias("answer"))


def folded_events(events: DataFrame) -> DataFrame:
    """Client's view of events (conv_id, seq, type, content): tokens are appended, the content of the first done replaces them,
    an error aborts; what follows the first done or error is ignored. (conv_id, answer, state)"""
    ends = F.col("type").isin("done", "error")
    end = events.where(ends).groupBy("conv_id").agg(F.min_by(F.struct("seq", "type", "content"), "seq").alias("end"))
    tokens = F.struct("seq", F.coalesce("content", F.lit("")).alias("t"))
    live = events.where("type = 'token'").join(end, "conv_id", "left").where("end is null or seq < end.seq")
    said = live.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(tokens)), lambda x: x["t"]), "").alias("said"))
    every = events.select("conv_id").distinct().join(said, "conv_id", "left").join(end, "conv_id", "left")
    answer = F.when(F.col("end.type") == "done", F.coalesce("end.content", "said")).otherwise(F.col("said"))
    return every.select("conv_id", F.coalesce(answer, F.lit("")).alias("answer"), F.coalesce("end.type", F.lit("open")).alias("state"))


def protocol(tokens: DataFrame, meta: DataFrame, ends: DataFrame) -> DataFrame:
    """(conv_id, seq, type, payload): a stream's events. meta (conv_id, payload) comes first, then the tokens (conv_id, seq,
    payload) in order, then the one end (conv_id, type, payload); a stream without an end is open."""
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("place", "seq")).cast("long") - 1
    first = meta.select("conv_id", F.lit(0).alias("place"), F.lit(0).cast("long").alias("seq"), F.lit("meta").alias("type"), "payload")
    middle = tokens.select("conv_id", F.lit(1).alias("place"), F.col("seq").cast("long").alias("seq"), F.lit("token").alias("type"), "payload")
    last = ends.groupBy("conv_id").agg(F.min(F.struct("type", "payload")).alias("e")).select("conv_id", F.lit(2).alias("place"), F.lit(0).cast("long").alias("seq"), "e.type", "e.payload")
    return first.unionByName(middle).unionByName(last).withColumn("n", n).select("conv_id", F.col("n").alias("seq"), "type", "payload")


def protocol_faults(events: DataFrame) -> DataFrame:
    """(conv_id, fault) of streams (conv_id, seq, type) that break the protocol: 'no meta', 'late meta', 'no end', 'after end'."""
    one = events.groupBy("conv_id").agg(
        F.min_by("type", "seq").alias("first"),
        F.count_if(F.col("type") == "meta").alias("metas"),
        F.min(F.when(F.col("type").isin("done", "error"), F.col("seq"))).alias("end"),
        F.max("seq").alias("last"),
    )
    fault = F.when(F.col("metas") == 0, "no meta").when((F.col("first") != "meta") | (F.col("metas") > 1), "late meta").when(F.col("end").isNull(), "no end").when(F.col("end") < F.col("last"), "after end")
    return one.select("conv_id", fault.alias("fault")).where("fault is not null")


def live(rows: DataFrame, evaluate, show, checkpoint: str | None = None):
    """A subscription: evaluate(rows so far) is shown anew whenever a stream brings rows; show(DataFrame, n) gets each result.
    evaluate must be an aggregation that Structured Streaming can keep up to date."""
    q = evaluate(rows).writeStream.outputMode("complete").foreachBatch(show)
    return (q.option("checkpointLocation", checkpoint) if checkpoint else q).trigger(availableNow=True).start()
