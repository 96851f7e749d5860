"""Shards of nearly equal bytes by histogram sort, with DataFrame functions only.

Keys are 63-bit: the crc32 of the text, then a hash of doc_id, so equal texts lie side by side and a large group of them can
still be cut. Bytes below candidate boundaries are counted exactly over all partitions: the first round counts equal slices of
the key range, each further round cuts only slices that hold a boundary, until every boundary is within tolerance of its
target or its slice is a single key. Then rows are exchanged once, by boundaries that are finer than the shards, and numbered
inside pieces. Only counts of slices reach the driver, at most MOST_PIECES * 2**STEP_BITS in a round.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import save, tidy

KEY_BITS, FIRST_BITS, STEP_BITS = 63, 12, 6
MOST_PIECES, PIECE_ROWS = 16_384, 50_000


def listed(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table from a literal, without Python workers."""
    names = [f.split()[0] for f in schema.split(", ")]
    text = json.dumps([dict(zip(names, r)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema.replace(' ', ':')}>>".replace(",:", ","))))


def splitters(light: DataFrame, pieces: int, shards: int, tolerance: float) -> tuple[list[tuple[int, int, int]], int]:
    """[(first key, bytes below it, rows below it)] of pieces 1.., and all rows. A piece that begins a shard meets the
    tolerance, a share of a shard's bytes; the others one of a piece's bytes."""
    shift = KEY_BITS - FIRST_BITS
    counts = light.groupBy(F.shiftright("key", shift).alias("slice")).agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).orderBy("slice").collect()
    total, rows = sum(r.b for r in counts), sum(r.n for r in counts)
    if not rows:
        return [], 0
    found: dict[int, tuple[int, int, int]] = {}
    # open boundaries by the slice that holds them: slice -> (bytes below, rows below, boundaries)
    open_ = {0: (0, 0, list(range(1, pieces)))}
    per = FIRST_BITS
    while open_:
        inside: dict[int, list] = {}
        for r in counts:
            inside.setdefault(r.slice >> per, []).append(r)
        nxt: dict[int, tuple[int, int, list[int]]] = {}
        for parent, (below, above, todo) in open_.items():
            todo = sorted(todo)
            for r in inside.get(parent, []):
                while todo and below + r.b >= todo[0] * total / pieces:
                    i = todo.pop(0)
                    goal = i * total / pieces
                    slack = tolerance * total / (shards if i % (pieces // shards) == 0 else pieces)
                    lo, hi = goal - below, below + r.b - goal
                    if lo <= slack and lo <= hi:
                        found[i] = (r.slice << shift, below, above)
                    elif hi <= slack or shift == 0:
                        first = lo <= hi
                        found[i] = ((r.slice + (not first)) << shift, below + (0 if first else r.b), above + (0 if first else r.n))
                    else:
                        nxt.setdefault(r.slice, (below, above, []))[2].append(i)
                below, above = below + r.b, above + r.n
            for i in todo:
                found[i] = (1 << KEY_BITS, total, rows)
        open_ = nxt
        if open_:
            step = min(STEP_BITS, shift)
            held = listed(light.sparkSession, [(int(k),) for k in open_], "parent long")
            old, shift, per = shift, shift - step, step
            counts = light.withColumn("parent", F.shiftright("key", old)).join(F.broadcast(held), "parent").groupBy(F.shiftright("key", shift).alias("slice")).agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).orderBy("slice").collect()
    out, last = [], 0
    for i in range(1, pieces):
        k = max(found[i], (last, 0, 0))
        out.append(k)
        last = k[0]
    return out, rows


@tidy
def sharded(docs: DataFrame, shards: int = 16, tolerance: float = 0.002) -> DataFrame:
    """doc_id, size (UTF-8 bytes and 1), text_crc32, law ('bytes'), shard, slot (gapless from 0 in a shard), grown_shard
    (null): one row for each row of docs (doc_id, text; other columns are ignored).

    Shards have equal bytes within tolerance of a shard, or as near as whole documents allow. Null texts are empty.
    Rows that agree in doc_id and text share a shard, unless doc_id is null: those are cut like any others only by their
    text. With fewer documents than shards some shards are empty. Empty table: no rows.
    """
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    light = docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    low = F.xxhash64("doc_id", F.lit(17)).bitwiseAND(F.lit((1 << 31) - 1))
    light = save(light.withColumn("key", F.shiftleft("text_crc32", 31).bitwiseOR(low)), "keys")
    per = max(1, min(MOST_PIECES, light.count() // PIECE_ROWS) // shards)
    cuts, rows = splitters(light, shards * per, shards, tolerance)
    # the piece of a key: pieces that begin before its coarse slice, and those inside it up to the key
    coarse = KEY_BITS - FIRST_BITS
    begins = [(0, 0, 0), *cuts]
    slices: dict[int, list[int]] = {}
    for k, *_ in cuts:
        slices.setdefault(k >> coarse, []).append(k)
    rows_of, below = [], 0
    for s in range(1 << FIRST_BITS):
        rows_of.append((s, below, slices.get(s, [])))
        below += len(slices.get(s, []))
    table = listed(light.sparkSession, rows_of, "slice long, below int, cuts array<long>")
    dealt = light.withColumn("slice", F.shiftright("key", coarse)).join(F.broadcast(table), "slice")
    piece = F.col("below") + F.size(F.filter("cuts", lambda c: c <= F.col("key")))
    dealt = dealt.withColumn("piece", piece.cast("int")).select("doc_id", "size", "text_crc32", "key", "piece")
    starts = []
    for i, (_, _, above) in enumerate(begins):
        starts.append((i, i // per, above - (begins[i - i % per][2])))
    at = listed(light.sparkSession, starts, "piece int, shard int, before long")
    n = F.row_number().over(Window.partitionBy("piece").orderBy("key", "doc_id"))
    out = dealt.withColumn("n", n).join(F.broadcast(at), "piece")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("n") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
