"""Sources mixed to target weights by systematic sampling, with DataFrame functions only.

Within a source, documents stand in classes of like size, the longest first. S is the prefix sum of their expected copies over the
whole source; one random offset u of the source is added, and a document is emitted once for each integer that lies in
(S before it + u, S with it + u]. All documents of a class expect r copies, so S at rank i of a class is its sum over the
classes before plus i * r, and the source's copies are floor(S + u) in all. The first class's r is the target over the
source's size; as a class gives whole documents only, what it takes too much or too little is spread over the shorter ones:
their r is what is left of the target over what is left of the source (3 at most). So a source comes near its target even if
a few documents are a large part of it.

Ranks need no task that holds a source: rows are counted by (source, size class, slice), the counts are summed up over the
slices of a class, and rows are numbered inside their cell only. A slice is the first SLICE_DIGITS of a hash of doc_id, at every
size of the table, so neither a hot source nor a hot size fills one task. The classes of a source, eight to an octave, are
a row. Texts are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import few, save, tidy

SLICE_DIGITS = 2  # 256 slices
MOST_COPIES = 3
BROADCAST = 1 << 16  # sources


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in a text; null: 0."""
    t = F.coalesce(text, F.lit(""))
    starts = F.length(F.regexp_replace(F.concat(F.lit(" "), t), r"[\x20\x09-\x0D](?=[^\x20\x09-\x0D])", ""))
    return (F.length(t) + 1 - starts).cast("long")


def slice_of(doc_id: Column, text: Column) -> Column:
    """Hex digits of a hash of doc_id; rows without one are told apart by their texts."""
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.coalesce(text, F.lit(""))))
    return F.substring(F.md5(key), 1, SLICE_DIGITS)


def offset(source: Column, seed: int) -> Column:
    """A number in [0, 1) fixed by source and seed."""
    hexed = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("")))), 1, 8)
    return F.conv(hexed, 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sources: DataFrame) -> DataFrame:
    """sources: one row per source (source, source_size). Adds target: all sizes shared by the weights 1, 2, 3, repeating
    by code point of the source, null last; stopped at three times a source's size, the excess reshared by weight. Windows
    run over the list of sources, not over documents."""
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    s = sources.withColumn("w", (1 + (F.row_number().over(by_name) - 1) % 3).cast("double")).withColumn("cap", (F.col("source_size") * MOST_COPIES).cast("double"))
    # sources fill up in the order of cap / w: before source k, `full` is held by those that are full already
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"))
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    s = s.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / F.sum("w").over(rest))
    fits = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct((F.col("cap") / F.col("w")).alias("ratio"), "level"))
    s = s.withColumn("level", F.min(fits).over(everything)["level"])  # of the first source that doesn't fill up
    return s.select("source", "source_size", F.least(F.coalesce(F.col("level") * F.col("w"), F.col("cap")), F.col("cap")).alias("target"))


def rates(classes: DataFrame, known: DataFrame, seed: int) -> DataFrame:
    """(source, g, r, base, u) of classes (source, g, n, size): expected copies of a document and of all documents of the
    classes before, and the source's offset."""
    each = classes.groupBy("source").agg(F.array_sort(F.collect_list(F.struct((-F.col("g")).alias("k"), "n", "size"))).alias("c"))
    each = each.join(known.select(F.col("source").alias("s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("s")))
    each = each.withColumn("u", offset(F.col("source"), seed))
    none = F.expr("cast(array() as array<struct<g:int,r:double,base:double>>)")
    start = F.struct(F.col("target").alias("goal"), F.col("source_size").cast("double").alias("left"), F.lit(0.0).alias("base"), none.alias("out"))

    def step(x: Column, c: Column) -> Column:
        r = F.when(x["left"] > 0, F.greatest(F.lit(0.0), F.least(F.lit(float(MOST_COPIES)), x["goal"] / x["left"]))).otherwise(0.0)
        upto = x["base"] + c["n"] * r
        took = (F.floor(upto + F.col("u")) - F.floor(x["base"] + F.col("u"))) * (c["size"] / c["n"])
        row = F.struct((-c["k"]).cast("int").alias("g"), r.alias("r"), x["base"].alias("base"))
        return F.struct((x["goal"] - took).alias("goal"), (x["left"] - c["size"]).alias("left"), upto.alias("base"), F.concat(x["out"], F.array(row)).alias("out"))

    return each.select("source", "u", F.inline(F.aggregate("c", start, step)["out"]))


@tidy
def copies(docs: DataFrame, seed: int = 7) -> DataFrame:
    """doc_id, size (words), source, source_size, target, copies: one row for each row of docs (doc_id, text, source; other
    columns are ignored). Null texts and texts without words have size 0. A null source is a source of its own. Rows that
    repeat are documents of their own. If no document has words, all copies are 0. Empty table: no rows."""
    light = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), slice_of(F.col("doc_id"), F.col("text")).alias("h"))
    light = save(light.withColumn("g", F.floor(F.log2(F.col("size") + 1) * 8).cast("int")), "sizes")
    known = save(targets(light.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets")
    bounded = known.count() <= BROADCAST
    small = lambda df: F.broadcast(df) if bounded else df
    classes = save(light.groupBy("source", "g").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")), "classes")
    given = rates(classes, known, seed).join(known.select(F.col("source").alias("t"), "source_size", "target"), F.col("source").eqNullSafe(F.col("t")))
    given = given.select(F.col("source").alias("s"), F.col("g").alias("cg"), "r", "base", "u", "source_size", "target")
    cells = light.groupBy("source", "g", "h").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("source", "g").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select(F.col("source").alias("s"), F.col("g").alias("cg"), F.col("h").alias("ch"), before.alias("before"))
    ranked = light.withColumn("n", F.row_number().over(Window.partitionBy("source", "g", "h").orderBy("size", "doc_id")))
    ranked = ranked.join(cells, F.col("source").eqNullSafe(F.col("s")) & (F.col("g") == F.col("cg")) & (F.col("h") == F.col("ch")))
    ranked = ranked.select("doc_id", "source", "size", "g", (F.col("before") + F.col("n")).alias("i"))
    out = ranked.join(small(given), F.col("source").eqNullSafe(F.col("s")) & (F.col("g") == F.col("cg")))
    n = F.floor(F.col("base") + F.col("i") * F.col("r") + F.col("u")) - F.floor(F.col("base") + (F.col("i") - 1) * F.col("r") + F.col("u"))
    # a rounded sum may cross one integer too many
    return out.select("doc_id", "size", "source", "source_size", "target", F.least(n, F.lit(MOST_COPIES)).cast("long").alias("copies"))


def mix(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The mixed documents: each row of docs as many times as it is drawn, all columns as they are. Rows with one doc_id
    take the number of the one that is drawn most. Documents without words follow their source as well."""
    drawn = copies(docs, seed).where("copies > 0").groupBy("doc_id").agg(F.max("copies").alias("copies"))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    out = whole.join(few(drawn), F.col("row.doc_id").eqNullSafe(F.col("doc_id")))
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*(F.col(f"row.`{c}`") for c in docs.columns))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'text:' || coalesce(text, ''))), 1, 2) AS h FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CAST(1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS DOUBLE) AS w, CAST(source_size * 3 AS DOUBLE) AS cap FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(w) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), t AS (
  SELECT source, source_size, least(coalesce((SELECT arg_min(level, cap / w) FROM l WHERE level * w <= cap) * w, cap), cap) AS target FROM l
), g AS (
  SELECT *, CAST(floor(log2(size + 1) * 8) AS INTEGER) AS g FROM d
), c AS (
  SELECT c.*, t.source_size, t.target, CAST(CAST('0x' || substr(md5('7:' || coalesce(t.source, '')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0::DOUBLE AS u,
    row_number() OVER (PARTITION BY t.source ORDER BY g DESC) AS k
  FROM (SELECT source, g, count(*) AS n, CAST(sum(size) AS BIGINT) AS size FROM g GROUP BY source, g) c JOIN t ON c.source IS NOT DISTINCT FROM t.source
), f AS (
  SELECT source, CAST(0 AS BIGINT) AS k, target AS goal, CAST(source_size AS DOUBLE) AS remaining, 0 AS g, 0.0::DOUBLE AS r, 0.0::DOUBLE AS base, 0.0::DOUBLE AS upto FROM c WHERE k = 1
  UNION ALL
  SELECT source, k, goal - (floor(base + n * r + u) - floor(base + u)) * (CAST(size AS DOUBLE) / n), remaining - size, g, r, base, base + n * r FROM (
    SELECT c.source, c.k, f.upto AS base, f.goal, f.remaining, c.g, c.n, c.size, c.u, CASE WHEN f.remaining > 0 THEN greatest(0.0::DOUBLE, least(3.0::DOUBLE, f.goal / f.remaining)) ELSE 0.0::DOUBLE END AS r
    FROM f JOIN c ON c.source IS NOT DISTINCT FROM f.source AND c.k = f.k + 1)
), r AS (
  SELECT g.doc_id, g.size, c.source_size, c.target, f.r, f.base, c.u, row_number() OVER (PARTITION BY g.source, g.g ORDER BY g.h, g.size, g.doc_id) AS i
  FROM g JOIN c ON g.source IS NOT DISTINCT FROM c.source AND g.g = c.g JOIN f ON f.source IS NOT DISTINCT FROM c.source AND f.k = c.k
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(size * least(floor(base + i * r + u) - floor(base + (i - 1) * r + u), 3) AS BIGINT) AS taken FROM r
"""
