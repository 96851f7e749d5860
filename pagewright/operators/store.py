"""Owner-scoped reads, ordered multi-gets, newest-N lists, and writes of the document store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import HISTORY_TURNS

FILTERED = 1000  # ids in a filter


def point(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == F.lit(value))


def equal(df: DataFrame, **keys) -> DataFrame:
    """Rows equal in every key; all conditions reach the scan."""
    for k, v in keys.items():
        df = df.where(F.col(k) == F.lit(v))
    return df


def owned(df: DataFrame, key: str, value, owner_column: str, owner) -> DataFrame:
    return df.where((F.col(key) == F.lit(value)) & (F.col(owner_column) == F.lit(owner)))


def multi_get(df: DataFrame, ids: list, key: str = "id") -> DataFrame:
    """Rows in the order of ids, with position; missing ids are dropped, repeated ones give their row again. The ids are a
    request's parameter; they reach the scan as a filter while there are at most FILTERED of them."""
    wanted = df.sparkSession.createDataFrame([(i, v) for i, v in enumerate(ids)], f"position long, {key} {dict(df.dtypes)[key]}")
    few = len(set(ids)) <= FILTERED
    return (df.where(F.col(key).isin(list(set(ids)))).join(F.broadcast(wanted), key) if few else df.join(wanted, key)).orderBy("position")


def multi_get_of(df: DataFrame, asked: DataFrame, key: str = "id") -> DataFrame:
    """The same for many requests at once: asked (request, position, key). A request's rows come together and in order; requests
    aren't sorted among each other."""
    return asked.join(df, key).repartition("request").sortWithinPartitions("request", "position")


def newest(df: DataFrame, n: int, order: str, tie: str | None = None) -> DataFrame:
    return df.orderBy(F.desc(order), *([F.desc(tie)] if tie else [])).limit(n)


def last_n(df: DataFrame, n: int, by: list[str], order: str, where: Column | None = None) -> DataFrame:
    """The newest n rows of each key, numbered oldest first. Spark keeps n rows of a key per task before the shuffle."""
    rows = df if where is None else df.where(where)
    top = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))).where(F.col("_n") <= n)
    return top.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(order)).cast("long")).drop("_n")


def history(messages: DataFrame, conversations: DataFrame, conversation, owner, n: int = HISTORY_TURNS, order: str = "created_at") -> DataFrame:
    """The newest n messages of a conversation, numbered oldest first; none if the owner's isn't that conversation."""
    mine = owned(conversations, "id", conversation, "owner", owner).select(F.col("id").alias("conversation_id"))
    return last_n(messages.where(F.col("conversation_id") == F.lit(conversation)).join(mine, "conversation_id", "left_semi"), n, ["conversation_id"], order)


def recent_oldest_first(df: DataFrame, n: int, order: str) -> DataFrame:
    """The newest n rows, in the order in which they came."""
    return newest(df, n, order).orderBy(order)


def first_n_then_sort(df: DataFrame, n: int, created: str, order: str) -> DataFrame:
    return df.orderBy(created).limit(n).orderBy(order)


def has_any(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    return parents.join(children, key, "left_semi")


def append_checked(parents: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """rows to be appended; a row whose parent is missing is an error."""
    known = parents.select(key).distinct().withColumn("_known", F.lit(True))
    out = rows.join(known, key, "left")
    checked = F.when(F.col("_known"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("no parent "), F.col(key).cast("string"))).cast(dict(rows.dtypes)[key]))
    return out.withColumn(key, checked).select(*rows.columns)


def inserted(df: DataFrame, rows: DataFrame, defaults: dict | None = None) -> DataFrame:
    """df with rows appended; fields that rows don't have, or have as null, take their default, or null."""
    defaults = defaults or {}
    kinds = dict(df.dtypes)

    def field(c: str) -> Column:
        given = F.col(f"`{c}`") if c in rows.columns else F.lit(None)
        return F.coalesce(given.cast(kinds[c]), F.lit(defaults.get(c)).cast(kinds[c])).alias(c)

    return df.unionByName(rows.select(*(field(c) for c in df.columns)))


def patched(df: DataFrame, changes: DataFrame, key: str = "id", unset: str | None = None) -> DataFrame:
    """Shallow merge: only fields that a change gives are overwritten. unset names a column of changes that lists fields to be
    cleared. A key is changed once; changes of unknown keys do nothing."""
    fields = [c for c in changes.columns if c not in (key, unset)]
    new = changes.select(F.col(key).alias("_key"), F.struct(*(F.col(f"`{c}`") for c in fields), *([F.col(unset).alias("_unset")] if unset else [])).alias("_new"))
    out = df.join(new, F.col(key) == F.col("_key"), "left")

    def field(c: str) -> Column:
        value = F.coalesce(F.col(f"_new.`{c}`"), F.col(f"`{c}`")) if c in fields else F.col(f"`{c}`")
        return (F.when(F.coalesce(F.array_contains("_new._unset", F.lit(c)), F.lit(False)), F.lit(None)).otherwise(value) if unset and c != key else value).alias(c)

    return out.select(*(field(c) for c in df.columns))


def replaced(df: DataFrame, rows: DataFrame, key: str = "id", drop: tuple[str, ...] = ("error",)) -> DataFrame:
    """df with whole rows in place of those of the same key; the fields of drop are cleared in them. Keys that df doesn't hold
    aren't added."""
    known = rows.join(df.select(key), key, "left_semi")
    new = known.select(*((F.lit(None) if c in drop or c not in rows.columns else F.col(f"`{c}`")).cast(t).alias(c) for c, t in df.dtypes))
    return df.join(rows.select(key), key, "left_anti").unionByName(new)


def deleted(df: DataFrame, keys: DataFrame, key: str = "id", guard: Column | None = None) -> DataFrame:
    """df without the rows of keys for which the guard holds."""
    target = df if guard is None else df.where(guard)
    gone = target.join(keys, key, "left_semi").select(key)
    return df.join(gone, key, "left_anti")


def cleared(df: DataFrame, documents: DataFrame, key: str = "document_id") -> DataFrame:
    """df without any row of the documents: what deletion in batches until nothing is left comes to."""
    return df.join(documents.select(key).distinct(), key, "left_anti")


def sse(payload: Column) -> Column:
    """A server-sent event of a struct."""
    return F.concat(F.lit("data: "), F.to_json(payload), F.lit("\n\n"))
