"""Generic record queries: where, select, sort, limit, offset and keyset pages."""

from __future__ import annotations

import base64
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def literal(v) -> Column:
    """A clause's value: text, number, boolean, or a list of one of these as an array."""
    return F.array(*(F.lit(x) for x in v)) if isinstance(v, (list, tuple)) else F.lit(v)


_BINARY = {
    "eq": lambda c, v: c.isNull() if v is None else c == literal(v),
    "ne": lambda c, v: c.isNotNull() if v is None else c != literal(v),
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "in": lambda c, v: c.isin(list(v)) if v else F.lit(False),
    "not_in": lambda c, v: ~c.isin(list(v)) if v else F.lit(True),
    "contains": lambda c, v: c.contains(v),
    "starts_with": lambda c, v: c.startswith(v),
    "ends_with": lambda c, v: c.endswith(v),
}


def condition(clause: dict) -> Column:
    return _BINARY[clause.get("operator", "eq")](F.col(clause["field"]), clause.get("value"))


def where(clauses: list[dict]) -> Column:
    """All AND clauses hold, and one of the OR clauses if there are any."""
    every = [condition(c) for c in clauses if c.get("connector", "AND") == "AND"]
    some = [condition(c) for c in clauses if c.get("connector") == "OR"]
    both = every + ([reduce(lambda a, b: a | b, some)] if some else [])
    return reduce(lambda a, b: a & b, both, F.lit(True))


def find_many(df: DataFrame, clauses=(), select=None, sort_by=None, limit=None, offset=None) -> DataFrame:
    out = df.where(where(list(clauses)))
    if sort_by:
        c = F.col(sort_by["field"])
        out = out.orderBy(c.desc() if sort_by.get("direction") == "desc" else c.asc(), *(F.col(k) for k in sort_by.get("ties", [])))
    if offset:
        out = out.offset(offset)
    if limit is not None:
        out = out.limit(limit)
    return out.select(*select) if select else out


def page(df: DataFrame, clauses, key: str, size: int, cursor=None, end=None) -> DataFrame:
    """A page of at most ``size`` rows in the order of a unique key after the cursor and, if given, up to the end cursor
    (which may hold more), with is_done and continue_cursor: the key after which the next page begins. Work doesn't grow
    with the page's number, as it does with an offset."""
    rows = df.where(where(list(clauses)))
    if cursor is not None:
        rows = rows.where(F.col(key) > F.lit(cursor))
    if end is not None:
        last = rows.where(F.col(key) <= F.lit(end))
        return last.withColumn("is_done", F.lit(rows.where(F.col(key) > F.lit(end)).isEmpty())).withColumn("continue_cursor", F.lit(end).cast(dict(df.dtypes)[key]))
    top = rows.orderBy(key).limit(size + 1)
    whole = Window.partitionBy()  # of size + 1 rows
    n = top.withColumn("_n", F.row_number().over(Window.orderBy(key))).withColumn("is_done", F.max("_n").over(whole) <= size)
    return n.where(F.col("_n") <= size).drop("_n").withColumn("continue_cursor", F.max(key).over(whole))


def _sorted_by(order: list[tuple[str, str]]) -> list[Column]:
    return [F.col(c).desc_nulls_last() if way == "desc" else F.col(c).asc_nulls_first() for c, way in order]


def cursor_of(order: list[tuple[str, str]], version: int | None = None) -> Column:
    """An opaque text that names a row's place in an order, and the version of the table in which it has it."""
    values = F.to_json(F.array(*(F.col(c).cast("string") for c, _ in order)))
    head = json.dumps({"order": [list(o) for o in order], "version": version})[:-1]
    return F.base64(F.encode(F.concat(F.lit(head + ', "after": '), values, F.lit("}")), "UTF-8"))


def cursor_version(cursor: str | None) -> int | None:
    """The version that a walk through pages stays on."""
    return None if cursor is None else json.loads(base64.b64decode(cursor))["version"]


def _beyond(column: Column, way: str, value: Column, null: bool) -> Column:
    """Later than a value in its column's order: ascending with nulls first, or descending with nulls last."""
    if way == "desc":
        return F.lit(False) if null else (column < value) | column.isNull()
    return column.isNotNull() if null else column > value


def after(order: list[tuple[str, str]], values: list[str | None], kinds: dict[str, str]) -> Column:
    """Rows later than the one with these values, key by key. What the first key says alone stands before it, so that it
    reaches the scan."""
    out, equal = F.lit(False), F.lit(True)
    for (c, way), v in zip(order, values):
        column, value = F.col(c), F.lit(v).cast(kinds[c])
        out = out | (equal & _beyond(column, way, value, v is None))
        equal = equal & column.eqNullSafe(value)
    (c, way), v = order[0], values[0]
    if v is None:
        return out
    value = F.lit(v).cast(kinds[c])
    return ((F.col(c) >= value) if way == "asc" else (F.col(c) <= value) | F.col(c).isNull()) & out


def sorted_page(df: DataFrame, clauses, order: list[tuple[str, str]], size: int, cursor: str | None = None, version: int | None = None) -> DataFrame:
    """A page of at most ``size`` rows in an order of several keys, (column, "asc" or "desc"), that together are unique; nulls come
    first in ascending and last in descending keys. is_done, and continue_cursor: what to ask the next page with, on every
    row. A cursor of another order is an error. On a table with versions, read the version that cursor_version names: pages
    then fit together, whatever is written meanwhile. Values travel as text, so keys are numbers, texts, booleans, dates or
    timestamps."""
    order = [tuple(o) for o in order]
    rows = df.where(where(list(clauses)))
    if cursor is not None:
        place = json.loads(base64.b64decode(cursor))
        if [tuple(o) for o in place["order"]] != order:
            raise ValueError("the cursor belongs to another order")
        version = place["version"] if version is None else version
        rows = rows.where(after(order, place["after"], dict(df.dtypes)))
    top = rows.orderBy(*_sorted_by(order)).limit(size + 1)
    whole = Window.partitionBy()  # of size + 1 rows
    n = top.withColumn("_n", F.row_number().over(Window.orderBy(*_sorted_by(order)))).withColumn("is_done", F.max("_n").over(whole) <= size)
    n = n.where(F.col("_n") <= size).withColumn("continue_cursor", F.max_by(cursor_of(order, version), "_n").over(whole))
    return n.orderBy("_n").drop("_n")


def created(df: DataFrame, rows: DataFrame) -> DataFrame:
    return df.unionByName(rows, allowMissingColumns=True).select(*df.columns)


def update_many(df: DataFrame, clauses, changes: dict) -> DataFrame:
    hit = where(list(clauses))
    return df.select(*(F.when(hit, F.lit(changes[c])).otherwise(F.col(c)).cast(t).alias(c) if c in changes else F.col(c) for c, t in df.dtypes))


def delete_many(df: DataFrame, clauses) -> DataFrame:
    return df.where(~F.coalesce(where(list(clauses)), F.lit(False)))
