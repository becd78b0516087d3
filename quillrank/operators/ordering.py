"""Places of rows in a total order of the whole table, without bringing the table into one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys that the driver sorts to find where to cut, whatever the table's size; a key is the order columns of one row.
SAMPLE = 4096
PARTS = 64


def _before(a: Column, b: Column, descending: bool) -> Column:
    """Whether a stands before b; nulls come first, or last if descending, as Spark orders them."""
    if descending:
        a, b = b, a
    return F.coalesce(a < b, a.isNull() & b.isNotNull())


def _precedes(a: list[Column], b: list[Column], descending: list[bool]) -> Column:
    """Whether the key a stands before the key b, column after column."""
    out = F.lit(False)
    for x, y, d in reversed(list(zip(a, b, descending, strict=True))):
        out = _before(x, y, d) | (x.eqNullSafe(y) & out)
    return out


def numbered(rows: DataFrame, order: list[tuple[str, bool]], name: str = "place", parts: int = PARTS) -> DataFrame:
    """``rows`` with their places from 1 as a long, in the order of (column, descending) pairs.

    The keys of least hash, at most SAMPLE of them, give at most ``parts`` - 1 cuts; ranges between cuts are counted,
    ranked each in a task of its own, and shifted by the sizes of the ranges before. Rows equal in all order columns get
    places in any order and share a range, so end the order with a column that tells rows apart. ``rows`` is read three
    times and must give the same rows each time. An empty table stays empty.
    """
    if name in rows.columns:
        raise ValueError(f"the column {name} is there")
    columns, falls = [c for c, _ in order], [d for _, d in order]
    sample = rows.select(*columns).orderBy(F.xxhash64(*columns)).limit(SAMPLE)
    keys = sample.orderBy(*[F.desc(c) if d else F.asc(c) for c, d in order]).collect()
    types = [rows.schema[c].dataType for c in columns]
    cuts = [keys[i * len(keys) // parts] for i in range(1, parts)] if len(keys) >= parts else []
    cuts = list(dict.fromkeys(tuple(c) for c in cuts))
    at = [[F.lit(v).cast(ty) for v, ty in zip(c, types, strict=True)] for c in cuts]
    own = [F.col(c) for c in columns]
    part = reduce(lambda n, c: n + (~_precedes(own, c, falls)).cast("int"), at, F.lit(0))
    cut = rows.withColumn("_range", part)
    sizes = cut.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # at most ``parts`` rows
    sizes = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))
    within = Window.partitionBy("_range").orderBy(*[F.desc(c) if d else F.asc(c) for c, d in order])
    out = cut.withColumn("_own", F.row_number().over(within)).join(F.broadcast(sizes), "_range")
    return out.select(*rows.columns, (F.col("_own") + F.col("_shift")).alias(name))
