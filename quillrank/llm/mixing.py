"""Mixing sources to target weights, by pivotal dependent rounding. DataFrame functions only.

Every source has a target in words. A document's share of it is a rate of copies: the whole part
is given to each, and the fractions are rounded dependently. Two documents exchange mass, weighed
by size and in a random direction that keeps both expectations, until one of them is integral; the
other goes on. Groups of about ``FAN`` documents of one source are folded so, each leaves one
document that may still be fractional, and these are grouped again: a reduction tree of depth
log(documents) / log(FAN) whose every level shuffles a FAN-th of the level before. Of each source one document
is left, and rounded to the nearer side; the words this leaves over or short are settled with a few smaller
documents, largest first, so a source's taken words differ from its target by about a small document.

Random numbers are hashes of the pair's ids and the seed, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import written
from .text import WORD_SQL

FAN, BUCKETS = 32, 1024
WEIGHTS = (5, 2, 1)
MOST = 3
_EPS = 1e-9


def word_count(text: str | Column) -> Column:
    """Number of words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD_SQL)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0, most: int = MOST) -> DataFrame:
    """Per source: ``source, source_size, n, target``.

    Sources in code point order (null last) take the weights in turn and share ``share`` of all
    sizes. No target exceeds ``most`` times its source's size; what is over goes to the others by
    weight, again and again. The fixed point is a water level: target = min(cap, level * weight),
    found by one pass over the sources in order of cap / weight. The windows see one row per
    source, never documents.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    per = per.withColumn("w", weight).withColumn("cap", F.col("source_size") * float(most))
    everything, before = Window.partitionBy(), Window.orderBy("full", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    per = (
        per.withColumn("full", F.col("cap") / F.col("w"))
        .withColumn("left_size", F.sum("source_size").over(everything) * float(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("left_w", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("level", F.try_divide("left_size", "left_w"))
    )
    # the first source, in this order, that does not fill up at its level sets the level of all the rest
    level = F.min(F.when(F.col("level") <= F.col("full"), F.struct("full", "level"))).over(everything)
    return per.select("source", "source_size", "n", F.when(level.isNull(), F.col("cap")).otherwise(F.least("cap", level["level"] * F.col("w"))).alias("target"))


def _uniform(*of: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*of), 11) * F.lit(2.0**-53)


def _with(value: Column, then) -> Column:
    """``then(value)``, with value computed once."""
    return F.transform(F.array(value), then)[0]


def _fold(items: Column, seed: int) -> Column:
    """Pivotal rounding along an array of (size, doc_id, m, ones, x): (last, done)."""

    def settled(e: Column, x: Column) -> Column:
        return F.struct(e["size"].alias("size"), e["doc_id"].alias("doc_id"), e["m"].alias("m"), e["ones"].alias("ones"), x.alias("x"))

    def step(acc: Column, e: Column) -> Column:
        c = acc["last"]
        a, b = c["x"], e["x"]
        s, t = c["size"].cast("double"), e["size"].cast("double")
        up, down = F.least((1 - a) * s, b * t), F.least(a * s, (1 - b) * t)

        def moved(v: Column) -> Column:
            gain = F.when(v["u"] * (v["up"] + v["down"]) < v["down"], v["up"]).otherwise(-v["down"])
            return F.struct((a + gain / s).alias("a"), (b - gain / t).alias("b"))

        def chosen(v: Column) -> Column:
            return F.when(
                (v["a"] < _EPS) | (v["a"] > 1 - _EPS),
                F.struct(settled(e, v["b"]).alias("last"), F.concat(acc["done"], F.array(settled(c, F.round(v["a"])))).alias("done")),
            ).otherwise(F.struct(settled(c, v["a"]).alias("last"), F.concat(acc["done"], F.array(settled(e, F.round(v["b"])))).alias("done")))

        drawn = F.struct(up.alias("up"), down.alias("down"), _uniform(c["doc_id"], c["size"], e["doc_id"], e["size"], F.lit(seed)).alias("u"))
        return _with(_with(drawn, moved), chosen)

    kind = "array<struct<size:bigint,doc_id:bigint,m:bigint,ones:bigint,x:double>>"
    return F.aggregate(F.slice(items, 2, F.size(items)), F.struct(items[0].alias("last"), F.array().cast(kind).alias("done")), step)


def _settled(done: DataFrame, short: DataFrame, seed: int) -> DataFrame:
    """``f_source, f_id, f_size, flip``: documents raised (1) or lowered (-1) by a copy, so that a source's words are no longer ``short`` (s, short).

    Documents that can move the right way are taken a power of two of sizes after another, the largest that are not
    above the shortage first: of each the longest run, in a random order, that what is still short holds. What a class leaves is less than one of its documents, and goes to
    the next, so the rest is less than the smallest documents there are, or all that can move have. Only documents within the shortage, which is less than one large
    document, are put in order: a class is dealt into buckets first, and whole buckets are left out by their sums.
    """
    d = done.select("source", "d.doc_id", "d.size", "d.m", (F.col("d.ones") + F.col("d.x").cast("long")).alias("raised"))
    able = F.when(F.col("short") > 0, F.col("raised") < F.col("m")).otherwise(F.col("raised") > 0)
    d = d.filter("size > 0").join(short, F.col("source").eqNullSafe(F.col("s"))).filter(able & (F.col("size") <= F.abs("short")))
    d = d.select("source", "doc_id", "size", "short", F.floor(F.log2("size")).cast("int").alias("class"), F.xxhash64("doc_id", "size", F.lit(seed)).alias("h"))
    d = written(d, "mix-able")  # read four times below: the plan of all levels would stand there four times
    classes = d.groupBy("source", "class").agg(F.greatest(F.lit(1), F.least(F.lit(BUCKETS), F.floor(F.sum("size") / (4 * F.abs(F.first("short")))))).alias("buckets"))
    same = lambda *names: reduce(and_, [F.col(c).eqNullSafe(F.col(f"o_{c}")) for c in names])
    other = lambda t, *names: t.withColumnsRenamed({c: f"o_{c}" for c in names})
    d = d.join(other(classes, "source", "class"), same("source", "class")).withColumn("bucket", F.pmod("h", "buckets")).drop("o_source", "o_class")
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source", "class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    dealt = d.groupBy("source", "class", "bucket").agg(F.sum("size").alias("words"), F.abs(F.first("short")).alias("most")).withColumn("before", before).filter("before <= most").select("source", "class", "bucket", "before")
    run = F.sum("size").over(Window.partitionBy("source", "class", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)) + F.col("before")
    offered = d.join(other(dealt, "source", "class", "bucket"), same("source", "class", "bucket")).drop("o_source", "o_class", "o_bucket").withColumn("run", run).filter(F.col("run") <= F.abs("short"))
    # a class is now a list of at most as many sums as the shortage has words of its size
    per = offered.groupBy("source", "class").agg(F.first("short").alias("short"), F.collect_set("run").alias("runs"))
    per = per.groupBy("source").agg(F.first("short").alias("short"), F.sort_array(F.collect_list(F.struct("class", "runs")), asc=False).alias("classes"))
    start = F.struct(F.abs("short").alias("left"), F.array().cast("array<struct<class:int,until:bigint>>").alias("cuts"))

    def step(acc: Column, e: Column) -> Column:
        until = F.coalesce(F.array_max(F.filter(e["runs"], lambda r: r <= acc["left"])), F.lit(0).cast("long"))
        return _with(until, lambda u: F.struct((acc["left"] - u).alias("left"), F.concat(acc["cuts"], F.array(F.struct(e["class"].alias("class"), u.alias("until")))).alias("cuts")))

    cuts = per.select("source", F.explode(F.aggregate("classes", start, step)["cuts"]).alias("e")).select(F.col("source").alias("o_source"), F.col("e.class").alias("o_class"), F.col("e.until").alias("until"))
    taken = offered.join(cuts, same("source", "class")).filter("run <= until")
    return taken.select(F.col("source").alias("f_source"), F.col("doc_id").alias("f_id"), F.col("size").alias("f_size"), F.when(F.col("short") > 0, 1).otherwise(-1).alias("flip"))


def mix_sources(docs: DataFrame, size: Column, weights: Sequence[float] = WEIGHTS, share: float = 1.0, most: int = MOST, seed: int = 42) -> DataFrame:
    """A row per row of ``docs`` (doc_id, source): ``doc_id, source, size, source_size, target, copies, taken``.

    A null source is a source of its own, last in order; a null doc_id is an id like another; a
    size of 0 takes 0 words, and gets the whole part of its source's rate in copies; rows repeated in full are rounded together (m equal rows with fraction f: the
    whole part of m * f are raised, one row keeps the rest) and then told apart again. An empty
    table gives an empty result. Other columns of ``docs`` are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("source"), size.cast("long").alias("size"))
    rows = written(rows.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("m")), "mix-sizes")
    spread = rows.select("source", F.expr("size * m").alias("size"))
    targets = written(source_targets(spread, weights, share, most), "mix-targets")
    deepest = targets.agg(F.max("n")).first()[0] or 0

    rate = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    per = targets.select(F.col("source").alias("s"), "n", rate.alias("rate"))
    per = per.withColumn("whole", F.floor(F.col("rate") + _EPS)).withColumn("part", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0)))
    per = per.withColumn("part", F.when(F.col("part") < _EPS, 0.0).otherwise(F.col("part")))
    start = rows.join(per, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    mass = F.col("m") * F.when(F.col("size") > 0, F.col("part")).otherwise(0.0)
    start = start.withColumn("ones", F.floor(mass + _EPS)).withColumn("x", F.greatest(mass - F.col("ones"), F.lit(0.0)))
    open_ = start.filter(F.col("x") > _EPS)
    item = F.struct("size", "doc_id", "m", "ones", "x")
    done = [start.filter(F.col("x") <= _EPS).select("source", F.struct("size", "doc_id", "m", "ones", F.lit(0.0).alias("x")).alias("d"))]

    level, left = 0, open_.select("source", F.ceil(F.col("n") / FAN).alias("groups"), item.alias("e"))
    while True:
        bucket = F.pmod(F.xxhash64(F.col("e.doc_id"), F.col("e.size"), F.lit(seed + level)), F.greatest("groups", F.lit(1)))
        grouped = left.groupBy("source", "groups", bucket.alias("bucket")).agg(F.sort_array(F.collect_list("e"), asc=False).alias("items"))
        folded = written(grouped.select("source", "groups", _fold(F.col("items"), seed + level).alias("f")), f"mix-level{level}")
        done.append(folded.select("source", F.explode("f.done").alias("d")))
        left = folded.select("source", F.ceil(F.col("groups") / FAN).alias("groups"), F.col("f.last").alias("e"))
        level += 1
        deepest = -(-deepest // FAN)
        if deepest <= 1:
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    short = left.select(F.col("source").alias("s"), ((F.col("e.x") - F.round("e.x")) * F.col("e.size")).alias("short")).filter("abs(short) >= 1")
    flips = written(_settled(out, written(short, "mix-short"), seed), "mix-flips")
    last = left.select("source", F.struct("e.size", "e.doc_id", "e.m", "e.ones", F.round("e.x").alias("x")).alias("d"))
    out = out.unionByName(last).select("source", "d.doc_id", "d.size", "d.m", (F.col("d.ones") + F.col("d.x").cast("long")).alias("raised"))
    same = F.col("source").eqNullSafe(F.col("f_source")) & F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("size") == F.col("f_size"))
    out = out.join(flips, same, "left").select("source", "doc_id", "size", "m", (F.col("raised") + F.coalesce("flip", F.lit(0))).alias("raised"))
    out = out.select("source", "doc_id", "size", "raised", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))).alias("i"))
    ends = targets.select(F.col("source").alias("s"), "source_size", "target", F.floor(rate + _EPS).alias("whole"))
    out = out.join(ends, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    copies = F.col("whole") + F.when(F.col("i") <= F.col("raised"), 1).otherwise(0)
    return out.select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"), (F.col("size") * copies).cast("long").alias("taken"))


def repeated_rows(docs: DataFrame, mixed: DataFrame, size: Column) -> DataFrame:
    """The rows of docs, each as often as ``mixed`` (of :func:`mix_sources`) takes it, with all their columns, whatever their names.

    Rows that the mix takes no copy of go; an empty table stays empty.
    """
    own = mixed.groupBy(F.col("doc_id").alias("k_id"), F.col("source").alias("k_source"), F.col("size").alias("k_size")).agg(F.sort_array(F.collect_list("copies"), asc=False).alias("k_copies")).filter("k_copies[0] > 0")
    names = docs.columns
    # the row goes along as one struct, so that no name of its columns meets ours
    columns = [F.col("`" + c.replace("`", "``") + "`").alias(f"c{i}") for i, c in enumerate(names)]
    rows = docs.select(F.struct(*columns).alias("row"), F.col("doc_id").cast("long").alias("r_id"), F.col("source").alias("r_source"), size.cast("long").alias("r_size"), F.xxhash64("text").alias("r_text"))
    on = F.col("r_id").eqNullSafe(F.col("k_id")) & F.col("r_source").eqNullSafe(F.col("k_source")) & (F.col("r_size") == F.col("k_size"))
    rows = rows.join(own, on).drop("r_id", "r_source", "r_size")
    # rows that share id, source and size are told apart by number; almost all stand alone
    single = rows.filter(F.size("k_copies") == 1).withColumn("k_n", F.col("k_copies")[0])
    turn = F.row_number().over(Window.partitionBy("k_id", "k_source", "k_size").orderBy("r_text"))
    shared = rows.filter(F.size("k_copies") > 1).withColumn("k_n", F.element_at("k_copies", turn))
    every = single.unionByName(shared)
    return every.withColumn("k_each", F.explode(F.array_repeat(F.lit(1), F.col("k_n").cast("int")))).select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)])
