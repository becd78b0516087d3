"""N-gram Jaccard join that skips by set relations.

Documents whose sets of SHINGLE consecutive words have a Jaccard similarity of NUM / DEN or more are linked, exactly up to
collisions of 64-bit hashes, and the components of the links are named. Documents of one set are one node.

The index. In any one order of all shingles two sets that similar have one of their first n - ceil(t n) + 1 in common, so
the index lists the nodes of every such shingle with the sets' sizes and the shingle's place. A list lies in blocks, in order
of size and place; a block that cannot reach the overlap a partner needs, by its sizes and by what follows its
places, is skipped whole. Blocks are cut from a range partitioning, so a list of any length is spread over tasks.

The answers. Of each list one set, the leader, is compared with all others; what it answers is kept: the exact overlaps, and for sets
linked to it the few shingles that only one of both has. The leader's links make most of a list one component, in which
nothing is compared again. The other sets' answers are derived from the leader's:

* distances to the leader that differ by more than a link allows rule a pair out, distances whose sum is within it make
  it a link, without looking at either set;
* else the overlap of b and c is the leader's overlap with c, plus c's share of what only b has, less c's share of what b
  lacks: one whole set is read for a pair instead of two. Pairs without such a leader are compared in full.

Of lists dense with pairs first a few for each set are settled (FEW), up to MEETINGS times: what they link is one component, in
which nothing is compared again. All pairs that are then left between components follow.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .components import components
from .near_copies import _lists, _often, shingle_sets
from .storage import bounded_batches, clean, mark, written

SHINGLE, NUM, DEN = 3, 9, 10
#: Entries of a block of a list, and cells of a set's parities.
BLOCK, CELLS = 512, 512
#: Leaders of a list, each of another component than those before.
LEADERS = 2
#: The first leaders' answers are kept up to so many times the distance of a link: what is linked to a set near a leader is hardly further from it.
NEAR = 2
#: So many pairs of a list for each of its sets are settled at first, and so often; lists that hold more are met again.
FEW, MEETINGS, SLAB = 32, 3, 64
#: So many shared shingles of their heads are waited for before two sets are looked at, if they must have as many.
COMMON = 4
#: 64-bit words of the filter that keeps texts no pair asks for in the scan; a full one lets all through.
FILTER = 1 << 18


def parities(doc: np.ndarray, grams: np.ndarray, n: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """For each text, of n shingles, whether each cell of its hashes holds an odd number: of CELLS cells, and of as many more as it has shingles.

    Sets differ in at least as many shingles as cells; wide parities folded are those of fewer cells.
    """
    cells = np.maximum(CELLS, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(cells)])
    odd = (np.bincount(at[doc] + (grams & (cells[doc] - 1).astype(tx.U)).astype(np.int64), minlength=at[-1]) & 1).astype(np.uint8)
    wide = np.packbits(odd).tobytes()
    wide = [wide[a:b] for a, b in zip((at[:-1] // 8).tolist(), (at[1:] // 8).tolist(), strict=True)]
    return [w if len(w) == CELLS // 8 else _folded(w, CELLS // 8) for w in wide], wide


def _folded(bits: bytes, size: int) -> bytes:
    return np.bitwise_xor.reduce(np.frombuffer(bits, np.uint8).reshape(-1, size), axis=0).tobytes()


def _scanned(texts: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """``doc_id, key, node, n, prefix, bits, wide`` for each text: node stands for its set, n is its size."""
    known, times = _often(texts, shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = tx.flat(batch.column(2))
            for a, b in tx.chunks(offsets):
                doc, grams = shingle_sets(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], shingle)
                n = np.bincount(doc, minlength=b - a)
                sums = np.concatenate([np.zeros(1, tx.U), np.cumsum(tx.mixed(grams))])
                first = np.searchsorted(doc, np.arange(b - a + 1))
                node = tx.mixed(sums[first[1:]] - sums[first[:-1]] + n.astype(tx.U))
                seen = np.zeros(len(grams), dtype=np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
                    seen = np.where(known[at] == grams, times[at], 0)
                order = np.lexsort((grams, seen, doc))
                head = np.arange(len(doc)) - first[doc] < (n - -(-num * n // den) + 1)[doc]
                bits, wide = (pa.array(v, pa.binary()) for v in parities(doc, grams, n))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(node.view(np.int64)), pa.array(n.astype(np.int32)), _lists(doc[head], grams[order][head], b - a), bits, wide], ["doc_id", "key", "node", "n", "prefix", "bits", "wide"])

    return texts.select("doc_id", "key", "text").mapInArrow(run, "doc_id bigint, key bigint, node bigint, n int, prefix array<bigint>, bits binary, wide binary")


@dataclass(frozen=True)
class _Least:
    """A similarity of ``num / den``, for columns and arrays alike: an overlap o of sets of sizes na and nb reaches it if o (num + den) >= (na + nb) num."""

    num: int
    den: int

    def reached(self, common, both):
        """Whether sets of sizes that add up to ``both`` are linked, or could be if all of ``common`` were."""
        return common * (self.num + self.den) >= both * self.num

    def sizes(self, small, large):
        return large * self.num <= small * self.den

    def most(self, both: np.ndarray) -> np.ndarray:
        """How many shingles at most lie in only one of two linked sets."""
        return both - 2 * self.overlap(both)

    def overlap(self, both: np.ndarray) -> np.ndarray:
        """The least overlap of linked sets."""
        return -(-self.num * both // (self.num + self.den))

    def common(self, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
        """How many shingles, or COMMON, the indexed heads of two linked sets share at least: what of the overlap does not fit behind the head of either."""
        behind = -(-self.num * np.maximum(na, nb) // self.den) - 1
        return np.clip(self.overlap(na + nb) - behind, 1, COMMON)


def _rest_of(row: np.ndarray, pair: np.ndarray, ok: np.ndarray, most: int) -> np.ndarray:
    """Of the places where ``ok`` holds those beyond ``most``; rows take turns, each in order of a hash of its pairs."""
    at = np.flatnonzero(ok)
    h = tx.mixed(pair[at].view(tx.U))
    order = np.lexsort((h, row[at]))
    own = row[at][order]
    turn = np.arange(len(own)) - np.searchsorted(own, own)
    return at[order[np.lexsort((h[order], turn))[most:]]]


def _places(key: Column) -> list[tuple[Column, Column]]:
    """Two places, word and bit, of each key in a filter of FILTER words."""
    return [(F.pmod(h, F.lit(FILTER)).cast("int"), F.shiftrightunsigned(h, 40).bitwiseAND(F.lit(63)).cast("int")) for h in (F.xxhash64(key, F.lit(i)) for i in (1, 2))]


def _filter(keys: DataFrame, key: str) -> np.ndarray:
    """A Bloom filter of the keys; words are joined before they reach the driver."""
    words = keys.select(F.explode(F.array(*[F.struct(w.alias("w"), F.expr("1L").alias("one"), b.alias("b")) for w, b in _places(F.col(key))])).alias("e"))
    got = words.groupBy("e.w").agg(F.bit_or(F.expr("shiftleft(e.one, e.b)")).alias("v")).toArrow()
    out = np.zeros(FILTER, np.int64)
    out[got["w"].to_numpy()] = got["v"].to_numpy()
    return out


class _Join:
    """The tables of one join: ``nodes`` (node, n, key, bits) and ``texts`` (key, text)."""

    def __init__(self, nodes: DataFrame, texts: DataFrame, shingle: int, least: _Least) -> None:
        self.nodes, self.texts, self.shingle, self.least = nodes, texts, shingle, least

    def possible(self, pairs: DataFrame, times: int) -> DataFrame:
        """The pairs (a, b, ...) whose parities allow a distance of ``times`` that of a link, with their sizes na and nb."""
        names, least = pairs.columns, self.least
        of = [self.nodes.select(F.col("node").alias(f"x{c}"), F.col("n").alias(f"n{c}"), F.col("wide").alias(f"b{c}")) for c in "ab"]
        both = pairs.join(of[0], F.col("a") == F.col("xa")).join(of[1], F.col("b") == F.col("xb")).select(*names, "na", "nb", "ba", "bb")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                na, nb = (batch.column(i).to_numpy().astype(np.int64) for i in (-4, -3))
                bits = list(zip(batch.column(-2).to_pylist(), batch.column(-1).to_pylist(), strict=True))
                size = [min(len(x), len(y)) for x, y in bits]
                whole = [[v if len(v) == w else _folded(v, w) for v in pair] for pair, w in zip(bits, size, strict=True)]
                x, y = (np.frombuffer(b"".join(v), np.uint64) for v in zip(*whole, strict=True)) if whole else (np.zeros(0, np.uint64),) * 2
                begin = np.cumsum([0, *size])[:-1] // 8
                apart = np.add.reduceat(np.bitwise_count(x ^ y).astype(np.int64), begin) if whole else np.zeros(0, np.int64)
                ok = apart <= times * least.most(na + nb)
                yield batch.select(range(batch.num_columns - 2)).filter(pa.array(ok))

        schema = ", ".join(f"{c} {t}" for c, t in [*pairs.dtypes, ("na", "int"), ("nb", "int")])
        return both.mapInArrow(run, schema)

    def sets(self, asked: DataFrame, name: str) -> DataFrame:
        """``node, s``: the sets of the nodes asked for (c), from the text that stands for each. Other texts do not leave the scan."""
        keys = written(asked.distinct().join(self.nodes.select("node", "key"), F.col("c") == F.col("node")).select("node", F.col("key").alias("k")), f"jaccard-{name}-asked")
        spark, shingle = keys.sparkSession, self.shingle
        # a filter of one row, of the same size whatever is asked for, lets few other texts out of the scan; the join is exact
        bits = F.broadcast(spark.createDataFrame(pa.table({"filter": pa.array([_filter(keys, "k")], pa.list_(pa.int64()))})))
        there = [F.getbit(F.element_at("filter", w + 1), b) == 1 for w, b in _places(F.col("key"))]
        asked_for = self.texts.select("key", "text").join(bits, there[0] & there[1]).select("key", "text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                buf, offsets = tx.flat(batch.column(1))
                for a, b in tx.chunks(offsets):
                    doc, grams = shingle_sets(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], shingle)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), _lists(doc, grams, b - a)], ["key", "s"])

        found = asked_for.mapInArrow(run, "key bigint, s array<bigint>").join(keys, F.col("key") == F.col("k"))
        return written(found.dropDuplicates(["node"]).select("node", "s"), f"jaccard-{name}-sets")

    def answers(self, pairs: DataFrame, name: str, times: int = 1) -> DataFrame:
        """``a, b, na, nb, common, link, less, more`` of the pairs (a, b) that parities allow; of links, less is what only a has, more what only b has.

        ``times``: answers are wanted up to so many times the distance of a link.
        """
        since = mark()
        pairs = written(self.possible(pairs.distinct(), times), f"jaccard-{name}-pairs")
        sets = self.sets(pairs.select(F.explode(F.array("a", "b")).alias("c")), name)
        both = pairs.join(sets.select(F.col("node").alias("xa"), F.col("s").alias("sa")), F.col("a") == F.col("xa")).join(sets.select(F.col("node").alias("xb"), F.col("s").alias("sb")), F.col("b") == F.col("xb"))
        both = both.withColumn("common", F.size(F.array_intersect("sa", "sb"))).withColumn("link", self.least.reached(F.col("common"), F.col("na") + F.col("nb")))
        only = {c: F.when(F.col("link"), F.array_except(*v)) for c, v in {"less": ("sa", "sb"), "more": ("sb", "sa")}.items()}
        out = written(both.select("a", "b", "na", "nb", "common", "link", *[v.alias(c) for c, v in only.items()]), f"jaccard-{name}-answers")
        clean(since, latest=1)
        return out

    def leaders(self, met: DataFrame, roots: DataFrame | None) -> DataFrame:
        """``x, lead, lead_n``, where the list x has more than one root: the node of the least hash, or that of another root than it has."""
        if roots is not None:
            met = met.join(roots.withColumnRenamed("node", "u"), F.col("node") == F.col("u"), "left").select("x", "node", "n", "i", F.coalesce("root", "node").alias("root"))
        else:
            met = met.withColumn("root", F.col("node"))
        entry = F.struct(F.xxhash64("node").alias("h"), "node", "n", "i", "root")
        first = met.groupBy("x").agg(F.min(entry).alias("e"), F.min("root").alias("p"), F.max("root").alias("q")).filter("p <> q").select(F.col("x").alias("y"), "e")
        if roots is not None:
            first = written(first, "jaccard-first")
            other = met.join(first, F.col("x") == F.col("y")).filter("root <> e.root").groupBy("x").agg(F.min(entry).alias("e"))
            first = other.select(F.col("x").alias("y"), "e")
        return first.select("y", F.col("e.node").alias("lead"), F.col("e.n").alias("lead_n"), F.col("e.i").alias("lead_i"), F.col("e.root").alias("lead_root"))

    def led(self, met: DataFrame, leads: DataFrame, roots: DataFrame | None) -> DataFrame:
        """``a, b``: each leader (a) with the sets of its list that are not in its component and can be linked to it."""
        rows = met.join(leads, F.col("x") == F.col("y")).filter((F.col("node") != F.col("lead")) & self.least.reached(F.least(F.col("n") - F.col("i"), F.col("lead_n") - F.col("lead_i")), F.col("n") + F.col("lead_n")))
        if roots is not None:
            rows = rows.select("lead", "node", "lead_root").distinct().join(roots.withColumnRenamed("node", "u"), F.col("node") == F.col("u"), "left").filter(F.coalesce("root", "node") != F.col("lead_root"))
        return rows.select(F.col("lead").alias("a"), F.col("node").alias("b"))

    def blocks(self, placed: DataFrame) -> DataFrame:
        """Lists in blocks of at most BLOCK entries, in order of size and place: bounds, the root if all have the same (``tag``), and the entries."""
        order = ["x", "n", "i", "node"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept: pa.Table | None = None

            def out(t: pa.Table) -> pa.RecordBatch:
                x = t["x"].to_numpy()
                new = np.append(True, x[1:] != x[:-1])
                begin = np.flatnonzero(new)
                size = np.diff(np.append(begin, len(x)))
                cuts = np.concatenate([b + np.arange(0, s, BLOCK) for b, s in zip(begin.tolist(), size.tolist(), strict=True)])
                n, i, node, root = (t[c].to_numpy().astype(np.int64) for c in ("n", "i", "node", "root"))
                low, high = np.minimum.reduceat(root, cuts), np.maximum.reduceat(root, cuts)
                ends = pa.array(np.append(cuts, len(x)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, t[c].combine_chunks()) for c in ("node", "n", "i", "root", "common", "bits")]
                cols = [pa.array(x[cuts]), pa.array(node[cuts]), pa.array(n[cuts].astype(np.int32)), pa.array(np.maximum.reduceat(n, cuts).astype(np.int32)), pa.array(np.maximum.reduceat(n - i, cuts).astype(np.int32)), pa.array(low, mask=low != high), t["lead"].combine_chunks().take(pa.array(cuts)), t["lead_n"].combine_chunks().take(pa.array(cuts)), *lists]
                return pa.RecordBatch.from_arrays(cols, ["x", "first", "n_low", "n_high", "rest", "tag", "lead", "lead_n", "nodes", "ns", "places", "roots", "commons", "bits"])

            for batch in batches:
                t = pa.Table.from_batches([batch])
                kept = t if kept is None else pa.concat_tables([kept, t])
                x = kept["x"].to_numpy()
                whole = int(np.searchsorted(x, x[-1])) if len(x) else 0
                whole += (len(x) - whole) // BLOCK * BLOCK  # of an unfinished list, whole blocks only
                if whole:
                    yield out(kept.slice(0, whole).combine_chunks())
                    kept = kept.slice(whole)
            if kept is not None and kept.num_rows:
                yield out(kept.combine_chunks())

        schema = "x bigint, first bigint, n_low int, n_high int, rest int, tag bigint, lead bigint, lead_n int, nodes array<bigint>, ns array<int>, places array<int>, roots array<bigint>, commons array<int>, bits array<binary>"
        rows = placed.select("x", "node", "n", "i", "root", "lead", "lead_n", "common", "bits")
        return written(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema), "jaccard-blocks")

    def met_again(self, blocks: DataFrame, few: int | None = None) -> DataFrame:
        """``a, b, lead, sure, need, cut``: for each list, the pairs of different components that sizes, places, parities and the leader's answers leave.

        Sure ones are links; others can be only if ``need`` lists have them. With ``few`` about so many for each set of a list and
        no more, the same in all lists where they can be; cut: there were more.
        """
        names = ["nodes", "ns", "places", "roots", "commons", "bits"]
        own = blocks.filter("tag is null").select("lead", "lead_n", *[F.col(c).alias(f"a_{c}") for c in names], *[F.lit(None).cast(t).alias(f"b_{c}") for c, t in blocks.select(*names).dtypes], F.expr("1L").alias("m"))
        # blocks of the same single root are never compared, so lists are joined by what roots their blocks have
        tags = written(blocks.select("x", "tag").distinct(), "jaccard-tags")
        several = blocks.groupBy("x").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select(F.col("x").alias("y"), "m")
        tags = tags.join(several, F.col("x") == F.col("y"))
        met = tags.select("x", "m", F.col("tag").alias("p")).join(tags.select(F.col("x").alias("x2"), F.col("tag").alias("q")), F.col("x") == F.col("x2")).filter("p is null or q is null or p <> q").select("x", "m", "p", "q")
        a = blocks.select(F.col("x").alias("ax"), F.col("tag").alias("atag"), F.col("first").alias("afirst"), F.col("n_low").alias("alow"), F.col("n_high").alias("ahigh"), F.col("rest").alias("arest"), "lead", "lead_n", *[F.col(c).alias(f"a_{c}") for c in names])
        b = blocks.select(F.col("x").alias("bx"), F.col("tag").alias("btag"), F.col("first").alias("bfirst"), F.col("n_low").alias("blow"), F.col("rest").alias("brest"), *[F.col(c).alias(f"b_{c}") for c in names])
        before = F.struct("alow", "afirst") < F.struct("blow", "bfirst")
        close = before & self.least.sizes(F.col("ahigh"), F.col("blow")) & self.least.reached(F.least("arest", "brest") + (COMMON - 1), F.col("alow") + F.col("blow"))
        cross = met.join(a, (F.col("x") == F.col("ax")) & F.col("p").eqNullSafe(F.col("atag"))).join(b, (F.col("x") == F.col("bx")) & F.col("q").eqNullSafe(F.col("btag")) & close)
        pairs = own.unionByName(cross.select(*own.columns)).repartition(F.xxhash64("a_nodes", "b_nodes"))
        least = self.least

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in range(batch.num_rows):
                    lead, lead_n = batch.column(0)[r].as_py(), batch.column(1)[r].as_py()
                    sides = []
                    for at in (2, 8):
                        col = [batch.column(at + k)[r] for k in range(6)]
                        if not col[0].is_valid:
                            continue
                        v = [c.values.to_numpy(zero_copy_only=False).astype(np.int64) for c in col[:4]]
                        common = col[4].values.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                        sides.append((*v, common, np.frombuffer(b"".join(col[5].values.to_pylist()), np.uint64).reshape(len(v[0]), -1)))
                    # a list of m blocks is m ** 2 pairs of them: together they keep as many pairs as it has sets, times few
                    most_kept = None if few is None else max(1, few * SLAB // batch.column(14)[r].as_py())
                    for lo in range(0, len(sides[0][0]), SLAB):
                        u = tuple(c[lo : lo + SLAB] for c in sides[0])
                        v = sides[-1]
                        left, right = u[1][:, None] - u[2][:, None], v[1][None, :] - v[2][None, :]
                        size = u[1][:, None] + v[1][None, :]
                        need = least.common(u[1][:, None], v[1][None, :])
                        hit = (u[3][:, None] != v[3][None, :]) & least.reached(np.minimum(left, right) + need - 1, size)
                        if len(sides) == 1:
                            hit &= np.arange(lo, lo + len(u[0]))[:, None] < np.arange(len(v[0]))[None, :]
                        p, q = np.nonzero(hit)
                        most = least.most(u[1][p] + v[1][q])
                        known = (u[4][p] >= 0) & (v[4][q] >= 0)
                        da, db = u[1][p] + (lead_n or 0) - 2 * u[4][p], v[1][q] + (lead_n or 0) - 2 * v[4][q]
                        sure = known & (da + db <= most)
                        ok = sure | (np.bitwise_count(u[5][p] ^ v[5][q]).sum(axis=1, dtype=np.int64) <= most) & ~(known & (np.abs(da - db) > most))
                        cut = most_kept is not None and int(ok.sum()) > most_kept
                        if cut:
                            ok[_rest_of(p, u[0][p] ^ v[0][q], ok, most_kept)] = False
                        if ok.any():
                            a, b = u[0][p][ok], v[0][q][ok]
                            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.full(len(a), lead or 0), mask=~known[ok]), pa.array(sure[ok]), pa.array(need[p, q][ok].astype(np.int32)), pa.array(np.full(len(a), cut))], ["a", "b", "lead", "sure", "need", "cut"])

        return pairs.mapInArrow(run, "a bigint, b bigint, lead bigint, sure boolean, need int, cut boolean")

    def derived(self, rest: DataFrame, answers: DataFrame) -> DataFrame:
        """``a, b``: the links among ``rest`` (of :meth:`met_again`)."""
        since = mark()
        best = F.min(F.struct((~F.col("sure")).alias("open"), F.col("lead").isNull().alias("alone"), "lead")).alias("e")
        rest = written(rest.groupBy("a", "b").agg(best, F.count(F.lit(1)).alias("lists"), F.max("need").alias("need")).filter("not e.open or lists >= need").select("a", "b", "e.lead", (~F.col("e.open")).alias("sure")), "jaccard-rest")
        linked = answers.filter("link").select(F.col("a").alias("l"), F.col("b").alias("v"), F.col("less").alias("lacks"), F.col("more").alias("has"), F.col("nb").alias("nv"))
        # the side that is linked to the leader is told by what it has and lacks, the other by its set
        sides = F.array(F.struct(F.col("a").alias("b"), F.col("b").alias("c")), F.struct(F.col("b").alias("b"), F.col("a").alias("c")))
        turned = rest.filter("not sure and lead is not null").select("lead", F.explode(sides).alias("e")).select("lead", "e.b", "e.c")
        turned = turned.join(linked, (F.col("lead") == F.col("l")) & (F.col("b") == F.col("v"))).dropDuplicates(["b", "c"])
        by_lead = answers.select(F.col("a").alias("l2"), F.col("b").alias("w"), F.col("common").alias("held"), F.col("nb").alias("nw"))
        turned = turned.join(by_lead, (F.col("lead") == F.col("l2")) & (F.col("c") == F.col("w"))).select("b", "c", "nv", "nw", "held", "lacks", "has")
        turned = written(turned, "jaccard-turned")
        done = turned.select(F.least("b", "c").alias("da"), F.greatest("b", "c").alias("db")).distinct()
        sets = self.sets(turned.select("c"), "turned")
        told = turned.join(sets.withColumnRenamed("node", "z"), F.col("c") == F.col("z"))
        common = F.col("held") + F.size(F.array_intersect("has", "s")) - F.size(F.array_intersect("lacks", "s"))
        found = told.filter(self.least.reached(common, F.col("nv") + F.col("nw"))).select(F.least("b", "c").alias("a"), F.greatest("b", "c").alias("b"))
        open_ = rest.filter("not sure").join(done, (F.col("a") == F.col("da")) & (F.col("b") == F.col("db")), "left_anti").select("a", "b")
        full = self.answers(open_, "full").filter("link").select("a", "b")
        links = written(rest.filter("sure").select("a", "b").union(found).union(full), "jaccard-links")
        clean(since, latest=1)
        return links


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_copies`` for each row of docs (doc_id, text).

    component_id is the smallest doc_id reachable over links of Jaccard num / den or more; n_copies is the number of
    other rows of the same set. Words are compared without regard to the case of A-Z; a text of fewer words than a shingle is
    one shingle. A null text, or one without words, has an empty set and no links, not even to another such: its component_id is its
    own id. Repeated rows are copies of each other. Null ids take part and name a component only where all its ids are null.
    An empty table gives no rows; columns besides doc_id and text are not read.
    """
    texts = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("rid", F.xxhash64("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    own = written(_scanned(texts, shingle, num, den), "jaccard")
    # equal sets have equal sizes, prefixes and parities: those of any of its texts
    nodes = own.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.min("key").alias("key"), *[F.first(c).alias(c) for c in ("n", "bits", "wide", "prefix")])
    nodes = written(nodes, "jaccard-nodes")
    rows = nodes.select("node", "n", F.posexplode("prefix").alias("i", "x")).select("x", "node", "n", "i")
    several = written(rows.groupBy("x").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select(F.col("x").alias("y")), "jaccard-several")
    met = written(rows.join(several, F.col("x") == F.col("y"), "left_semi"), "jaccard-lists")
    join = _Join(nodes.select("node", "n", "key", "wide"), texts, shingle, _Least(num, den))

    leads = written(join.leaders(met, None), "jaccard-leaders")
    answers = join.answers(join.led(met, leads, None), "lead1", NEAR)
    links = answers.filter("link").select("a", "b")
    roots = components(links)
    for turn in range(2, LEADERS + 1):
        more = join.answers(join.led(met, join.leaders(met, roots), roots), f"lead{turn}").filter("link").select("a", "b")
        links = links.union(more)
        roots = components(links)

    placed = met.join(roots.withColumnRenamed("node", "u"), F.col("node") == F.col("u"), "left").select("x", "node", "n", "i", F.coalesce("root", "node").alias("root"))
    placed = written(placed, "jaccard-placed")
    split = placed.groupBy("x").agg(F.min("root").alias("p"), F.max("root").alias("q")).filter("p <> q").select(F.col("x").alias("z"))
    placed = placed.join(split, F.col("x") == F.col("z"), "left_semi").join(leads.select("y", "lead", "lead_n"), F.col("x") == F.col("y"))
    held = answers.select(F.col("a").alias("l"), F.col("b").alias("v"), "common")
    placed = placed.join(held, (F.col("lead") == F.col("l")) & (F.col("node") == F.col("v")), "left").withColumn("common", F.when(F.col("node") == F.col("lead"), F.col("n")).otherwise(F.col("common")))
    placed = placed.join(nodes.select(F.col("node").alias("u"), "bits"), F.col("node") == F.col("u"))
    for turn in range(MEETINGS + 1):
        since = mark()
        found = written(join.met_again(join.blocks(placed), FEW if turn < MEETINGS else None), "jaccard-found")
        clean(since, latest=1)  # but for found
        if turn == MEETINGS or found.filter("cut").isEmpty():
            break
        links = links.union(join.derived(found, answers))
        roots = components(links)
        placed = placed.select("x", "node", "n", "i", "lead", "lead_n", "common", "bits").join(roots.select(F.col("node").alias("w"), F.col("root").alias("r")), F.col("node") == F.col("w"), "left")
        placed = written(placed.select("x", "node", "n", "i", F.coalesce("r", "node").alias("root"), "lead", "lead_n", "common", "bits"), "jaccard-placed")
        split = placed.groupBy("x").agg(F.min("root").alias("p"), F.max("root").alias("q")).filter("p <> q").select(F.col("x").alias("z"))
        placed = placed.join(split, F.col("x") == F.col("z"), "left_semi")
    rest = join.derived(found, answers)
    of = [roots.select(F.col("node").alias(f"u{c}"), F.col("root").alias(f"r{c}")) for c in "ab"]
    between = rest.join(of[0], F.col("a") == F.col("ua"), "left").join(of[1], F.col("b") == F.col("ub"), "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    tops = components(between).select(F.col("node").alias("v"), F.col("root").alias("top"))
    named = nodes.select("node", "least", "copies").join(roots.withColumnRenamed("node", "u"), F.col("node") == F.col("u"), "left").select("node", "least", "copies", F.coalesce("root", "node").alias("root"))
    named = named.join(tops, F.col("root") == F.col("v"), "left").select("node", "least", "copies", F.coalesce("top", "root").alias("root"))
    firsts = named.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "r")
    named = named.join(firsts, F.col("root") == F.col("r")).select(F.col("node").alias("u"), "component_id", "copies")
    out = own.select("doc_id", "node", "n").join(named, F.col("node") == F.col("u"), "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("copies") - 1, F.lit(0)).cast("long").alias("n_copies"))
