"""Near copies of texts: SimHash first, then an exact set-similarity join on shingles of words for what it cannot see.

Fingerprints of the same shingles meet in the tiles of :mod:`simhash`; the pairs it finds, held against their sets,
make most copies one component at once. But similar sets mostly differ in more bits than a bucket join can
reach (at Jaccard 0.8 about ten of 64), so every other pair is found exactly, by the rest of this module.

Two texts are linked if their sets of SHINGLE consecutive words have Jaccard LEAST or more. In any
one order of all shingles two such sets have one of their first n - ceil(LEAST * n) + 1 in common, so texts meet on these
only. The order puts last what a sample finds often, then goes by hash; the sample decides what it
costs, never what is found. A pair that meets is kept by its sizes, the places of the shingle and its parities, which
bound how similar the sets can be; what is left is compared in full.

Texts of equal sets are one node. The nodes of a shingle are first compared with STARS of them; all pairs
follow where this left them in different components, so a group of thousands of copies is no square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .components import components
from .simhash import _single_spaced, fingerprints, links as close_fingerprints
from .storage import bounded_batches, clean, mark, written

SHINGLE, LEAST = 5, 0.8
SAMPLE, OFTEN = 10_000, 200_000
TILE = 1024
#: The most cells of the parities that go with a text to each of its shingles.
CELLS = 512
AT_ONCE = 1 << 16
#: 64-bit words of the filter that keeps texts no pair asks for out of the shuffle; a full one lets all through.
FILTER = 1 << 19
STARS = 4


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of each different shingle of the texts of a chunk, in order; a shorter text is one shingle, one without words has none."""
    buf, offsets = _single_spaced(buf, offsets)
    starts, ends, first = tx.words(buf, offsets)
    h, size = tx.span_hashes(buf, starts, ends), np.diff(first)
    grams = tx.rolled(h, shingle)
    doc = np.repeat(np.arange(len(size)), size)[: len(grams)]
    whole = np.arange(len(grams)) + shingle <= first[1:][doc]
    short = np.flatnonzero((size > 0) & (size < shingle))
    ones = [tx.rolled(h[first[i] : first[i + 1]], int(size[i])) for i in short.tolist()]
    doc, grams = np.concatenate([doc[whole], short]), np.concatenate([grams[whole], *ones])
    order = np.lexsort((grams, doc))
    doc, grams = doc[order], grams[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])
    return doc[new], grams[new]


def _lists(doc: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """The values of each of n texts."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)), pa.array(values.view(np.int64)))


def parities(doc: np.ndarray, grams: np.ndarray, n: np.ndarray, most: int | None = None) -> list[bytes]:
    """For each text a bit for every cell of its hashes: whether the cell holds an odd number.

    There are 64 cells or the power of two from its size n on; with ``most``, four times as many, but no more than that.
    A bit in which two sets differ is at least one shingle that only one of them has.
    """
    cells = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    if most is not None:
        cells = np.minimum(4 * cells, most)
    at = np.concatenate([[0], np.cumsum(cells)])
    odd = (np.bincount(at[doc] + (grams & (cells[doc] - 1).astype(tx.U)).astype(np.int64), minlength=at[-1]) & 1).astype(np.uint8)
    bits = np.packbits(odd).tobytes()
    return [bits[a:b] for a, b in zip((at[:-1] // 8).tolist(), (at[1:] // 8).tolist(), strict=True)]


def differing(a: bytes, b: bytes) -> int:
    """The number of bits in which parities differ, the longer folded to the shorter."""
    x, y = sorted((np.frombuffer(v, np.uint8) for v in (a, b)), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


def _often(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, of the shingles that a sample of at most about SAMPLE texts has more than once, and how often; at most OFTEN."""
    part = max(1, -(-texts.count() // SAMPLE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = tx.flat(batch.column(0))
            for a, b in tx.chunks(offsets):
                _, grams = shingle_sets(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], shingle)
                yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64))], ["x"])

    some = texts.filter(F.pmod("rid", F.lit(part)) == 0).select("text").mapInArrow(run, "x bigint")
    got = some.groupBy("x").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").orderBy(F.desc("n"), "x").limit(OFTEN).toArrow()
    x, n = got["x"].to_numpy().view(tx.U), got["n"].to_numpy()
    order = np.argsort(x)
    return x[order], n[order]


def _scanned(texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """``doc_id, key, node, n, prefix, bits, few, fp`` for each text: node stands for its set, n is its size, bits are its parities, few those of at most CELLS cells, fp its fingerprint."""
    known, times = _often(texts, shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = tx.flat(batch.column(2))
            for a, b in tx.chunks(offsets):
                part = buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                doc, grams = shingle_sets(*part, shingle)
                n = np.bincount(doc, minlength=b - a)
                sums = np.concatenate([np.zeros(1, tx.U), np.cumsum(tx.mixed(grams))])
                first = np.searchsorted(doc, np.arange(b - a + 1))
                node = tx.mixed(sums[first[1:]] - sums[first[:-1]] + n.astype(tx.U))
                seen = np.zeros(len(grams), dtype=np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
                    seen = np.where(known[at] == grams, times[at], 0)
                order = np.lexsort((grams, seen, doc))
                place = np.arange(len(doc)) - first[doc]
                head = place < (n - np.ceil(least * n - 1e-9).astype(np.int64) + 1)[doc]
                lists = _lists(doc[head], grams[order][head], b - a)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(node.view(np.int64)), pa.array(n.astype(np.int32)), lists, pa.array(parities(doc, grams, n), pa.binary()), pa.array(parities(doc, grams, n, CELLS), pa.binary()), pa.array(fingerprints(*part, shingle).view(np.int64))], ["doc_id", "key", "node", "n", "prefix", "bits", "few", "fp"])

    return texts.select("doc_id", "key", "text").mapInArrow(run, "doc_id bigint, key bigint, node bigint, n int, prefix array<bigint>, bits binary, few binary, fp bigint")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Rows sorted by their first column, whole groups of it at a time."""
    kept: list[np.ndarray] | None = None
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        kept = cols if kept is None else [np.concatenate(p) for p in zip(kept, cols, strict=True)]
        cut = int(np.searchsorted(kept[0], kept[0][-1])) if len(kept[0]) else 0
        if cut:
            yield [k[:cut] for k in kept]
            kept = [k[cut:] for k in kept]
    if kept is not None and len(kept[0]):
        yield kept


def _fits(na: np.ndarray, ia: np.ndarray, nb: np.ndarray, ib: np.ndarray, least: float) -> np.ndarray:
    """Whether sets of these sizes whose first common shingle has these places can be that similar."""
    return np.minimum(na - ia, nb - ib) >= least / (1 + least) * (na + nb) - 1e-9


def _met(nodes: DataFrame, least: float) -> DataFrame:
    """``x, node, n, i, stars``: the prefixes of nodes, of shingles that more than one has; stars are those of STARS nodes of the shingle that can be similar."""
    rows = nodes.select("node", "n", F.posexplode("prefix").alias("i", "x")).select("x", "node", "n", "i")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, node, n, i in _groups(batches):
            begin = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
            size = np.diff(np.append(begin, len(x)))
            first, many = np.repeat(begin, size), np.repeat(size, size)
            turn = np.repeat(x[begin].view(tx.U) % size.astype(tx.U), size).astype(np.int64)
            star = first[:, None] + (turn[:, None] + np.arange(STARS) * (many // STARS + 1)[:, None]) % many[:, None]
            n, i = n.astype(np.int64), i.astype(np.int64)
            fit = _fits(n[:, None], i[:, None], n[star], i[star], least) & (node[star] != node[:, None])
            some = many > 1
            cuts = np.concatenate([[0], np.cumsum(fit[some].sum(axis=1))]).astype(np.int32)
            stars = pa.ListArray.from_arrays(pa.array(cuts), pa.array(node[star[some]][fit[some]]))
            yield pa.RecordBatch.from_arrays([pa.array(x[some]), pa.array(node[some]), pa.array(n[some].astype(np.int32)), pa.array(i[some].astype(np.int32)), stars], ["x", "node", "n", "i", "stars"])

    return rows.repartition("x").sortWithinPartitions("x", "node").mapInArrow(run, "x bigint, node bigint, n int, i int, stars array<bigint>")


def _near(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether the parities x[a] and y[b], of which y's have as many cells as x's or a multiple, differ in at most so many bits."""
    y = np.bitwise_xor.reduce(y.reshape(len(y), -1, x.shape[1]), axis=1)
    out = np.zeros(len(a), dtype=bool)
    for i in range(0, len(a), AT_ONCE):
        p = slice(i, i + AT_ONCE)
        out[p] = np.bitwise_count(x[a[p]] ^ y[b[p]]).sum(axis=1) <= most[p]
    return out


def _across(rows: DataFrame, least: float) -> DataFrame:
    """``a, b``: the pairs of nodes of a shingle that lie in different components and can be similar by size, place and parities.

    Tiles hold texts of equally many cells, in order of their sizes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, node, n, i, root, few in _groups(batches):
            cuts = np.append(np.flatnonzero(np.append(True, x[1:] != x[:-1])), len(x)).tolist()
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                order = lo + np.argsort(n[lo:hi], kind="stable")
                g, m, at, r, bits = node[order], n[order].astype(np.int64), i[order].astype(np.int64), root[order], few[order]
                width = np.fromiter(map(len, bits), np.int64, len(bits))
                edges = np.append(np.flatnonzero(np.append(True, width[1:] != width[:-1])), len(g)).tolist()
                tiles = [slice(p, min(p + TILE, end)) for start, end in zip(edges[:-1], edges[1:], strict=True) for p in range(start, end, TILE)]
                packed = [np.frombuffer(b"".join(bits[t]), "<u8").reshape(t.stop - t.start, -1) for t in tiles]
                for p, u in enumerate(tiles):
                    for q in range(p, len(tiles)):
                        v = tiles[q]
                        if m[u][-1] < least * m[v.start] - 1e-9:
                            break
                        hit = (r[u][:, None] != r[v][None, :]) & _fits(m[u][:, None], at[u][:, None], m[v][None, :], at[v][None, :], least)
                        a, b = np.nonzero(hit)
                        if p == q:
                            a, b = a[a < b], b[a < b]
                        ok = _near(packed[p], packed[q], a, b, (1 - least) / (1 + least) * (m[u][a] + m[v][b]) + 1e-6)
                        a, b = a[ok], b[ok]
                        if len(a):
                            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(g[u][a], g[v][b])), pa.array(np.maximum(g[u][a], g[v][b]))], ["a", "b"])

    return rows.repartition("x").sortWithinPartitions("x", "node").mapInArrow(run, "a bigint, b bigint")


def _places(key: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Two places, word and bit, of each key in a filter."""
    spread = [tx.mixed(key), tx.mixed(key ^ tx.U(0x632BE59BD9B4E01A))]
    return [((h >> tx.U(6)) % tx.U(FILTER), h & tx.U(63)) for h in spread]


def _filter(asked: DataFrame) -> np.ndarray:
    """A Bloom filter of the keys k: FILTER words, whatever their number. Words are joined before they reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _places(batch.column(0).to_numpy().view(tx.U))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([w for w, _ in at]).astype(np.int64)), pa.array(np.concatenate([tx.U(1) << b for _, b in at]).view(np.int64))], ["w", "v"])

    got = asked.select("k").mapInArrow(run, "w bigint, v bigint").groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
    out = np.zeros(FILTER, tx.U)
    out[got["w"].to_numpy()] = got["v"].to_numpy().view(tx.U)
    return out


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, shingle: int, least: float, name: str) -> DataFrame:
    """Those of the pairs ``a, b`` whose sets are similar. Texts themselves are not shuffled, only the sets of those asked for."""
    since = mark()

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # of sets that similar at most this many shingles are in one only
            most = (1 - least) / (1 + least) * (batch.column(2).to_numpy() + batch.column(3).to_numpy()) + 1e-6
            ok = [differing(a.as_py(), b.as_py()) <= m for a, b, m in zip(batch.column(4), batch.column(5), most.tolist(), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    pairs = pairs.distinct().join(nodes.select(F.col("node").alias("x"), F.col("n").alias("na"), F.col("bits").alias("ba")), F.col("a") == F.col("x")).join(nodes.select(F.col("node").alias("y"), F.col("n").alias("nb"), F.col("bits").alias("bb")), F.col("b") == F.col("y"))
    pairs = written(pairs.select("a", "b", "na", "nb", "ba", "bb").mapInArrow(possible, "a bigint, b bigint"), f"copies-{name}-pairs")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct().join(nodes.select("node", "key"), F.col("c") == F.col("node")).select("node", F.col("key").alias("k"))
    asked = written(asked, f"copies-{name}-asked")
    bits = _filter(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy().view(tx.U)
            batch = batch.filter(pa.array(np.all([bits[w] >> b & tx.U(1) for w, b in _places(key)], axis=0).astype(bool)))
            buf, offsets = tx.flat(batch.column(1))
            for a, b in tx.chunks(offsets):
                doc, grams = shingle_sets(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], shingle)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), _lists(doc, grams, b - a)], ["key", "s"])

    own = texts.select("key", "text").mapInArrow(run, "key bigint, s array<bigint>").join(asked, F.col("key") == F.col("k")).dropDuplicates(["node"])
    sets = written(own.select("node", "s"), f"copies-{name}-sets")
    both = pairs.join(sets.select(F.col("node").alias("x"), F.col("s").alias("sa")), F.col("a") == F.col("x")).join(sets.select(F.col("node").alias("y"), F.col("s").alias("sb")), F.col("b") == F.col("y"))
    common = F.size(F.array_intersect("sa", "sb"))
    links = written(both.filter(common >= F.lit(least) * (F.size("sa") + F.size("sb") - common) - 1e-9).select("a", "b"), f"copies-{name}-links")
    clean(since, latest=1)  # but for links
    return links


def _by_fingerprint(nodes: DataFrame) -> DataFrame:
    """``a, b``: pairs of nodes whose fingerprints are equal or close, each node with one of its fingerprint's and each fingerprint's with another's."""
    first = written(nodes.groupBy("fp").agg(F.min("node").alias("first")), "copies-fingerprints")
    same = nodes.select("fp", "node").join(first.withColumnRenamed("fp", "f"), F.col("fp") == F.col("f")).filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    near = close_fingerprints(first.select("fp")).withColumnsRenamed({"a": "x", "b": "y"})
    near = near.join(first.select(F.col("fp").alias("f"), F.col("first").alias("p")), F.col("x") == F.col("f")).join(first.select(F.col("fp").alias("g"), F.col("first").alias("q")), F.col("y") == F.col("g"))
    return same.union(near.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")))


def near_copies(docs: DataFrame, shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """``doc_id, component_id`` for each row of docs: the smallest doc_id reachable over links of Jaccard ``least`` or more.

    Words are compared without regard to the case of A-Z. Texts without words, and null ones, are copies of each other. Null
    ids take part; component_id is null only where all ids of a component are.
    """
    since = mark()
    texts = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # rid tells texts apart, key rows: of many copies of a text one is read again
    texts = texts.withColumn("rid", F.xxhash64("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    own = written(_scanned(texts, shingle, least), "copies")
    # equal sets have equal sizes, prefixes and parities: those of any of its texts
    nodes = own.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("key").alias("key"), *[F.first(c).alias(c) for c in ("n", "bits", "few", "prefix", "fp")])
    nodes = written(nodes, "copies-nodes")
    met = written(_met(nodes, least), "copies-met")
    stars = met.select("node", F.explode("stars").alias("star")).select(F.least("node", "star").alias("a"), F.greatest("node", "star").alias("b"))
    links = _verified(_by_fingerprint(nodes).union(stars), nodes, texts, shingle, least, "first")
    roots = components(links)
    placed = met.join(roots.withColumnRenamed("node", "u"), F.col("node") == F.col("u"), "left").select("x", "node", "n", "i", F.coalesce("root", "node").alias("root"))
    placed = written(placed, "copies-placed")
    split = placed.groupBy("x").agg(F.min("root").alias("p"), F.max("root").alias("q")).filter("p <> q").select(F.col("x").alias("y"))
    placed = placed.join(split, F.col("x") == F.col("y"), "left_semi").join(nodes.select(F.col("node").alias("u"), "few"), F.col("node") == F.col("u"))
    rest = _across(placed.select("x", "node", "n", "i", "root", "few"), least)
    rest = _verified(rest, nodes, texts, shingle, least, "rest")
    # what the rest links are whole components: only their roots are joined further
    of = [roots.select(F.col("node").alias(f"u{c}"), F.col("root").alias(f"r{c}")) for c in "ab"]
    between = rest.join(of[0], F.col("a") == F.col("ua"), "left").join(of[1], F.col("b") == F.col("ub"), "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    tops = components(between).select(F.col("node").alias("v"), F.col("root").alias("top"))
    named = nodes.join(roots.withColumnRenamed("node", "u"), F.col("node") == F.col("u"), "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    named = named.join(tops, F.col("root") == F.col("v"), "left").select("node", "least", F.coalesce("top", "root").alias("root"))
    firsts = named.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "r")
    named = named.join(firsts, F.col("root") == F.col("r")).select(F.col("node").alias("u"), "component_id")
    out = written(own.select("doc_id", "node").join(named, F.col("node") == F.col("u")).select("doc_id", "component_id"), "copies-components")
    clean(since, latest=1)  # but for out
    return out
