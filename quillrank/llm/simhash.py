"""SimHash near-dedup with an exact Hamming join.

Fingerprints that differ in two bits at most agree in two of four 16-bit blocks, so each distinct
fingerprint goes to six buckets, one for each pair of blocks, and is compared within them only.
In a bucket fingerprints lie in order of their population count and are compared tile against
tile, by exclusive-or and bit counts in numpy; tile pairs whose population counts differ by more
than the radius are skipped. A bucket of many fingerprints is cut, by population count and hash,
into tiles whose pairs go to different tasks. Nothing is dropped: a fingerprint has at most
64 + 64 * 63 / 2 = 2080 neighbours, which bounds the links by the number of distinct fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .components import components
from .storage import bounded_batches, written

SHINGLE, SEED, RADIUS = 3, 42, 2
TILE = 1024
HOT = 4096
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[tx.SEPARATOR] = 32


def _single_spaced(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts in lower case with one space for each run of separators."""
    buf = _LOWER[buf]
    gap = buf == 32
    keep = np.ones(len(buf), dtype=bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    at = np.concatenate([[0], np.cumsum(keep)])
    return buf[keep], at[offsets]


def fingerprints(buf: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each text of a chunk, as uint64."""
    n = len(offsets) - 1
    out = np.zeros((n, 64), dtype=bool)
    buf, offsets = _single_spaced(buf, offsets)
    starts, ends, first = tx.words(buf, offsets)
    size = np.diff(first)
    shingles = np.where(size >= shingle, size - shingle + 1, np.minimum(size, 1))
    some = np.flatnonzero(shingles)
    if len(some):
        doc = np.repeat(some, shingles[some])
        begin = np.cumsum(shingles) - shingles
        at = first[doc] + np.arange(len(doc)) - begin[doc]
        last = at + np.minimum(size[doc], shingle) - 1
        data = buf.tobytes()
        spans = [data[a:b] for a, b in zip(starts[at].tolist(), ends[last].tolist(), strict=True)]
        bits = np.unpackbits(np.frombuffer(b"".join(map(xxhash.xxh64_digest, spans, repeat(SEED))), np.uint8).reshape(-1, 8), axis=1)
        out[some] = 2 * np.add.reduceat(bits, begin[some], axis=0, dtype=np.int32) > shingles[some][:, None]
    return np.packbits(out, axis=1).view(">u8").astype(np.uint64).ravel()


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a bigint) for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = tx.flat(batch.column(1))
            parts = [fingerprints(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in tx.chunks(offsets)]
            if parts:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts).view(np.int64))], ["doc_id", "fp"])

    return bounded_batches(docs).selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id bigint, fp bigint")


def close_pairs(a: np.ndarray, b: np.ndarray | None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (of a with b, or within a) at most ``radius`` bits apart, tile against tile."""
    within = b is None
    a = a[np.argsort(np.bitwise_count(a), kind="stable")]
    b = a if within else b[np.argsort(np.bitwise_count(b), kind="stable")]
    ca, cb = np.bitwise_count(a).astype(np.int64), np.bitwise_count(b).astype(np.int64)
    left, right = [], []
    for i in range(0, len(a), TILE):
        x = a[i : i + TILE]
        for j in range(i if within else 0, len(b), TILE):
            y = b[j : j + TILE]
            if cb[j] - ca[i + len(x) - 1] > radius:
                break
            if ca[i] - cb[j + len(y) - 1] > radius:
                continue
            p, q = np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= radius)
            if within and i == j:
                p, q = p[p < q], q[p < q]
            left.append(x[p])
            right.append(y[q])
    none = np.zeros(0, np.uint64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _keys() -> Column:
    """The six (pair of blocks, their bits)."""
    block = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    return F.array(*[(F.lit(n << 32) + block[i] * 65536 + block[j]).cast("long") for n, (i, j) in enumerate(combinations(range(4), 2))])


def links(distinct: DataFrame) -> DataFrame:
    """``a, b``: every pair of distinct fingerprints (fp) at most RADIUS bits apart, some of them more than once."""
    keyed = distinct.select("fp", F.explode(_keys()).alias("key"))
    hot = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT).select(F.col("key").alias("k"), F.ceil(F.col("n") / HOT).alias("m"))
    keyed = keyed.join(hot, F.col("key") == F.col("k"), "left").drop("k")
    # a tile of a hot bucket is a population count and one of m hashes; it meets its own and the later ones in reach
    count = F.bit_count("fp").cast("long")
    tile = count * F.col("m") + F.pmod(F.xxhash64("fp"), F.col("m"))
    reach = F.sequence(F.lit(0).cast("long"), (F.lit(RADIUS + 1) * F.col("m")))
    low = F.transform(reach, lambda d: F.struct(tile.alias("x"), (tile + d).alias("y"), F.lit(0).alias("side")))
    high = F.transform(F.slice(reach, 2, F.lit(1 << 30)), lambda d: F.struct((tile - d).alias("x"), tile.alias("y"), F.lit(1).alias("side")))
    alone = F.array(F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.lit(0).alias("side")))
    met = keyed.select("key", "fp", F.explode(F.when(F.col("m").isNull(), alone).otherwise(F.concat(low, high))).alias("t"))
    dealt = met.select("key", "t.x", "t.y", "t.side", "fp").repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows: list[np.ndarray]) -> pa.RecordBatch | None:
            key, x, y, side, fp = rows
            if not len(key):
                return None
            new = np.ones(len(key), dtype=bool)
            new[1:] = (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
            begin = np.flatnonzero(new)
            end = np.append(begin[1:], len(key))
            big = end - begin > 1
            left, right = [], []
            for i, j in zip(begin[big].tolist(), end[big].tolist(), strict=True):
                own, s = fp[i:j].view(np.uint64), side[i:j]
                p, q = close_pairs(own, None) if x[i] == y[i] else close_pairs(own[s == 0], own[s == 1])
                left.append(p)
                right.append(q)
            if not left or not sum(map(len, left)):
                return None
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).view(np.int64)) for v in (left, right)], ["a", "b"])

        kept = [np.zeros(0, np.int64)] * 5
        for batch in batches:
            kept = [np.concatenate([k, c.to_numpy(zero_copy_only=False).astype(np.int64)]) for k, c in zip(kept, batch.columns, strict=True)]
            if not len(kept[0]):
                continue
            last = [k[-1] for k in kept[:3]]
            cut = int(np.flatnonzero((kept[0] != last[0]) | (kept[1] != last[1]) | (kept[2] != last[2]))[-1]) + 1 if len(kept[0]) and ((kept[0] != last[0]) | (kept[1] != last[1]) | (kept[2] != last[2])).any() else 0
            if cut:
                if (out := found([k[:cut] for k in kept])) is not None:
                    yield out
                kept = [k[cut:] for k in kept]
        if (out := found(kept)) is not None:
            yield out

    return dealt.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id, n_links`` for each row of docs.

    component_id is the smallest doc_id reachable over links (equal fingerprints count as linked);
    n_links is the number of other fingerprints linked to the row's own. A null or empty text, or one without
    words, has fingerprint zero and links like any other. Null ids take part and are smaller than
    none: component_id is null only where all ids of a component are. Equal rows give a row each. Columns besides
    doc_id and text are not read.
    """
    own = written(fingerprint_table(docs), "simhash")
    distinct = written(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    edges = written(links(distinct).distinct(), "simhash-links")
    roots = components(edges)
    degree = edges.select(F.explode(F.array("a", "b")).alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("n_links"))
    named = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    firsts = named.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "r")
    named = named.join(firsts, F.col("root") == F.col("r")).select("fp", "component_id")
    named = named.join(degree, F.col("fp") == F.col("d"), "left").select(F.col("fp").alias("f"), "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    named = written(named, "simhash-components")
    out = own.join(named, F.col("fp") == F.col("f"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_links")
