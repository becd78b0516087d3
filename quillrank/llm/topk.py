"""Exact top-k inner products by Fagin's threshold algorithm.

Candidates lie in blocks. In a block every dimension has a list of the candidates in order of its value.
A query walks all its lists at once, the best end first (the least value where its own component is negative), and
scores what it meets in full. No candidate unseen at some depth can score more than the sum over dimensions of the query's
component times the value at that depth; once this bound cannot beat the k-th score found so
far, the walk stops. The walk goes in steps of STEP rows of every list, then twice as many each time. Many queries take it together: what one list
shows is scored for all of them at once, as a product of matrices, in the narrowest floats that hold the scores exactly.

A group's answers merge by a grouped top-k. Queries are a stated set against all rows: blocks are put together to groups of bounded
bytes, and each pair of a group of queries and a group of candidates meets in a shuffle, by itself. So a block is sent
once for each group of the other side, never for each of its blocks, and no side is held whole anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import written

K, SCALE = 5, 256.0
BLOCK, QUERIES = 4096, 4096
STEP = 8
#: Bytes of the blocks of a group, on either side; and groups of candidates for each core, where there are blocks enough.
GROUP, FOR_A_CORE = 16 << 20, 4
#: Queries of a block that walk together.
TOGETHER = 1024
_OUT = "query_id bigint, vec_id bigint, score bigint"


def quantised(column: str = "embedding", scale: float = SCALE) -> Column:
    """floor(scale * x) of each component, x as double; null for vectors that are null, empty or hold a null or non-finite component.

    A finite component that a bigint cannot hold is an error.
    """
    v = F.transform(F.col(column), lambda x: x.cast("double"))
    far = F.exists(v, lambda x: (F.abs(x * scale) >= 2.0**63) & (F.abs(x) < float("inf")))
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.when(far, F.raise_error(F.lit("a component is too large to be quantised")).cast("array<bigint>")).otherwise(F.transform(v, lambda x: F.floor(x * scale).cast("long")))
    return F.when(~odd & (F.size(v) > 0), whole)


def threshold_topk(x: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray | None = None) -> list[np.ndarray]:
    """For each query (row of q) the rows of x among which its k best lie, ties of the k-th too: found without seeing all of x.

    ``floor``: scores that k candidates elsewhere are known to reach, for each query. Where a score may pass
    2 ** 53 the bound would not be exact: nothing is left out then.
    """
    if not _below(x, q, 53):
        return [np.arange(len(x))] * len(q)
    at, row, _ = _walk(x, _lists(x), q, k, np.full(len(q), -np.inf) if floor is None else floor.astype(float), *[np.zeros(0, np.int64)] * 2)
    return [row[at == i] for i in range(len(q))]


def _lists(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each dimension the rows of x in order of its value, and the values in that order."""
    order = np.argsort(x, axis=0, kind="stable")
    return order, np.take_along_axis(x, order, axis=0)


def _walk(x: np.ndarray, lists: tuple[np.ndarray, np.ndarray], q: np.ndarray, k: int, kth: np.ndarray, own_at: np.ndarray, own_row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``at, row, score``: of each query (at) the rows with its k best scores, ties too, but for the pairs (own_at, own_row); kth, the floors, is raised in place.

    The queries walk together: a row that any list has at a step is scored for all that still walk, as one product of matrices.
    """
    (n, d), (order, values) = x.shape, lists
    kind = np.float32 if _below(x, q, 24) else np.float64  # whole numbers, and sums of their products, that it holds exactly
    xf, qf = x.astype(kind), q.astype(kind)
    up, down = np.maximum(q, 0).astype(np.float64), np.minimum(q, 0).astype(np.float64)
    best = np.full((len(q), k), -np.inf, dtype=kind)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    seen = np.zeros(n, dtype=bool)
    some = q.any(axis=1)
    live, depth, to = np.arange(len(q)), 0, 0
    while n:
        # what an unseen row can score at most; before the first step, any row. A query of zeros has no list to walk: all of x ties
        bound = up[live] @ values[n - 1 - depth] + down[live] @ values[depth]
        live = live[(bound >= kth[live]) | ~some[live]]
        if not len(live):
            break
        to = min(n, 2 * to or STEP)
        met = np.zeros(n, dtype=bool)
        met[order[n - to : n - depth].ravel()] = True
        met[order[depth:to].ravel()] = True
        rows = np.flatnonzero(met & ~seen)
        seen |= met
        if len(rows):
            scores = qf[live] @ xf[rows].T
            if len(own_at):
                line, place = np.full(len(q), -1), np.full(n, -1)
                line[live], place[rows] = np.arange(len(live)), np.arange(len(rows))
                i, j = line[own_at], place[own_row]
                scores[i[(i >= 0) & (j >= 0)], j[(i >= 0) & (j >= 0)]] = -np.inf
            more = np.flatnonzero(scores.max(axis=1) >= kth[live])
            if len(more):
                scores, those = scores[more], live[more]
                top = np.partition(scores, len(rows) - k, axis=1)[:, -k:] if len(rows) > k else scores
                best[those] = np.partition(np.concatenate([best[those], top], axis=1), -k, axis=1)[:, -k:]
                kth[those] = np.maximum(kth[those], best[those].min(axis=1))
                i, j = np.nonzero((scores >= kth[those][:, None]) & (scores > -np.inf))
                found.append((those[i], rows[j], scores[i, j].astype(np.int64)))
        depth = to
        if depth >= n or seen.all():
            break
    if not found:
        return (np.zeros(0, np.int64),) * 3
    at, row, score = (np.concatenate(c) for c in zip(*found, strict=True))
    still = score >= kth[at]
    return at[still], row[still], score[still]


def _below(x: np.ndarray, q: np.ndarray, bits: int) -> bool:
    """Whether every product and sum of x and q is below 2 ** bits: 53 for float64 to hold it, 63 for int64."""
    most = [max(abs(int(v.max(initial=0))), abs(int(v.min(initial=0)))) for v in (x, q)]
    return most[0] * most[1] * x.shape[-1] < 1 << bits


def _scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The products of the rows of x with q; an error where one does not fit into a bigint."""
    if _below(x, q, 63):
        return x @ q
    exact = x.astype(object) @ q.astype(object)
    if any(abs(s) >= 1 << 63 for s in exact.tolist()):
        raise OverflowError("a score does not fit into a bigint")
    return exact.astype(np.int64)


def _packed(vectors: DataFrame, n: int, size: int, length: int, name: str) -> tuple[DataFrame, int]:
    """The n vectors in rows of about ``size``: ``block, ids, data`` (filled up with zeros to ``length``), ``rows``, ``width`` (bytes of a component); and the number of blocks."""
    blocks = max(1, -(-n // size))
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)))

    def pack(table: pa.Table) -> pa.Table:
        v = table["v"].combine_chunks()
        size = np.diff(v.offsets.to_numpy())
        x = np.zeros((len(v), length), dtype=np.int64)
        x[np.arange(length)[None, :] < size[:, None]] = v.flatten().to_numpy()
        ids = table["vec_id"].combine_chunks().to_numpy().astype(np.int64)
        small = next((w for w in (2, 4) if x.size == 0 or -(1 << 8 * w - 1) <= int(x.min()) <= int(x.max()) < 1 << 8 * w - 1), 8)
        return pa.table({"block": table["block"][:1], "ids": pa.array([ids.tobytes()], pa.binary()), "data": pa.array([x.astype(f"<i{small}").tobytes()], pa.binary()), "rows": pa.array([table.num_rows], pa.int64()), "width": pa.array([small], pa.int32())})

    return written(dealt.groupBy("block").applyInArrow(pack, "block bigint, ids binary, data binary, rows bigint, width int"), name), blocks


def _in_group(packed: DataFrame, blocks: int, least: int) -> int:
    """How many of the blocks are a group: as many as GROUP bytes hold, but so few that there are ``least`` groups if there are blocks enough."""
    longest = packed.agg(F.max(F.length("data") + F.length("ids"))).first()[0] or 1
    return max(1, min(GROUP // longest, blocks // least))


def _best(at: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """The places of each query's k best, ties to the smaller id."""
    order = np.lexsort((ids, -score, at))
    first = np.searchsorted(at[order], at[order])
    return order[np.arange(len(order)) - first < k]


def _equal(q_ids: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (place in q_ids, place in ids) of one id; q_ids are distinct."""
    order = np.argsort(q_ids)
    near = np.minimum(np.searchsorted(q_ids[order], ids), max(len(q_ids) - 1, 0))
    row = np.flatnonzero(q_ids[order][near] == ids)
    return order[near[row]], row


def topk(vectors: DataFrame, queries: Column, k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best candidates of each query.

    ``vectors``: ``vec_id, v`` (array of bigint; rows with a null of either take no part; a vector shorter than others
    counts as filled up with zeros; a score beyond a bigint is an error). ``queries`` marks the rows that are queries; a candidate is every row whose id is not the
    query's own. Ties go to the smaller vec_id. Rows repeated under one id are candidates each, and one
    query, by the least of their vectors. Without queries or candidates there are no rows.
    """
    own = vectors.filter("vec_id is not null and v is not null")
    n, n_asked, length = own.agg(F.count(F.lit(1)), F.count_if(queries), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    candidates, blocks = _packed(own, n, BLOCK, length, "topk-candidates")
    asked, asked_blocks = _packed(own.filter(queries).groupBy("vec_id").agg(F.min("v").alias("v")), n_asked, QUERIES, length, "topk-queries")
    per_c = _in_group(candidates, blocks, FOR_A_CORE * vectors.sparkSession.sparkContext.defaultParallelism)
    per_q = _in_group(asked, asked_blocks, 1)
    names = ["ids", "data", "rows", "width"]

    def met(side: DataFrame, own: str, per: int, other: str, groups: int, asks: bool) -> DataFrame:
        """The blocks of a side, once for each group of the other."""
        every = F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))
        return side.select(F.floor(F.col("block") / per).cast("long").alias(own), F.explode(every).alias(other), F.lit(asks).alias("asks"), *names).select("g", "h", "asks", *names)

    both = met(candidates, "g", per_c, "h", -(-asked_blocks // per_q), False).unionByName(met(asked, "h", per_q, "g", -(-blocks // per_c), True))

    def walk(table: pa.Table) -> pa.Table:
        def unpacked(asks: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in table.filter(pc.equal(table["asks"], asks)).select(names).to_batches():
                for r in range(batch.num_rows):
                    ids, data, rows, width = (c[r].as_py() for c in batch.columns)
                    yield np.frombuffer(ids, np.int64), np.frombuffer(data, f"<i{width}").reshape(rows, -1)

        asked = list(unpacked(True))
        floors = [np.full(len(q), -np.inf) for _, q in asked]  # for each block of queries, what k candidates of a block before reach
        held = [(np.zeros(0, np.int64),) * 3] * len(asked)  # the k best of each query so far: of a group no more leave a task
        for ids, x in unpacked(False) if asked else ():
            x = x.astype(np.int64)
            lists = _lists(x)
            for b, ((q_ids, q), floor) in enumerate(zip(asked, floors, strict=True)):
                q = q.astype(np.int64)
                exact = _below(x, q, 53)
                found = [held[b]]
                for lo in range(0, len(q), TOGETHER if exact else 1):
                    if exact:
                        part = slice(lo, lo + TOGETHER)
                        at, row, score = _walk(x, lists, q[part], k, floor[part], *_equal(q_ids[part], ids))
                    else:
                        row = np.flatnonzero(ids != q_ids[lo])
                        at, score = np.zeros(len(row), np.int64), _scores(x[row], q[lo])
                    best = _best(at, ids[row], score, k)
                    found.append((lo + at[best], ids[row[best]], score[best]))
                at, those, score = (np.concatenate(c) for c in zip(*found, strict=True))
                best = _best(at, those, score, k)
                held[b] = at[best], those[best], score[best]
        parts = [(np.zeros(0, np.int64),) * 3, *((q_ids[at], those, score) for (q_ids, _), (at, those, score) in zip(asked, held, strict=True))]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*parts, strict=True)), strict=True)))

    scored = both.groupBy("g", "h").applyInArrow(walk, _OUT)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
