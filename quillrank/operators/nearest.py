"""Inner products of query vectors and all candidates, by blocks, of which only what may be among the first k leaves a task.

Candidates and queries are packed into blocks by hash, and each pair of blocks is a row of its own. A task multiplies the
two matrices, keeps of each query the products that can be among the k best of a group of candidates, and sums those anew,
component after component, as a row's expression does: the doubles that leave are those of ``retrieval.dot``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vectors of a block of candidates or queries, and queries multiplied at once.
BLOCK, TOGETHER = 4096, 1024
#: Scores that lie so close may be equal once rounded to nine digits.
SLACK = 2e-9
#: Components up to here, so that no product of two vectors overflows.
LARGEST = 1e100


def even(v: str | Column, length: int) -> Column:
    """Whether a vector has ``length`` components, all of them numbers."""
    c = F.col(v) if isinstance(v, str) else v
    return F.coalesce((F.size(c) == length) & ~F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > LARGEST)), F.lit(False))


def _packed(rows: DataFrame, length: int, side: str) -> tuple[DataFrame, int]:
    """Rows of about BLOCK of ``rows`` (id, v, group): their ids and groups, and the vectors as one matrix; and the number of blocks."""
    blocks = max(1, -(-rows.count() // BLOCK))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)))

    def pack(table: pa.Table) -> pa.Table:
        x = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        packed = [np.ascontiguousarray(c).tobytes() for c in (table["id"].to_numpy(), table["group"].to_numpy(), x)]
        return pa.table([table["block"][:1].combine_chunks(), *(pa.array([c], pa.binary()) for c in packed)], ["block", "ids", "groups", "data"])

    packed = dealt.groupBy("block").applyInArrow(pack, "block bigint, ids binary, groups binary, data binary")
    return packed.select(*[F.col(c).alias(f"{side}_{c}") for c in packed.columns]), blocks


def _first(at: np.ndarray, value: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Of each query's rows of one value the places of the k least ids: the others cannot be among the first k."""
    order = np.lexsort((ids, value, at))
    new = np.append(True, (np.diff(at[order]) != 0) | (np.diff(value[order]) != 0))[: len(order)]
    return order[np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0)) < k]


def products(queries: DataFrame, candidates: DataFrame, k: int, length: int, itself: bool = True, slack: float = SLACK) -> DataFrame:
    """``query_id, query_group, candidate_id, candidate_group, product``: for each query, and each group of candidates, those that may be among the k best.

    Both sides have id, v and group: ids and groups are bigint, vectors :func:`even` arrays. Products count as clipped to
    [0, 1], and ties go to the smaller id; those less than ``slack`` below the k-th stay. ``itself``: whether candidates of
    the query's own id count.
    """
    kinds = [np.float32 if d.schema["v"].dataType.simpleString() == "array<float>" else np.float64 for d in (candidates, queries)]
    c, blocks = _packed(candidates, length, "c")
    q, _ = _packed(queries, length, "q")
    every = F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))
    names = [f"{side}_{c}" for side in "cq" for c in ("ids", "groups", "data")]
    pairs = c.join(q.withColumn("b", F.explode(every)), F.col("c_block") == F.col("b")).select(*names).repartition(F.xxhash64("c_ids", "q_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids, groups, data, q_ids, q_groups, q_data = (c[r].as_py() for c in batch.columns)
                ids, groups, q_ids, q_groups = (np.frombuffer(v, np.int64) for v in (ids, groups, q_ids, q_groups))
                x, q = (np.frombuffer(v, kind).reshape(-1, length).astype(np.float64) for v, kind in zip((data, q_data), kinds, strict=True))
                # the product of matrices and the sum in order each lie within d * eps * |x| |q| of the exact one
                off = slack + 4 * length * np.finfo(float).eps * float(np.linalg.norm(x, axis=1).max() * np.linalg.norm(q, axis=1).max())
                order = np.argsort(groups, kind="stable")
                cuts = [0, *(np.flatnonzero(np.diff(groups[order])) + 1).tolist(), len(order)]
                for lo in range(0, len(q), TOGETHER):
                    part, own = q[lo : lo + TOGETHER], q_ids[lo : lo + TOGETHER]
                    by_id = np.argsort(own, kind="stable")
                    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                        rows = order[a:b]
                        near = np.clip(part @ x[rows].T, 0.0, 1.0)
                        if not itself:
                            first, last = (np.searchsorted(own[by_id], ids[rows], side) for side in ("left", "right"))
                            for j in np.flatnonzero(last > first).tolist():
                                near[by_id[first[j] : last[j]], j] = -np.inf
                        least = np.partition(near, len(rows) - k, axis=1)[:, len(rows) - k] if len(rows) > k else np.zeros(len(part))
                        i, j = np.nonzero((near >= least[:, None] - off) & (near >= 0))
                        j = rows[j]
                        total = np.zeros(len(i))
                        for d in range(length):
                            total += part[i, d] * x[j, d]
                        kept = _first(i, np.clip(total, 0.0, 1.0), ids[j], k)
                        i, j = i[kept], j[kept]
                        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (own[i], q_groups[lo + i], ids[j], groups[j], total[kept])], ["query_id", "query_group", "candidate_id", "candidate_group", "product"])

    return pairs.mapInArrow(run, "query_id bigint, query_group bigint, candidate_id bigint, candidate_group bigint, product double")
