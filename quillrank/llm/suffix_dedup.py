"""Suffix-array dedup of byte strings.

Candidates are the winnowed runs (see winnow) whose anchor occurs again, a class of equal runs taken once
with its number of copies. They are dealt by anchor to shards of about SHARD_BYTES. A shard sorts its suffixes by
Larsson-Sadakane refinement (ranks of 8 bytes first, then of twice as many, only where still tied, up to the window
and no further), so suffixes that stay tied are equal windows; such a group is repeated if its copies are two or more.

An anchor with more different surroundings than one shard holds is spread over several. Their sorted windows
are then cut into ranges, each shard sends its part of a range as one packed list, and a window that was alone in its
shard is looked up in the others' lists by binary search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx
from . import winnow as wn
from .storage import clean, mark, written

WINDOW = 400
SHARD_BYTES = 1 << 20
LANE = 512
#: No byte of UTF-8; it ends each segment of a shard.
END = 0xFF


def gram(window: int) -> int:
    """Bytes of an anchor."""
    return max(1, min(128, window // 3))


def packed(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a number, most significant first; zeros follow the end."""
    k = np.concatenate([buf, np.zeros(8, np.uint8)]).astype(tx.U)
    for m in (1, 2, 4):
        k = (k[:-m] << tx.U(8 * m)) | k[m:]
    return k[: len(buf)]


def suffix_array(buf: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in order of the suffixes from there, and each position's rank; those of equal first ``depth`` bytes stay tied.

    Larsson-Sadakane: the rank of a position is the place where its group of ties begins. A round sorts
    the tied ones by the rank ``h`` bytes on and doubles h, the last one by that of the bytes still missing to
    ``depth``; what is alone in its group is never touched again.
    """
    n = len(buf)
    key = packed(buf) >> tx.U(8 * max(8 - depth, 0))
    sa = np.argsort(key)  # the order within a group of ties is of no account
    ranked = key[sa]
    head = np.ones(n, dtype=bool)
    head[1:] = ranked[1:] != ranked[:-1]
    place = np.flatnonzero(head)
    rank = np.empty(n, dtype=np.int64)
    rank[sa] = np.repeat(place, np.diff(np.append(place, n)))
    tied = ~(head & np.append(head[1:], True))
    slots = np.flatnonzero(tied)
    h = 8
    while h < depth and len(slots):
        at = sa[slots]
        step = min(h, depth - h)
        later = at + step
        follow = np.where(later < n, rank[np.minimum(later, n - 1)] + 1, 0)
        own = rank[at]
        order = np.argsort(own * (n + 1) + follow)
        at, own, follow = at[order], own[order], follow[order]
        sa[slots] = at
        new = np.ones(len(at), dtype=bool)
        new[1:] = (own[1:] != own[:-1]) | (follow[1:] != follow[:-1])
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(at)))
        rank[at] = np.repeat(slots[begin], size)
        slots = slots[np.repeat(size > 1, size)]
        h += step
    return sa, rank


def common_prefixes(buf: np.ndarray, sa: np.ndarray, most: int, limit: np.ndarray) -> np.ndarray:
    """For each place in the suffix array how many bytes, ``most`` at most, its suffix shares with the one before.

    Kasai's rule: the prefix of the next position of the text is shorter by one at most. Lanes of
    LANE consecutive positions go side by side, each carrying its own length from position to position.
    Suffixes that ``sa`` left tied may lie the other way round one byte on; there the length is counted anew.
    ``limit``: bytes from each position to its segment's end, which no prefix passes.
    """
    n = len(buf)
    before = np.full(n, -1, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    place = np.empty(n, dtype=np.int64)
    place[sa] = np.arange(n)
    key = packed(buf)
    prefix = np.zeros(n, dtype=np.int64)
    lanes = np.arange(0, n, LANE)
    h = np.zeros(len(lanes), dtype=np.int64)
    last = np.full(len(lanes), -1, dtype=np.int64)
    for t in range(min(LANE, n)):
        if lanes[-1] + t >= n:
            lanes, h, last = lanes[:-1], h[:-1], last[:-1]
        i = lanes + t
        j = before[i]
        top = np.minimum(np.minimum(limit[i], limit[np.maximum(j, 0)]), most)
        top[j < 0] = 0
        h[place[np.minimum(last + 1, n - 1)] > place[i]] = 0
        h = np.minimum(np.maximum(h - 1, 0), top)
        live = np.flatnonzero(h < top)
        while len(live):
            a, b = i[live] + h[live], j[live] + h[live]
            x = key[a] ^ key[b]
            gain = (x == 0).astype(np.int64)  # equal leading bytes of eight
            for k in range(1, 8):
                gain += x < tx.U(1 << (8 * k))
            h[live] = np.minimum(h[live] + gain, top[live])
            live = live[(gain == 8) & (h[live] < top[live])]
        prefix[i] = h
        last = j
    return prefix[sa]


def shard_groups(buf: np.ndarray, begin: np.ndarray, end: np.ndarray, copies: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of a shard of segments [begin, end): their positions, grouped; the group of each; copies in each group."""
    owner = np.repeat(np.arange(len(begin)), end - begin + 1)  # the byte after a segment is END
    limit = end[owner] - np.arange(len(buf))
    sa, rank = suffix_array(buf, window)
    at = sa[limit[sa] >= window]
    # a window that passes its segment's end holds END, so it is tied with no whole one
    tied = rank[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = tied[1:] != tied[:-1]
    group = np.cumsum(new) - 1
    return at, group, np.bincount(group, weights=copies[owner[at]]).astype(np.int64) if len(at) else np.zeros(0, np.int64)


def _run_lists(segment: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Sorted (segment, window) pairs as a row for each segment: first windows of its runs, how many in each."""
    new = np.ones(len(i), dtype=bool)
    new[1:] = (segment[1:] != segment[:-1]) | (i[1:] != i[:-1] + 1)
    p = np.flatnonzero(new)
    n = np.diff(np.append(p, len(i)))
    owner = segment[p]
    first = np.ones(len(p), dtype=bool)
    first[1:] = owner[1:] != owner[:-1]
    row = np.flatnonzero(first)
    cuts = pa.array(np.append(row, len(p)).astype(np.int32))
    return owner[row], pa.ListArray.from_arrays(cuts, pa.array(i[p].astype(np.int32))), pa.ListArray.from_arrays(cuts, pa.array(n.astype(np.int32)))


def _segments(classes: DataFrame, docs: DataFrame, window: int) -> DataFrame:
    """The bytes of one run of each class."""
    own = classes.groupBy(F.col("rep.rid").alias("r"), F.col("rep.doc_id").alias("d")).agg(F.collect_list(F.struct("anchor", "digest", "copies", "rep.p", "rep.n")).alias("c"))
    rows = docs.join(own, wn.same_row("r", "d")).dropDuplicates(["rid", "doc_id"]).select("text", "c.anchor", "c.digest", "c.copies", "c.p", "c.n")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).cast(pa.large_binary())
            for k in range(batch.num_rows):
                text = memoryview(texts[k].as_buffer())
                anchor, digest, copies, p, n = (batch.column(c)[k].values for c in range(1, 6))
                parts = [bytes(text[a : a + m + window - 1]) for a, m in zip(p.to_pylist(), n.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([anchor, digest, copies, pa.array(parts, pa.binary())], ["anchor", "digest", "copies", "segment"])

    return rows.mapInArrow(cut, "anchor bigint, digest bigint, copies bigint, segment binary")


_MARKS = [("anchor", pa.int64()), ("digest", pa.int64()), ("starts", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))]
_MARKS_DDL = "anchor bigint, digest bigint, starts array<int>, counts array<int>"
_OUT = pa.schema([*_MARKS, ("part", pa.int64()), ("packed", pa.binary())])
_OUT_DDL = _MARKS_DDL + ", part bigint, packed binary"


def _by_shard(table: pa.Table, window: int = WINDOW) -> pa.Table:
    """A row for each class of a shard that has repeated windows (part null). Of a spread anchor, too, for each
    range of window hashes one packed list (window hash, digest, 2 * place + whether alone here) in order of hash, to be looked up in."""
    anchor, digest, copies = (table[c].to_numpy() for c in ("anchor", "digest", "copies"))
    shards = table["m"].fill_null(0).to_numpy()  # how many shards the anchor is spread over; 0: this one alone
    parts = table["segment"].to_pylist()
    buf = np.frombuffer(b"".join(x for part in parts for x in (part, bytes([END]))), np.uint8)
    sizes = np.array([len(x) for x in parts], dtype=np.int64)
    end = np.cumsum(sizes + 1) - 1
    begin = end - sizes
    at, group, total = shard_groups(buf, begin, end, copies, window)
    on = np.sort(at[total[group] > 1])
    owner = np.searchsorted(end, on, side="right")
    seg, starts, counts = _run_lists(owner, on - begin[owner])
    out = [pa.table([pa.array(anchor[seg]), pa.array(digest[seg]), starts, counts, pa.nulls(len(seg), pa.int64()), pa.nulls(len(seg), pa.binary())], schema=_OUT)]
    if shards.any() and len(at):
        first = np.ones(len(at), dtype=bool)
        first[1:] = group[1:] != group[:-1]
        one = at[first]
        own = np.searchsorted(end, one, side="right")
        hashes = tx.rolled(tx.BYTE[buf], window)[one]
        part = ((hashes >> tx.U(32)) % np.maximum(shards[own], 1).astype(tx.U)).astype(np.int64)
        order = np.lexsort((hashes, part, anchor[own], shards[own] == 0))[: int((shards[own] > 0).sum())]
        a, q = anchor[own[order]], part[order]
        rows = np.stack([hashes[order].view(np.int64), digest[own[order]], 2 * (one - begin[own])[order] + (total[order] == 1)], axis=1)
        cuts = np.flatnonzero(np.append(np.append(True, (a[1:] != a[:-1]) | (q[1:] != q[:-1])), True)) if len(a) else np.zeros(1, np.int64)
        packs = [rows[i:j].tobytes() for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        none = pa.nulls(len(packs), pa.int64())
        out.append(pa.table([pa.array(a[cuts[:-1]]), none, pa.nulls(len(packs), _MARKS[2][1]), pa.nulls(len(packs), _MARKS[3][1]), pa.array(q[cuts[:-1]]), pa.array(packs, pa.binary())], schema=_OUT))
    return pa.concat_tables(out)


def _across(table: pa.Table) -> pa.Table:
    """Of one range of a spread anchor's windows, those alone in their shard but found in another's, a row for each class."""
    lists = [np.frombuffer(x, np.int64).reshape(-1, 3) for x in table["packed"].to_pylist()]
    merged = np.sort(np.concatenate([x[:, 0].view(tx.U) for x in lists]))
    found = []
    for own in lists:
        h = own[:, 0].view(tx.U)
        more = np.searchsorted(merged, h, side="right") - np.searchsorted(merged, h, side="left") > 1
        found.append(own[more & (own[:, 2] % 2 == 1)])
    rows = np.concatenate(found)
    digest, place = rows[:, 1], rows[:, 2] // 2
    order = np.lexsort((place, digest))
    seg, starts, counts = _run_lists(digest[order], place[order])
    return pa.table([pa.array(np.full(len(seg), table["anchor"][0].as_py(), np.int64)), pa.array(seg), starts, counts], schema=pa.schema(_MARKS))


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``rid, doc_id, starts, counts``: the windows of ``keyed`` docs that start anywhere else too."""
    since = mark()
    found = wn.repeated_runs(docs, wn.byte_tokens, window, gram(window), "suffix", within=True)
    classes = found.groupBy("anchor", "digest").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "rid", "p", "n")).alias("rep"))
    classes = written(classes, "suffix-classes")
    size = classes.groupBy("anchor").agg(F.sum(F.col("rep.n") + window).alias("bytes"))
    total = size.agg(F.sum("bytes")).first()[0] or 0
    hot = size.filter(F.col("bytes") > SHARD_BYTES).select(F.col("anchor").alias("x"), F.ceil(F.col("bytes") / SHARD_BYTES).alias("m"))
    n_shards = max(1, -(-total // SHARD_BYTES))
    rows = _segments(classes, docs, window).join(hot, F.col("anchor") == F.col("x"), "left")
    spread = F.col("m").isNotNull()
    # a spread anchor's shards are its own; the others share theirs by hash
    shard = F.when(spread, F.xxhash64("anchor")).otherwise(F.pmod(F.xxhash64("anchor", F.lit(1)), F.lit(n_shards)))
    sub = F.when(spread, F.pmod(F.col("digest"), F.col("m")) + 1).otherwise(F.lit(0))
    rows = rows.select("anchor", "digest", "copies", "segment", F.col("m").cast("long").alias("m"), shard.alias("shard"), sub.cast("long").alias("sub"))

    def sharded(table: pa.Table) -> pa.Table:
        return _by_shard(table, window)

    groups = written(rows.groupBy("shard", "sub").applyInArrow(sharded, _OUT_DDL), "suffix-shards")
    crossed = groups.filter("part is not null").select("anchor", "part", "packed").groupBy("anchor", "part").applyInArrow(_across, _MARKS_DDL)
    marks = groups.filter("part is null").select("anchor", "digest", "starts", "counts").unionByName(crossed)
    marks = marks.select(F.col("anchor").alias("x"), F.col("digest").alias("y"), "starts", "counts")
    out = found.join(marks, (F.col("anchor") == F.col("x")) & (F.col("digest") == F.col("y")))
    out = written(out.select("rid", "doc_id", F.transform("starts", lambda i: F.col("p") + i).alias("starts"), "counts"), "suffix-windows")
    clean(since, latest=1)  # but for out
    return out


def _cut(text: bytes, starts: list[int] | None, counts: list[int] | None, window: int) -> tuple[int, int, bytes]:
    """Bytes removed, runs of them, what is left."""
    gone = wn.covered_by(len(text), starts, counts, window)
    if gone is None:
        return 0, 0, text
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])) == 1)
    return int(gone.sum()), len(edge), np.frombuffer(text, np.uint8)[~gone].tobytes()


def dedup(docs: DataFrame, digest: bool = False, window: int = WINDOW) -> DataFrame:
    """For each row of docs ``doc_id, n_bytes, n_removed, n_spans, kept`` (binary: a cut may fall within a character).

    ``digest``: kept_sha256 in place of kept. A text of fewer than ``window`` bytes keeps all; a null one
    is empty. Equal rows repeat each other, rows of a null id or of one id like any. Columns besides doc_id and text
    are not read.
    """
    own = wn.keyed(docs)
    rows = wn.with_spans(own, repeated_windows(own, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, starts, counts in zip(batch.column(1).cast(pa.large_binary()), batch.column(2), batch.column(3), strict=True):
                raw = text.as_py() or b""
                a, b, kept = _cut(raw, starts.as_py(), counts.as_py(), window)
                out.append((len(raw), a, b, hashlib.sha256(kept).hexdigest() if digest else kept))
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string() if digest else pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256" if digest else "kept"])

    return rows.mapInArrow(run, f"doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, {'kept_sha256 string' if digest else 'kept binary'}")


def dedup_text(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs with the repeated bytes gone from their texts, all other columns as they were.

    Every copy goes, the first too: a string of this length that several documents have is a template, not one
    document's own text. Windows are as long as ``window`` says.

    A character that a cut leaves incomplete goes with it; null texts come back empty.
    """
    names = docs.columns
    place = names.index("text")
    # the text goes beside the row, not in it too
    columns = [(F.lit("") if i == place else F.col("`" + c.replace("`", "``") + "`")).alias(f"c{i}") for i, c in enumerate(names)]
    own = wn.keyed(docs.select(F.struct(*columns).alias("row"), "doc_id", "text"), "row")
    spans = wn.per_document(repeated_windows(own.drop("row"), window).distinct())
    rows = own.join(spans, wn.same_row("r", "d"), "left").select("row", "text", "starts", "counts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            kept = [_cut(t.as_py() or b"", a.as_py(), b.as_py(), window)[2].decode("utf-8", errors="ignore") for t, a, b in zip(texts, batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string())], ["row", "kept"])

    schema = T.StructType([rows.schema["row"], T.StructField("kept", T.StringType())])
    return rows.mapInArrow(run, schema).select(*[F.col("kept" if i == place else f"row.c{i}").alias(c) for i, c in enumerate(names)])
