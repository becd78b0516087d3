"""Quality classifier from weak labels.

Heuristic labellers vote bad, good or nothing on each document. How often each pattern of votes
occurs is counted over all documents; from these counts alone expectation-maximisation estimates
the share of bad documents and each labeller's accuracy, with no hand label. The posterior of its
votes is then a document's label, and such labels train a linear scorer over hashed features: byte
trigrams of the whole text and the binned statistics.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import stats as st
from . import text as tx
from .storage import bounded_batches

#: name: (bad if, good if) over the counts; neither: no vote.
LABELLERS = {
    "symbols": ("n_symbols > 0.2 * n_words", "n_symbols < 0.05 * n_words"),
    "capitals": ("n_upper > 0.4 * word_chars", "n_upper < 0.2 * word_chars"),
    "repeats": ("n_repeat_words > 0.5 * n_words", "n_repeat_words < 0.3 * n_words"),
    "lines": ("n_dup_lines > 0.5 * n_lines", "n_dup_lines <= 0.1 * n_lines"),
    "function words": ("n_words >= 20 and n_common < 0.02 * n_words", "n_common > 0.08 * n_words"),
    "length": ("n_words < 2", "n_words >= 20"),
    "word length": ("n_words >= 20 and (word_chars > 12 * n_words or word_chars < 2 * n_words)", "word_chars between 3 * n_words and 9 * n_words"),
    "marks": ("n_marks > 0.3 * n_words", "n_marks < 0.1 * n_words"),
}
MAX_FIT_ROWS = 3_000
DIM = 4096
_RATIOS = (("n_symbols", "n_words"), ("n_upper", "word_chars"), ("n_repeat_words", "n_words"), ("n_dup_lines", "n_lines"), ("n_common", "n_words"), ("word_chars", "n_words"), ("n_marks", "n_words"))
_EDGES = np.array([0.0, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.6, 1.0, 2.0, 4.0, 6.0, 9.0, 12.0])


#: Which kind of bad document a labeller speaks of: style, repetition or language.
KINDS = {"symbols": 0, "capitals": 0, "marks": 0, "repeats": 1, "lines": 1, "function words": 2, "length": 2, "word length": 2}
GOOD = 3
MOST_WRONG = 0.01


@dataclass(frozen=True)
class LabelModel:
    """votes[j, y, v]: how likely a vote of labeller j is v (0 bad, 1 good) on a document of class y: a kind of bad ones, or GOOD.

    No vote (2) says nothing: its likelihood is 1 for every class.
    """

    prior: np.ndarray
    votes: np.ndarray

    def classes(self, patterns: np.ndarray) -> np.ndarray:
        """The probability of each class for each row of votes."""
        logs = np.log(self.prior) + sum(np.log(self.votes[j][:, patterns[:, j]]).T for j in range(patterns.shape[1]))
        p = np.exp(logs - logs.max(axis=1, keepdims=True)) if len(logs) else np.zeros((0, GOOD + 1))
        return p / p.sum(axis=1, keepdims=True)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """The probability of good for each row of votes."""
        return self.classes(patterns)[:, GOOD]

    def accuracies(self) -> dict[str, float]:
        """For each labeller, how often a vote of its is right, over documents as they come."""
        hit = (self.votes[:, :GOOD, 0] * self.prior[:GOOD]).sum(axis=1) + self.votes[:, GOOD, 1] * self.prior[GOOD]
        return dict(zip(LABELLERS, hit.tolist(), strict=True))


def estimate(patterns: np.ndarray, n: np.ndarray, rounds: int = 300) -> LabelModel:
    """Expectation-maximisation over vote patterns and their counts.

    Bad documents are of several kinds, and one kind may be seen by few labellers; as one class, the rarer kind would end
    as a vote that good documents sometimes get. So each kind is a class, and a pattern begins in the kinds its bad votes
    speak of, or as good where it has none. Labellers are made to accuse few good documents: no more than MOST_WRONG of them
    in any step. One document is added to each count, so no probability is zero.
    """
    width = patterns.shape[1]
    kind = np.array([KINDS[k] for k in LABELLERS])
    p = np.full((len(patterns), GOOD + 1), 0.01)
    for y in range(GOOD):
        p[:, y] += 0.97 * (patterns[:, kind == y] == 0).any(axis=1)
    p[~(patterns == 0).any(axis=1), GOOD] += 0.97
    p = p / p.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        weight = p * n[:, None]
        votes = np.ones((width, GOOD + 1, 3))
        for j in range(width):
            for v in range(2):
                votes[j, :, v] += weight[patterns[:, j] == v].sum(axis=0)
        votes[:, :, :2] /= votes[:, :, :2].sum(axis=2, keepdims=True)
        votes[:, GOOD, 0] = np.minimum(votes[:, GOOD, 0], MOST_WRONG)
        votes[:, GOOD, 1] = 1 - votes[:, GOOD, 0]
        votes[:, :, 2] = 1
        total = weight.sum(axis=0) + 1
        model = LabelModel(total / total.sum(), votes)
        new = model.classes(patterns)
        if len(p) == 0 or np.abs(new - p).max() < 1e-9:
            break
        p = new
    return model


def vote_columns() -> list:
    return [F.when(F.expr(b), 0).when(F.expr(g), 1).otherwise(2).alias(f"v{j}") for j, (b, g) in enumerate(LABELLERS.values())]


def hashed(buf: np.ndarray, offsets: np.ndarray, counts: dict[str, np.ndarray]) -> np.ndarray:
    """A row of DIM features for each text: square roots of trigram shares, and one-hot bins of ratios."""
    n = len(offsets) - 1
    out = np.zeros((n, DIM), dtype=np.float32)
    if len(buf) >= 3:
        slot = (tx.rolled(tx.BYTE[buf], 3) >> tx.U(52)).astype(np.int64)
        doc = np.repeat(np.arange(n), np.diff(offsets))
        same = doc[:-2] == doc[2:]
        for a, b in tx.chunks(offsets, 1 << 20):  # rows of counts for a few texts at a time
            lo, hi = offsets[a], min(offsets[b], len(slot))
            on = same[lo:hi]
            out[a:b] = np.bincount((doc[lo:hi][on] - a) * DIM + slot[lo:hi][on], minlength=(b - a) * DIM).reshape(b - a, DIM)
        out = np.sqrt(out / np.maximum(out.sum(axis=1, keepdims=True), 1))
    for k, (over, under) in enumerate(_RATIOS):
        bin_ = np.searchsorted(_EDGES, counts[over] / np.maximum(counts[under], 1), side="right")
        slot = (tx.mixed(((bin_ + 1) * 64 + k).astype(tx.U)) >> tx.U(52)).astype(np.int64)
        out[np.arange(n), slot] += 1.0
    return out


@dataclass(frozen=True)
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -40, 40)))


def train(x: np.ndarray, p: np.ndarray, l2: float = 1e-4, rounds: int = 300) -> Scorer:
    """Logistic regression on soft labels, both classes weighing the same, by accelerated gradient steps."""
    if not len(p):
        return Scorer(np.zeros(DIM, np.float32), 4.0)
    share = min(max(float(p.mean()), 0.02), 0.98)
    w8 = p / (2 * share) + (1 - p) / (2 * (1 - share))
    w8 = w8 / w8.mean()
    w, b = np.zeros(x.shape[1], np.float32), float(np.log(share / (1 - share)))
    vw, vb, step = w.copy(), b, 4.0 / max(1.0, float(np.concatenate([(x[i : i + 256] ** 2).sum(axis=1) for i in range(0, len(x), 256)]).mean()) + 1)
    for i in range(rounds):
        err = (1 / (1 + np.exp(-(x @ vw + vb))) - p) * w8 / len(p)
        nw, nb = vw - step * (x.T @ err.astype(np.float32) + l2 * vw), vb - step * float(err.sum())
        vw, vb = nw + i / (i + 3) * (nw - w), nb + i / (i + 3) * (nb - b)
        w, b = nw.astype(np.float32), nb
    return Scorer(w, b)


def _features(batch: pa.RecordBatch, common: np.ndarray) -> Iterator[tuple[int, int, dict[str, np.ndarray], np.ndarray]]:
    buf, offsets = tx.flat(batch.column(1))
    for a, b in tx.chunks(offsets):
        part, at = buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        c = st.counts(part, at, common)
        for lo in range(0, b - a, 512):  # a chunk of very short texts is many rows
            hi = min(lo + 512, b - a)
            own = {k: v[lo:hi] for k, v in c.items()}
            yield a + lo, a + hi, own, hashed(part[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], own)


@dataclass(frozen=True)
class QualityModel:
    labels: LabelModel
    scorer: Scorer

    def apply(self, docs: DataFrame) -> DataFrame:
        """``doc_id, n_words, score, kept`` for each row of docs."""
        return self._scored(docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text"))

    def keep(self, docs: DataFrame) -> DataFrame:
        """The rows of docs that are kept, with all their columns as they were."""
        names = docs.columns
        columns = [F.col("`" + c.replace("`", "``") + "`").alias(f"c{i}") for i, c in enumerate(names)]
        rows = docs.select(F.struct(*columns).alias("row"), F.col("text").cast("string").alias("text"))
        return self._scored(rows).filter("kept").select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)])

    def _scored(self, rows: DataFrame) -> DataFrame:
        scorer = self.scorer

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            common = st.common_hashes()
            for batch in batches:
                scores, n_words = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
                for a, b, c, x in _features(batch, common):
                    scores[a:b], n_words[a:b] = np.round(scorer.score(x), 6), c["n_words"]
                kept = (scores >= 0.5) & (n_words > 0)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(scores), pa.array(kept)], [batch.schema.names[0], "n_words", "score", "kept"])

        schema = T.StructType([rows.schema[0], T.StructField("n_words", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())])
        return bounded_batches(rows).mapInArrow(run, schema)


def fit(docs: DataFrame, most: int = MAX_FIT_ROWS) -> QualityModel:
    """Label model over all documents, scorer on at most ``most`` of them (the least hashes of their ids).

    There are at most 3 ** 8 patterns of votes, whatever the corpus, so their counts fit the driver;
    the sample is sent there as rows of DIM hashed features, never as texts.
    """
    found = st.text_stats(docs).select(*vote_columns()).groupBy(*[f"v{j}" for j in range(len(LABELLERS))]).count().toPandas()
    labels = estimate(found.iloc[:, :-1].to_numpy(dtype=np.int64).reshape(-1, len(LABELLERS)), found["count"].to_numpy(dtype=float))

    ids = docs.select(F.col("doc_id").cast("long").alias("id")).dropna().distinct().orderBy(F.xxhash64("id"), "id").limit(most)
    sample = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").join(F.broadcast(ids), F.col("doc_id") == F.col("id")).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = st.common_hashes()
        for batch in batches:
            for _, _, c, x in _features(batch, common):
                cols = [pa.array(np.asarray(c[k], np.int64)) for k in st.COUNTS]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())], [*st.COUNTS, "x"])

    rows = sample.mapInArrow(run, ", ".join(f"{c} bigint" for c in st.COUNTS) + ", x binary").select(*vote_columns(), "x").orderBy(F.xxhash64("x")).limit(2 * most).toArrow()
    votes = np.stack([rows[f"v{j}"].to_numpy() for j in range(len(LABELLERS))], axis=1).astype(np.int64) if rows.num_rows else np.zeros((0, len(LABELLERS)), np.int64)
    x, at = np.zeros((rows.num_rows, DIM), np.float32), 0
    for batch in rows.select(["x"]).to_batches():  # no second copy of all rows on the driver
        for value in batch.column(0):
            x[at] = np.frombuffer(value.as_buffer(), dtype=np.float16)
            at += 1
    del rows
    return QualityModel(labels, train(x, labels.posterior(votes)))
