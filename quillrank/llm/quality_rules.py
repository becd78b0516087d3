"""Quality rules: an ordered decision list learned by sequential covering.

Each rule is a conjunction of thresholds on statistics of a text. It is grown on two thirds of the
labelled sample, a condition at a time by information gain, then pruned from its end on the other
third; what it covers is set aside and the next rule is grown. A rule is kept only if it is right
often enough on the rows it was not grown on, so clean texts stay. The list becomes one ordered
Spark conditional expression, evaluated without Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import labelled_sample
from .stats import text_stats

MAX_FIT_ROWS = 20_000
MAX_RULES, MAX_CONDITIONS, THRESHOLDS = 12, 4, 32
LEAST_PRECISION, LEAST_COVER = 0.9, 5

#: Statistics that rules may speak of, as Spark expressions over the counts.
FEATURES = {
    "n_words": "cast(n_words as double)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "common_share": "n_common / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self) -> Column:
        at = F.expr(FEATURES[self.feature])
        return at >= F.lit(self.threshold) if self.above else at <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def holds(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    return np.logical_and.reduce([c.holds(x) for c in rule])


def _log_share(p: np.ndarray | float, n: np.ndarray | float):
    return np.log2((p + 1e-9) / (p + n + 1e-9))


def _best(x: dict[str, np.ndarray], y: np.ndarray, inside: np.ndarray) -> tuple[float, Condition | None]:
    """The condition of the largest gain p * (log share after - log share before) on the rows inside."""
    p0, n0 = float((y & inside).sum()), float((~y & inside).sum())
    base, top = _log_share(p0, n0), (0.0, None)
    for name, values in x.items():
        v, bad = values[inside], y[inside]
        cuts = np.unique(np.quantile(v[bad], np.linspace(0, 1, THRESHOLDS)))
        order = np.argsort(v, kind="stable")
        v, total = v[order], np.concatenate([[0], np.cumsum(bad[order])]).astype(float)
        for above in (True, False):
            k = np.searchsorted(v, cuts, side="left" if above else "right")
            p = total[-1] - total[k] if above else total[k]
            n = (len(v) - k if above else k) - p
            gain = np.where(p >= LEAST_COVER, p * (_log_share(p, n) - base), 0.0)
            if gain[i := int(np.argmax(gain))] > top[0] + 1e-9:
                top = (float(gain[i]), Condition(name, above, float(cuts[i])))
    return top


def grow(x: dict[str, np.ndarray], y: np.ndarray) -> Rule:
    rule: list[Condition] = []
    inside = np.ones(len(y), dtype=bool)
    while len(rule) < MAX_CONDITIONS and (y & inside).any() and (~y & inside).any():
        _, found = _best(x, y, inside)
        if found is None:
            break
        rule.append(found)
        inside &= found.holds(x)
    return tuple(rule)


def prune(rule: Rule, x: dict[str, np.ndarray], y: np.ndarray) -> tuple[Rule, int, int]:
    """The beginning of the rule with the best (p - n) / (p + n), shorter on ties; its p and n."""
    best = (-2.0, rule, 0, 0)
    for k in range(1, len(rule) + 1):
        on = holds(rule[:k], x)
        p, n = int((y & on).sum()), int((~y & on).sum())
        if (value := (p - n) / max(1, p + n)) > best[0] + 1e-9:
            best = (value, rule[:k], p, n)
    return best[1:]


def learn(x: dict[str, np.ndarray], bad: np.ndarray) -> list[Rule]:
    """The decision list for the rows that ``bad`` marks; without both kinds of rows, none."""
    to_prune = np.arange(len(bad)) % 3 == 2
    rules: list[Rule] = []
    left = np.ones(len(bad), dtype=bool)
    while len(rules) < MAX_RULES:
        on = left & ~to_prune
        if (bad & on).sum() < LEAST_COVER:
            break
        if not (rule := grow({k: v[on] for k, v in x.items()}, bad[on])):
            break
        held = left & to_prune
        rule, p, n = prune(rule, {k: v[held] for k, v in x.items()}, bad[held])
        covered = holds(rule, x) & left
        if p + n == 0:
            p, n = int((bad & covered).sum()), int((~bad & covered).sum())
        if p < LEAST_PRECISION * (p + n) or not (bad & covered).any():
            break
        rules.append(rule)
        left &= ~covered
    return rules


def expression(rules: list[Rule], covered: Column, otherwise: Column) -> Column:
    """The list as one ordered conditional."""
    out = None
    for rule in rules:
        on = rule[0].column()
        for c in rule[1:]:
            on = on & c.column()
        out = F.when(on, covered) if out is None else out.when(on, covered)
    return otherwise if out is None else out.otherwise(otherwise)


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_FIT_ROWS) -> list[Rule]:
    """Learn from ``labels.quality`` (0: bad) on at most ``most`` labelled documents."""
    sample = labelled_sample(docs, labels, "quality", most)
    ids = sample.select("doc_id", "label").distinct()
    stats = text_stats(sample).select("doc_id", *[F.expr(e).alias(k) for k, e in FEATURES.items()])
    got = stats.join(F.broadcast(ids), "doc_id").orderBy(F.xxhash64("doc_id"), *FEATURES).toPandas()
    if not len(got):
        return []
    return learn({k: got[k].to_numpy(dtype=float) for k in FEATURES}, got["label"].to_numpy() == 0)


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """A row per document: its counts, ``base_failed``, ``rule`` (which one rejects, from 1; null: none), ``kept``.

    base_failed: fewer than 10 words, or over 20 % of the words in 5-word windows that occur twice.
    A null or empty text has no words and fails. Equal rows and null ids give a row each.
    """
    s = text_stats(docs)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    number = expression([], F.lit(0), F.lit(None).cast("int")) if not rules else None
    if number is None:
        number = F.lit(None).cast("int")
        for i in range(len(rules), 0, -1):
            number = expression([rules[i - 1]], F.lit(i), number)
    out = s.withColumn("base_failed", base).withColumn("rule", number)
    return out.withColumn("kept", ~F.col("base_failed") & expression(rules, F.lit(False), F.lit(True)))
