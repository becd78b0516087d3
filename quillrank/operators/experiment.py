"""Lock, then test: a configuration is published with hashes of itself and of the data before the held-out part can be read."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..llm.storage import written
from . import metrics, ranking, selection
from .freeze import Changed, exists, manifest_of, opened, publish_json, read_json

LOCK = "selection_lock.json"


class TestLocked(PermissionError):
    """The held-out part was asked for before a configuration was locked."""

    __test__ = False


def configuration_digest(value: dict) -> str:
    """SHA-256 of a JSON value with sorted keys."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


class Experiment:
    """A frozen dataset at ``data`` and the folder ``place`` of one experiment over it; both may be shared by any number of drivers.

    Whatever is read is held against the manifest first. The part ``held_out`` opens only where a lock stands, whose
    data digest is the manifest's and whose configuration has the digest it was locked with. A lock is never replaced.
    """

    def __init__(self, spark: SparkSession, data: str, place: str, held_out: str = "test") -> None:
        self.spark, self.data, self.place, self.held_out = spark, data, place, held_out

    @property
    def locked(self) -> dict | None:
        at = f"{self.place}/{LOCK}"
        return read_json(self.spark, at) if exists(self.spark, at) else None

    def lock(self, configuration: dict) -> dict:
        """Publish the choice. Data that are not as frozen, and a place that has a lock, refuse it."""
        opened(self.spark, self.data)
        lock = {"configuration": configuration, "configuration_sha256": configuration_digest(configuration), "data_sha256": manifest_of(self.spark, self.data)["digest"], "held_out": self.held_out, "held_out_used_for_selection": False}
        publish_json(self.spark, f"{self.place}/{LOCK}", lock)
        return lock

    def rows(self, *parts: str) -> DataFrame:
        """The rows of some parts."""
        if self.held_out in parts:
            lock = self.locked
            if lock is None or lock["held_out"] != self.held_out:
                raise TestLocked(f"{self.held_out} opens after a configuration is locked")
            if lock["data_sha256"] != manifest_of(self.spark, self.data)["digest"]:
                raise Changed("the configuration was locked over other data")
            if lock["configuration_sha256"] != configuration_digest(lock["configuration"]):
                raise Changed("the configuration is not the one that was locked")
        return opened(self.spark, self.data, list(parts))


def train_then_test(experiment: Experiment, features: Sequence[str], signals: DataFrame, key: str = "pair_id", grid: dict | None = None, locked: dict | None = None) -> DataFrame:
    """``method, direction`` and the metrics of the held-out part: of the learned order and of those it is compared with.

    The configuration is chosen by folds of groups within train, or is ``locked`` (l2, hr_weight, grade_gap) and only fitted. Weights are
    locked before the held-out rows are read, and then taken from the lock. ``signals``: key, the features and selection_rank; they are
    computed once for either part, which are written and read many times.
    """
    train = written(experiment.rows("train").join(signals, key), "experiment-train")
    if locked is None:
        best = ranking.pick(selection.select_configuration(train, features, **(grid or {}))).first()
        chosen = {k: best[k] for k in ("l2", "hr_weight", "grade_gap")}
    elif set(locked) != {"l2", "hr_weight", "grade_gap"}:
        raise ValueError("a locked configuration is l2, hr_weight and grade_gap")
    else:
        chosen = dict(locked)
    model, _ = selection.train(train, features, chosen["l2"], chosen["hr_weight"], chosen["grade_gap"])
    experiment.lock(chosen | {"features": list(model.features), "mean": list(model.mean), "scale": list(model.scale), "weights": list(model.weights)})
    kept = experiment.locked["configuration"]
    model = ranking.LinearModel(tuple(kept["features"]), tuple(kept["mean"]), tuple(kept["scale"]), tuple(kept["weights"]))
    test = written(experiment.rows(experiment.held_out).join(signals, key), "experiment-test")
    out = [metrics.summary(part).select(F.lit(name).alias("method"), F.lit(direction).alias("direction"), "*") for name, scored in selection.baseline_scores(test, model).items() for direction, part in selection.directions(scored).items()]
    first, *rest = out
    for more in rest:
        first = first.unionByName(more)
    return first
