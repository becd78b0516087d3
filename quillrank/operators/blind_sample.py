"""A sample of judged pairs for blind review: quotas of labels, a cap for each candidate, as varied as it can be.

Pairs are taken one by one, each time the one that adds most that is new. What a pair can add only ever shrinks while
others are taken, so an old value is a bound: a heap is asked for its top, which is valued anew, until the top stands.
A greedy choice hangs on how ties fall, so every cap is tried RESTARTS times with other random ties, each a group of its own for a task,
and the most varied of the complete ones is kept. The cap is raised only where no restart is complete.

Pairs alike in all that a choice looks at differ by their ties alone, and of one label and group no more are taken than the cap and the
label's seats. So of each kind of pairs a restart needs those of the highest ties only: they are picked by ranges of places, and a restart's task
holds as many pairs as there are kinds, times the cap, however many pairs there are.
"""

from __future__ import annotations

import heapq
import random
from collections import Counter
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicon as lx
from ..llm.storage import written
from . import ordering

RESTARTS = 96
#: Places of a range, whose ties a task draws, and restarts that it draws them for.
RANGE, AT_ONCE = 1 << 20, 8
_ROW = ("pair_id", "label", "group", "cv", "vacancy", "family", "split", "risks")


def families(title: str | Column) -> Column:
    """The first of the fixed profile families whose pattern a title has."""
    low = F.lower(F.col(title) if isinstance(title, str) else title)
    found = [F.when(low.rlike(f"(?U){p}"), F.lit(name)) for name, p in lx.PROFILE_FAMILIES]
    return F.coalesce(*found, F.lit(lx.OTHER_FAMILY))


def risks(requirements: str | Column, cv_text: str | Column) -> Column:
    """What makes a pair worth a second look, from its judged requirements (array of score, category)."""
    req = F.coalesce(F.col(requirements) if isinstance(requirements, str) else requirements, F.array())
    text = F.col(cv_text) if isinstance(cv_text, str) else cv_text
    some = lambda test: F.exists(req, test)
    tags = {
        "empty-cv": F.trim(F.coalesce(text, F.lit(""))) == "",
        "mixed-known-unknown": some(lambda r: r["score"] == 0) & some(lambda r: r["score"].isin(1, 2, 3)),
        "partial-requirement": some(lambda r: r["score"] == 2),
        "role-or-experience-shortfall": some(lambda r: r["category"].isin("ROLE_LEVEL", "EXPERIENCE") & r["score"].isin(1, 2)),
    }
    return F.filter(F.array(*[F.when(F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in tags.items()]), lambda x: x.isNotNull())


def quotas(available: dict[int, int], count: int, weights: dict[int, int] = lx.REVIEW_WEIGHTS) -> dict[int, int]:
    """Seats of each label (M17): the whole part of its share, then a seat each by largest remainder, then by what is short of the share.

    No label has more seats than pairs. Where the pairs are too few for the seats it is an error.
    """
    if sum(available.get(k, 0) for k in weights) < count:
        raise ValueError("not enough pairs for the count")
    whole = sum(weights.values())
    share = {k: count * w / whole for k, w in weights.items()}
    seats = {k: min(available.get(k, 0), count * w // whole) for k, w in weights.items()}
    second: set[int] = set()
    for _ in range(count - sum(seats.values())):
        free = [k for k in weights if seats[k] < available.get(k, 0)]
        best = min(free, key=lambda k: (-1 if k in second else -(share[k] % 1) - 2, seats[k] - share[k], seats[k] - available[k], k))
        seats[best] += 1
        second.add(best)
    return seats


class _Taken:
    """What a sample has so far, and what a pair would add to it."""

    def __init__(self, seats: dict[int, int], cap: int) -> None:
        self.seats, self.cap, self.rows = seats, cap, []
        self.has = {k: Counter() for k in ("label", "group", "cv", "family", "vacancy", "split", "risks")}

    def open(self, row) -> bool:
        return self.has["label"][row.label] < self.seats.get(row.label, 0) and self.has["group"][row.group] < self.cap

    def value(self, row) -> tuple[int, ...]:
        """Higher is better; no part of it grows while pairs are taken."""
        new = [int(not self.has[k][getattr(row, k)]) for k in ("group", "cv", "family", "vacancy")]
        return (*new, sum(not self.has["risks"][r] for r in row.risks), -self.has["split"][row.split], -self.has["group"][row.group])

    def take(self, row) -> None:
        self.rows.append(row)
        for k, c in self.has.items():
            c.update(row.risks if k == "risks" else [getattr(row, k)])

    def variety(self) -> list[int]:
        held = self.has["split"]
        return [*(len(self.has[k]) for k in ("group", "cv", "family", "vacancy", "risks")), min(held["validation"], held["test"])]


def greedy(rows: Sequence, seats: dict[int, int], cap: int, ties: Sequence[float]) -> _Taken:
    """The pairs taken from ``rows``, in their order; ``ties``: a number for each row, the higher is taken first."""
    out, count = _Taken(seats, cap), sum(seats.values())
    bound = lambda i: tuple(-v for v in out.value(rows[i])) + (-ties[i], i)
    heap = [bound(i) for i in range(len(rows))]
    heapq.heapify(heap)
    while heap and len(out.rows) < count:
        old = heapq.heappop(heap)
        row = rows[old[-1]]
        if not out.open(row):
            continue  # a full label and a full group stay so
        now = bound(old[-1])
        if heap and heap[0] < now:
            heapq.heappush(heap, now)
        else:
            out.take(row)
    return out


def _draws(seed: str, first: int, count: int) -> np.ndarray:
    """``count`` of the numbers of ``random.Random(seed).random()``, from that of place ``first`` on."""
    state = random.Random(seed).getstate()[1]
    own = np.random.RandomState()
    own.set_state(("MT19937", np.array(state[:-1], dtype=np.uint32), state[-1]))
    for at in range(0, first, RANGE):
        own.random_sample(min(RANGE, first - at))
    return own.random_sample(count)


def _highest(cap: int, seed: int, restarts: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """A function of (range, block of restarts) and the range's rows (place, kind, most) to ``attempt, place, kind, most, tie`` of the highest ties of each kind."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        place, most = rows["place"].to_numpy(), rows["most"].to_numpy()
        kind = np.unique(rows["kind"].to_numpy(), return_inverse=True)[1]
        first = int(key[0]) * RANGE
        out = []
        for attempt in range(int(key[1]) * AT_ONCE, min(restarts, (int(key[1]) + 1) * AT_ONCE)):
            tie = _draws(f"{seed}:selection:{cap}:{attempt}", first, int(place.max()) - first + 1)[place - first]
            order = np.lexsort((place, -tie, kind))
            new = np.r_[True, kind[order][1:] != kind[order][:-1]]
            turn = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
            kept = order[turn < most[order]]
            out.append(pd.DataFrame({"attempt": attempt, "place": place[kept], "kind": rows["kind"].to_numpy()[kept], "most": most[kept], "tie": tie[kept]}))
        return pd.concat(out)

    return run


def _restart(seats: dict[int, int]) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """A function of an attempt's number and rows to the pairs it takes; none where it cannot fill the seats."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        ties, cap = rows["tie"].tolist(), int(rows["cap"].iloc[0])
        rows = list(rows[list(_ROW)].itertuples(index=False))
        got = greedy(rows, seats, cap, ties)
        whole = got.rows if len(got.rows) == sum(seats.values()) else []
        variety = got.variety()
        return pd.DataFrame([(key[0], i, r.pair_id, r.label, r.group, variety) for i, r in enumerate(whole)], columns=["attempt", "place", "pair_id", "label", "group", "variety"])

    return run


def blind_sample(pairs: DataFrame, count: int = 50, seed: int = 42, restarts: int = RESTARTS, weights: dict[int, int] = lx.REVIEW_WEIGHTS) -> DataFrame:
    """``place, pair_id, label, group, cap, quota``: the chosen pairs in the order they were taken.

    ``pairs``: pair_id (unique), label (int), group, cv, vacancy, family, split (strings), risks (array of strings). Null values are
    values like others, null risks are none. Reruns choose the same pairs, however the rows lie. Too few pairs for the quotas and a repeated pair_id
    are errors, and so is a count below 1.
    """
    own = pairs.select(*[F.col(c) for c in _ROW[:-1]], F.coalesce("risks", F.array().cast("array<string>")).alias("risks"))
    own = written(own, "sample-pairs")
    seen = own.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("pair_id").alias("ids"), F.count_distinct(F.coalesce(F.col("group").cast("string"), F.lit("\0"))).alias("groups")).first()
    if not 1 <= count <= seen.n:
        raise ValueError(f"a sample of {count} from {seen.n} pairs")
    if seen.ids < seen.n:
        raise ValueError("a pair_id is null or there twice")
    available = {r.label: r["n"] for r in own.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    seats = quotas(available, count, weights)
    # a label whose groups, each up to the cap, have fewer pairs than its seats rules a cap out
    held = own.groupBy("label", "group").agg(F.count(F.lit(1)).alias("n")).groupBy("label", "n").agg(F.count(F.lit(1)).alias("groups")).collect()
    most = lambda cap: Counter({k: sum(min(r.n, cap) * r.groups for r in held if r.label == k) for k in seats})
    schema = "attempt int, place int, pair_id string, label int, group string, variety array<int>"
    named = own.withColumn("pair_id", F.col("pair_id").cast("string"))
    # a CV of several pairs is part of their kind; one that a single pair has is new whenever it is taken
    again = own.groupBy(F.col("cv").alias("cv2")).agg(F.count(F.lit(1)).alias("pairs")).filter("pairs > 1").select("cv2", F.col("cv2").alias("shared"), F.lit(True).alias("again"))
    kind = F.xxhash64(F.to_json(F.struct("label", "group", "vacancy", "family", "split", "risks", "again", "shared"), {"ignoreNullFields": "false"}))
    named = ordering.numbered(named, [("pair_id", False)], "at").withColumn("at", F.col("at") - 1)
    named = named.join(again, F.col("cv").eqNullSafe(F.col("cv2")), "left").withColumn("kind", kind).drop("cv2", "shared", "again")
    named = written(named.filter(F.col("label").isin([k for k, n in seats.items() if n])), "sample-places")
    blocks = F.explode(F.sequence(F.lit(0), F.lit((restarts - 1) // AT_ONCE)))
    limit = F.element_at(F.create_map(*[F.lit(v) for k, n in seats.items() for v in (k, n)]), F.col("label"))
    for cap in range(max(2, -(-count // max(1, seen.groups))), max(2, count) + 1):
        if any(most(cap)[k] < n for k, n in seats.items()):
            continue
        drawn = named.select(F.floor(F.col("at") / RANGE).alias("range"), blocks.alias("block"), F.col("at").alias("place"), "kind", F.least(limit, F.lit(cap)).alias("most"))
        high = drawn.groupBy("range", "block").applyInPandas(_highest(cap, seed, restarts), "attempt int, place long, kind long, most int, tie double")
        turn = F.row_number().over(Window.partitionBy("attempt", "kind").orderBy(F.desc("tie"), "place"))
        high = high.withColumn("turn", turn).filter("turn <= most").select("attempt", "place", "tie", F.lit(cap).alias("cap"))
        tries = high.join(named, F.col("place") == F.col("at")).select("attempt", "tie", "cap", "at", *_ROW)
        found = tries.groupBy("attempt").applyInPandas(_restart(seats), schema).withColumn("last", -F.col("attempt"))
        best = F.max(F.struct("variety", "last")).over(Window.partitionBy())  # over count rows of each restart
        rows = found.withColumn("best", best).filter("last = best.last").select("place", "pair_id", "label", "group").collect()  # count rows, or none
        if rows:
            own_rows = [(r.place, r.pair_id, r.label, r.group, cap, seats[r.label]) for r in sorted(rows)]
            return pairs.sparkSession.createDataFrame(own_rows, "place int, pair_id string, label int, `group` string, cap int, quota int")
    raise ValueError("no cap fills the quotas")
