"""Folds that depend on order by definition: bounded counts, quantile centroids.

Each key's events are one sequence; keys run side by side. The state that a fold holds is bounded
by its capacity, not by the number of events, which stream through in batches.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.conform import HALF_LIFE


def fold(rows: DataFrame, key: str, order: tuple[str, ...], start, step, schema: str) -> DataFrame:
    """For each row of each key, in order, what ``step(state, row)`` returns; state begins as ``start()``.

    Rows are dealt by key and sorted in their partition; a task holds one state at a time.
    """
    names = rows.columns
    out_names = [f.split()[0] for f in schema.split(", ")]

    def run(frames):
        state, last = None, object()
        for f in frames:
            out = []
            for row in f[names].itertuples(index=False):
                k = getattr(row, key)
                if k != last:
                    state, last = start(), k
                out.append(step(state, row))
            yield pd.DataFrame(out, columns=out_names)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def bounded_novelty(e: DataFrame, capacity: int = 8, half_life: int = HALF_LIFE, alpha: float = 1.0) -> DataFrame:
    """off, n_v, held, overstated and p: novelty over at most ``capacity`` values of each entity.

    When full, the value with the least decayed weight goes (of equals the smallest) and the new one
    inherits that weight, which is kept as its overstatement. The total is of all events.
    """

    def step(s, r):
        now = {v: c * 2 ** (-max(0.0, r.at - t) / half_life) for v, (c, t, _) in s["cells"].items()}
        n = s["n"] * 2 ** (-max(0.0, r.at - s["t"]) / half_life)
        k, n_v = len(now), now.get(r.v, 0.0)
        d = n + alpha * (k + 1)
        p = 1.0 if not k else alpha / d if r.v not in now else min(1.0, (sum(c + alpha for c in now.values() if c <= n_v) + alpha) / d)
        over = s["cells"][r.v][2] if r.v in now else 0.0
        if r.v not in now and k >= capacity:
            out = min(now, key=lambda v: (now[v], v))
            n_v = over = now[out]
            del s["cells"][out]
            s["evicted"] += 1
        s["cells"][r.v] = (n_v + 1, float(r.at), over)
        s["n"], s["t"] = n + 1, float(r.at)
        return int(r.off), now.get(r.v, 0.0), k, float(over), p

    return fold(e.select("ent", "at", "off", F.col("k").alias("v")).where("v is not null"), "ent", ("at", "off"), lambda: {"cells": {}, "n": 0.0, "t": 0.0, "evicted": 0}, step, "off long, n_v double, held long, overstated double, p double")


class Centroids:
    """At most ``most`` weighted means in order; past that the lightest neighbouring pair becomes one."""

    def __init__(self, most: int = 128):
        self.most, self.mean, self.weight = most, [], []

    def add(self, x: float) -> None:
        i = bisect.bisect_left(self.mean, x)
        if i < len(self.mean) and self.mean[i] == x:
            self.weight[i] += 1
            return
        self.mean.insert(i, x)
        self.weight.insert(i, 1.0)
        if len(self.mean) > self.most:
            w = np.array(self.weight)
            j = int((w[1:] + w[:-1]).argmin())
            total = self.weight[j] + self.weight[j + 1]
            self.mean[j : j + 2] = [(self.mean[j] * self.weight[j] + self.mean[j + 1] * self.weight[j + 1]) / total]
            self.weight[j : j + 2] = [total]

    def cdf(self, x: float) -> float:
        """The share below x, half of a centroid at x itself."""
        i, j = bisect.bisect_left(self.mean, x), bisect.bisect_right(self.mean, x)
        total = sum(self.weight)
        return (sum(self.weight[:i]) + sum(self.weight[i:j]) / 2) / total if total else 0.5


def marginal_numeric(e: DataFrame, least: int = 200) -> DataFrame:
    """off, f and p of a value against all earlier ones of its event type: twice the smaller side, at least 1 / (w + 1); null before ``least``."""

    def step(s, r):
        w = sum(s.weight)
        f = s.cdf(r.value) if w else 0.5
        s.add(r.value)
        return (int(r.off), f, max(1 / (w + 1), 2 * min(f, 1 - f))) if w >= least else (int(r.off), None, None)

    return fold(e.select("event_type", "at", "off", "value").where("value is not null"), "event_type", ("at", "off"), Centroids, step, "off long, f double, p double")
