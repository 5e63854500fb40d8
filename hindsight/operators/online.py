"""LORD++ over an ordered stream, block by block, each block by parallel passes.

A test's level depends on the rejections before it, and grows with each of them. Within a block the levels under the
rejections that are known so far are therefore lower bounds: what they reject is rejected. New rejections raise the
levels behind them; when a pass finds none, the levels are those of the sequence. A chain of rejections that each need
the one before takes as many passes as it is long; most blocks take a few. What goes from block to block, and what a pass
sends to its tasks, is the rejections as runs of neighbouring tests: those of the block, of which it has ``block`` at most, and
the latest ``RUNS`` before it. Older runs spend no more, which keeps control and only lowers levels.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ranks import numbered
from ..plans.store import cut

RUNS = 512
BLOCK = 1_000_000
_TABLE = 100_000


def _raw(j: np.ndarray) -> np.ndarray:
    x = np.maximum(j, 1).astype(float)
    return np.where(j < 1, 0.0, 1 / (x * np.log(np.maximum(x, 2)) ** 2))


class Spending:
    """gamma_j in proportion to 1 / (j ln^2 max(j, 2)), summing to one, and its running sums: from a table, then by their expansion."""

    def __init__(self, table: int = _TABLE):
        raw = _raw(np.arange(table + 1))
        self.last = table
        self.sums = np.cumsum(raw)
        # the rest beyond the table: integral, half of the term at the end, and its slope
        self.scale = 1 / (self.sums[-1] + self._rest(np.array([np.inf]))[0])

    def _rest(self, k: np.ndarray) -> np.ndarray:
        """The sum of the terms after the table up to k."""
        m = float(self.last)
        with np.errstate(divide="ignore", invalid="ignore"):
            integral = 1 / math.log(m) - np.where(np.isinf(k), 0.0, 1 / np.log(k))
            f = lambda x: np.where(np.isinf(x), 0.0, 1 / (x * np.log(x) ** 2))
            slope = lambda x: np.where(np.isinf(x), 0.0, -(np.log(x) + 2) / (x * x * np.log(x) ** 3))
            end = np.array([m])
            return integral + (f(k) - f(end)) / 2 + (slope(k) - slope(end)) / 12

    def at(self, j: np.ndarray) -> np.ndarray:
        return self.scale * _raw(j)

    def upto(self, k: np.ndarray) -> np.ndarray:
        """gamma_1 + ... + gamma_k."""
        near = self.sums[np.clip(k, 0, self.last)]
        return self.scale * np.where(k <= self.last, near, self.sums[-1] + self._rest(np.maximum(k, self.last + 1).astype(float)))


def levels(i: np.ndarray, first: int, runs: np.ndarray, spending: Spending, wealth: float, q: float) -> np.ndarray:
    """The level of each test number, given the first rejection (0: none) and the runs (from, to) of all that count; what comes after a test says nothing about it."""
    out = spending.at(i) * wealth
    if first:
        out = out + (q - wealth) * spending.at(i - first)
    for a, b in runs:
        low, high = np.maximum(i - b, 1), i - a
        if a == b:
            part = spending.at(high)
        else:
            part = np.where(high >= low, spending.upto(np.maximum(high, 0)) - spending.upto(low - 1), 0.0)
        out = out + q * part
    return out


def as_runs(rejected: list[int]) -> np.ndarray:
    """Sorted numbers as (from, to) of neighbours."""
    x = np.array(rejected, dtype=np.int64)
    if not len(x):
        return np.zeros((0, 2), np.int64)
    cut_at = np.flatnonzero(np.diff(x) > 1) + 1
    return np.stack([x[np.append(0, cut_at)], x[np.append(cut_at - 1, len(x) - 1)]], axis=1)


def _known(before: np.ndarray, first: int, block_rejected: list[int], most: int) -> tuple[int, np.ndarray]:
    """The first rejection and the runs behind it that count in the block. The first one has its own share, so it leaves its run."""
    runs = np.concatenate([before, as_runs([r for r in block_rejected if r != first])])
    return first, runs


def lord(t: DataFrame, p: str = "p", q: float = 0.1, wealth: float | None = None, block: int = BLOCK, most_runs: int = RUNS) -> DataFrame:
    """at, off, test, p, level and rejected of the stream ``t`` (at, off, p) in its order, under LORD++ with the first rejection earning q - wealth."""
    wealth = q / 20 if wealth is None else wealth
    spending = Spending()
    x = numbered(t.select("at", "off", F.col(p).alias("p")), ["at", "off"], name="test").withColumn("block", F.floor((F.col("test") - 1) / block))
    x = cut(x)
    blocks = (x.agg(F.max("block")).first()[0] or 0) + 1
    first, before, results = 0, np.zeros((0, 2), np.int64), None
    for b in range(int(blocks)):
        # no level is above q: gamma sums to one
        open_tests = x.where((F.col("block") == b) & (F.col("p") <= q)).select("test", "p")
        found: list[int] = []
        while True:
            start, runs = _known(before, first or (found[0] if found else 0), found, most_runs)

            def more(frames, start=start, runs=runs, have=frozenset(found)):
                for f in frames:
                    i = f["test"].to_numpy()
                    hit = f["p"].to_numpy() <= levels(i, start, runs, spending, wealth, q)
                    yield pd.DataFrame({"test": i[hit]})

            now = sorted(r["test"] for r in open_tests.mapInPandas(more, "test long").collect())  # rejections of one block
            if now == found:
                break
            found = now
        first = first or (found[0] if found else 0)
        start, runs = _known(before, first, found, most_runs)

        def judged(frames, start=start, runs=runs):
            for f in frames:
                level = levels(f["test"].to_numpy(), start, runs, spending, wealth, q)
                yield f.assign(level=level, rejected=f["p"].to_numpy() <= level)

        part = x.where(F.col("block") == b).drop("block").mapInPandas(judged, f"at long, off {x.schema['off'].dataType.simpleString()}, p double, test long, level double, rejected boolean")
        results = part if results is None else results.unionAll(part)
        before = runs[-most_runs:]
    return results
