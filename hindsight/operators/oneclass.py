"""One-class support vector machine: landmark features of a Gaussian kernel, and averaged gradient steps over partitions.

The kernel is replaced by its features against a bounded set of landmarks (``landmarks``, a sample in the order of a hash of
the key). Training minimises |w|^2 / 2 - rho + mean(max(0, rho - w phi)) / nu over all rows. For a given w the best rho is the
nu-quantile of w phi, and the gradient is w less the mean feature of the rows below it, so a step moves w towards that
mean. In each round every partition starts from the common w and takes steps over its batches; the results are averaged by
their rows, and the driver sees one vector for each round. A row's score is rho - w phi: higher is odder.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.store import cut
from .baselines import sample


#: Rows that a partition has on average at least.
LEAST_ROWS = 4096


class Features:
    """phi with phi(x) phi(y) near exp(-gamma |x - y|^2): kernel values at the landmarks times the inverse root of theirs."""

    def __init__(self, landmarks: np.ndarray, gamma: float):
        self.at = np.unique(landmarks, axis=0)
        self.gamma = gamma
        values, vectors = np.linalg.eigh(self.kernel(self.at))
        keep = values > 1e-10 * values.max()
        self.root = vectors[:, keep] / np.sqrt(values[keep])

    def kernel(self, x: np.ndarray) -> np.ndarray:
        square = (x**2).sum(axis=1)[:, None] + (self.at**2).sum(axis=1) - 2 * x @ self.at.T
        return np.exp(-self.gamma * np.maximum(square, 0))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.kernel(x) @ self.root


def objective(w: np.ndarray, rho: float, phi: np.ndarray, nu: float) -> float:
    return float(w @ w / 2 - rho + np.maximum(0, rho - phi @ w).mean() / nu)


def steps(batches, w: np.ndarray, begun: int, least: int, nu: float) -> tuple[np.ndarray, int, int]:
    """w after a step on each batch of features and, where there are fewer than ``least``, on the held ones again; the steps and rows."""
    held, taken, rows = [], 0, 0

    def one(w, x):
        reach = x @ w
        low = np.argpartition(reach, k)[: k + 1] if (k := max(int(nu * len(x)) - 1, 0)) < len(x) - 1 else np.arange(len(x))
        return w + (x[low].mean(axis=0) - w) / (begun + taken + 2)

    for x in batches:
        w, rows = one(w, x), rows + len(x)
        taken += 1
        if len(held) < least:
            held.append(x)
    while held and taken < least:
        w = one(w, held[taken % len(held)])
        taken += 1
    return w, taken, rows


def one_class_svm(df: DataFrame, key: str, columns: list[str], scale: list[float], nu: float = 0.1, landmarks: int = 100, rounds: int = 8, batch: int = 512, least: int = 150, gamma: float | None = None) -> DataFrame:
    """key and score of every row. Columns are divided by ``scale``; nulls count as 0. A round takes at least ``least`` steps in each partition."""
    rows = cut(df.select(key, *((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) / s).alias(c) for c, s in zip(columns, scale, strict=True))))
    points = sample(rows, key, columns, landmarks)
    kind = rows.schema[key].dataType.simpleString()
    if not len(points):
        return rows.select(key, F.lit(0.0).alias("score"))
    # a mean of what few rows each have found is no solution: small partitions are put together
    rows = rows.coalesce(max(1, rows.count() // LEAST_ROWS))
    phi = Features(points, 1 / len(columns) if gamma is None else gamma)
    w, begun = phi(points).mean(axis=0), 0
    for _ in range(rounds):

        def run(frames, w=w, begun=begun):
            parts = (phi(x[a : a + batch]) for x in (f[columns].to_numpy(float) for f in frames) for a in range(0, len(x), batch))
            w, taken, n = steps(parts, w, begun, least, nu)
            if n:
                yield pd.DataFrame({"i": np.arange(len(w) + 1), "v": np.append(w, taken) * n, "n": n})

        got = rows.mapInPandas(run, "i int, v double, n long").groupBy("i").agg((F.sum("v") / F.sum("n")).alias("v")).toPandas().sort_values("i")["v"].to_numpy()
        w, begun = got[:-1], begun + int(got[-1])
    reach = rows.mapInPandas(lambda frames: (pd.DataFrame({key: f[key], "reach": phi(f[columns].to_numpy(float)) @ w}) for f in frames), f"{key} {kind}, reach double")
    rho = reach.agg(F.percentile_approx("reach", nu, 100_000)).first()[0]
    return reach.select(key, (F.lit(rho) - F.col("reach")).alias("score"))
