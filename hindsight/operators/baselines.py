"""Baseline scores: forests of random splits, local outlier factor, principal components, entity averages.

Models are fitted on a bounded sample (a documented parameter) and sent to the tasks, which score
every row in vectorised batches.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FIT_ROWS = 4096


def sample(df: DataFrame, key: str, columns: list[str], rows: int = FIT_ROWS) -> np.ndarray:
    """A fixed sample in the order of a hash of the key: a top-k, not a sort of all."""
    got = df.select(key, *columns).orderBy(F.xxhash64(key), key).limit(rows).collect()
    return np.array([[float(v) for v in r[1:]] for r in sorted(got, key=lambda r: r[0])])


def path_length(n: float) -> float:
    """Mean depth of an unsuccessful search among n."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grow(x: np.ndarray, rng: np.random.Generator, limit: int, extended: bool):
    """A tree of random cuts: (normal, offset, left, right), or a leaf's size. A plain cut looks at one column."""
    if limit == 0 or len(x) <= 1 or (x.min(0) == x.max(0)).all():
        return len(x)
    if extended:
        normal = rng.standard_normal(x.shape[1])
        point = rng.uniform(x.min(0), x.max(0))
    else:
        wide = np.flatnonzero(x.max(0) > x.min(0))
        normal = np.zeros(x.shape[1])
        normal[rng.choice(wide)] = 1.0
        point = rng.uniform(x.min(0), x.max(0))
    side = (x - point) @ normal <= 0
    return normal, point @ normal, grow(x[side], rng, limit - 1, extended), grow(x[~side], rng, limit - 1, extended)


def depths(tree, x: np.ndarray, depth: int = 0) -> np.ndarray:
    if isinstance(tree, int):
        return np.full(len(x), depth + path_length(tree))
    normal, offset, left, right = tree
    side = x @ normal <= offset
    out = np.empty(len(x))
    out[side], out[~side] = depths(left, x[side], depth + 1), depths(right, x[~side], depth + 1)
    return out


def forest(df: DataFrame, key: str, columns: list[str], trees: int = 50, size: int = 256, extended: bool = False, seed: int = 1) -> DataFrame:
    """key and score in (0, 1): 2 ** (-mean depth / expected depth)."""
    x = sample(df, key, columns)
    rng = np.random.default_rng(seed)
    grown = [grow(x[rng.choice(len(x), min(size, len(x)), replace=False)], rng, math.ceil(math.log2(max(2, size))), extended) for _ in range(trees)]
    norm = path_length(min(size, len(x)))
    return _scored(df, key, columns, lambda v: 2 ** (-sum(depths(t, v) for t in grown) / trees / norm))


def local_outlier_factor(df: DataFrame, key: str, columns: list[str], k: int = 20, rows: int = 2000) -> DataFrame:
    """Density around a row's k nearest rows of the fit sample over its own."""
    x = sample(df, key, columns, rows)
    mean, sd = x.mean(0), x.std(0) + 1e-12
    x = (x - mean) / sd
    d = np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (x * x).sum(1) - 2 * x @ x.T))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1)[:, :k]
    reach = np.take_along_axis(d, near, 1)[:, -1]
    density = 1 / (np.maximum(np.take_along_axis(d, near, 1), reach[near]).mean(1) + 1e-12)

    def score(v):
        v = (v - mean) / sd
        e = np.sqrt(np.maximum(0, (v * v).sum(1)[:, None] + (x * x).sum(1) - 2 * v @ x.T))
        i = np.argpartition(e, k, axis=1)[:, :k]
        own = 1 / (np.maximum(np.take_along_axis(e, i, 1), reach[i]).mean(1) + 1e-12)
        return density[i].mean(1) / own

    return _scored(df, key, columns, score)


def principal_error(df: DataFrame, key: str, columns: list[str], components: int = 2) -> DataFrame:
    """Squared distance to the plane of the leading components; means and covariances are one aggregate over all rows."""
    aggs = [F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)] + [F.covar_samp(a, b).alias(f"c{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns)]
    r = df.agg(*aggs).first()
    mean = np.array([r[f"m{i}"] for i in range(len(columns))])
    cov = np.array([[r[f"c{i}_{j}"] for j in range(len(columns))] for i in range(len(columns))])
    sd = np.sqrt(np.diag(cov)) + 1e-12
    _, vectors = np.linalg.eigh(cov / np.outer(sd, sd))
    top = vectors[:, ::-1][:, :components]

    def score(v):
        z = (v - mean) / sd
        return ((z - z @ top @ top.T) ** 2).sum(1)

    return _scored(df, key, columns, score)


def _scored(df: DataFrame, key: str, columns: list[str], f) -> DataFrame:
    def run(frames):
        for x in frames:
            yield pd.DataFrame({key: x[key], "score": f(x[columns].to_numpy(float))})

    return df.select(key, *columns).mapInPandas(run, f"{key} long, score double")


def entity_ewma(df: DataFrame, half_life: float = 20.0) -> DataFrame:
    """off and z: value against the entity's own earlier exponentially weighted mean and deviation, by events; 0 while cold."""
    w = Window.partitionBy("ent").orderBy("at", "off")
    n = F.row_number().over(w)
    x = df.select("ent", "at", "off", "value", n.alias("n")).withColumn("g", F.pow(F.lit(2.0), F.col("n") / half_life))
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    s, m, q = F.sum("g").over(past), F.sum(F.col("g") * F.col("value")).over(past), F.sum(F.col("g") * F.col("value") * F.col("value")).over(past)
    x = x.select("off", "value", "n", (m / s).alias("mean"), (q / s - F.pow(m / s, F.lit(2))).alias("var"))
    return x.select("off", F.when((F.col("n") > 2) & (F.col("var") > 1e-12), (F.col("value") - F.col("mean")) / F.sqrt("var")).otherwise(0.0).alias("z"))
