"""Whitening of embeddings by the leading singular vectors of the centred rows.

Golub-Kahan-Lanczos bidiagonalisation: from a unit vector v the rows give u = X v, the rows and u
give the next v = X'u, each freed of what came before it (full reorthogonalisation on both sides);
the coefficients form a small bidiagonal matrix whose singular values are those of X.

X has a row for each vector and never leaves the tasks, nor does any u: as u = X w for a w of the
rows' dimension, only w is sent out, and one pass over the stored rows gives everything that a
step needs: u'u, X'u, and U'u against all earlier u. Sums are added up by Spark.

A starting vector may miss a component, one of two of the same deviation at the latest. So when the
leading values have settled, the process goes on from a fresh vector orthogonal to all v, until what that
one finds has settled too and lies below them, or until all dimensions are used up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, stored

COMPONENTS = 8
#: Residual of a singular vector over the largest singular value, at which it has settled.
SETTLED = 1e-13
#: Share of ||u|| that lies in the span of earlier u, past which u is computed once more after it is freed of it.
LOST = 1e-9
#: Deviations below this share of the largest one are rounding: such a component cannot be whitened.
LEAST_SHARE = 1e-12


def whole_numbers(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and x (array of long): floor(1024 c) + 100000 of each usable vector."""
    v = df[vector_col].cast("array<double>")
    fit = F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    rows = df.select(df[id_col].cast("long").alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & fit & (F.size("v") > 0))
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(c * 1024) + F.lit(100_000).cast("long")).alias("x"))


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The batch's x as an integer matrix; all rows have the same length."""
    x = batch.column(batch.schema.get_field_index("x"))
    return x.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def summed(rows: DataFrame, of, kind: str = "double") -> np.ndarray:
    """The sum over all batches of the vectors that ``of(matrix)`` returns; one partial sum leaves each task."""

    def make():
        total = None

        def step(batch):
            nonlocal total
            if batch is not None and batch.num_rows:
                part = of(matrix(batch))
                total = part if total is None else total + part
            if batch is None and total is not None:
                yield {"i": np.arange(len(total)), "s": total}

        return step

    found = arrow_map(rows.select("x"), make, f"i long, s {kind}").groupBy("i").agg(F.sum("s").alias("s")).toPandas().sort_values("i")
    return found["s"].to_numpy()


class Rows:
    """The centred rows: their number, mean, and the products with them."""

    def __init__(self, rows: DataFrame, n: int, sums: np.ndarray):
        self.rows, self.n, self.sums, self.mean = rows, n, sums, sums / n

    def products(self, w: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        """U'u, u'u and X'u for u = X w and U = X before."""
        both, mean = np.column_stack([before, w]), self.mean

        def of(x):
            c = x - mean
            y = c @ both
            return np.concatenate([y.T @ y[:, -1], c.T @ y[:, -1]])

        s = summed(self.rows, of)
        k = before.shape[1]
        return s[:k], s[k], s[k + 1 :]

    def trace(self) -> float:
        """The sum of all squares."""
        mean = self.mean
        return summed(self.rows, lambda x: ((x - mean) ** 2).sum(keepdims=True)[0])[0]


def leading(x: Rows, components: int = COMPONENTS, seed: int = 5, settled: float = SETTLED) -> tuple[np.ndarray, np.ndarray]:
    """The largest singular values of the centred rows and their right vectors (as columns), at most ``components``."""
    d = len(x.mean)
    rng = np.random.default_rng(seed)
    V, W, G = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))  # v, w with u = X w, X'u
    B = np.zeros((0, 0))
    begun, beta, top = 0, 0.0, 0.0

    def fresh() -> np.ndarray | None:
        v = rng.standard_normal(d)
        for _ in range(3):
            v -= V @ (V.T @ v)
            v /= np.linalg.norm(v)
        return v

    v = fresh()
    while V.shape[1] < d:
        k = V.shape[1]
        w = v - (beta * W[:, -1] if k and beta else 0.0)
        for _ in range(3):
            along, square, g = x.products(w, W)
            if k and np.linalg.norm(along) > LOST * np.sqrt(max(square, 0.0)):
                w = w - W @ along
                continue
            break
        # what is left along earlier u is rounding, freed by the products that are known already
        w, g = w - W @ along, g - G @ along
        alpha = np.sqrt(max(square - along @ along, 0.0))
        top = max(top, alpha)
        V = np.column_stack([V, v])
        grown = np.zeros((k + 1, k + 1))
        grown[:k, :k] = B
        if k:
            grown[k - 1, k] = beta
        if alpha <= 1e-14 * top:  # X v lies in the span of what is there: no further u from it
            W, G = np.column_stack([W, np.zeros(d)]), np.column_stack([G, np.zeros(d)])
            B, v, beta, begun = grown, None, 0.0, k + 1
        else:
            grown[k, k] = alpha
            W, G, B = np.column_stack([W, w / alpha]), np.column_stack([G, g / alpha]), grown
            r = G[:, -1] - alpha * V[:, -1]
            for _ in range(2):
                r -= V @ (V.T @ r)
            beta = float(np.linalg.norm(r))
            top = max(top, beta)
            v = r / beta if beta > 1e-14 * top else None
            if v is None:
                beta, begun = 0.0, k + 1
        if v is None and V.shape[1] < d:
            v = fresh()
        left, values, _ = np.linalg.svd(B)
        if len(values) <= components or V.shape[1] == d:
            continue
        if begun == V.shape[1]:  # an end was reached; the next vector is fresh, so what it finds is yet to be seen
            continue
        residual = beta * np.abs(left[-1, :])
        if (residual[:components] <= settled * values[0]).all() and beta:
            if begun:  # the run from a fresh vector: its own largest value must have settled below the leading ones
                l2, own, _ = np.linalg.svd(B[begun:, begun:])
                if len(own) >= 4 and own[0] + beta * abs(l2[-1, 0]) < values[components - 1]:
                    break
            else:
                beta, begun = 0.0, V.shape[1]
                v = fresh()
    left, values, right = np.linalg.svd(B)
    keep = min(components, int((values**2 > LEAST_SHARE * max(values[0] ** 2, 1e-300)).sum())) if len(values) else 0
    p = V @ right[:keep].T
    return values[:keep], p / np.linalg.norm(p, axis=0)


def whiten(df: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every usable row, up to ``components`` each.

    Vectors that are null, empty or hold null or non-finite entries take no part; nor do those whose
    length is not the most frequent one (of equally frequent ones the greatest). Null ids are kept, equal rows and ties
    are rows like others. Directions in which the rows do not vary (beyond ``LEAST_SHARE`` of the largest
    deviation) cannot be whitened and have no rows; so one vector alone, or an empty table, gives none.
    Other columns are not read. An entry beyond the range of a long, or squares beyond it, raise an error.
    """
    spark = df.sparkSession
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = whole_numbers(df, id_col, vector_col)
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if sizes is None:
        return spark.createDataFrame([], out)
    rows = stored(rows.where(F.size("x") == sizes["d"]), "whole-numbers")
    n = sizes["n"]
    sums = summed(rows, lambda x: x.sum(axis=0), "long").astype(np.int64)
    x = Rows(rows, n, sums)
    total = x.trace()
    if not total:
        return spark.createDataFrame([], out)
    values, vectors = leading(x, components)
    scaled, k = vectors / (values / np.sqrt(n)), len(values)  # to deviation 1
    explained, mean = values**2 / total, x.mean
    centre = summed(rows, lambda m: ((m - mean) @ scaled).sum(axis=0)) / n

    def second(m):
        z = (m - mean) @ scaled - centre
        return (z.T @ z).ravel()

    error = float(np.abs(summed(rows, second).reshape(k, k) / n - np.eye(k)).max())

    def make():
        def step(batch):
            if batch is None or not batch.num_rows:
                return
            m = matrix(batch)
            far = np.abs(n * m.astype(float) - sums)
            if (far.max() if far.size else 0) >= 2**53 or (far**2).sum(axis=1).max() >= 2**62:
                raise OverflowError("squared deviations go beyond a long")
            deviation = ((n * m - sums) ** 2).sum(axis=1)
            z = (m - mean) @ scaled
            ids = batch.column(batch.schema.get_field_index("vec_id"))
            yield {
                "vec_id": ids.take(pa.array(np.repeat(np.arange(len(m)), k))), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(m)),
                "n": np.full(len(m) * k, n), "deviation": np.repeat(deviation, k), "whitened": z.ravel(), "explained": np.tile(explained, len(m)), "identity_error": np.full(len(m) * k, error),
            }

        return step

    return arrow_map(rows, make, out)
