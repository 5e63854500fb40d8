"""Half-space trees over an ordered stream, by counts and joins.

A row's place in a tree depends on its own values and on bounds that are stated beforehand, so all rows are placed side by
side. Rows are numbered in the order of the stream; the mass of a cell is counted by window of
rows, and a row is scored by its cells' masses in the window before its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ranks import numbered

#: Halvings of a column are told by this many bits of its place between the bounds.
BITS = 8


def dimension(tree, node, columns: int):
    """The column that a node of a tree halves: a multiplicative hash of both."""
    return ((node + 1) * 2_654_435_761 + tree * 40_503 * 65_537) % 4_294_967_296 // 65_536 % columns


def places(v: np.ndarray, bounds: list[tuple[float, float]]) -> np.ndarray:
    """Each value's place between its column's bounds, in 2 ** BITS steps; what lies outside takes the nearest."""
    low, high = np.array(bounds).T
    return np.clip(np.floor((v - low) / (high - low) * (1 << BITS)), 0, (1 << BITS) - 1).astype(np.int64)


def cells(v: np.ndarray, bounds: list[tuple[float, float]], trees: int, depth: int) -> np.ndarray:
    """The leaf of each row in each tree."""
    u, columns = places(v, bounds), v.shape[1]
    rows, tree = np.arange(len(v))[:, None], np.arange(trees)[None, :]
    node, used = np.zeros((len(v), trees), np.int64), np.zeros((len(v), trees, columns), np.int64)
    for _ in range(depth):
        d = dimension(tree, node, columns)
        k = used[rows, tree, d]
        node = 2 * node + 1 + ((u[rows, d] >> np.maximum(BITS - 1 - k, 0)) & 1)
        used[rows, tree, d] = k + 1
    return node - ((1 << depth) - 1)


def half_space_trees(x: DataFrame, columns: list[str], bounds: list[tuple[float, float]], trees: int = 25, depth: int = 8, window: int = 250) -> DataFrame:
    """off, window and score of a stream (at, off, columns): the negative mass of the last full window in a row's cells, summed over trees.

    Rows of the first window score 0, as nothing came before. Nulls count as the lower bound.
    """
    if depth > BITS:
        raise ValueError("a column could be halved more often than its bits tell")
    low = {c: b[0] for c, b in zip(columns, bounds, strict=True)}
    rows = numbered(x.select("at", "off", *(F.coalesce(F.col(c).cast("double"), F.lit(low[c])).alias(c) for c in columns)), ["at", "off"], name="_n")
    rows = rows.withColumn("window", F.floor((F.col("_n") - 1) / window))
    kind = x.schema["off"].dataType.simpleString()

    def run(frames):
        for f in frames:
            found = cells(f[columns].to_numpy(float), bounds, trees, depth)
            yield pd.DataFrame({"off": np.repeat(f["off"].to_numpy(), trees), "window": np.repeat(f["window"].to_numpy(), trees), "tree": np.tile(np.arange(trees, dtype=np.int32), len(f)), "cell": found.ravel()})

    placed = rows.select("off", "window", *columns).mapInPandas(run, f"off {kind}, window long, tree int, cell long")
    mass = placed.groupBy((F.col("window") + 1).alias("window"), "tree", "cell").agg(F.count("*").alias("mass"))
    return placed.join(mass, ["window", "tree", "cell"], "left").groupBy("off", "window").agg((-F.coalesce(F.sum("mass"), F.lit(0))).cast("double").alias("score"))


def sql(source: str, columns: list[str], bounds: list[tuple[float, float]], trees: int = 25, depth: int = 8, window: int = 250) -> str:
    """CTEs after which ``hst_score`` (off, window, score) holds the same for the rows of ``source`` (off, tm, columns)."""
    n = len(columns)
    u = ", ".join(f"CAST(least({(1 << BITS) - 1}, greatest(0, floor((coalesce({c}, {a}) - {a}) / {b - a} * {1 << BITS}))) AS BIGINT) AS u{i}" for i, (c, (a, b)) in enumerate(zip(columns, bounds, strict=True)))
    steps = [f"h0 AS (SELECT *, 0::BIGINT AS node, {', '.join(f'0::BIGINT AS k{i}' for i in range(n))} FROM (SELECT off, (row_number() OVER (ORDER BY tm, off) - 1) // {window} AS w, {u} FROM {source}), range({trees}) r(tree))"]
    d = f"((node + 1) * 2654435761 + tree * 40503 * 65537) % 4294967296 // 65536 % {n}"
    for j in range(depth):
        pick = lambda name: "CASE d " + " ".join(f"WHEN {i} THEN {name}{i}" for i in range(n)) + " END"
        steps.append(
            f"h{j + 1} AS (SELECT off, w, tree, {', '.join(f'u{i}' for i in range(n))}, 2 * node + 1 + (({pick('u')} >> CAST({BITS - 1} - {pick('k')} AS BIGINT)) & 1) AS node, {', '.join(f'k{i} + CASE WHEN d = {i} THEN 1 ELSE 0 END AS k{i}' for i in range(n))} FROM (SELECT *, {d} AS d FROM h{j}))"
        )
    steps.append(f"hst_mass AS (SELECT w + 1 AS w, tree, node, count(*) AS mass FROM h{depth} GROUP BY ALL)")
    steps.append(f"hst_score AS (SELECT off, w AS window, CAST(-coalesce(sum(mass), 0) AS DOUBLE) AS score FROM h{depth} LEFT JOIN hst_mass USING (w, tree, node) GROUP BY off, w)")
    return ",\n".join(steps)
