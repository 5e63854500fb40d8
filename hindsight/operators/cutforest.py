"""Robust random cut forest over an ordered stream: cut trees of the latest rows, and how far a row displaces others in them.

A tree of given points has the same law in whatever order they came and went, so a stream may be cut into segments:
each begins with the ``size`` rows before it, put in without being scored. Trees and segments run side by side, and no
task holds more than one tree.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ranks import numbered


class Node:
    """A leaf (``point``) or a cut; ``n`` points lie in the box from ``low`` to ``high``."""

    __slots__ = ("cut", "dim", "high", "left", "low", "n", "parent", "point", "right")

    def __init__(self, point=None):
        self.point, self.n, self.parent, self.left, self.right = point, 1, None, None, None
        self.low, self.high = point, point


class CutTree:
    """A cut tree with insertion and deletion; equal points share a leaf."""

    def __init__(self, seed):
        self.root, self.random = None, random.Random(seed)

    def insert(self, point: tuple) -> Node:
        if self.root is None:
            self.root = Node(point)
            return self.root
        node = self.root
        while True:
            if node.point == point:
                self._climb(node, 1)
                return node
            low, high = tuple(map(min, node.low, point)), tuple(map(max, node.high, point))
            sides = [b - a for a, b in zip(low, high, strict=True)]
            at = self.random.random() * sum(sides)
            dim = 0
            while dim < len(sides) - 1 and at >= sides[dim]:
                at -= sides[dim]
                dim += 1
            cut = low[dim] + at
            left = point[dim] <= cut
            # the cut parts the point from the box: a new node stands above both
            if (left and cut < node.low[dim]) or (not left and cut >= node.high[dim]):
                leaf, above = Node(point), Node()
                above.dim, above.cut, above.low, above.high, above.n = dim, cut, node.low, node.high, node.n
                above.left, above.right = (leaf, node) if left else (node, leaf)
                self._replace(node, above)
                node.parent = leaf.parent = above
                above.n, above.low, above.high = node.n + 1, low, high
                self._climb(above.parent, 1)
                return leaf
            node = node.left if point[node.dim] <= node.cut else node.right

    def delete(self, leaf: Node) -> None:
        """Takes one point out of a leaf."""
        if leaf.n > 1:
            self._climb(leaf, -1)
        elif leaf.parent is None:
            self.root = None
        else:
            above = leaf.parent
            other = above.right if above.left is leaf else above.left
            self._replace(above, other)
            self._climb(other.parent, -1)

    def displacement(self, leaf: Node) -> float:
        """The largest ratio, over the ways up, of the points beside a subtree that holds the leaf to those in it."""
        best, node = 0.0, leaf
        while node.parent is not None:
            above = node.parent
            best = max(best, (above.n - node.n) / node.n)
            node = above
        return best

    def _replace(self, node: Node, by: Node) -> None:
        by.parent = node.parent
        if node.parent is None:
            self.root = by
        elif node.parent.left is node:
            node.parent.left = by
        else:
            node.parent.right = by

    def _climb(self, node: Node | None, more: int) -> None:
        while node is not None:
            node.n += more
            if node.point is None:
                node.low, node.high = tuple(map(min, node.left.low, node.right.low)), tuple(map(max, node.left.high, node.right.high))
            node = node.parent


def slide(rows, size: int, seed):
    """The displacement of each point of (point, scored) as it enters a tree of the latest ``size`` points; None where it is not scored."""
    tree, held = CutTree(seed), []
    for point, scored in rows:
        if len(held) == size:
            tree.delete(held.pop(0))
        leaf = tree.insert(point)
        held.append(leaf)
        yield tree.displacement(leaf) if scored else None


def robust_cut_forest(x: DataFrame, columns: list[str], scale: list[float], trees: int = 10, size: int = 64, segment: int = 2000, thinning: int = 1, seed: int = 11) -> DataFrame:
    """off and score: the mean displacement over trees when a row of the stream (at, off, columns) enters.

    Columns are divided by ``scale`` first; nulls count as 0. With ``thinning`` only every so many rows of the stream take part.
    """
    rows = x.select("at", "off", *((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) / s).alias(c) for c, s in zip(columns, scale, strict=True)))
    rows = numbered(rows, ["at", "off"], name="_n").where((F.col("_n") - 1) % thinning == 0).withColumn("_n", F.floor((F.col("_n") - 1) / thinning))
    own = F.floor(F.col("_n") / segment)
    # the last rows of a segment lead the next one in
    both = rows.select("*", F.explode(F.when(F.col("_n") % segment >= segment - size, F.array(own, own + 1)).otherwise(F.array(own))).alias("_s"), own.alias("_o"))
    dealt = both.select("*", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("_t"))
    kind = x.schema["off"].dataType.simpleString()

    def run(key, frame):
        frame = frame.sort_values("_n")
        scored = (frame["_o"] == frame["_s"]).to_numpy()
        points = zip(map(tuple, frame[columns].to_numpy().tolist()), scored, strict=True)
        found = list(slide(points, size, f"{seed}-{key[0]}-{key[1]}"))
        return pd.DataFrame({"off": frame["off"][scored], "score": [v for v, s in zip(found, scored, strict=True) if s]})

    return dealt.groupBy("_t", "_s").applyInPandas(run, f"off {kind}, score double").groupBy("off").agg(F.avg("score").alias("score"))
