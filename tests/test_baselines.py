"""Cut trees against their definition, the one-class machine against a direct solve."""

import random

import numpy as np
import pytest

from hindsight.operators import cutforest as R
from hindsight.operators import oneclass as O


def leaves(node):
    return [node] if node.point is not None else leaves(node.left) + leaves(node.right)


def points(node):
    return [p for leaf in leaves(node) for p in [leaf.point] * leaf.n]


def check(node):
    """Counts, boxes and cuts of every node are those of the points below it."""
    below = points(node)
    assert node.n == len(below)
    assert node.low == tuple(map(min, *below)) if len(below) > 1 else node.low == below[0]
    assert node.high == tuple(map(max, *below)) if len(below) > 1 else node.high == below[0]
    if node.point is None:
        assert node.left.parent is node and node.right.parent is node
        assert all(p[node.dim] <= node.cut for p in points(node.left)) and all(p[node.dim] > node.cut for p in points(node.right))
        check(node.left)
        check(node.right)


def displacement(root, leaf):
    """By its definition: for each subtree that holds the leaf, how many others would move up per point that leaves with it."""
    best, node = 0.0, leaf
    while node is not root:
        sibling = node.parent.right if node.parent.left is node else node.parent.left
        best = max(best, len(points(sibling)) / len(points(node)))
        node = node.parent
    return best


@pytest.mark.parametrize("seed", range(6))
def test_cut_tree_under_insertion_and_deletion(seed):
    r = random.Random(seed)
    tree, held = R.CutTree(seed), []
    for _ in range(150):
        if held and r.random() < 0.4:
            tree.delete(held.pop(r.randrange(len(held))))
        else:
            held.append(tree.insert((r.randrange(4) / 4, r.random(), r.choice([0.0, 1.0]))))
        if held:
            check(tree.root)
            assert sorted(points(tree.root)) == sorted(leaf.point for leaf in held)
            leaf = r.choice(held)
            assert tree.displacement(leaf) == displacement(tree.root, leaf)
        else:
            assert tree.root is None


def test_first_cut_has_its_law():
    """Of three points on a line at 0, 1 and 10 the first cut parts the last one with chance 9 / 10, in whatever order they come."""
    for order in ([0.0, 1.0, 10.0], [10.0, 1.0, 0.0], [0.0, 10.0, 1.0]):
        apart = 0
        for seed in range(2000):
            tree = R.CutTree(seed)
            for p in order:
                tree.insert((p,))
            apart += 1.0 <= tree.root.cut < 10.0
        assert abs(apart / 2000 - 0.9) < 0.03


def test_segments_cover_the_stream_and_find_what_is_odd(spark):
    r = np.random.default_rng(1)
    v = r.normal(0, 0.05, (400, 2))
    odd = [130, 260, 333]
    v[odd] += 3
    df = spark.createDataFrame([(i // 2, i, *map(float, x)) for i, x in enumerate(v)], "at long, off long, a double, b double")
    got = {x["off"]: x["score"] for x in R.robust_cut_forest(df, ["a", "b"], [1.0, 1.0], trees=6, size=32, segment=100).collect()}
    assert sorted(got) == list(range(400)) and set(sorted(got, key=got.get)[-3:]) == set(odd)
    thin = R.robust_cut_forest(df, ["a", "b"], [1.0, 1.0], trees=2, size=16, segment=50, thinning=10).collect()
    assert sorted(x["off"] for x in thin) == list(range(0, 400, 10))
    # one segment is the plain slide over the stream
    one = {x["off"]: x["score"] for x in R.robust_cut_forest(df, ["a", "b"], [1.0, 1.0], trees=1, size=32, segment=1000).collect()}
    assert [one[i] for i in range(400)] == list(R.slide([(tuple(map(float, x)), True) for x in v], 32, "11-0-0"))


def test_one_class_machine_against_a_direct_solve(spark):
    r = np.random.default_rng(3)
    v = np.concatenate([r.normal(0, 0.4, (360, 2)), r.uniform(-4, 4, (40, 2))])
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(v)], "off long, a double, b double").repartition(4)
    got = {x["off"]: x["score"] for x in O.one_class_svm(df, "off", ["a", "b"], [1.0, 1.0], nu=0.1, landmarks=60).collect()}
    from hindsight.operators.baselines import sample

    phi = O.Features(sample(df, "off", ["a", "b"], 60), 0.5)
    x = phi(v)
    w, rho, best = np.zeros(x.shape[1]), 0.0, np.inf
    for t in range(20_000):  # the direct solve: all rows in each step
        inside = x @ w < rho
        w, rho = w - (w - (x * inside[:, None]).mean(axis=0) / 0.1) / (t + 2), rho - (inside.mean() / 0.1 - 1) / (t + 20)
        if t % 100 == 0:
            best = min(best, O.objective(w, rho, x, 0.1))
    score = np.array([got[i] for i in range(len(v))])
    direct = rho - x @ w
    assert np.corrcoef(score, direct)[0, 1] > 0.97
    assert 0.05 < (score > 0).mean() < 0.17 and score[360:].mean() > score[:360].mean()
    # w and rho back from the scores: the objective is close to the best one
    solved = np.linalg.lstsq(np.column_stack([np.ones(len(v)), -x]), score, rcond=None)[0]
    assert O.objective(solved[1:], solved[0], x, 0.1) < best + 0.02 * abs(best)


def test_landmark_features_give_the_kernel():
    v = np.random.default_rng(0).random((30, 3))
    phi = O.Features(v, 0.7)
    want = np.exp(-0.7 * ((v[:, None] - v[None]) ** 2).sum(axis=2))
    assert np.allclose(phi(v) @ phi(v).T, want, atol=1e-6)
