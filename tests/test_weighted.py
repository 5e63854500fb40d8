"""The weighted arm against plain Python: tails, censored weights, one queue."""

import math
import random

import pytest
from pyspark.sql import functions as F

from hindsight.operators import weighted as W


def log_quantile(sample, total, x, excess):
    s = sorted(sample)
    deep = s[: min(excess, len(s))]
    edge = deep[-1]
    over = [edge - v for v in deep if v < edge]
    scale = sum(over) / len(over) if over else 0.0
    if x < edge and scale > 0:
        return math.log(sum(v <= edge for v in s) / total) - (edge - x) / scale
    c = sum(v <= x for v in s)
    return math.log(c / total) if c else -math.log(total)


def best_weight(observed, censored, most):
    def f(a):
        return len(observed) * math.log(a) + (a - 1) * sum(observed) + (censored * math.log(1 - math.exp(a * most)) if censored else 0.0)

    if not observed:
        return 1.0
    a = max((i / 20_000 for i in range(1, 20_001)), key=f)
    return a if 2 * (f(a) - f(1.0)) > 2.706 else 1.0


@pytest.mark.parametrize("excess", [5, 40])
def test_quantiles(spark, excess):
    r = random.Random(excess)
    past = [(arm, round(-r.expovariate(1.0), 2)) for arm, n in (("x", 60), ("y", 12), ("z", 1)) for _ in range(n)]
    asked = [(arm, round(-r.expovariate(0.5), 2), i) for i, arm in enumerate("xyz" * 40)]
    totals = {"x": 900, "y": 50, "z": 7}
    p = spark.createDataFrame(past, "arm string, lp double")
    tail = W.tails(p, spark.createDataFrame(list(totals.items()), "arm string, total long"), excess)
    got = {r["i"]: r["lq"] for r in W.quantiles(spark.createDataFrame(asked, "arm string, lp double, i int"), p, tail).collect()}
    want = {i: log_quantile([v for a, v in past if a == arm], totals[arm], x, excess) for arm, x, i in asked if arm != "z"}  # one value is no tail
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-12) for i in want)


def test_weights(spark):
    r = random.Random(8)
    rows = []
    for arm, power in (("strong", 0.2), ("none", 1.0), ("silent", 1.0)):
        for i in range(60):
            red = arm != "silent" and i % 2 == 0
            rows.append((arm, i, math.log(r.random()) / (power if red else 1.0) - 1e-3, red))
    q = spark.createDataFrame(rows, "arm string, off long, lq double, red boolean")
    labelled = [(arm, i) for arm in ("strong", "none", "silent") for i in [*range(0, 60, 2), *range(100, 104)]]
    tail = spark.createDataFrame([(a, -1.0, 1.0) for a in ("strong", "none", "silent")], "arm string, threshold double, scale double")
    got = {x["arm"]: x for x in W.weights(q, spark.createDataFrame(labelled, "arm string, off long"), tail).collect()}
    for arm in got:
        observed = [lq for a, _, lq, red in rows if a == arm and red]
        missed = sum(1 for a, i in labelled if a == arm and not any(b == a and i == j for b, j, *_ in rows))
        assert (got[arm]["observed"], got[arm]["censored"]) == (len(observed), missed)
        assert got[arm]["a"] == pytest.approx(best_weight(observed, missed, max(lq for a, _, lq, _ in rows if a == arm)), abs=1e-4)
    assert got["strong"]["a"] < 0.5 and got["silent"]["a"] == 1.0


def test_each_event_stands_once_by_its_best_arm(spark):
    rows = [("x", 0, 1, 1, 5, -6.0), ("y", 0, 1, 1, 5, -9.0), ("x", 0, 2, 1, 6, -8.0), ("y", 0, 3, 1, 7, -20.0), ("x", 1, 4, 1, 99, -1.0)]
    fits = spark.createDataFrame([("x", 0.5), ("y", 1.0)], "arm string, a double")
    got = W.queue(spark.createDataFrame(rows, "arm string, d long, off long, ent long, at long, lq double"), fits, 2).orderBy("d", "rank").collect()
    score = lambda lq: math.log(0.5) - 0.5 * lq
    assert [(r["d"], r["rank"], r["off"], r["arm"]) for r in got] == [(0, 1, 2, "x"), (0, 2, 1, "x"), (1, 1, 4, "x")]
    assert [r["score"] for r in got] == pytest.approx([score(-8.0), score(-6.0), score(-1.0)])
    assert W.queue(spark.createDataFrame(rows, "arm string, d long, off long, ent long, at long, lq double").where(F.lit(False)), fits, 2).collect() == []
