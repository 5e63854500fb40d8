"""Ranks, step-up procedures and online control against plain Python on skewed tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hindsight.functions.special import splitmix64
from hindsight.operators import combine as K
from hindsight.operators import online as O
from hindsight.plans.ranks import numbered, prefix


def p_values(spark, seed, n=700):
    r = random.Random(seed)
    rows = [(i, 0 if r.random() < 0.7 else r.randrange(1, 4), round(r.random() ** r.choice([1, 1, 6]), 3) or 0.001) for i in range(n)]
    return rows, spark.createDataFrame(rows, "off long, d int, p double")


def test_ranks_and_running_sums_of_one_hot_key(spark):
    rows, df = p_values(spark, 1)
    got = {r["off"]: r["rank"] for r in numbered(df, ["p", "off"], ["d"]).collect()}
    for d in range(4):
        assert [o for p, o in sorted((p, o) for o, x, p in rows if x == d)] == sorted((o for o, x, p in rows if x == d), key=got.get)
    assert sorted(got[o] for o, x, _ in rows if x == 0) == list(range(1, sum(x == 0 for _, x, _ in rows) + 1))
    same = prefix(spark.range(50).selectExpr("id as off", "1.0D as p"), [], ["p", "off"], {"s": F.col("off")}).collect()
    assert {r["off"]: r["s"] for r in same} == {i: i * (i + 1) // 2 for i in range(50)}
    assert numbered(df.limit(0), ["p"]).collect() == []


def test_ranges_are_spread_over_tasks(spark):
    df = spark.range(4000).selectExpr("id as off", "0 as d", "0.5D as p")  # one day, one value
    sizes = [r["n"] for r in numbered(df, ["p", "off"], ["d"]).groupBy(F.floor((F.col("rank") - 1) / 1000)).agg(F.count("*").alias("n")).collect()]
    assert sizes == [1000] * 4
    from hindsight.plans.store import cut

    dealt = cut(df.repartitionByRange(4, "d", "p", "off").withColumn("piece", F.spark_partition_id()))
    assert max(r["count"] for r in dealt.groupBy("piece").count().collect()) < 2000


def bh(ps, level, factor=1.0):
    m, s = len(ps), sorted(ps)
    k = max((i + 1 for i, p in enumerate(s) if p <= (i + 1) * level / (m * factor)), default=0)
    return s[k - 1] if k else -1.0


@pytest.mark.parametrize("dependence", [False, True])
def test_step_up(spark, dependence):
    rows, df = p_values(spark, 2)
    got = {r["off"] for r in K.step_up(df, "d", "p", 0.2, dependence).where("rejected").collect()}
    want = set()
    for d in range(4):
        mine = [(o, p) for o, x, p in rows if x == d]
        last = bh([p for _, p in mine], 0.2, sum(1 / i for i in range(1, len(mine) + 1)) if dependence else 1.0)
        want |= {o for o, p in mine if p <= last}
    assert got == want and want


def test_harmonic_numbers(spark):
    got = spark.createDataFrame([(m,) for m in (1, 2, 63, 64, 65, 1000, 10**6)], "m long").select("m", K.harmonic(F.col("m")).alias("h")).collect()
    for r in got:
        assert r["h"] == pytest.approx(math.fsum(1 / i for i in range(1, r["m"] + 1)), rel=1e-14)


def test_cross_fitted_weights(spark):
    rows, df = p_values(spark, 3, 203)
    df = df.withColumn("c", F.pmod(F.hash("off"), F.lit(50)))
    cov = {r["off"]: r["c"] for r in df.collect()}
    order = sorted((cov[o], o) for o, _, _ in rows)
    size, longer = divmod(len(order), 4)
    stratum, at = {}, 0
    for s in range(4):
        for _ in range(size + (s < longer)):
            stratum[order[at][1]] = s + 1
            at += 1
    fold = {o: splitmix64(1 + o)[1] % 5 for o, _, _ in rows}
    weight = {}
    for o, _, _ in rows:
        rest = [p for u, _, p in rows if stratum[u] == stratum[o] and fold[u] != fold[o]]
        pi0 = min(1.0, (1 + sum(p > 0.5 for p in rest)) / (len(rest) * 0.5))
        weight[o] = (1 - pi0) / pi0
    got = K.cross_fitted_weights(df, "c", "p").collect()
    assert {r["off"]: (r["stratum"], r["fold"]) for r in got} == {o: (stratum[o], fold[o]) for o in stratum}
    assert all(r["weight"] == pytest.approx(weight[r["off"]]) for r in got)


def test_higher_criticism_over_the_whole_half(spark):
    rows, df = p_values(spark, 4)
    for r in K.higher_criticism(df, "d", "p").collect():
        ps = sorted((p, o) for o, x, p in rows if x == r["d"])
        n = len(ps)
        value = [math.sqrt(n) * ((i + 1) / n - p) / math.sqrt(p * (1 - p)) for i, (p, _) in enumerate(ps[: max(n // 2, 1)]) if 0 < p < 1]
        assert r["hc"] == pytest.approx(max(value)) and r["hc_tail"] == pytest.approx(max(value[:32])) and r["truncated"] == (n // 2 > 32)


def sequential(ps, q=0.1, block=None, most=512):
    s, w0 = O.Spending(), 0.1 / 20
    g = s.at(np.arange(len(ps) + 1))
    hits, out = [], []
    for i, p in enumerate(ps, 1):
        level = g[i] * w0 + sum((q - w0 if j == 0 else q) * g[i - h] for j, h in enumerate(hits))
        out.append((level, p <= level))
        if p <= level:
            hits.append(i)
    return out


@pytest.mark.parametrize(("block", "signal"), [(10_000, 0.02), (97, 0.1), (50, 0.6), (13, 0.0)])
def test_online_control_is_the_sequence(spark, block, signal):
    r = random.Random(block)
    ps = [r.random() * (1e-6 if r.random() < signal else 1.0) for _ in range(400)]
    df = spark.createDataFrame([(i // 3, i, p) for i, p in enumerate(ps)], "at long, off long, p double")
    got = O.lord(df, block=block).orderBy("off").collect()
    want = sequential(ps)
    assert [x["rejected"] for x in got] == [x for _, x in want] and [x["test"] for x in got] == list(range(1, 401))
    assert np.allclose([x["level"] for x in got], [x for x, _ in want], rtol=1e-6)
    assert any(x for _, x in want) == (signal > 0)


def test_spending_sums_to_one():
    s, small = O.Spending(), O.Spending(1000)
    j = np.array([1, 2, 5, 999, 1000, 1001, 5000, 80_000])
    assert np.allclose(s.at(j), small.at(j), rtol=1e-12) and np.allclose(s.upto(j), small.upto(j), rtol=1e-12)
    assert s.upto(np.array([10**15]))[0] == pytest.approx(1 - s.scale / math.log(1e15), rel=1e-12)


def test_runs_leave_out_the_first_rejection():
    assert O.as_runs([3, 4, 5, 9]).tolist() == [[3, 5], [9, 9]] and O.as_runs([]).shape == (0, 2)
    assert O._known(np.zeros((0, 2), int), 3, [3, 4, 5], 512)[1].tolist() == [[4, 5]]
