"""All-pairs co-occurrence against plain loops over each event's past, and a graph worked by hand; the share of an hour against a plain integral."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hindsight.operators import pairgraph as G
from hindsight.operators import rates as R
from hindsight.plans import conform as C

FIELDS = ("a", "b", "c")


def stream(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "off long, ent long, at long, a string, b string, c string").withColumn("known", F.lit(True))


def fields():
    return {f: F.col(f) for f in FIELDS}


def blocks_of(spark, blocks):
    return spark.createDataFrame([(f, v, b) for (f, v), b in blocks.items()], "field string, value string, block string")


def made(seed, n=250):
    r, at, rows = random.Random(seed), C.ORIGIN, []
    for _ in range(n):
        at += r.choice([0, 0, C.HOUR, 30 * C.HOUR])
        rows.append((r.randrange(3), at, *(None if r.random() < 0.2 else f"v{int(5 * r.random() ** 2)}" for _ in FIELDS)))
    return rows


def plain(rows, blocks):
    """(off, f_a, f_b) -> (w, k_a, k_b, total, lam, fallback)."""
    past, out = [], {}
    for off, (_, at, *values) in enumerate(rows):
        nodes = [(f, v) for f, v in zip(FIELDS, values) if v is not None]
        edge, degree, total, deg_b, met = Counter(), Counter(), 0.0, Counter(), Counter()
        for t, old in past:
            w = 2.0 ** ((t - at) / C.HALF_LIFE)
            for i, x in enumerate(old):
                for y in old[i + 1 :]:
                    edge[x, y] += w
                    degree[x] += w
                    degree[y] += w
                    total += w
                    r, s = blocks.get(x), blocks.get(y)
                    if r and s:
                        met[frozenset((r, s))] += 2 * w if r == s else w
        for x, k in degree.items():
            if x in blocks:
                deg_b[blocks[x]] += k
        for i, x in enumerate(nodes):
            for y in nodes[i + 1 :]:
                r, s = blocks.get(x), blocks.get(y)
                fallback = not (r and s and deg_b[r] > 0 and deg_b[s] > 0)
                lam = (degree[x] * degree[y] / (2 * total) if total else 0.0) if fallback else degree[x] * degree[y] * met[frozenset((r, s))] / (deg_b[r] * deg_b[s])
                out[off, x[0], y[0]] = (edge[x, y], degree[x], degree[y], total, lam, fallback)
        if len(nodes) > 1:
            past.append((at, nodes))
    return out


def tail(lam, w):
    if lam <= 0:
        return 0.0
    return min(0.0, math.log(sum(math.exp(-lam + i * math.log(lam) - math.lgamma(i + 1)) for i in range(math.floor(w + 1e-9) + 1))))


@pytest.mark.parametrize("partition", [None, {("a", "v0"): "a:0", ("a", "v1"): "a:1", ("b", "v0"): "b:0", ("b", "v1"): "b:0", ("b", "v2"): "b:1", ("c", "v0"): "a:0", ("c", "v1"): "c:1"}])
def test_pairs_and_least_tail(spark, partition):
    rows = made(5)
    want = plain(rows, partition or {})
    pairs = G.priced_pairs(stream(spark, rows), fields(), None if partition is None else blocks_of(spark, partition)).persist()
    got = {(r["off"], r["f_a"], r["f_b"]): r for r in pairs.collect()}
    assert got.keys() == want.keys()
    for key, (w, k_a, k_b, total, lam, fallback) in want.items():
        r = got[key]
        assert [r["w"], r["k_a"], r["k_b"], r["total"], r["lam"]] == pytest.approx([w, k_a, k_b, total, lam], abs=1e-9) and r["fallback"] == fallback
    found = {r["off"]: r for r in G.least_pair(pairs).collect()}
    assert found.keys() == {off for off, _, _ in want}
    for off, r in found.items():
        tails = {k[1:]: tail(v[4], v[0]) for k, v in want.items() if k[0] == off}
        assert r["tests"] == len(tails) and r["least"] == pytest.approx(min(tails.values()), abs=1e-8)
        assert tails[r["f_a"], r["f_b"]] == pytest.approx(min(tails.values()), abs=1e-8)
        assert r["log_p"] == pytest.approx(math.log(1 - (1 - math.exp(r["least"])) ** len(tails)) if r["least"] < 0 else 0.0, abs=1e-8)


EDGES = {("u1", "l1"): 4, ("u1", "l2"): 1, ("u2", "l1"): 2, ("u3", "l2"): 3}
HAND = {("u1", "l1"): 30 / 7, ("u2", "l1"): 12 / 7, ("u3", "l2"): 3.0, ("u1", "l2"): 5 / 7, ("u2", "l2"): 2 / 7, ("u3", "l1"): 0.0}


@pytest.mark.parametrize("probe", sorted(HAND))
def test_graph_worked_by_hand(spark, probe):
    """Degrees 5, 2, 3 and 6, 4; weights 6, 1, 0 and 3 between blocks of degree 7, 3, 6 and 4."""
    at = C.ORIGIN
    rows = [(1, at, u, v, None) for (u, v), n in EDGES.items() for _ in range(n)] + [(1, at, *probe, None)]
    blocks = {("a", "u1"): "a:0", ("a", "u2"): "a:0", ("a", "u3"): "a:1", ("b", "l1"): "b:0", ("b", "l2"): "b:1"}
    r = G.priced_pairs(stream(spark, rows), fields(), blocks_of(spark, blocks)).where("off = 10").collect()[0]
    assert r["lam"] == pytest.approx(HAND[probe], abs=1e-12) and not r["fallback"] and r["total"] == 10


def test_one_block_is_the_configuration_model(spark):
    rows = made(9, 80)
    one = {(f, f"v{i}"): "all" for f in FIELDS for i in range(5)}
    a = {(r["off"], r["f_a"], r["f_b"]): r["lam"] for r in G.priced_pairs(stream(spark, rows), fields(), blocks_of(spark, one)).collect()}
    b = {(r["off"], r["f_a"], r["f_b"]): r["lam"] for r in G.priced_pairs(stream(spark, rows), fields()).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)


def test_nothing_to_pair(spark):
    assert G.least_pair(G.priced_pairs(stream(spark, []), fields(), blocks_of(spark, {}))).count() == 0
    assert G.least_pair(G.priced_pairs(stream(spark, [(1, C.ORIGIN, "x", None, None), (1, C.ORIGIN, None, None, None)]), fields())).count() == 0


def test_share_of_the_hour_against_a_plain_integral(spark):
    r, at, times = random.Random(3), C.ORIGIN, []
    for _ in range(60):
        at += int(r.choice([0.2, 3, 21.5, 24]) * C.HOUR)
        times.append(at)
    e = spark.createDataFrame([(i, 1, t) for i, t in enumerate(times)], "off long, ent long, at long")
    _, coefficients = R.harmonics()
    got = {x["hour"]: x for x in R.hour_shares(e).collect()}
    assert sum(x["k"] for x in got.values()) == 60
    steps = 400
    for hour, x in got.items():
        past = [t for t in times if t // C.HOUR < hour]
        if not past:
            assert x["share"] == 1 / 24
            continue
        w = [2.0 ** ((t - C.ORIGIN) / C.HALF_LIFE) for t in past]
        phases = [2 * math.pi * (t % C.DAY) / C.DAY for t in past]
        density = lambda p: (1 + 2 * sum(c * sum(v * math.cos(h * (p - q)) for v, q in zip(w, phases)) / sum(w) for h, c in enumerate(coefficients, 1))) / (2 * math.pi)  # noqa: B023,E731
        width = 2 * math.pi / 24
        mass = sum(density(width * (hour % 24 + (i + 0.5) / steps)) for i in range(steps)) * width / steps
        assert x["share"] == pytest.approx(min(1.0, max(0.0, mass)), abs=1e-5)
