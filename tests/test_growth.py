"""Held-out fields, daily cuts and information against plain loops."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from hindsight.operators import growth as W
from hindsight.plans import conform as C

FIELDS = ("a", "b", "c")
DAY0 = C.ORIGIN // C.DAY


def verdicts(seed, n=300):
    r, at, rows = random.Random(seed), C.ORIGIN, []
    for off in range(n):
        at += r.choice([0, C.HOUR // 2, C.HOUR])
        rows += [(off, at, f, max(1e-12, r.random() ** 4)) for f in FIELDS if r.random() < 0.6]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "off long, at long, field string, p double")


def tail(ps):
    half = -sum(map(math.log, ps))
    return min(1.0, math.exp(-half) * sum(half**i / math.factorial(i) for i in range(len(ps))))


def plain(rows, fields, introduced, wait):
    events, out = defaultdict(list), {}
    for off, at, f, p in rows:
        events[at, off].append((f, p))
    for h in fields:
        seen = 0
        for (at, off), said in sorted(events.items()):
            for t in "AB":
                joined = at >= introduced and (t == "B" or seen >= wait)
                ps = [p for f, p in said if f != h or joined]
                if ps:
                    out[h, t, off] = (len(ps), tail(ps))
            seen += at >= introduced and any(f == h for f, _ in said)
    return out


@pytest.mark.parametrize("wait", [0, 1, 25, 10_000])
def test_held_out(spark, wait):
    rows = verdicts(wait)
    introduced = rows[len(rows) // 2][1]  # events of that very time are in
    want = plain(rows, ("a", "c"), introduced, wait)
    got = {(r["h"], r["treatment"], r["off"]): (r["j"], r["p"]) for r in W.held_out(frame(spark, rows), ("a", "c"), introduced, wait).collect()}
    assert got.keys() == want.keys()
    for key, (j, p) in want.items():
        assert got[key][0] == j and got[key][1] == pytest.approx(p, rel=1e-9)
    if wait == 0:
        assert all(want[h, "A", off] == v for (h, t, off), v in want.items() if t == "B")


def test_discoveries_by_day_and_level(spark):
    r = random.Random(8)
    tests = [(h, t, off, C.ORIGIN + (off % 6) * C.DAY, max(0.002, round(r.random() ** 6, 3)), int(r.random() < 0.3)) for h in "ac" for t in "AB" for off in range(240)]  # many ties
    levels = (0.001, 0.05, 0.2)
    want = Counter()
    for h in "ac":
        for t in "AB":
            for d in range(6):
                day = sorted((p, off, red) for x, y, off, at, p, red in tests if (x, y) == (h, t) and at // C.DAY == DAY0 + d)
                for q in levels:
                    cut = max((i for i, (p, _, _) in enumerate(day, 1) if p <= i * q / 40), default=0)
                    era = "pre" if d < 4 else "post"
                    want[h, t, era, q, "n"] += cut
                    want[h, t, era, q, "hits"] += sum(x[2] for x in day[:cut])
    df = spark.createDataFrame(tests, "h string, treatment string, off long, at long, p double, red int")
    rows = W.discoveries(df, C.day(), DAY0 + 4, levels).collect()
    assert len(rows) == 2 * 2 * 2 * 3 and any(x["discoveries"] for x in rows) and any(not x["discoveries"] for x in rows)
    for x in rows:
        key = (x["h"], x["treatment"], x["era"], x["q"])
        n, hits = want[*key, "n"], want[*key, "hits"]
        assert (x["discoveries"], x["hits"], x["days"]) == (n, hits, 4 if x["era"] == "pre" else 2)
        assert x["fdr"] == (pytest.approx(1 - hits / n) if n else None)


def test_nothing_to_combine(spark):
    empty = frame(spark, [])
    assert W.held_out(empty, FIELDS, 0).count() == 0
    tests = spark.createDataFrame([], "h string, treatment string, off long, at long, p double, red int")
    assert W.discoveries(tests, C.day(), 0, (0.1,)).count() == 0
    # only the held-out field speaks, and it has not come yet
    assert W.held_out(frame(spark, [(1, 5, "a", 0.5)]), ("a",), 6).count() == 0


def test_information(spark):
    r = random.Random(2)
    rows = [(x := r.choice("pqr"), x if r.random() < 0.8 else r.choice("pqr"), r.choice(["s", "t", None])) for _ in range(400)]
    got = {(x["f_a"], x["f_b"]): x for x in W.information(spark.createDataFrame(rows, "a string, b string, c string"), {f: F.col(f) for f in FIELDS}).collect()}
    assert got.keys() == {("a", "b"), ("a", "c"), ("b", "c")}
    for (f, g), x in got.items():
        pairs = Counter((row[FIELDS.index(f)], row[FIELDS.index(g)]) for row in rows if None not in (row[FIELDS.index(f)], row[FIELDS.index(g)]))
        n, one, two = sum(pairs.values()), Counter(), Counter()
        for (u, v), c in pairs.items():
            one[u] += c
            two[v] += c
        assert x["n"] == n and x["mi"] == pytest.approx(sum(c / n * math.log(c * n / (one[u] * two[v])) for (u, v), c in pairs.items()), abs=1e-9)
    mi = spark.createDataFrame([("a", "b", 0.5), ("a", "c", 0.5), ("b", "c", 0.1)], "f_a string, f_b string, mi double")
    assert {(x["h"], x["nearest"]) for x in W.nearest_information(mi).collect()} == {("a", "b"), ("b", "a"), ("c", "a")}
