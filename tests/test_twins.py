"""Arms whose tails SQL cannot say, against plain loops: timing, the scan of bursts, drift. Readers: gzip, a layout of times, schemas, labels, partitions, caps."""

import gzip
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from hindsight import catalog
from hindsight.operators import rates as R
from hindsight.plans import conform as C
from hindsight.sources import delimited as D
from tests.conftest import DATA


def test_timing(spark):
    r, rows = random.Random(6), []
    for ent in (1, 2):
        at = C.ORIGIN + 1_234_567  # no event stands on a point of the grid, where rounding alone would decide
        for _ in range(45):
            at += r.choice([0, 1, 1, 2]) and int(r.choice([0.5, 11, 24]) * C.HOUR) + r.randrange(1, 10**9)
            rows.append((len(rows), ent, at))
    _, coefficients = R.harmonics()
    grid = [2 * math.pi * i / 512 for i in range(512)]
    want = {}
    for ent in (1, 2):
        past = []
        for off, _, at in [x for x in rows if x[1] == ent]:
            w = [2.0 ** ((t - at) / C.HALF_LIFE) for t, _ in past]
            u = 1.0
            if past:
                phases = [2 * math.pi * (t % C.DAY) / C.DAY for t, _ in past]
                cs = [(c * sum(v * math.cos(h * p) for v, p in zip(w, phases)) / sum(w), c * sum(v * math.sin(h * p) for v, p in zip(w, phases)) / sum(w)) for h, c in enumerate(coefficients, 1)]
                density = lambda x: max(0.0, (1 + 2 * sum(c * math.cos(h * x) + s * math.sin(h * x) for h, (c, s) in enumerate(cs, 1))) / (2 * math.pi))  # noqa: B023,E731
                all_, own = [density(g) for g in grid], density(2 * math.pi * (at % C.DAY) / C.DAY)
                u = max(sum(d for d in all_ if d <= own) / sum(all_), 1 / 1024)
            z = None
            if len(past) >= 20:
                mean = sum(v * math.log(x) for v, (_, x) in zip(w, past)) / sum(w)
                var = sum(v * math.log(x) ** 2 for v, (_, x) in zip(w, past)) / sum(w) - mean**2
                z = (math.log(u) - mean) / math.sqrt(var) if var > 1e-12 else None
            want[off] = (u, z)
            past.append((at, u))
    got = {x["off"]: x for x in R.timing(spark.createDataFrame(rows, "off long, ent long, at long")).collect()}
    assert got.keys() == want.keys() and any(z is not None for _, z in want.values())
    for off, (u, z) in want.items():
        assert got[off]["u"] == pytest.approx(u, abs=1e-9) and got[off]["z"] == (None if z is None else pytest.approx(z, abs=1e-6))
    assert all((got[off]["status"] == "evaluated") == (z is not None) for off, (_, z) in want.items())


def log_gamma_lower(a, x):
    term = total = 1.0
    n = a
    while term > 1e-18 * total:
        n += 1
        term *= x / n
        total += term
    return a * math.log(x) - x - math.lgamma(a + 1) + math.log(total)


def test_burst_scan(spark):
    r, times, at = random.Random(7), [], C.ORIGIN
    for i in range(110):
        at += r.choice([0, 1, 2]) * 1_000_000 if 70 <= i < 80 else r.randrange(1, 400) * 10_000_000
        times.append(at)
    e = spark.createDataFrame([(i, 1, t) for i, t in enumerate(times)], "off long, ent long, at long")
    got = {x["at"]: x for x in R.burst_log_p(R.burst(e)).collect()}
    instants, want = sorted(set(times)), {}
    for i, t in enumerate(instants):
        if i < 50:
            continue
        gaps = [((b - a) / 1e6, 2.0 ** ((b - t) / C.HALF_LIFE)) for a, b in zip(instants[:i], instants[1 : i + 1])]
        w = sum(v for _, v in gaps)
        mu = sum(g * v for g, v in gaps) / w
        var = sum(g * g * v for g, v in gaps) / w - mu * mu
        kappa = max(0.01, min(1.0, mu * mu / var))
        tails = [log_gamma_lower((k - 1) * kappa, max(1.0, (t - instants[i - k + 1]) / 1e6) / (mu / kappa)) for k in range(3, 33) if i - k + 1 >= 0]
        least = min(tails)
        want[t] = (len(tails), math.log(len(tails)) + least if least < -30 else math.log(-math.expm1(len(tails) * math.log1p(-math.exp(least)))))
    assert got.keys() == want.keys() and min(p for _, p in want.values()) < -10
    for t, (n, p) in want.items():
        assert got[t]["tests"] == n and got[t]["log_p"] == pytest.approx(p, abs=1e-6)


def test_drift_tail(spark):
    rows = {(x["ent"], x["d"]): x for x in R.drift(C.events(spark, DATA)).collect()}
    got = {(x["ent"], x["d"]): x for x in catalog.queries()["drift_tail"](spark, DATA).collect()}
    assert got.keys() == rows.keys() and {x["status"] for x in got.values()} == {"evaluated", "abstained_structural"}
    for key, x in rows.items():
        p = None if x["z"] is None else 0.5 * math.erfc(x["z"] / math.sqrt(2))
        assert got[key]["p"] == (None if p is None else pytest.approx(p, abs=1e-6))


def test_gzip_and_layout(spark, tmp_path):
    path = tmp_path / "x.csv.gz"
    path.write_bytes(gzip.compress(b"2024-01-02 03:04:05,u1,a\nnot a time,u1,b\n2024-01-01 00:00:00,u2,?\n2024-01-01 00:00:00,,c\n"))
    schema = D.load_schema(json.dumps({"source": "s", "columns": ["t", "u", "f"], "time": "t", "entity": "u", "layout": "yyyy-MM-dd HH:mm:ss", "epoch": "2024-01-01 00:00:00", "delimiter": ",", "missing": "?"}))
    lines = D.read_lines(spark, str(path))
    assert [x["line"][:4] for x in lines.orderBy("offset").collect()] == ["2024", "not ", "2024", "2024"]
    good, bad = D.parse(lines, schema)
    rows = good.orderBy("offset").collect()
    assert [(x["entity"], x["at"]) for x in rows] == [("u1", C.DAY + (3 * 3600 + 4 * 60 + 5) * 1_000_000), ("u2", 0)]
    assert rows[0]["fields"]["f"]["usable"] and not rows[1]["fields"]["f"]["usable"]
    assert [x["reason"] for x in bad.orderBy("offset").collect()] == ["time", "entity"]


def test_caps_labels_and_partitions(spark, tmp_path):
    events = spark.createDataFrame([(i, 10 * i) for i in range(8)], "offset long, at long")
    assert [x["offset"] for x in D.cap(events, max_rows=3).orderBy("offset").collect()] == [0, 1, 2]
    assert D.cap(events, max_at=45).count() == 5 and D.cap(events, 3, 15).count() == 2 and D.cap(events.limit(0), 3).count() == 0
    labels = tmp_path / "l.csv"
    labels.write_text("time,user,src,dst\n1,u,a,b\n1,u,a,b\n2,u,a,b\n")
    assert sorted(x["time"] for x in D.load_labels(spark, str(labels)).collect()) == ["1", "2"]
    text = json.dumps({"blocks": {"f\x1fv": 0, "g\x1fw": 1}, "degree_sums": {"0": 2.5, "1": 1}, "block_weights": {"0\x1f1": 1.5}})
    blocks, sums, pairs = D.load_partition(spark, text)
    assert {tuple(x) for x in blocks.collect()} == {("f", "v", 0), ("g", "w", 1)} and {tuple(x) for x in sums.collect()} == {(0, 2.5), (1, 1.0)} and [tuple(x) for x in pairs.collect()] == [(0, 1, 1.5)]


def test_a_loaded_partition_prices_pairs(spark):
    from hindsight.operators import pairgraph as G

    rows = [(i, 1, C.ORIGIN + i, f"v{i % 2}", f"w{i % 3}", True) for i in range(30)]
    e = spark.createDataFrame(rows, "off long, ent long, at long, f string, g string, known boolean")
    nodes = [("f", "v0"), ("f", "v1"), ("g", "w0"), ("g", "w1")]
    text = json.dumps({"blocks": {"\x1f".join(n): i for i, n in enumerate(nodes)}, "degree_sums": {"0": 1.0}, "block_weights": {"0\x1f1": 1.0}})
    blocks = D.load_partition(spark, text)[0].withColumn("block", F.col("block").cast("string"))
    x = {(r["off"], r["v_b"]): r for r in G.priced_pairs(e, {"f": F.col("f"), "g": F.col("g")}, blocks).collect()}
    assert len(x) == 30 and x[29, "w2"]["fallback"] and not x[28, "w1"]["fallback"]
    # each block is one node: the expected weight is the observed one
    assert x[28, "w1"]["lam"] == pytest.approx(x[28, "w1"]["w"], rel=1e-6)
