"""Hand-computed fixtures and brute-force twins of what SQL cannot say."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hindsight.functions import special as X
from hindsight.operators import decide
from hindsight.operators import novelty as N
from hindsight.operators import rates as R
from hindsight.plans import conform as C
from hindsight.sources import delimited as D


def stream(spark, rows):
    return spark.createDataFrame([(i, e, C.ORIGIN + int(t), v) for i, (e, t, v) in enumerate(rows)], "off long, ent long, at long, v string").withColumn("known", spark_true())


def spark_true():
    from pyspark.sql import functions as F

    return F.lit(True)


def test_dirichlet_masses_by_hand(spark):
    """Half-life one day, scored at day 4: A at days 0, 1, 2; B at 3; C at 0; D twice at 2; E at 1. n is 1.625 and the reserve 8/61."""
    past = [(1, C.DAY * d, v) for d, v in ((0, "A"), (0, "C"), (1, "A"), (1, "E"), (2, "A"), (2, "D"), (2, "D"), (3, "B"))]
    tails = {}
    for v in "ABCDEZ":
        e = stream(spark, [*past, (1, 4 * C.DAY, v)])
        r = N.dirichlet(e, "v", half_life=C.DAY).where(f"off = {len(past)}").first()
        tails[v] = r["p"]
        assert r["n"] == pytest.approx(1.625) and r["k"] == 5
    assert tails["Z"] == pytest.approx(8 / 61)
    # masses in 122ths: A 23, B 24, C 17, D 24, E 18, reserve 16
    assert tails["C"] == pytest.approx((17 + 16) / 122) and tails["E"] == pytest.approx((18 + 17 + 16) / 122)
    assert tails["A"] == pytest.approx((23 + 18 + 17 + 16) / 122) and tails["B"] == pytest.approx(1.0)


def test_cold_start_is_one(spark):
    assert N.dirichlet(stream(spark, [(1, 0, "A")]), "v").first()["p"] == 1.0


def test_two_level_prefix_equals_one_window(spark):
    from pyspark.sql import functions as F

    e = stream(spark, [(i % 2, i * C.HOUR * 7, "x") for i in range(60)])
    got = {r["off"]: r["n"] for r in C.running(e, ["ent"], {"n": F.lit(1).cast("long")}).collect()}
    assert got == {i: i // 2 for i in range(60)}


def test_cusum_recursion(spark):
    e = stream(spark, [(1, C.DAY * d + i * C.HOUR, "x") for d in range(12) for i in range(1 + d % 4)])
    rows = R.drift(e).orderBy("d").collect()
    post = {r["d"]: (r["a"], r["b"]) for r in R.gamma_posterior(e).collect()}
    s = 0.0
    for i, r in enumerate(rows):
        a, b = post[r["d"]]
        s = s if i == 0 else max(0.0, s + r["n"] - a / b * 0.3 / math.log(1.3))
        assert r["cusum"] == pytest.approx(s, abs=1e-9)


def test_special_functions():
    assert X.log_gamma_upper(np.array([2.0]), np.array([3.0]))[0] == pytest.approx(math.log(4 * math.exp(-3)), rel=1e-12)
    assert X.log_gamma_lower(np.array([1.0]), np.array([0.5]))[0] == pytest.approx(math.log(1 - math.exp(-0.5)), rel=1e-12)
    assert X.log_gamma_upper(np.array([3.0]), np.array([2000.0]))[0] == pytest.approx(-2000 + math.log(1 + 2000 + 2000**2 / 2), rel=1e-12)
    assert X.beta_inc(np.array([2.0]), np.array([3.0]), np.array([0.4]))[0] == pytest.approx(0.5248, abs=1e-12)
    assert X.mcnemar(3, 9) == pytest.approx(2 * sum(math.comb(12, i) for i in range(4)) / 4096)
    low, high = X.clopper_pearson(0, 10)
    assert low == 0 and high == pytest.approx(1 - 0.025**0.1, abs=1e-9)
    assert X.fnv1a64("") == 0xCBF29CE484222325 and X.fnv1a64("a") == 0xAF63DC4C8601EC8C
    k = X.bessel_ratios(1.0, 2)
    assert k[0] == pytest.approx(0.4463899658965345) and k[1] == pytest.approx(0.1072200682069309)


@given(st.integers(0, 12), st.integers(0, 12), st.floats(0.3, 5), st.floats(0.3, 5))
@settings(max_examples=40, deadline=None)
def test_beta_binomial_tail(k, m, a, b):
    k = min(k, m)
    pmf = [math.exp(math.lgamma(m + 1) - math.lgamma(j + 1) - math.lgamma(m - j + 1) + math.lgamma(j + a) + math.lgamma(m - j + b) - math.lgamma(m + a + b) - math.lgamma(a) - math.lgamma(b) + math.lgamma(a + b)) for j in range(m + 1)]
    assert math.exp(X.log_beta_binomial_tail(np.array([k]), np.array([m]), np.array([a]), np.array([b]))[0]) == pytest.approx(sum(pmf[k:]), rel=1e-9)


def test_games():
    v, mix, other = decide.solve_game(np.array([[0, -1, 1], [1, 0, -1], [-1, 1, 0]]))
    assert abs(v) < 1e-12 and mix == pytest.approx([1 / 3] * 3) and other == pytest.approx([1 / 3] * 3)
    v, mix, _ = decide.solve_game(np.array([[1, -1], [-1, 1]]))
    assert abs(v) < 1e-12 and mix == pytest.approx([0.5, 0.5])


def test_reader_sets_rows_aside(spark):
    s = D.Schema("x", ("time", "user", "v"), "time", "user", unit=1_000_000, missing="?")
    lines = spark.createDataFrame([(1, "5,U1,a"), (2, "bad,U1,a"), (3, "5,U1"), (4, "5,?,a"), (5, "5,,a"), (6, "6,U2,?"), (7, "7,U3,")], "offset long, line string")
    good, errors = D.parse(lines, s)
    assert {r["offset"]: r["reason"] for r in errors.collect()} == {2: "time", 3: "columns", 4: "entity", 5: "entity"}
    f = {r["offset"]: r["fields"] for r in good.collect()}
    assert f[1]["v"]["usable"] and not f[6]["v"]["usable"] and f[7] == {}
    with pytest.raises(ValueError):
        D.Schema("x", ("a",), "a", "b", unit=1)
    with pytest.raises(ValueError):
        D.finite_json({"a": [1.0, float("nan")]})


def test_stream_equals_batch(spark):
    from hindsight.streaming import replay
    from tests.conftest import DATA

    got = {r["off"]: r for r in replay.run_to_end(replay.decayed_novelty(replay.source(spark, DATA)), "append").collect()}
    from pyspark.sql import functions as F

    e = C.events(spark, DATA).withColumn("known", F.lit(True))
    want = N.dirichlet(e, "event_type").collect()
    assert len(got) == len(want)
    for r in want:
        g = got[r["off"]]
        assert (g["n_v"], g["n"], g["k"]) == (pytest.approx(r["n_v"], abs=1e-9), pytest.approx(r["n"], abs=1e-9), r["k"])


def test_bounded_novelty_equals_the_exact_one_while_nothing_is_evicted(spark):
    from hindsight.operators import sketches
    from pyspark.sql import functions as F

    e = stream(spark, [(i % 3, i * C.HOUR, "abc"[i * i % 3]) for i in range(60)]).withColumnRenamed("v", "k")
    got = {r["off"]: r["p"] for r in sketches.bounded_novelty(e, 8).collect()}
    want = {r["off"]: r["p"] for r in N.dirichlet(e.withColumn("known", F.lit(True)), "k").collect()}
    assert got == pytest.approx(want)
    assert max(r["held"] for r in sketches.bounded_novelty(e, 1).collect()) == 1


def test_centroids():
    from hindsight.operators.sketches import Centroids

    c = Centroids(16)
    x = np.random.default_rng(0).permutation(2000) / 2000
    for v in x:
        c.add(float(v))
    assert len(c.mean) == 16 and sum(c.weight) == 2000 and abs(c.cdf(0.5) - 0.5) < 0.2


def test_kinds(spark):
    from hindsight.queries.fields import kinds

    rows = [("on" if i % 2 else "OFF", f"id{i}", str(i % 7), str(i + 0.5), "abc"[i % 3], "x" if i < 40 else None) for i in range(250)]
    e = spark.createDataFrame(rows, "flag string, ident string, small string, wide string, kind3 string, few string")
    assert {r["field"]: r["kind"] for r in kinds(e, "s", e.columns).collect()} == {"flag": "boolean", "ident": "identifier", "small": "discrete", "wide": "continuous", "kind3": "categorical", "few": "unknown"}
