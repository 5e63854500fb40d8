"""Stored verdicts, evidence, ledgers and half-space trees by hand and against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hindsight import catalog
from hindsight.operators import arms as A
from hindsight.operators import trees as T
from hindsight.plans import conform as C
from hindsight.plans import store
from hindsight.sources import ledger
from tests.conftest import DATA


def test_kept_until_its_source_changes(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string")

    source = tmp_path / "source"
    source.write_text("one")
    ask = lambda: sorted(map(tuple, store.kept(spark, "t", str(source), make, by=("y",)).select("x", "y").collect()))
    assert ask() == ask() == [(1, "a"), (2, "b")] and len(calls) == 1
    source.write_text("other")
    assert ask() == [(1, "a"), (2, "b")] and len(calls) == 2


def test_evidence_alone_gives_p_and_a_changed_one_does_not(spark):
    x = A.table(spark, DATA)
    again = x.withColumn("again", A.recomputed()).where("status = 'evaluated'")
    assert again.where("again is null or abs(again - p) > 1e-12 * p").count() == 0 and again.count() > 0
    changed = x.where("status = 'evaluated' and evidence.k > 1").withColumn("evidence", F.struct(*(F.when(F.lit(n == "n"), F.col(f"evidence.{n}") + 1).otherwise(F.col(f"evidence.{n}")).alias(n) for n in x.select("evidence.*").columns)))
    changed = changed.withColumn("again", A.recomputed()).where("p < 1")
    assert changed.where("abs(again - p) <= 1e-12 * p").count() == 0 and changed.count() > 0
    assert {r["cause"] for r in x.where("status <> 'evaluated'").select("cause").distinct().collect()} == {"history"}
    assert x.where("(p is null) <> (ln_p is null) or abs(exp(ln_p) - p) > 1e-9").count() == 0


def scored(spark, rows):
    return spark.createDataFrame(rows, "arm string, d long, off long, ent long, at long, p double")


def test_ledger_by_hand(spark, tmp_path):
    rows = [("x", 0, 1, 1, 10, 0.5), ("x", 0, 2, 1, 11, 0.1), ("x", 0, 3, 2, 12, 0.1 + 1e-12), ("x", 1, 4, 1, 90, 0.9), ("y", 0, 5, 1, 13, 0.2), ("y", 0, 6, 1, 14, None)]
    q = ledger.queues(scored(spark, rows), 2, burn_in=50)
    ledger.write(q, str(tmp_path / "a"))
    a = ledger.read(spark, str(tmp_path / "a"))
    # equal to nine digits: the earlier one first
    assert sorted((r["phase"], r["arm"], r["d"], r["rank"], r["off"]) for r in a.collect()) == [("burn_in", "x", 0, 1, 2), ("burn_in", "x", 0, 2, 3), ("burn_in", "y", 0, 1, 5), ("scoring", "x", 1, 1, 4)]
    assert "PartitionFilters: [isnotnull(phase" in a.where("phase = 'scoring'")._jdf.queryExecution().toString()
    with pytest.raises(Exception, match="already exists"):
        ledger.write(q, str(tmp_path / "a"))
    b = ledger.queues(scored(spark, [("x", 0, 1, 1, 10, 0.01), *rows[1:4]]), 2, burn_in=50)
    assert {(r["phase"], r["arm"]): tuple(r)[2:] for r in ledger.difference(a, b).collect()} == {("burn_in", "x"): (1, 1, 1), ("burn_in", "y"): (1, 0, 0), ("scoring", "x"): (0, 0, 0)}
    assert ledger.queues(scored(spark, rows).limit(0), 2, 50).collect() == []


def test_half_space_trees_are_the_streaming_loop(spark):
    r = np.random.default_rng(2)
    v = r.random((330, 3)) * [1.0, 5.0, 100.0]
    v[40], bounds = [9.0, -1.0, 1e9], [(0.0, 1.0), (0.0, 5.0), (0.0, 100.0)]
    order = r.permutation(330)
    df = spark.createDataFrame([(int(order[i] // 2), i, *map(float, v[i])) for i in range(330)], "at long, off long, a double, b double, c double")
    got = {x["off"]: x["score"] for x in T.half_space_trees(df, ["a", "b", "c"], bounds, trees=7, depth=5, window=50).collect()}
    leaf = T.cells(v, bounds, 7, 5)
    assert leaf.min() >= 0 and leaf.max() < 32
    last, now, want = {}, {}, {}
    for seen, i in enumerate(sorted(range(330), key=lambda i: (order[i] // 2, i)), 1):
        want[i] = -sum(last.get((t, c), 0) for t, c in enumerate(leaf[i]))
        for t, c in enumerate(leaf[i]):
            now[t, c] = now.get((t, c), 0) + 1
        if seen % 50 == 0:
            last, now = now, {}
    assert got == want
    assert T.half_space_trees(df.limit(0), ["a", "b", "c"], bounds).collect() == []


def test_a_leaf_is_a_box():
    """Rows of one leaf agree with its box: halving the box of the node's column at each step."""
    r = np.random.default_rng(4)
    v = r.random((200, 2))
    for x, leaf in zip(v, T.cells(v, [(0.0, 1.0)] * 2, 3, 6), strict=True):
        for t in range(3):
            low, high, node = [0.0, 0.0], [1.0, 1.0], 0
            for _ in range(6):
                d = T.dimension(t, node, 2)
                mid = (low[d] + high[d]) / 2
                right = x[d] >= mid
                (low if right else high)[d] = mid
                node = 2 * node + 1 + right
            assert leaf[t] == node - 63


def test_a_name_is_registered_once():
    with pytest.raises(ValueError, match="already"):
        catalog.register(next(iter(catalog.queries())))(None)


def test_days_of_the_table_are_those_of_its_times(spark):
    assert A.table(spark, DATA).where(F.col("d") != F.floor(F.col("at") / C.DAY)).count() == 0
