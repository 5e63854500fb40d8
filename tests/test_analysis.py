"""Samples, tails and guards against plain Python."""

import math
import subprocess
import sys

from hindsight import catalog
from hindsight.functions.special import fnv1a64
from hindsight.queries.base import red
from hindsight.plans import conform as C
from tests.conftest import DATA


def test_labelled_entities_stay_in_the_sample(spark):
    labelled = {str(r["ent"]) for r in C.events(spark, DATA).where(red()).select("ent").distinct().collect()}
    everyone = {str(r["ent"]) for r in C.events(spark, DATA).select("ent").distinct().collect()}
    got = {r["ent"] for r in catalog.queries()["entity_sample"](spark, DATA).collect()}
    assert got == {e for e in everyone if e in labelled or fnv1a64(e) % 4 == 0}


def test_volume_tail_holds_every_hour(spark):
    from hindsight.operators.rates import volume

    rows = {(r["ent"], r["hour"]): r for r in volume(C.events(spark, DATA)).collect()}
    got = {(r["ent"], r["hour"]): r for r in catalog.queries()["volume_tail"](spark, DATA).collect()}
    assert got.keys() == rows.keys()
    assert {r["status"] for r in rows.values()} == {"evaluated", "abstained_unusable"}
    for key, r in rows.items():
        if r["status"] != "evaluated":
            assert got[key]["p"] is None and r["dispersion"] is None and r["expected"] > 0
            continue
        if r["expected"] <= 0:
            assert got[key]["p"] == 1.0
            continue
        k, mean, spread = r["k"], r["expected"], max(1.0, r["dispersion"] or 1.0)
        if spread > 1:
            shape, share = mean / (spread - 1), 1 / spread
            below = sum(math.exp(math.lgamma(shape + i) - math.lgamma(shape) - math.lgamma(i + 1) + shape * math.log(share) + i * math.log(1 - share)) for i in range(k))
        else:
            below = sum(math.exp(-mean + i * math.log(mean) - math.lgamma(i + 1)) for i in range(k))
        assert abs(got[key]["p"] - (1 - below)) < 2e-6


def test_the_rest_imports_without_the_training_data_operators():
    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert e.llm is None and 'pipeline' not in e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True)


def test_good_turing_reads_histories_of_five(spark):
    from hindsight.operators.novelty import dirichlet
    from hindsight.queries.base import settled_events

    past = {r["off"]: r for r in dirichlet(settled_events(spark, DATA), "k").collect()}
    got = {r["off"]: r for r in catalog.queries()["novelty_good_turing"](spark, DATA).collect()}
    assert got.keys() == past.keys()
    used = 0
    for off, r in past.items():
        share, plain = min(0.99, got[off]["n1"] / r["n"]) if r["n"] else 0.0, 1 / (r["n"] + r["k"] + 1)
        use = r["n"] >= 5 and share > plain
        used += use
        assert abs(got[off]["reserve"] - (share if use else plain)) < 1e-6
    assert used > len(past) / 2
