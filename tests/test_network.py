"""The network regressor: gradient, convergence where a ridge fails, early stop."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnscore.operators import network as nw
from turnscore.operators import regression as rg


@pytest.mark.parametrize("hidden", [(), (5,), (6, 4)])
def test_gradient_equals_finite_differences(hidden):
    r = np.random.RandomState(1)
    params = nw.init_params(3, hidden, seed=2)
    x, y = r.randn(7, 3), r.randn(7) * 3
    loss, gradient = nw.loss_and_gradient(params, x, y)
    assert loss == pytest.approx(np.log(np.cosh(nw.forward(params, x) - y)).sum())
    at = nw.flat(params)
    for i in range(len(at)):
        step = np.zeros_like(at)
        step[i] = 1e-6
        up, down = (nw.loss_and_gradient(nw.shaped(at + s, params), x, y)[0] for s in (step, -step))
        assert gradient[i] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def curved(spark, n=400, seed=3):
    r = np.random.RandomState(seed)
    x = r.randn(n, 2)
    y = x[:, 0] ** 2 + np.abs(x[:, 1])
    rows = [(f"d{i}", x[i].tolist(), float(y[i]) if i % 9 else None) for i in range(n)]
    df = spark.createDataFrame(rows, "dialogue_id string, features array<double>, label double").withColumn("k", F.substring("dialogue_id", 2, 9).cast("int"))
    return df.where("k % 4 <> 0"), df.where("k % 4 = 0")


def test_learns_what_a_ridge_cannot(spark):
    train, dev = curved(spark)
    net = nw.fit_network(train, dev, hidden=(16,), rounds=4, steps=100, rate=0.02, shares=2, local=20)
    ridge = rg.fit_candidates(train, (0.1,))[0]
    got = {r["candidate"]: r["spearman"] for r in rg.evaluate_candidates([ridge, net], dev).collect()}
    assert got[0] < 0.5 < 0.9 < got[1] and net.losses[-1] < 0.2 * net.losses[0]
    assert rg.select_best([ridge, net], dev, 1)[0][0] is net
    assert rg.predict(net, dev).count() == dev.count()


def test_spread_of_the_rows_does_not_matter(spark):
    train, dev = curved(spark, 120)
    one, three = (nw.fit_network(train.repartition(p), dev, hidden=(4,), rounds=1, steps=5, shares=s, local=1) for p, s in ((2, 1), (5, 3)))
    assert np.allclose(nw.flat(one.params), nw.flat(three.params), atol=1e-9) and np.allclose(one.losses, three.losses)


def test_early_stop_small_batches_and_odd_inputs(spark):
    train, dev = curved(spark, 120)
    flat = nw.fit_network(train, dev.withColumn("label", F.lit(1.0)), hidden=(3,), rounds=3, steps=2, shares=2)
    assert flat.dev == [None] * 3
    stopped = nw.fit_network(train, dev, hidden=(3,), rounds=20, steps=1, rate=0.0, patience=2, shares=2)
    assert len(stopped.dev) == 3 and stopped.converged
    some = nw.fit_network(train, dev, hidden=(8,), rounds=2, steps=40, batch=16, shares=2)
    assert some.losses[-1] < some.losses[0]
    with pytest.raises(ValueError, match="labelled"):
        nw.fit_network(train.withColumn("label", F.lit(None).cast("double")), dev)
