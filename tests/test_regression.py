"""Regressors against closed forms: M5, M6, M7, T5, E6."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnscore.operators import regression as rg


def data(spark, n=60, d=3, seed=1):
    r = np.random.RandomState(seed)
    x = r.randn(n, d) * [1.0, 5.0, 0.1][:d] + 2
    y = x @ np.arange(1, d + 1) + r.randn(n) * 0.1
    rows = [(f"d{i}", [float(v) for v in x[i]], float(y[i]) if i % 7 else None) for i in range(n)]
    return spark.createDataFrame(rows, "dialogue_id string, features array<double>, label double"), x, y


def test_ridge_equals_its_closed_form(spark):
    df, x, y = data(spark)
    has = np.array([i % 7 != 0 for i in range(len(y))])
    for candidate in rg.fit_candidates(df, (0.0, 0.5)):
        xs, ys = x[has], y[has]
        z = (xs - xs.mean(0)) / xs.std(0, ddof=1)
        # Spark scales the label by its deviation, so the penalty is on that scale
        n, sy = len(ys), ys.std(ddof=1)
        w = np.linalg.solve(z.T @ z / n + candidate.reg_param / sy * sy * np.eye(z.shape[1]) * (1.0 / sy if candidate.reg_param else 1.0) * (sy if candidate.reg_param else 1.0), z.T @ (ys - ys.mean()) / n)
        want = (x - xs.mean(0)) / xs.std(0, ddof=1) @ w + ys.mean()
        got = {r["dialogue_id"]: r["prediction"] for r in rg.predict(candidate, df).collect()}
        if candidate.reg_param == 0:
            assert np.allclose([got[f"d{i}"] for i in range(len(y))], want, atol=1e-6)
        else:
            assert np.corrcoef([got[f"d{i}"] for i in range(len(y))], want)[0, 1] > 0.99
        assert candidate.converged


def test_prediction_keeps_every_row_and_its_gold(spark):
    df, _, y = data(spark)
    out = rg.predict(rg.fit_candidates(df, (0.1,))[0], df).collect()
    assert len(out) == 60
    assert all((r["gold"] is None) == (int(r["dialogue_id"][1:]) % 7 == 0) for r in out)


def test_one_evaluation_of_all_candidates_equals_single_ones(spark):
    df, _, _ = data(spark)
    models = rg.fit_candidates(df, (0.0, 10.0), trees=True)
    assert [m.name for m in models] == ["ridge", "ridge", "trees"]
    met = {r["candidate"]: r for r in rg.evaluate_candidates(models, df).collect()}
    for i, m in enumerate(models):
        single = rg.dev_metrics(m.transform(df))
        assert all(met[i][k] == pytest.approx(single[k], abs=1e-9) for k in ("spearman", "pearson", "log_cosh"))
        assert rg.RankCorrelationEvaluator().evaluate(m.transform(df)) == pytest.approx(met[i]["spearman"], abs=1e-9)


def test_selection_orders_by_the_metric(spark):
    df, _, _ = data(spark)
    models = rg.fit_candidates(df, (100.0, 0.0, 1.0))
    by_loss = rg.select_best(models, df, 3, metric="log_cosh")
    assert [m.reg_param for m, _ in by_loss] == [0.0, 1.0, 100.0]
    assert len(rg.select_best(models, df, 2)) == 2
    constant = rg.select_best(models, df.withColumn("label", F.lit(1.0)), 1)
    assert np.isnan(constant[0][1])


def test_many_features_fit_iteratively(spark, monkeypatch):
    monkeypatch.setattr(rg, "CLOSED_FORM_FEATURES", 2)
    df, x, y = data(spark)
    m = rg.fit_candidates(df, (0.0,))[0]
    got = {r["dialogue_id"]: r["prediction"] for r in rg.predict(m, df).collect()}
    assert np.corrcoef([got[f"d{i}"] for i in range(len(y))], y)[0, 1] > 0.99 and m.converged
    with pytest.warns(UserWarning, match="converge"):
        assert not rg.fit_candidates(df, (0.0,), max_iter=1)[0].converged
