"""Regressor on embeddings: M5, M6, M7, T5.

Re-aimed from a hand-written neural net to Spark ML (which has no regression
MLP): ``array_to_vector`` -> ``StandardScaler`` -> ridge regression per
regularisation value, and gradient-boosted trees as the non-linear choice. The
scaler is fitted once; the scaled training rows are written once, so fitting
re-reads files. All candidates score the dev rows in one plan and are judged
by one grouped evaluation (Spearman, Pearson, log-cosh), as in the reference's
checkpointing by dev Spearman; the best two are kept (T5).
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import StandardScaler, StandardScalerModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnscore.operators.agreement import correlations, log_cosh_loss

#: The closed-form solver takes up to so many features; beyond, L-BFGS fits.
CLOSED_FORM_FEATURES = 4096


class RankCorrelationEvaluator(Evaluator):
    """M7: Spearman (default), Pearson or log-cosh of predictions against the
    label, computed with the distributed rank plan."""

    def __init__(self, metric: str = "spearman", labelCol: str = "label", predictionCol: str = "prediction"):
        super().__init__()
        self.metric, self.labelCol, self.predictionCol = metric, labelCol, predictionCol

    def _evaluate(self, dataset: DataFrame) -> float:
        d = dataset.select(F.col(self.labelCol).cast("double").alias("gold"),
                           F.col(self.predictionCol).cast("double").alias("score"), F.lit("all").alias("g"))
        if self.metric == "log_cosh":
            row = log_cosh_loss(d, ["g"]).first()
            return float(row["log_cosh"]) if row else float("nan")
        row = correlations(d, ["g"]).first()
        v = row[self.metric] if row else None
        return float(v) if v is not None else float("nan")

    def isLargerBetter(self) -> bool:
        return self.metric != "log_cosh"


def dev_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> dict[str, float]:
    """Spearman and Pearson (one correlation pass) and log-cosh of a scored
    dev set; two small jobs."""
    d = pred.select(F.col(label).cast("double").alias("gold"), F.col(prediction).cast("double").alias("score"),
                    F.lit("all").alias("g"))
    c = correlations(d, ["g"]).first()
    lc = log_cosh_loss(d, ["g"]).first()

    def val(row, k):
        return float(row[k]) if row is not None and row[k] is not None else float("nan")

    return {"spearman": val(c, "spearman"), "pearson": val(c, "pearson"), "log_cosh": val(lc, "log_cosh")}


def features(df: DataFrame, vec: str = "features") -> DataFrame:
    """Embedding arrays as ML vectors."""
    return df.withColumn("_vec", array_to_vector(F.col(vec)))


@dataclass
class Candidate:
    """A fitted regressor with the scaler that its input goes through."""

    name: str
    reg_param: float | None
    scaler: StandardScalerModel
    model: Model
    converged: bool = True

    def transform(self, df: DataFrame, vec: str = "features", out: str = "prediction") -> DataFrame:
        scaled = self.scaler.transform(features(df, vec))
        return self.model.copy().setPredictionCol(out).transform(scaled).drop("_vec", "_scaled")


def fit_candidates(
    train: DataFrame, reg_params: Sequence[float] = (0.0, 0.1, 1.0), label: str = "label",
    vec: str = "features", max_iter: int = 100, trees: bool = False,
) -> list[Candidate]:
    """M5: one ridge regression per regularisation value and, with ``trees``, a
    boosted-tree regressor. The scaled training rows are written to the shared
    folder first: every pass re-reads them, and a lost executor re-reads files
    instead of recomputing the feature lineage. Up to ``CLOSED_FORM_FEATURES``
    features a ridge is solved in closed form (one pass), beyond by L-BFGS;
    a fit that used up ``max_iter`` is warned of and marked."""
    from turnscore.session import reliable_checkpoint

    data = features(train, vec).where(F.col(label).isNotNull() & ~F.isnan(F.col(label).cast("double")))
    scaler = StandardScaler(inputCol="_vec", outputCol="_scaled", withMean=True, withStd=True).fit(data)
    rows = reliable_checkpoint(scaler.transform(data).select(F.col(label).cast("double").alias("_label"), "_scaled"))
    closed = len(scaler.mean) <= CLOSED_FORM_FEATURES
    out = []
    for rp in reg_params:
        fit = LinearRegression(featuresCol="_scaled", labelCol="_label", predictionCol="prediction", regParam=rp, maxIter=max_iter,
                               standardization=False, solver="normal" if closed else "l-bfgs").fit(rows)
        done = closed or fit.summary.totalIterations < max_iter
        if not done:
            warnings.warn(f"ridge with reg_param={rp} did not converge in {max_iter} iterations", stacklevel=2)
        out.append(Candidate("ridge", float(rp), scaler, fit, done))
    if trees:
        fit = GBTRegressor(featuresCol="_scaled", labelCol="_label", predictionCol="prediction", maxIter=10, maxDepth=3, seed=42).fit(rows)
        out.append(Candidate("trees", None, scaler, fit))
    return out


def evaluate_candidates(models: Sequence[Candidate], dev: DataFrame, label: str = "label", vec: str = "features") -> DataFrame:
    """M7 for all candidates at once: (candidate, n, spearman, pearson, log_cosh);
    every dev row is scored by all models in one plan."""
    scored = dev
    for i, m in enumerate(models):
        scored = m.transform(scored, vec, f"_p{i}")
    cells = F.array(*[F.struct(F.lit(i).alias("candidate"), F.col(f"_p{i}").cast("double").alias("score")) for i in range(len(models))])
    rows = scored.select(F.col(label).cast("double").alias("gold"), F.inline(cells))
    rank = correlations(rows, ["candidate"])
    return rank.join(log_cosh_loss(rows, ["candidate"]).drop("n"), "candidate", "left").select(
        "candidate", "n", "spearman", "pearson", "log_cosh")


def predict(model: Candidate, df: DataFrame, id_col: str = "dialogue_id", label: str = "label",
            vec: str = "features") -> DataFrame:
    """M6: ``(id, prediction, gold)`` (real gold, NULL when absent; the
    export writes -1 for NULL at the sink)."""
    out = model.transform(df, vec)
    gold = F.col(label).cast("double") if label in df.columns else F.lit(None).cast("double")
    return out.select(id_col, F.col("prediction").cast("double").alias("prediction"), gold.alias("gold"))


def select_best(
    models: Sequence[Candidate], dev: DataFrame, keep: int = 2, label: str = "label", vec: str = "features", metric: str = "spearman",
) -> list[tuple[Candidate, float]]:
    """T5: rank candidates by a dev metric (Spearman; ``log_cosh``: the smallest),
    keep the best ``keep`` (the first is the model to reload). The candidate
    list is a handful of models."""
    found = {r["candidate"]: r[metric] for r in evaluate_candidates(models, dev, label, vec).collect()}
    sign = 1 if metric == "log_cosh" else -1
    worst = float("inf")
    order = sorted(range(len(models)), key=lambda i: (sign * found[i] if found.get(i) is not None else worst, i))
    return [(models[i], found.get(i) if found.get(i) is not None else float("nan")) for i in order[:keep]]
