"""Linear forecasters solved from moments, and their MLlib counterparts.

The solvers see p x p matrices only. Standardisation is that of the training rows
(population deviation; a constant column gets coefficient 0).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.models.moments import Moments


@dataclass
class LinearFit:
    predictors: list[str]
    standardized: np.ndarray
    coefficients: np.ndarray
    intercept: float
    score_variance: np.ndarray | None = None

    def expression(self) -> Column:
        """The forecast as a built-in expression over the predictor columns."""
        terms = [F.lit(float(b)) * F.col(c).cast("double") for c, b in zip(self.predictors, self.coefficients) if b != 0.0]
        while len(terms) > 1:  # pairwise, so that the tree stays shallow
            terms = [terms[k] + terms[k + 1] if k + 1 < len(terms) else terms[k] for k in range(0, len(terms), 2)]
        return F.lit(float(self.intercept)) + terms[0] if terms else F.lit(float(self.intercept))


def _standardised(m: Moments):
    means, cov = m.centred()
    var = np.diag(cov)[1:].copy()
    live = var > 1e-14 * np.maximum(1.0, means[1:] ** 2)
    sd = np.where(live, np.sqrt(np.maximum(var, 0.0)), 1.0)
    gram = np.where(np.outer(live, live), cov[1:, 1:] / np.outer(sd, sd), 0.0)
    xy = np.where(live, cov[0, 1:] / sd, 0.0)
    return means, sd, gram, xy


def _finish(predictors, means, sd, w, score_variance=None) -> LinearFit:
    coef = w / sd
    return LinearFit(list(predictors), w, coef, float(means[0] - coef @ means[1:]), score_variance)


def solve_ols(m: Moments, predictors: Sequence[str]) -> LinearFit:
    means, sd, gram, xy = _standardised(m)
    return _finish(predictors, means, sd, np.linalg.lstsq(gram, xy, rcond=1e-12)[0])


def solve_elastic_net(
    m: Moments, predictors: Sequence[str], alpha: float, l1_ratio: float, max_iter: int = 20_000, tol: float = 1e-10
) -> LinearFit:
    """Coordinate descent with covariance updates on the correlation matrix (Friedman et al. 2010)."""
    return solve_elastic_path(m, predictors, [alpha], l1_ratio, max_iter, tol)[0]


def solve_elastic_path(
    m: Moments, predictors: Sequence[str], alphas: Sequence[float], l1_ratio: float, max_iter: int = 20_000, tol: float = 1e-10, sweeps: list[int] | None = None
) -> list[LinearFit]:
    """Elastic nets of one ratio for several penalties, in the order given; solved from the largest penalty down, each from the last solution.

    Only predictors that the sequential strong rule (Tibshirani et al. 2012) keeps, or that are in the model, are swept; what it discards is checked
    against the optimality conditions afterwards and let in if it breaks them, so the fits are those of full sweeps. ``sweeps`` collects their number of coordinate steps.
    """
    means, sd, gram, xy = _standardised(m)
    w, live, fits = np.zeros(len(xy)), np.diag(gram) > 0.0, {}
    last = float(np.abs(xy).max(initial=0.0)) / max(l1_ratio, 1e-12)
    for alpha in sorted(set(alphas), reverse=True):
        cut, ridge, steps = alpha * l1_ratio, alpha * (1 - l1_ratio), 0
        kept = live & ((w != 0.0) | (np.abs(xy - gram @ w) >= l1_ratio * (2 * alpha - max(last, alpha))))
        while True:
            own = np.flatnonzero(kept)
            inner, part = gram[np.ix_(own, own)], w[own]
            gradient, scale = xy[own] - inner @ part, np.diag(inner)
            active, settled = np.arange(len(own)), False
            for _ in range(max_iter):
                biggest = 0.0
                for j in active:
                    z = gradient[j] + scale[j] * part[j]
                    new = np.sign(z) * max(abs(z) - cut, 0.0) / (scale[j] + ridge)
                    step = new - part[j]
                    if step != 0.0:
                        gradient -= step * inner[:, j]
                        part[j] = new
                        biggest = max(biggest, abs(step))
                steps += len(active)
                if biggest <= tol:
                    if len(active) == len(own):
                        settled = True
                        break
                    active = np.arange(len(own))
                elif len(active) == len(own):
                    # Until the nonzero coefficients settle only these are swept.
                    active = np.flatnonzero(part)
            if not settled:
                raise RuntimeError(f"elastic net (alpha {alpha}, ratio {l1_ratio}) did not settle in {max_iter} sweeps")
            w = np.zeros(len(xy))
            w[own] = part
            broken = live & ~kept & (np.abs(xy - gram @ w) > cut + tol)
            if not broken.any():
                break
            kept |= broken
        if sweeps is not None:
            sweeps.append(steps)
        fits[alpha], last = _finish(predictors, means, sd, w), alpha
    return [fits[a] for a in alphas]


def solve_pls(m: Moments, predictors: Sequence[str], n_components: int) -> list[LinearFit]:
    """PLS1 by the kernel form of Dayal and MacGregor (1997); one fit per number of components 1..k."""
    means, sd, gram, xy = _standardised(m)
    p, r_all, p_all, fits = len(xy), [], [], []
    remaining, w_sum, variances = xy.copy(), np.zeros(len(xy)), []
    scale = m.n / max(m.n - 1.0, 1.0)
    for _ in range(min(n_components, p)):
        norm = np.linalg.norm(remaining)
        if norm <= 1e-14 * max(1.0, np.linalg.norm(xy)):
            break
        r = remaining / norm
        for loading, direction in zip(p_all, r_all):
            r = r - (loading @ (remaining / norm)) * direction
        t2 = float(r @ gram @ r)
        if t2 <= 1e-14:
            break
        loading, q = gram @ r / t2, float(r @ xy) / t2
        remaining = remaining - loading * q * t2
        w_sum = w_sum + r * q
        r_all.append(r)
        p_all.append(loading)
        variances.append(t2 * scale)
        fits.append(_finish(predictors, means, sd, w_sum.copy(), np.array(variances)))
    if not fits:
        fits.append(_finish(predictors, means, sd, w_sum, np.array([])))
    while len(fits) < n_components:  # further components add nothing
        fits.append(fits[-1])
    return fits


def coefficient_rows(spark: SparkSession, fits: dict[str, LinearFit]) -> DataFrame:
    """(model, ordinal, predictor, standardized_coefficient), input of the coefficient table."""
    rows = [
        (model, i, c, float(b)) for model, f in fits.items() for i, (c, b) in enumerate(zip(f.predictors, f.standardized))
    ]
    return spark.createDataFrame(rows, "model string, ordinal int, predictor string, standardized_coefficient double")


def component_rows(spark: SparkSession, fit: LinearFit) -> DataFrame:
    rows = [(k, float(v)) for k, v in enumerate(fit.score_variance, 1)]
    return spark.createDataFrame(rows, "component int, x_score_variance double")


# --- MLlib -------------------------------------------------------------------
def _moments_columns(train: DataFrame, predictors: Sequence[str], target: str):
    row = train.agg(
        *[F.avg(F.col(c).cast("double")) for c in predictors],
        *[F.stddev_pop(F.col(c).cast("double")) for c in predictors],
        F.stddev_samp(target),
    ).first()
    p = len(predictors)
    return [float(v) for v in row[:p]], [float(v) for v in row[p: 2 * p]], float(row[2 * p])


def scale_columns(df: DataFrame, predictors: Sequence[str], means: Sequence[float], deviations: Sequence[float]) -> DataFrame:
    """Standardise with given training statistics; constant columns become 0."""
    scaled = {
        c: ((F.col(c).cast("double") - F.lit(m)) / F.lit(s) if s > 0 else F.lit(0.0)).alias(c)
        for c, m, s in zip(predictors, means, deviations)
    }
    return df.select(*[scaled.get(c, F.col(c)) for c in df.columns])


def fit_linear_mllib(
    train: DataFrame, predictors: Sequence[str], target: str, alpha: float | None = None, l1_ratio: float = 0.5
) -> LinearFit:
    """OLS (``alpha=None``) or elastic net with MLlib on standardised columns.

    MLlib scales the label by its deviation s and both penalties with it; asking for the penalties
    a1 = alpha r and a2 = alpha (1 - r) of the usual objective means lambda = a1 + a2 s, ratio = a1 / lambda.
    """
    means, sds, label_sd = _moments_columns(train, predictors, target)
    scaled = scale_columns(train, predictors, means, sds)
    data = VectorAssembler(inputCols=list(predictors), outputCol="__x").transform(scaled).select("__x", F.col(target).alias("__y"))
    if alpha is None:
        estimator = LinearRegression(featuresCol="__x", labelCol="__y", regParam=0.0, solver="normal")
    else:
        a1, a2 = alpha * l1_ratio, alpha * (1 - l1_ratio)
        lam = a1 + a2 * label_sd
        estimator = LinearRegression(
            featuresCol="__x", labelCol="__y", regParam=lam, elasticNetParam=a1 / lam if lam else 0.0,
            standardization=False, maxIter=5000, tol=1e-12,
        )
    model = estimator.fit(data)
    w = np.array(model.coefficients.toArray())
    sd = np.array([s if s > 0 else 1.0 for s in sds])
    coef = w / sd
    return LinearFit(list(predictors), w, coef, float(model.intercept - coef @ np.array(means)))
