"""Expanding-window grid search and the final refit."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.functions import names
from panelmill.models.grid import CANDIDATES, FIXED, candidate_rows, candidate_table
from panelmill.models.linear import LinearFit, coefficient_rows, component_rows, solve_elastic_net, solve_elastic_path, solve_ols, solve_pls
from panelmill.models.boosting import Run, boost, tree_summary
from panelmill.models.forest import ForestRun, grow
from panelmill.models.moments import Moments, combine, fold_moments, require_complete
from panelmill.models.trees import complexity_rows, importance_rows, oob_metrics
from panelmill.operators.evaluate import forecast_metrics, rank_models
from panelmill.operators.folds import fold_bounds, fold_table, summarise_folds
from panelmill.operators.quality import expect, never, no_infinities, no_nulls
from panelmill.operators.relational import missing_keys, union_all
from panelmill.operators.reports import coefficient_table, cumulative_share, importance_table
from panelmill.session import cut_lineage, drop_stored

LINEAR = ("pls", "elastic_net")
TREES = ("random_forest", "gradient_boosting")
#: Bytes of stored trees that the forests of a grid hold at once: so many, or so many for every row if these are more. A tree takes about ``TREE_BYTES`` for each row it learns from.
STORED_BYTES, STORED_A_ROW, TREE_BYTES = 1 << 30, 64, 2


def linear_candidates(m: Moments, predictors: Sequence[str], family: str, settings: Sequence[dict]) -> list[LinearFit]:
    if family == "pls":
        path = solve_pls(m, predictors, max(s["n_components"] for s in settings))
        return [path[s["n_components"] - 1] for s in settings]
    ratios = {s["l1_ratio"] for s in settings}
    paths = {r: iter(solve_elastic_path(m, predictors, [s["alpha"] for s in settings if s["l1_ratio"] == r], r)) for r in ratios}
    return [next(paths[s["l1_ratio"]]) for s in settings]


def tune_linear(
    df: DataFrame, time: str, predictors: Sequence[str], target: str, years: Sequence[int], candidates=CANDIDATES
) -> DataFrame:
    """Fold scores (candidate_id, validation_year, monthly_mse) of all linear candidates.

    One pass over the rows for the moments, one to score every candidate in every fold: validation rows
    of a year meet the coefficient matrix of that year's fold (p x candidates numbers per fold). The fits of all folds and
    families are solved side by side in tasks, from the years' moments (years x p x p numbers, sent once). A missing value raises.
    """
    spark = df.sparkSession
    predictors = list(predictors)
    per_year = fold_moments(df, time, predictors, target)
    families = [f for f in LINEAR if f in candidates]
    ids = [r[1] for r in candidate_rows(families, candidates)]
    for year in years:
        if year not in per_year or min(per_year) >= year:
            raise ValueError(f"empty fold for validation year {year}")
    sent = spark.sparkContext.broadcast(per_year)
    # The components of one PLS fit are a path, and so are the elastic nets of one ratio: a job solves the candidates of its path, named by their places in the grid.
    paths = {
        f: [list(range(len(candidates[f])))] if f == "pls"
        else [[k for k, s in enumerate(candidates[f]) if s["l1_ratio"] == r] for r in dict.fromkeys(s["l1_ratio"] for s in candidates[f])]
        for f in families
    }
    jobs = [(int(y), f, path) for y in years for f in families for path in paths[f]]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for year, family, path in batch.itertuples(index=False):
                m = combine([m for y, m in sent.value.items() if y < year])
                for at, fit in zip(path, linear_candidates(m, predictors, family, [candidates[family][k] for k in path]), strict=True):
                    at = int(at)
                    yield pd.DataFrame({"year": [year], "family": [family], "k": [at], "w": [fit.coefficients.tolist()], "a": [fit.intercept]})

    solved = spark.createDataFrame(jobs, "year int, family string, path array<int>").repartition(len(jobs)).mapInPandas(solve, "year int, family string, k int, w array<double>, a double")
    fits = {(r.year, r.family, r.k): (r.w, r.a) for r in solved.collect()}
    order = [(f, k) for f in families for k in range(len(candidates[f]))]
    matrices = {y: (np.column_stack([fits[y, f, k][0] for f, k in order]), np.array([fits[y, f, k][1] for f, k in order])) for y in map(int, years)}

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, y = batch[predictors].to_numpy(dtype=float), batch["__y"].to_numpy(dtype=float)
            when = batch["__year"].to_numpy()
            for year in np.unique(when):
                rows = when == year
                b, a = matrices[int(year)]
                squared = (y[rows, None] - x[rows] @ b - a) ** 2
                by_month = pd.DataFrame(squared, columns=ids).groupby(batch["__month"].to_numpy()[rows])
                sums = by_month.sum().rename_axis("month").reset_index().melt("month", var_name="candidate_id", value_name="sse")
                sizes = by_month.size().rename_axis("month").rename("n").reset_index()
                yield sums.merge(sizes, on="month")[["month", "candidate_id", "sse", "n"]]

    validation = df.filter(F.year(time).isin([int(y) for y in years])).select(
        F.col(time).alias("__month"), F.year(time).alias("__year"), F.col(target).cast("double").alias("__y"),
        *[F.col(c).cast("double").alias(c) for c in predictors],
    )
    parts = validation.mapInPandas(score, "month date, candidate_id string, sse double, n long")
    by_month = parts.groupBy("candidate_id", "month").agg((F.sum("sse") / F.sum("n")).alias("mse"))
    return by_month.groupBy("candidate_id", F.year("month").alias("validation_year")).agg(F.avg("mse").alias("monthly_mse"))


def tune_trees(
    df: DataFrame, time: str, predictors: Sequence[str], target: str, years: Sequence[int], candidates=CANDIDATES,
    keys: Sequence[str] = (), **tree_options,
) -> DataFrame:
    """Fold scores of all tree candidates.

    Sizes of a family share their fits: one forest of the largest size per fold and one boosting run per (rate, depth) and fold. All forests
    advance in step, and so do all boosting runs. Forests that would fill more than ``STORED_BYTES`` grow some trees at a time: these vote and go, and only the sums of their votes
    are kept. ``keys`` name the rows for the bootstrap (by default all their values do). A missing value raises.
    """
    require_complete(df, [target, *predictors])
    keys = list(keys) or [time, target, *predictors]
    plain = cut_lineage(df.select(*dict.fromkeys([*keys, time, target, *predictors])).withColumn("__row", F.monotonically_increasing_id()))
    years = [int(y) for y in years]

    def scores(scored: DataFrame, columns: dict[str, str], year: int) -> list[tuple]:
        """Mean over the months of the monthly mean squared error of every candidate, in one aggregate."""
        months = scored.groupBy(time).agg(*[F.avg((F.col(target) - F.col(c)) ** 2).alias(c) for c in set(columns.values())])
        means = months.agg(*[F.avg(c).alias(c) for c in set(columns.values())]).first()
        return [(cid, year, means[c]) for cid, c in columns.items()]

    found: list[tuple] = []
    if "random_forest" in candidates:
        sizes = [s["n_estimators"] for s in candidates["random_forest"]]
        validation = plain.filter(F.year(time).isin(years))
        per_year = plain.groupBy(F.year(time).alias("y")).count().collect()
        learning, rows = sum(r["count"] for r in per_year for y in years if r.y is not None and r.y < y), sum(r["count"] for r in per_year)
        step = max(1, int(max(STORED_BYTES, STORED_A_ROW * rows) // (TREE_BYTES * max(1, learning))))
        names = [f"random_forest_{i:03d}" for i in range(1, len(sizes) + 1)]
        kept = None
        for start in range(0, max(sizes), step):
            stop = min(max(sizes), start + step)
            forest = grow(plain, predictors, target, keys, [ForestRun(str(y), stop - start, y, start) for y in years], F.year(time), **tree_options)
            own = {c: min(n, stop) - start for c, n in zip(names, sizes, strict=True) if n > start}
            if forest.subtrees is None:
                voted = union_all(*[forest.forecasts(plain.filter(F.year(time) == y), {c: (k, n) for c, n in own.items()}) for k, y in enumerate(years)])
            else:  # The stored trees of all folds are read once.
                voted = forest.fold_forecasts(validation, F.array_position(F.array(*[F.lit(y) for y in years]), F.year(time)) - 1, own)
            part = cut_lineage(voted.select("__row", *[(F.col(c) * own[c] if c in own else F.lit(0.0)).alias(c) for c in names]))
            forest.drop()
            if kept is not None:
                before = [kept, part]
                part = cut_lineage(kept.unionByName(part).groupBy("__row").agg(*[F.sum(c).alias(c) for c in names]))
                drop_stored(*before)
            kept = part
        means = [(F.col(c) / n).alias(c) for c, n in zip(names, sizes, strict=True)]
        scored = cut_lineage(validation.select("__row", time, target).join(kept, "__row").select(time, target, *means))
        drop_stored(kept)
        for year in years:
            found += scores(scored.filter(F.year(time) == year), {c: c for c in names}, year)
        drop_stored(scored)
    grid = candidates.get("gradient_boosting", [])
    if grid:
        settings = sorted({(s["learning_rate"], s["max_depth"]) for s in grid})
        most = {key: max(s["n_estimators"] for s in grid if (s["learning_rate"], s["max_depth"]) == key) for key in settings}
        keys = [(year, *key) for year in years for key in settings]
        model = boost(plain, predictors, target, [Run(str(k), k[1], k[2], most[k[1:]], before=k[0]) for k in keys], F.year(time))
        for year in years:
            members = {f"gradient_boosting_{i:03d}": (keys.index((year, s["learning_rate"], s["max_depth"])), s["n_estimators"]) for i, s in enumerate(grid, 1)}
            scored = model.forecasts(plain.filter(F.year(time) == year), members)
            found += scores(scored, {c: c for c in members}, year)
    drop_stored(plain)
    return df.sparkSession.createDataFrame(found, "candidate_id string, validation_year int, monthly_mse double")


STORED = "sample string, parameters string, candidate_id string, validation_year int, monthly_mse double"


def sample_mark(df: DataFrame, columns: Sequence[str], *settings) -> str:
    """Names a problem by its rows (in any order) and settings, so that a store never lends scores to another one."""
    h = F.xxhash64(*columns)
    rows = df.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1 << 24)))).first()
    return hashlib.blake2b(json.dumps([*rows, list(columns), *settings], default=str, sort_keys=True).encode(), digest_size=16).hexdigest()


def _stored(spark: SparkSession, store: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    return spark.read.schema(STORED).parquet(store)


def resumed_scores(
    df: DataFrame, time: str, predictors: Sequence[str], target: str, years: Sequence[int], store: str, candidates=CANDIDATES,
    keys: Sequence[str] = (), commit_folds: int = 1, **tree_options,
) -> DataFrame:
    """Fold scores as ``tune_linear`` and ``tune_trees`` give them, committed step by step to the folder ``store``.

    An anti-join of the wanted (candidate, fold) pairs with the store finds what is left; only that is tuned. The linear families are one step, as they share
    their passes; a tree family takes ``commit_folds`` folds a step. A step's scores are one small file, so it is there as a whole or not at all: a lost driver
    costs one step. Scores count only for the same rows, settings and parameters; pairs that two runs committed count once.
    """
    spark, years = df.sparkSession, [int(y) for y in years]
    mark = sample_mark(df, list(dict.fromkeys([*keys, time, target, *predictors])), time, target, list(keys), tree_options)
    wanted = spark.createDataFrame(
        [(mark, f, parameters, cid, y) for f, cid, parameters, *_ in candidate_rows(list(candidates), candidates) for y in years],
        "sample string, family string, parameters string, candidate_id string, validation_year int",
    )
    pair = ["sample", "parameters", "candidate_id", "validation_year"]
    left = wanted.join(_stored(spark, store), pair, "left_anti").select("family", *pair).collect()  # candidates x folds at most
    open_years = {f: sorted({r.validation_year for r in left if r.family == f}) for f in candidates}
    steps = []
    linear = [f for f in LINEAR if open_years.get(f)]
    if linear:
        steps.append((linear, sorted({y for f in linear for y in open_years[f]})))
    for start in range(0, len(years), commit_folds):
        # Steps hold the same folds in every run, so a resumed run grows the same trees.
        chunk = years[start : start + commit_folds]
        steps += [([f], chunk) for f in TREES if set(chunk) & set(open_years.get(f, ()))]
    lacking = spark.createDataFrame(left, "family string, sample string, parameters string, candidate_id string, validation_year int") if left else None
    for families, folds in steps:
        part = {f: candidates[f] for f in families}
        if families[0] in LINEAR:
            scores = tune_linear(df, time, predictors, target, folds, part)
        else:
            scores = tune_trees(df, time, predictors, target, folds, part, keys, **tree_options)
        fresh = scores.join(F.broadcast(lacking), ["candidate_id", "validation_year"])  # candidates x folds at most
        fresh.select(*pair, "monthly_mse").coalesce(1).write.mode("append").parquet(store)
    known = _stored(spark, store).join(F.broadcast(wanted), pair, "left_semi")
    return known.groupBy("candidate_id", "validation_year").agg(F.min("monthly_mse").alias("monthly_mse"))


def tune(
    df: DataFrame, time: str, predictors: Sequence[str], target: str, years: Sequence[int], candidates=CANDIDATES,
    fixed=FIXED, keys: Sequence[str] = (), store: str | None = None, commit_folds: int = 1, **tree_options,
) -> tuple[DataFrame, DataFrame]:
    """(fold results, candidate summary) over all families of ``candidates``. With a folder ``store`` a stopped run goes on where it was (``resumed_scores``)."""
    spark = df.sparkSession
    parts = []
    if store:
        parts.append(resumed_scores(df, time, predictors, target, years, store, candidates, keys, commit_folds, **tree_options))
    elif any(f in candidates for f in LINEAR):
        parts.append(tune_linear(df, time, predictors, target, years, candidates))
    if not store and any(f in candidates for f in TREES):
        parts.append(tune_trees(df, time, predictors, target, years, candidates, keys, **tree_options))
    scores = parts[0]
    for part in parts[1:]:
        scores = scores.unionByName(part)
    grid = candidate_table(spark, list(candidates), candidates, fixed)
    bounds = fold_bounds(df, fold_table(spark, years), time)
    results = scores.join(F.broadcast(grid), "candidate_id").join(F.broadcast(bounds), "validation_year")  # tens of rows
    summary = summarise_folds(
        results, ["model_family", "candidate_id", "parameters", "model_parameters", "is_original_fixed_configuration"]
    )
    return results, summary


def selected_settings(selected: DataFrame) -> dict[str, dict]:
    """Typed settings of the chosen candidates, one row per family."""
    return {r.model_family: json.loads(r.parameters) for r in selected.select("model_family", "parameters").collect()}


def fit_and_forecast(
    fit_sample: DataFrame,
    samples: dict[str, DataFrame],
    keys: Sequence[str],
    month: str,
    predictors: Sequence[str],
    target: str,
    settings: dict[str, dict],
    ols_predictors: Sequence[str] = tuple(names.OLS3_PREDICTORS),
    **tree_options,
) -> dict[str, DataFrame]:
    """Fit the historical mean, OLS on few predictors and the given families on one sample; forecast others.

    ``settings`` maps family to parameters. Returns predictions, metrics (one row per model and sample), coefficients,
    complexity and, where they apply, importances, components and out-of-bag metrics. A missing value in any sample raises: no row
    to forecast is left out. All trees of the forest that is reported vote out of bag.
    """
    spark = fit_sample.sparkSession
    predictors, out, fits, sizes, importances, forest = list(predictors), [], {}, {}, {}, None
    result: dict[str, DataFrame] = {}
    usable = fit_sample
    mean = require_complete(usable, [target, *predictors], "sample to fit")[0]
    for name, df in samples.items():
        require_complete(df, [target, *predictors], name)
    rows = {s: df.select(*keys, month, target, *predictors) for s, df in samples.items()}

    def finish(model: str, value, scored: dict[str, DataFrame]) -> None:
        for sample, df in scored.items():
            out.append(
                df.select(
                    *keys, month, F.col(target).alias("realized_target"), value.cast("double").alias("prediction"),
                    F.lit(float(mean)).alias("benchmark"), F.lit(model).alias("model"), F.lit(sample).alias("sample"),
                )
            )

    finish("historical_mean", F.lit(float(mean)), rows)
    moments = combine(list(fold_moments(usable, month, predictors, target).values()))
    at = [0, 1, *[2 + predictors.index(c) for c in ols_predictors]]
    small = Moments(moments.cross[np.ix_(at, at)], moments.shift[[i - 1 for i in at[1:]]])
    fits["ols_3"] = solve_ols(small, ols_predictors)
    if "pls" in settings:
        fits["pls"] = solve_pls(moments, predictors, settings["pls"]["n_components"])[-1]
        sizes["pls"] = {"pls_components": len(fits["pls"].score_variance)}
    if "elastic_net" in settings:
        fits["elastic_net"] = solve_elastic_net(moments, predictors, settings["elastic_net"]["alpha"], settings["elastic_net"]["l1_ratio"])
    for model, fit in fits.items():
        finish(model, fit.expression(), rows)
        if model != "pls":
            nonzero = int(np.sum(np.abs(fit.standardized) > names.COEFFICIENT_TOLERANCE))
            sizes[model] = {"nonzero_coefficients": nonzero, "nonzero_share": nonzero / len(fit.predictors)}
        sizes[model]["number_of_predictors"] = len(fit.predictors)
    if "random_forest" in settings:
        n = settings["random_forest"]["n_estimators"]
        forest = grow(usable, predictors, target, [*keys, month], [ForestRun("final", n)], **tree_options)
        finish("random_forest", F.col("__forest"), {s: forest.forecasts(df, {"__forest": (0, n)}) for s, df in rows.items()})
        importances["random_forest"] = forest.importances()
        sizes["random_forest"] = {**forest.summary(), "number_of_predictors": len(predictors)}
        voted = forest.out_of_bag(usable.select(*keys, month, target, *predictors))
        result["oob"] = cut_lineage(oob_metrics(voted, month, target))
    if "gradient_boosting" in settings:
        g = settings["gradient_boosting"]
        boosted = boost(usable, predictors, target, [Run("final", g["learning_rate"], g["max_depth"], g["n_estimators"])])
        finish("gradient_boosting", F.col("__boosted"), {s: boosted.forecasts(df, {"__boosted": (0, g["n_estimators"])}) for s, df in rows.items()})
        importances["gradient_boosting"] = boosted.importances()
        sizes["gradient_boosting"] = {
            **tree_summary(boosted.trees[0]), "number_of_predictors": len(predictors), "learning_rate": float(g["learning_rate"]),
            "maximum_depth_setting": int(g["max_depth"]),
        }
    result["predictions"] = cut_lineage(union_all(*out))  # several tables are made from it
    if forest is not None:
        forest.drop()
    values = ["realized_target", "prediction"]
    expect(result["predictions"], [no_nulls(values), no_infinities(values)], unique=[*keys, month, "model", "sample"], strict=True)
    result["metrics"] = forecast_metrics(result["predictions"], ["model", "sample"], month)
    result["coefficients"] = coefficient_table(coefficient_rows(spark, fits))
    result["complexity"] = complexity_rows(spark, sizes)
    if importances:
        result["importances"] = importance_table(importance_rows(spark, importances, predictors))
    if "pls" in fits:
        result["components"] = cumulative_share(component_rows(spark, fits["pls"]), "component", "x_score_variance")
    return result


def final_evaluation(
    development: DataFrame, test: DataFrame, keys: Sequence[str], month: str, predictors: Sequence[str], target: str,
    settings: dict[str, dict], **options,
) -> dict[str, DataFrame]:
    """Refit the chosen settings on development data, forecast the test rows once, rank the models. A forest always has out-of-bag metrics, of all its trees."""
    result = fit_and_forecast(development, {"test": test}, keys, month, predictors, target, settings, **options)
    result["ranking"] = rank_models(result["metrics"], "test")
    return result


def selection_checks(results: DataFrame, grid: DataFrame, years: Sequence[int]) -> DataFrame:
    """Completeness and leakage of tuning results: every candidate in every fold once, training before validation.

    ``results`` holds one row per candidate and fold.
    """
    folds = fold_table(results.sparkSession, years)
    wanted = grid.select("candidate_id").withColumn("validation_year", F.explode(F.array(*[F.lit(int(y)) for y in years])))
    keys = ["candidate_id", "validation_year"]
    checks = [never(F.year("train_end") >= F.col("validation_year"), "leaking_folds"), no_nulls(["monthly_mse"], "missing_scores")]
    known = expect(results, checks, unique=keys)
    absent = missing_keys(wanted, results, keys).agg(F.lit("missing_fits").alias("check"), F.count(F.lit(1)).alias("failures"))
    extra = missing_keys(results, wanted, keys).agg(F.lit("unknown_fits").alias("check"), F.count(F.lit(1)).alias("failures"))
    lost = missing_keys(folds, results, ["validation_year"]).agg(F.lit("empty_folds").alias("check"), F.count(F.lit(1)).alias("failures"))
    more = union_all(absent, extra, lost).withColumn("ok", F.col("failures") == 0)
    return known.unionByName(more)


def selection_metadata(selected: DataFrame, folds: int, predictors: int, first_month: str, last_month: str) -> DataFrame:
    """One JSON document describing a selection run."""
    chosen = selected.agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("model_family", "parameters")))).alias("selected")  # one entry per family
    )
    body = F.struct(
        F.lit("exact minimum unrounded average monthly MSE").alias("selection_rule"),
        F.lit("deterministic candidate grid order for exact ties only").alias("tie_break"),
        F.array(F.lit(first_month), F.lit(last_month)).alias("development_period"),
        F.lit(folds).alias("fold_count"),
        F.lit(predictors).alias("predictor_count"),
        F.lit(False).alias("test_used_in_selection"),
        F.col("selected"),
    )
    return chosen.select(F.to_json(body).alias("metadata"))
