import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelmill.models import boosting, grid, linear, moments, trees, tuning, forest

P = ["x1", "x2", "x3", "x4"]


def data(n=400, seed=7):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)) * [1.0, 5.0, 0.1, 2.0] + [0.0, 100.0, 3.0, -1.0]
    x[:, 3] = x[:, 0] * 0.7 + x[:, 3] * 0.3
    y = 0.5 * x[:, 0] - 0.1 * (x[:, 1] - 100) + rng.normal(size=n) * 0.5 + 2.0
    return x, y


@pytest.fixture(scope="module")
def frame(spark):
    x, y = data()
    rows = [(f"e{k % 20}", dt.date(2000 + k // 100, 1 + (k // 8) % 12, 28), *map(float, x[k]), float(y[k])) for k in range(len(y))]
    return spark.createDataFrame(rows, "entity string, month date, x1 double, x2 double, x3 double, x4 double, y double").cache()


@pytest.fixture(scope="module")
def whole(frame):
    return moments.combine(list(moments.fold_moments(frame, "month", P, "y").values()))


def test_moments_equal_direct(frame, whole):
    x, y = data()
    means, cov = whole.centred()
    np.testing.assert_allclose(means, [y.mean(), *x.mean(0)], rtol=1e-10)
    np.testing.assert_allclose(cov, np.cov(np.column_stack([y, x]).T, bias=True), rtol=1e-7, atol=1e-10)


def test_prefix_moments(frame):
    parts = moments.fold_moments(frame, "month", P, "y")
    early = moments.combine([m for year, m in parts.items() if year < 2002])
    assert early.n == frame.filter(F.year("month") < 2002).count()


def test_ols(frame, whole):
    x, y = data()
    beta = np.linalg.lstsq(np.column_stack([np.ones(len(y)), x]), y, rcond=None)[0]
    fit = linear.solve_ols(whole, P)
    np.testing.assert_allclose([fit.intercept, *fit.coefficients], beta, rtol=1e-6)
    lib = linear.fit_linear_mllib(frame, P, "y")
    np.testing.assert_allclose(lib.coefficients, beta[1:], rtol=1e-6)


def plain_elastic_net(x, y, alpha, ratio):
    z = (x - x.mean(0)) / x.std(0)
    r, w = y - y.mean(), np.zeros(x.shape[1])
    for _ in range(5000):
        for j in range(len(w)):
            r = r + z[:, j] * w[j]
            c = z[:, j] @ r / len(y)
            w[j] = np.sign(c) * max(abs(c) - alpha * ratio, 0) / (1 + alpha * (1 - ratio))
            r = r - z[:, j] * w[j]
    return w


@pytest.mark.parametrize("alpha,ratio", [(0.05, 0.75), (1e-4, 0.5), (5.0, 0.9)])
def test_elastic_net(frame, whole, alpha, ratio):
    x, y = data()
    want = plain_elastic_net(x, y, alpha, ratio)
    np.testing.assert_allclose(linear.solve_elastic_net(whole, P, alpha, ratio).standardized, want, atol=1e-7)
    np.testing.assert_allclose(linear.fit_linear_mllib(frame, P, "y", alpha, ratio).standardized, want, atol=1e-4)


def nipals(x, y, k):
    z, r = (x - x.mean(0)) / x.std(0), y - y.mean()
    ws, ps, qs, var = [], [], [], []
    for _ in range(k):
        w = z.T @ r
        w /= np.linalg.norm(w)
        t = z @ w
        p, q = z.T @ t / (t @ t), r @ t / (t @ t)
        z, r = z - np.outer(t, p), r - t * q
        ws.append(w), ps.append(p), qs.append(q), var.append(t.var(ddof=1))
    w, p = np.array(ws).T, np.array(ps).T
    return w @ np.linalg.inv(p.T @ w) @ np.array(qs), var


@pytest.mark.parametrize("k", [1, 2, 3])
def test_pls(whole, k):
    x, y = data()
    want, variance = nipals(x, y, k)
    fit = linear.solve_pls(whole, P, k)[-1]
    np.testing.assert_allclose(fit.standardized, want, atol=1e-8)
    np.testing.assert_allclose(fit.score_variance, variance, rtol=1e-7)


def test_constant_column_gets_zero(spark):
    rows = [(dt.date(2000, 1, 31), float(k), 5.0, 2.0 * k + 1) for k in range(30)]
    df = spark.createDataFrame(rows, "month date, x1 double, c double, y double")
    m = moments.combine(list(moments.fold_moments(df, "month", ["x1", "c"], "y").values()))
    for fit in (linear.solve_ols(m, ["x1", "c"]), linear.solve_pls(m, ["x1", "c"], 5)[-1]):
        assert fit.coefficients == pytest.approx([2.0, 0.0]) and fit.intercept == pytest.approx(1.0)


def test_linear_search_equals_direct_fits(spark, frame):
    small = {"pls": [{"n_components": 2}], "elastic_net": [{"alpha": 0.05, "l1_ratio": 0.75}]}
    got = {(r.candidate_id, r.validation_year): r.monthly_mse for r in tuning.tune_linear(frame, "month", P, "y", [2001, 2002], small).collect()}
    pdf = frame.toPandas()
    for year in (2001, 2002):
        train, test = pdf[[d.year < year for d in pdf.month]], pdf[[d.year == year for d in pdf.month]]
        x, y = train[P].to_numpy(), train.y.to_numpy()
        for name, w in (("pls_001", nipals(x, y, 2)[0]), ("elastic_net_001", plain_elastic_net(x, y, 0.05, 0.75))):
            forecast = ((test[P].to_numpy() - x.mean(0)) / x.std(0)) @ w + y.mean()
            want = ((test.y - forecast) ** 2).groupby(test.month).mean().mean()
            assert got[(name, year)] == pytest.approx(want, rel=1e-6)


def test_empty_fold_is_refused(frame):
    with pytest.raises(ValueError, match="empty fold"):
        tuning.tune_linear(frame, "month", P, "y", [2000], {"pls": [{"n_components": 1}]})


def test_boosting_follows_the_recursion(spark):
    """Stumps on one binary predictor have a closed form: every tree closes the share `rate` of the gap to the group means."""
    rows = [(k, float(k % 2), 10.0 if k % 2 else 2.0) for k in range(40)]
    df = spark.createDataFrame(rows, "id int, x double, y double")
    model = boosting.boost(df, ["x"], "y", [boosting.Run("a", 0.1, 2, 13)])
    assert boosting.tree_summary(model.trees[0]) == {"trees": 13, "average_tree_depth": 1.0, "maximum_tree_depth": 1, "average_tree_leaves": 2.0}
    assert model.importances() == [1.0]
    for r in model.forecasts(df, {"p_1": (0, 1), "p_3": (0, 3), "p_13": (0, 13)}).collect():
        side = 4.0 if r.x else -4.0
        assert r.p_13 == pytest.approx(6 + side * (1 - 0.9**13))
        assert r.p_1 == pytest.approx(6 + side * 0.1)
        assert r.p_3 == pytest.approx(6 + side * (1 - 0.9**3))


def loop_forest(x, y, draws, paths, subset, leaf, bins):
    """Forecasts of one tree by recursion over its drawn rows, on the same bins and predictors per node."""
    out = np.empty(len(y))

    def node(rows, free, path, depth=0):
        w = draws[rows].astype(float)
        mean = (w * y[rows]).sum() / w.sum()
        best = (1e-15 * w.sum(), None)
        for k in forest.feature_subsets(np.array([path], np.uint64), x.shape[1], subset)[0] if w.sum() >= 2 * leaf else ():
            for cut in range(bins):
                left = x[rows, k] <= cut
                a, b = w[left].sum(), w[~left].sum()
                if min(a, b) >= leaf:
                    gain = a * b / (a + b) * ((w * y[rows])[left].sum() / a - (w * y[rows])[~left].sum() / b) ** 2
                    if gain > best[0] * (1 + 1e-9):
                        best = (gain, (k, cut))
        if best[1] is None:
            out[rows], out[free] = mean, mean
            return
        k, cut = best[1]
        low, high = forest.child_paths(np.array([path], np.uint64))
        node(rows[x[rows, k] <= cut], free[x[free, k] <= cut], low[0])
        node(rows[x[rows, k] > cut], free[x[free, k] > cut], high[0])

    node(np.flatnonzero(draws), np.flatnonzero(draws == 0), paths)
    return out


def test_forests_in_step_equal_a_loop(spark, monkeypatch):
    """Trees grown level by level over all tasks, finished in one task, or half and half: all equal a recursion, for two runs, with their out-of-bag means."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, 9, (600, 5)).astype(float)
    y = np.sin(x[:, 0]) + (x[:, 1] > 4) * x[:, 2] + rng.normal(size=600)
    rows = [(i, int(2000 + i % 3), float(v), *map(float, r)) for i, (r, v) in enumerate(zip(x, y))]
    names = ["a", "b", "c", "d", "e"]
    df = spark.createDataFrame(rows, "id long, year int, y double, " + ", ".join(f"{n} double" for n in names)).repartition(5)
    runs = [forest.ForestRun("all", 3), forest.ForestRun("early", 2, before=2002)]
    number = np.array([r.n for r in df.select("id", forest.row_number_of(["id"]).alias("n")).orderBy("id").collect()])
    factor, offset = forest.tree_numbers(3)
    want = {}
    for local in (10**6, 150, 0):
        grown = forest.grow(df, names, "y", ["id"], runs, "year", leaf=5, local_rows=local)
        codes = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(grown.edges)], 1)
        got = grown.out_of_bag(grown.forecasts(df, {"p1": (0, 1), "p3": (0, 3), "q2": (1, 2)})).orderBy("id").toPandas()
        if not want:
            drawn = forest.draws(number, factor, offset)
            paths = forest._mix(np.arange(3, dtype=np.uint64) + np.uint64(grid.SEED) * np.uint64(1 << 40))
            trees_ = [loop_forest(codes, y, drawn[:, t], paths[t], 2, 5, 10) for t in range(3)]
            early = np.arange(600) % 3 < 2
            for t in range(2):
                own = np.where(early, drawn[:, t], 0)
                want[t] = loop_forest(codes, y, own, paths[t], 2, 5, 10)
            want |= {"p1": trees_[0], "p3": np.mean(trees_, 0), "q2": (want[0] + want[1]) / 2}
            free = drawn == 0
            want["oob_prediction"] = np.where(free.any(1), (np.stack(trees_, 1) * free).sum(1) / np.maximum(free.sum(1), 1), np.nan)
        for name in ("p1", "p3", "q2", "oob_prediction"):
            assert np.allclose(got[name], want[name], rtol=0, atol=1e-12, equal_nan=True), (local, name)
        assert sum(grown.importances()) == pytest.approx(1.0) and grown.summary()["trees"] == 3
        assert grown.summary(1)["maximum_tree_depth"] >= 3


def test_a_stored_forest_equals_a_held_one(spark, monkeypatch):
    """Subtrees that stay a table, which rows meet by their small nodes, give the same forecasts, votes, importances and sizes."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 30, (900, 4)).astype(float)
    y = np.sin(x[:, 0]) + (x[:, 1] > 14) * x[:, 2] + rng.normal(size=900)
    rows = [(i, 2000 + i % 3, None if i == 3 else "t", float(v), *map(float, r)) for i, (r, v) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, year int, note string, y double, a double, b double, c double, d double").repartition(5)
    runs = [forest.ForestRun(str(k), 4, before=k) for k in (2001, 2002)]
    monkeypatch.setattr(forest, "MOST_CELLS", 0)
    monkeypatch.setattr(forest, "ROW_BLOCK", 64)
    monkeypatch.setattr(forest, "VOTES", 200)
    stages, run = {"p4": (1, 4), "q2": (0, 2), "p1": (1, 1)}, F.greatest(F.col("year") - 2001, F.lit(0)).cast("int")
    for local in (10**6, 100):
        found = []
        for most in (10**6, 0):
            monkeypatch.setattr(forest, "HELD_NODES", most)
            grown = forest.grow(df, ["a", "b", "c", "d"], "y", ["id"], runs, "year", leaf=5, local_rows=local)
            assert (grown.subtrees is None) == (most > 0)
            got = grown.out_of_bag(grown.forecasts(df, stages), 1).orderBy("id").toPandas()
            if most:
                each = grown.forecasts(df, {f"r{r}_{n}": (r, n) for r in (0, 1) for n in (2, 4)}).orderBy("id").toPandas()
                folds = {f"f{n}": np.where(each.year == 2002, each[f"r1_{n}"], each[f"r0_{n}"]) for n in (2, 4)}
            else:
                own = grown.fold_forecasts(df, run, {"f2": 2, "f4": 4}).orderBy("id").toPandas()
                assert all(np.allclose(own[c], folds[c], rtol=0, atol=1e-12) for c in folds)
            found.append((got, [grown.importances(k) for k in (0, 1)], [grown.summary(k) for k in (0, 1)], len(grown.nodes.value)))
        held, stored = found
        assert list(held[0].columns) == list(stored[0].columns) and held[0].note.equals(stored[0].note)
        assert all(np.allclose(held[0][c], stored[0][c], rtol=0, atol=1e-12, equal_nan=True) for c in (*stages, "oob_prediction"))
        assert np.allclose(held[1], stored[1]) and held[2] == stored[2] and stored[3] < held[3] / 2


def test_forests_of_few_values_grow_from_sums(spark, monkeypatch):
    """Sums per value, year and tree give the trees that the rows give."""
    rng = np.random.default_rng(6)
    rows = [(i, 2000 + i % 3, float(a), float(b), float(a * b + rng.normal())) for i, (a, b) in enumerate(rng.integers(0, 4, (800, 2)))]
    df = spark.createDataFrame(rows, "id long, year int, a double, b double, y double").repartition(4)
    runs = [forest.ForestRun("early", 3, before=2002), forest.ForestRun("all", 5)]
    found, sent = [], []
    monkeypatch.setattr(forest, "_finished", lambda *a, f=forest._finished: sent.append(1) or f(*a))
    for most in (1 << 20, 0):
        monkeypatch.setattr(forest, "MOST_CELLS", most)
        grown = forest.grow(df, ["a", "b"], "y", ["id"], runs, "year", leaf=5, subset=1)
        assert len(sent) == (most == 0)
        found.append((grown.forecasts(df, {"p": (0, 3), "q": (1, 5)}).orderBy("id").toPandas(), grown.importances(1), grown.summary(0)))
    assert np.allclose(found[0][0][["p", "q"]], found[1][0][["p", "q"]], rtol=0, atol=1e-12)
    assert np.allclose(found[0][1], found[1][1]) and found[0][2] == found[1][2]


def test_boosting_of_few_values_needs_no_rows(spark, monkeypatch):
    """Equal rows of a year count as one, so a large table of few values is not boosted in step, and its trees are those of all rows."""
    rng = np.random.default_rng(7)
    rows = [(i, 2000 + i % 3, float(a), float(a + rng.normal())) for i, a in enumerate(rng.integers(0, 3, 600))]
    df = spark.createDataFrame(rows, "id long, year int, a double, y double").repartition(4)
    runs = [boosting.Run("all", 0.3, 2, 12), boosting.Run("early", 0.1, 1, 5, before=2002)]
    sizes = []
    monkeypatch.setattr(boosting, "_side_by_side", lambda state, *a, f=boosting._side_by_side: sizes.append(state.count()) or f(state, *a))
    found = []
    for most in (50, 0):
        monkeypatch.setattr(boosting, "LOCAL_CELLS", most)
        found.append(boosting.boost(df, ["a"], "y", runs, "year").forecasts(df, {"p": (0, 12), "q": (1, 5)}).orderBy("id").toPandas())
    assert sizes == [9]
    assert np.allclose(found[0][["p", "q"]], found[1][["p", "q"]], rtol=0, atol=1e-12)


def test_boosted_rows_beyond_the_bound_do_not_pass_the_driver(spark, monkeypatch):
    """Rows that are shuffled to the tasks of the runs give the trees of broadcast rows, bit by bit, and the driver gathers none of them."""
    rng = np.random.default_rng(11)
    rows = [(i, 2000 + i % 4, *map(float, rng.normal(size=3))) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, year int, a double, b double, y double").repartition(5)
    runs = [boosting.Run("all", 0.3, 2, 12), boosting.Run("early", 0.1, 1, 130, before=2002), boosting.Run("late", 0.2, 3, 6, before=2003)]
    gathered = []
    monkeypatch.setattr(type(df), "toArrow", lambda self, f=type(df).toArrow: gathered.append(self.columns) or f(self))
    found = []
    for most in (1 << 24, 900 * 24 - 1):
        monkeypatch.setattr(boosting, "SENT_BYTES", most)
        found.append((boosting.boost(df, ["a", "b"], "y", runs, "year").trees, len(gathered)))
    assert found[0][1] == found[1][1] == 1
    for one, other in zip(found[0][0], found[1][0], strict=True):
        for a, b in zip(one, other, strict=True):
            assert all(np.array_equal(getattr(a, k), getattr(b, k)) for k in ("feature", "cut", "value", "gain"))


def test_draws_are_poisson(spark):
    number = np.array([r.n for r in spark.range(20000).select(forest.row_number_of(["id"]).alias("n")).collect()])
    drawn = forest.draws(number, *forest.tree_numbers(40)).astype(float)
    assert drawn.mean() == pytest.approx(1, abs=0.005) and drawn.var() == pytest.approx(1, abs=0.02)
    assert (drawn == 0).mean() == pytest.approx(np.exp(-1), abs=0.005)
    assert np.abs(np.corrcoef(drawn.T) - np.eye(40)).max() < 0.04


def test_sums_meet_in_levels(spark):
    """Blocks from more tasks than are added at once."""
    rows = [(k % 7, np.full(3, float(k)).tobytes()) for k in range(700)]
    parts = spark.createDataFrame(rows, "key long, h binary").repartition(70)
    for tasks in (1, 70):
        got = {r.key: np.frombuffer(r.h).tolist() for r in boosting.summed(parts, tasks).collect()}
        assert got == {k: [float(sum(range(k, 700, 7)))] * 3 for k in range(7)}


def test_grid(spark):
    table = grid.candidate_table(spark)
    assert table.count() == 30
    assert {r.model_family: r["count"] for r in table.groupBy("model_family").count().collect()} == grid.EXPECTED_COUNTS
    assert all(r.ok for r in grid.grid_problems(table, grid.EXPECTED_COUNTS).collect())
    assert [r.ok for r in grid.grid_problems(table.limit(4), {"pls": 5}).collect()][0] is False


def test_tune_and_select(spark, frame):
    small = {
        "pls": [{"n_components": 1}, {"n_components": 3}],
        "random_forest": [{"n_estimators": 2}],
        "gradient_boosting": [{"n_estimators": n, "learning_rate": 0.3, "max_depth": 1} for n in (1, 2)],
    }
    fixed = {"pls": {"n_components": 3}, "random_forest": {"n_estimators": 2}, "gradient_boosting": small["gradient_boosting"][0]}
    results, summary = tuning.tune(frame, "month", P, "y", [2002, 2003], small, fixed, max_depth=3, bins=16)
    assert results.count() == 10 and summary.count() == 5
    assert all(r.completed_folds == 2 for r in summary.collect())
    from panelmill.operators import folds

    chosen = tuning.selected_settings(folds.select_minimum(summary))
    assert set(chosen) == set(small) and chosen["pls"] == {"n_components": 3}
    out = tuning.final_evaluation(
        frame.filter("month < '2003-01-01'"), frame.filter("month >= '2003-01-01'"), ["entity"], "month", P, "y", chosen, ols_predictors=P[:3], max_depth=3, bins=16
    )
    ranking = out["ranking"].collect()
    assert [r["rank"] for r in ranking] == [1, 2, 3, 4, 5]
    assert ranking[0].model in ("pls", "ols_3")
    assert out["coefficients"].filter("model = 'pls'").count() == 4
    assert out["complexity"].count() == 4 and out["components"].count() == 3
    assert out["oob"].first().oob_rows > 100


def plain_tree(x, y, depth):
    """Best splits over all distinct values; forecasts of the rows."""
    best = (1e-12, None)
    for k in range(x.shape[1] if depth else 0):
        for v in np.unique(x[:, k])[:-1]:
            left = x[:, k] <= v
            gain = left.sum() * (~left).sum() / len(y) * (y[left].mean() - y[~left].mean()) ** 2
            if gain > best[0] * (1 + 1e-9):
                best = (gain, left)
    if best[1] is None:
        return np.full(len(y), y.mean())
    out = np.empty(len(y))
    for side in (best[1], ~best[1]):
        out[side] = plain_tree(x[side], y[side], depth - 1)
    return out


@pytest.mark.parametrize("cells", [0, 10**6])
def test_boosting_in_step_equals_plain_loops(spark, monkeypatch, cells):
    """In step over all tasks and run by run."""
    monkeypatch.setattr(boosting, "LOCAL_CELLS", cells)
    rng = np.random.default_rng(1)
    x = rng.integers(0, 9, (300, 3)).astype(float)
    y = np.sin(x[:, 0]) + (x[:, 1] > 4) * x[:, 2] + rng.normal(size=300)
    rows = [(*map(float, r), float(v), int(t)) for r, v, t in zip(x, y, rng.integers(2000, 2003, 300))]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double, year int")
    runs = [boosting.Run("deep", 0.2, 2, 12), boosting.Run("early", 0.3, 1, 5, before=2002)]
    got = boosting.boost(df, ["a", "b", "c"], "y", runs, "year").forecasts(df, {"deep": (0, 12), "early": (1, 5)}).toPandas()
    for name, rows_, depth, rate, rounds in (("deep", np.ones(300, bool), 2, 0.2, 12), ("early", got.year.to_numpy() < 2002, 1, 0.3, 5)):
        xs, ys = got.loc[rows_, ["a", "b", "c"]].to_numpy(), got.loc[rows_, "y"].to_numpy()
        f = np.full(len(ys), ys.mean())
        for _ in range(rounds):
            f = f + rate * plain_tree(xs, ys - f, depth)
        assert np.abs(f - got.loc[rows_, name].to_numpy()).max() < 1e-10


def test_missing_values_are_refused(spark, frame):
    holes = frame.withColumn("x1", F.when(F.col("month") > "2001-06-01", F.col("x1")))
    for fit in (lambda: tuning.tune_linear(holes, "month", P, "y", [2001], {"pls": [{"n_components": 1}]}), lambda: boosting.boost(holes, P, "y", [boosting.Run("a", 0.1, 1, 1)])):
        with pytest.raises(ValueError, match="missing values"):
            fit()


def test_moments_of_many_predictors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 401))
    names = [f"v{k}" for k in range(400)]
    rows = [(dt.date(2000 + i % 3, 1, 31), *map(float, r)) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "month date, y double, " + ", ".join(f"{n} double" for n in names)).repartition(5)
    m = moments.combine(list(moments.fold_moments(df, "month", names, "y").values()))
    means, cov = m.centred()
    assert np.abs(means - x.mean(0)).max() < 1e-12 and np.abs(cov - np.cov(x.T, bias=True)).max() < 1e-10


def test_selection_checks(spark, frame):
    small = {"pls": [{"n_components": 1}, {"n_components": 3}]}
    results, _ = tuning.tune(frame, "month", P, "y", [2002, 2003], small, {"pls": {"n_components": 3}})
    table = grid.candidate_table(spark, None, small)
    assert all(r.ok for r in tuning.selection_checks(results, table, [2002, 2003]).collect())
    bad = tuning.selection_checks(results.filter("candidate_id = 'pls_001' or validation_year = 2002"), table, [2002, 2003])
    assert {r.check: r.failures for r in bad.collect() if not r.ok} == {"missing_fits": 1}


def test_parameter_and_complexity_tables(spark):
    from panelmill.operators import reports

    chosen = spark.createDataFrame([("b", "b_1", '{"n": 3, "rate": 0.1}'), ("a", "a_2", '{"k": 5}')], "model_family string, candidate_id string, parameters string")
    assert [tuple(r) for r in reports.chosen_parameters(chosen).collect()] == [("a", "a_2", "k", "5"), ("b", "b_1", "n", "3"), ("b", "b_1", "rate", "0.1")]
    sizes = trees.complexity_rows(spark, {"pls": {"pls_components": 2, "number_of_predictors": 4}})
    assert [(r.measure, r.value) for r in reports.complexity_report(sizes).collect()] == [("number_of_predictors", 4.0), ("pls_components", 2.0)]


def test_all_trees_of_the_reported_forest_vote_out_of_bag(spark, frame):
    grown = forest.grow(frame, P, "y", ["entity", "month"], [forest.ForestRun("a", 5)], max_depth=3)
    drawn = forest.draws(np.array([r.n for r in frame.select(forest.row_number_of(["entity", "month"]).alias("n")).collect()]), *forest.tree_numbers(5))
    assert trees.oob_metrics(grown.out_of_bag(frame), "month", "y").first().oob_rows == (drawn == 0).any(1).sum()
    out = tuning.final_evaluation(
        frame.filter("month < '2003-01-01'"), frame.filter("month >= '2003-01-01'"), ["entity"], "month", P, "y", {"random_forest": {"n_estimators": 2}}, ols_predictors=P[:3], max_depth=3
    )
    assert out["oob"].first().oob_rows > 100


def test_elastic_net_path_equals_cold_sweeps():
    """400 correlated predictors: warm starts and the strong rule change the number of steps, not the fits."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 400)) + rng.normal(size=(900, 1))
    y = x[:, :8] @ rng.normal(size=8) + rng.normal(size=900)
    z = np.column_stack([np.ones(900), y, x])
    m, names = moments.Moments(z.T @ z, np.zeros(401)), [f"v{k}" for k in range(400)]
    alphas = [0.05, 0.4, 0.1, 0.2]
    warm, cold = [], []
    path = linear.solve_elastic_path(m, names, alphas, 0.8, sweeps=warm)
    means, sd, gram, xy = linear._standardised(m)
    for alpha, fit in zip(alphas, path):
        w, gradient, steps = np.zeros(400), xy.copy(), 0
        while True:
            before = w.copy()
            for j in range(400):
                value = gradient[j] + gram[j, j] * w[j]
                new = np.sign(value) * max(abs(value) - alpha * 0.8, 0.0) / (gram[j, j] + alpha * 0.2)
                gradient -= (new - w[j]) * gram[:, j]
                w[j] = new
            steps += 400
            if np.abs(w - before).max() <= 1e-11:
                break
        cold.append(steps)
        assert np.abs(fit.standardized - w).max() < 1e-9 and 0 < np.count_nonzero(w) < 400
    assert sum(warm) < 0.5 * sum(cold)


def test_moments_take_one_pass_and_keep_digits(spark):
    """Means far above the spread, rows dealt over many tasks: the merged states give the covariances, and the table is scanned once."""
    rng = np.random.default_rng(5)
    values = rng.normal(size=(600, 3)) * [1e-3, 1.0, 10.0] + [1e6, -1e7, 3.0]
    rows = [(dt.date(2001 + k % 3, 1, 31), *map(float, v)) for k, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "month date, y double, a double, b double").repartition(7)
    whole = moments.combine(list(moments.fold_moments(frame, "month", ["a", "b"], "y").values()))
    means, covariance = whole.centred()
    assert np.allclose(means, values.mean(axis=0), rtol=1e-14)
    assert np.allclose(covariance, np.cov(values.T, bias=True), rtol=1e-6, atol=1e-9)
    plan = moments.packed_states(frame.selectExpr("year(month) AS p", "*"), "p", ["a", "b"], "y")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1


def test_moments_name_missing_values(spark):
    frame = spark.createDataFrame([(dt.date(2001, 1, 31), 1.0, None), (dt.date(2002, 1, 31), 2.0, float("nan"))], "month date, y double, a double")
    with pytest.raises(ValueError, match="2 rows: {'a': 2}"):
        moments.fold_moments(frame, "month", ["a"], "y")


def test_stopped_grid_goes_on_from_its_store(spark, frame, tmp_path, monkeypatch):
    """A run that dies at its third step has stored two; the next one tunes only the rest, and the scores are those of an undisturbed run."""
    small = {
        "pls": [{"n_components": 1}, {"n_components": 2}],
        "random_forest": [{"n_estimators": 3}, {"n_estimators": 5}],
        "gradient_boosting": [{"n_estimators": 4, "learning_rate": 0.3, "max_depth": 1}],
    }
    real, steps, limit = tuning.tune_trees, [], [1]

    def counted(df, time, predictors, target, years, candidates, keys=(), **options):
        steps.append((tuple(years), *candidates))
        if len(steps) > limit[0]:
            raise RuntimeError("driver lost")
        return real(df, time, predictors, target, years, candidates, keys, **options)

    monkeypatch.setattr(tuning, "tune_trees", counted)
    run = lambda folder, grid=small: tuning.tune(frame, "month", P, "y", [2002, 2003], grid, {}, ["entity", "month"], store=str(tmp_path / folder), max_depth=3, bins=16)[0]
    with pytest.raises(RuntimeError, match="driver lost"):
        run("stopped")
    kept = {tuple(r) for r in spark.read.parquet(str(tmp_path / "stopped")).collect()}
    assert len(kept) == 2 * 2 + 2
    limit[0] = 99
    steps.clear()
    scores = lambda df: {(r.candidate_id, r.validation_year): r.monthly_mse for r in df.collect()}
    resumed = scores(run("stopped"))
    assert steps == [((2002,), "gradient_boosting"), ((2003,), "random_forest"), ((2003,), "gradient_boosting")]
    steps.clear()
    assert scores(run("stopped")) == resumed and not steps
    whole = scores(run("whole"))
    assert resumed.keys() == whole.keys() and len(whole) == 10
    assert all(abs(resumed[k] - whole[k]) < 1e-12 for k in whole)
    steps.clear()
    other = small | {"random_forest": [{"n_estimators": 2}, {"n_estimators": 5}]}  # only the changed candidate is tuned
    run("stopped", other)
    assert steps == [((2002,), "random_forest"), ((2003,), "random_forest")]


def test_tables_about_a_large_forest_gather_no_trees(spark, monkeypatch):
    """Sizes and importances of a stored forest come from one row per tree, and per tree and predictor, however many nodes there are."""
    from panelmill.plans import model_queries

    x, y = data(3000)
    rows = [(k, *map(float, x[k]), float(y[k])) for k in range(len(y))]
    df = spark.createDataFrame(rows, "id long, ret_1m double, retvol_1m double, avg_log_dolvol_1m double, avg_range_1m double, y double")
    monkeypatch.setattr(forest, "HELD_NODES", 100)
    monkeypatch.setattr(model_queries, "_KEYS", ["id"])
    monkeypatch.setattr(model_queries, "_stored", lambda *_: df)
    held = []
    for name in ("collect", "toArrow"):
        monkeypatch.setattr(type(df), name, lambda self, *a, f=getattr(type(df), name): held.append(f(self, *a)) or held[-1])
    size = model_queries.model_complexity(spark, "").first()
    share = model_queries.random_forest_importance(spark, "")
    monkeypatch.undo()
    assert size.trees == 100 and size.average_tree_leaves > 50
    assert sum(r.impurity_importance for r in share.collect()) == pytest.approx(1.0)
    assert max(len(h) for h in held) <= 100 * len(P)


def test_trees_take_turns(spark, monkeypatch, tmp_path):
    """Forests whose trees, drawn rows and votes are sent in turns give the trees and votes of one turn, and what a step has stored goes when it is replaced."""
    from panelmill import session

    rng = np.random.default_rng(15)
    rows = [(i, dt.date(2000 + i % 4, 1 + i % 12, 28), *map(float, x), float(x[0] * x[1] + rng.normal())) for i, x in enumerate(rng.normal(size=(1500, 4)))]
    rows += rows[:30]  # rows may repeat
    df = spark.createDataFrame(rows, "id long, month date, a double, b double, c double, d double, y double").repartition(5)
    names, grid = ["a", "b", "c", "d"], {"random_forest": [{"n_estimators": n} for n in (3, 5, 7)], "gradient_boosting": [{"n_estimators": 25, "learning_rate": 0.3, "max_depth": 2}]}
    monkeypatch.setattr(boosting, "LOCAL_CELLS", 0)
    monkeypatch.setattr(forest, "MOST_CELLS", 0)
    monkeypatch.setattr(session, "shared_folder", lambda spark: str(tmp_path))
    found, sent = [], []
    monkeypatch.setattr(forest, "turns", lambda *a, f=forest.turns: sent.append(f(*a)) or sent[-1], raising=False)
    for stored, most, held in ((1 << 30, 1 << 26, 1 << 18), (2 * 4500 * 2, 1 << 26, 0), (1 << 30, 2000, 0)):
        for module, name, value in ((tuning, "STORED_BYTES", stored), (tuning, "STORED_A_ROW", 0), (forest, "SENT", most), (forest, "SENT_A_ROW", 0), (forest, "HELD_NODES", held)):
            monkeypatch.setattr(module, name, value, raising=False)
        sent.clear()
        scores = tuning.tune_trees(df, "month", names, "y", [2001, 2002, 2003], grid, ["id"], leaf=5, local_rows=200)
        found.append({(r.candidate_id, r.validation_year): r.monthly_mse for r in scores.collect()})
        assert max(len(turn) for turns in sent for turn in turns) <= (21 if most > 2000 else 20)
        assert not list(tmp_path.glob("panelmill/*"))
    assert len(found[0]) == 12 and all(f.keys() == found[0].keys() for f in found)
    assert all(abs(f[k] - found[0][k]) < 1e-12 for f in found for k in f)
    voted = []
    for most in (1 << 26, 300):
        monkeypatch.setattr(forest, "SENT", most, raising=False)
        grown = forest.grow(df, names, "y", ["id"], [forest.ForestRun("a", 6)], leaf=5, local_rows=200)
        voted.append(grown.out_of_bag(df).orderBy("id").toPandas().oob_prediction.to_numpy())
        assert len(sent[-1]) == (1 if most > 300 else 6)
    assert np.allclose(voted[0], voted[1], rtol=0, atol=1e-12, equal_nan=True)
