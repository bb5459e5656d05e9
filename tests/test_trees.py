"""Explanations against Shapley values by all subsets, gains against the library's own, fits that stop early."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import modelling, trees


def random_tree(rng: random.Random, depth: int, features: int) -> trees.Tree:
    nodes: list[list] = []

    def grow(level: int, cover: float) -> int:
        at = len(nodes)
        nodes.append([-1, 0.0, -1, -1, rng.uniform(-1, 1), cover, 0.0])
        if level < depth and (level == 0 or rng.random() < 0.8):
            share = rng.uniform(0.1, 0.9)
            nodes[at][0], nodes[at][1] = rng.randrange(features), rng.choice([0.25, 0.5, 0.75])
            nodes[at][2], nodes[at][3] = grow(level + 1, cover * share), grow(level + 1, cover * (1 - share))
        return at

    grow(0, 100.0)
    kinds = (np.int64, float, np.int64, np.int64, float, float, float)
    return trees.Tree(*[np.array(c, t) for c, t in zip(zip(*nodes, strict=True), kinds, strict=True)], rng.uniform(0.1, 1))


def expected(t: trees.Tree, x: np.ndarray, known: set[int], n: int = 0) -> float:
    """Value of a tree where only some features are known: others follow both branches by their shares."""
    if t.left[n] < 0:
        return float(t.value[n])
    a, b = int(t.left[n]), int(t.right[n])
    if int(t.feature[n]) in known:
        return expected(t, x, known, a if x[t.feature[n]] <= t.threshold[n] else b)
    return (t.cover[a] * expected(t, x, known, a) + t.cover[b] * expected(t, x, known, b)) / t.cover[n]


def by_subsets(found: list[trees.Tree], x: np.ndarray, m: int) -> list[float]:
    game = {s: sum(t.weight * expected(t, x, set(s)) for t in found) for k in range(m + 1) for s in itertools.combinations(range(m), k)}
    out = []
    for i in range(m):
        rest = [j for j in range(m) if j != i]
        out.append(sum(math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m) * (game[tuple(sorted((*s, i)))] - game[s]) for k in range(m) for s in itertools.combinations(rest, k)))
    return out


@pytest.mark.parametrize("table", [trees.TABLE, 1])
def test_contributions_are_shapley_values(monkeypatch, table):
    """Trees with repeated features on a path, by tables and without."""
    monkeypatch.setattr(trees, "TABLE", table)
    rng = random.Random(4)
    for _ in range(12):
        m = rng.randrange(1, 6)
        found = [random_tree(rng, rng.randrange(1, 6), m) for _ in range(3)]
        x = np.array([[rng.choice([0.1, 0.25, 0.3, 0.6, 0.9]) for _ in range(m)] for _ in range(6)])
        got = trees.contributions(trees.leaves(found), x)
        for row, values in zip(x, got, strict=True):
            assert np.allclose(values, by_subsets(found, row, m))
            assert abs(trees.bias(found) + values.sum() - sum(t.weight * expected(t, row, set(range(m))) for t in found)) < 1e-9


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 4)).round(3)
    y = 2 * x[:, 0] - np.where(x[:, 1] > 0, 1.0, 0.0) * x[:, 2] + rng.normal(size=1500) * 0.1
    data = [(i, *map(float, r), float(v), i % 4 == 0, float(rng.normal())) for i, (r, v) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(data, "id int, a double, b double, c double, d double, y double, held boolean, noise double").withColumn("a", F.when(F.col("id") % 50 != 0, F.col("a"))).cache()


def test_explained_predictions(rows):
    """Sum and base give the model's prediction for each row; missing values are seen as the imputer left them."""
    names = ["a", "b", "c", "d"]
    model = trees.fit_with_stop(rows, names, "y", "held", rounds=8, depth=4)
    out = trees.explain(model.transform(rows), model.stages[-1], names, [f"{n}_filled" for n in names], top=3).collect()
    assert len(out) == 1500 and all(r.sanity_ok for r in out)
    for r in out[:50]:
        sizes = [abs(c.contrib) for c in r.top_positive_contrib + r.top_negative_contrib]
        assert len(r.shap) == 3 and max(map(abs, r.shap.values())) == max(sizes)
        assert all(c.contrib > 0 for c in r.top_positive_contrib) and all(c.contrib < 0 for c in r.top_negative_contrib)
    mean = lambda n: sum(abs(r.shap.get(n, 0.0)) for r in out)
    assert mean("a") > mean("c") > mean("d")
    empty = trees.explain(model.transform(rows.limit(0)), model.stages[-1], names, [f"{n}_filled" for n in names])
    assert empty.count() == 0


def test_gains_are_those_of_the_library(rows):
    """Of one tree, shares of gain are the library's importances."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    names = ["b", "c", "d", "noise"]
    model = GBTRegressor(featuresCol="v", labelCol="y", maxIter=1, maxDepth=4, seed=1).fit(VectorAssembler(inputCols=names, outputCol="v").transform(rows))
    found = {f: g for f, g, _ in trees.gains(model, names)}
    own = model.trees[0].featureImportances.toArray()
    assert np.allclose([found[n] / sum(found.values()) for n in names], own)
    text = model.trees[0].toDebugString
    assert {f: s for f, _, s in trees.gains(model, names)} == {n: text.count(f"If (feature {i} ") for i, n in enumerate(names)}


def test_noise_stops_early(rows):
    names = ["b", "c", "d"]
    few = trees.fit_with_stop(rows, names, "noise", "held", rounds=30, depth=3)
    more = trees.fit_with_stop(rows, ["a", *names], "y", "held", rounds=30, depth=3)
    assert few.stages[-1].getNumTrees < 10 < more.stages[-1].getNumTrees


def test_folds(spark):
    rng = random.Random(8)
    data = [(f"T{t}", f"2020-01-{1 + d // 24:02}" if d < 0 else str(np.datetime64("2020-01-01") + d), x := rng.gauss(0, 1), rng.gauss(0, 1), 0.5 * x + rng.gauss(0, 0.1)) for t in range(4) for d in range(200)]
    df = spark.createDataFrame(data, "ticker string, date string, p double, q double, y double").withColumn("date", F.to_date("date"))
    folds = modelling.walk_forward(df, 1).cache()
    weighted = trees.fold_rows(folds, "y").where("fold = 0 AND NOT held").orderBy("date", "ticker").collect()
    n = len(weighted)
    assert np.allclose([r.recency for r in weighted], np.exp(np.linspace(-0.4, 0, n)))
    found, gains, model = trees.fit_folds(folds, ["p", "q"], "y", 2, rounds=5, depth=2)
    assert [f["fold"] for f in found] == [0, 1] and all(f["hit"] > 0.8 and f["corr"] > 0.8 and f["q90"] <= f["q95"] and 0 < f["rounds"] <= 5 for f in found)
    assert gains[0][0] == "p" and model is not None
    held = folds.where("fold = 1 AND role = 'validation'")
    p = [(r.prediction, r.y) for r in model.transform(held).collect()]
    assert abs(found[1]["mae"] - np.mean([abs(a - b) for a, b in p])) < 1e-9 and abs(found[1]["q90"] - np.quantile([abs(a - b) for a, b in p], 0.9)) < 1e-9
    assert trees.fit_folds(folds, ["p", "q"], "y", 2, least_train=10_000) == ([], [], None)
    shown = trees.with_share(spark.createDataFrame(gains, "feature string, gain double, splits int")).collect()
    assert abs(sum(r.gain_pct for r in shown) - 100) < 0.1


def test_small_errors_dont_stop_a_fit(rows):
    """Whether a round gains doesn't depend on the unit of the label (F1 of round 4)."""
    names = ["a", "b", "c", "d"]
    small = rows.withColumn("y", F.col("y") / 1024)
    fits = [trees.fit_with_stop(df, names, "y", "held", rounds=20, depth=3).stages[-1] for df in (rows, small)]
    assert fits[0].getNumTrees == fits[1].getNumTrees > 10


def test_patience(rows):
    """The least error before the stop counts; a cut model is the first rounds of a longer one."""
    errors = [5.0, 4.0, 4.5, 4.2, 3.0, 3.1, 3.0, 3.2, 1.0]
    assert [trees.best_round(errors, p) for p in (1, 2, 3, 4, 9)] == [(2, True), (2, True), (5, True), (9, False), (9, False)]
    names, options = ["b", "c", "d"], {"rounds": 12, "depth": 2}
    whole = trees.fit_with_stop(rows, names, "noise", "held", **options, patience=12).stages[-1]
    soon = trees.fit_with_stop(rows, names, "noise", "held", **options, patience=1).stages[-1]
    assert soon.getNumTrees <= whole.getNumTrees < 12
    cut = trees.first_rounds(whole, 1)
    assert cut.getNumTrees == 1 and cut.treeWeights == [1.0] and cut.trees[0].toDebugString == whole.trees[0].toDebugString and cut.getFeaturesCol() == "vector"


def test_queries_leave_the_stop_to_held_rows(monkeypatch):
    """No query of folds limits rounds or depth below what a fit takes by itself (F1 of round 4)."""
    from barloom.plans import learned

    asked = []
    monkeypatch.setattr(learned, "labelled", lambda *_: None)
    monkeypatch.setattr(modelling, "walk_forward", lambda *_: None)
    monkeypatch.setattr(trees, "fit_folds", lambda *_, **options: asked.append(options) or ([], [], None))
    learned.fitted(None, "", 1)
    assert asked == [{}]


@pytest.fixture(scope="module")
def gaps(spark):
    """Rows whose label only tells whether ``a`` is missing, by NULL or NaN; values there are as likely to be the median as any."""
    data = [(i, [None, float("nan"), 0.0, 1.0, 1.0, 2.0][i % 6], float(i * 7 % 5), float(i % 6 < 2), i // 6 % 4 == 0) for i in range(600)]
    return spark.createDataFrame(data, "id int, a double, b double, y double, held boolean").cache()


def test_missing_values_are_told_apart(gaps):
    """Trees see which values were missing and not only a median in their place (F2 of round 4)."""
    names = ["a", "b"]
    model = modelling.boosted_trees(gaps, names, "y", rounds=2, depth=2)
    assert all(abs(r.prediction - r.y) < 1e-9 for r in model.transform(gaps).collect())
    assert dict(modelling.importances(model, names)) == pytest.approx({"a": 1.0, "b": 0.0})
    sure = modelling.boosted_trees(gaps, names, "y", classify=True, rounds=2, depth=2).transform(gaps)
    assert sure.where("prediction <> y").isEmpty()


def test_stopped_fits_tell_missing_values_apart(gaps):
    """The same in fits that stop, with a flag's gain and contribution under the name of its feature."""
    names = ["a", "b"]
    model = trees.fit_with_stop(gaps, names, "y", "held", rounds=3, depth=2, patience=1)
    assert [f for f, g, _ in trees.gains(model.stages[-1], names) if g > 0] == ["a"]
    for r in trees.explain(model.transform(gaps), model.stages[-1], names, [f"{n}_filled" for n in names]).collect():
        assert r.sanity_ok and abs(r.prediction - r.y) < 1e-9 and r.shap["b"] == 0.0 and (r.shap["a"] > 0) == (r.y == 1)


def test_variants_stop_where_validation_rows_ask(rows, monkeypatch):
    """Variants are fitted until their validation rows gain nothing more, and not for a fixed number of rounds (F2 of round 4)."""
    stopped, fit = [], trees.fit_with_stop
    monkeypatch.setattr(trees, "fit_with_stop", lambda *a, **o: stopped.append(fit(*a, **o)) or stopped[-1])
    part = F.when(F.col("held"), "validation").when(F.col("id") % 4 == 1, "test").otherwise("train")
    df = rows.withColumn("part", part)
    got = modelling.compare_variants(df, {"w": "y"}, {"all": ["a", "b", "c"], "some": ["b", "c"]}, depth=3, rounds=40, patience=20)
    assert {(r.window, r.variant): r.n for r in got.collect()} == {("w", "all"): 375, ("w", "some"): 375}
    assert len(stopped) == 2 and max(m.stages[-1].getNumTrees for m in stopped) > 20
    test = df.where("part = 'test'")
    errors = sorted(math.sqrt(m.transform(test).agg(F.avg((F.col("prediction") - F.col("y")) ** 2)).first()[0]) for m in stopped)
    assert sorted(r.rmse for r in got.collect()) == pytest.approx(errors)
