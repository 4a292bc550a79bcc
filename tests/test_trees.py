"""Boosted and extremely randomised trees against plain recursive versions on small tables."""

import numpy as np
import pandas as pd
import pytest

from tabwright.operators import boosting, extra_trees, forest, models, packed


def table(seed=1, n=240):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"a": rng.integers(0, 12, n).astype(float), "b": rng.integers(0, 5, n) / 4, "c": rng.integers(0, 40, n).astype(float)})
    pdf["y"] = np.round(3 * pdf.a - pdf.b * pdf.c + rng.normal(size=n), 3)
    pdf["two"] = (pdf.y > pdf.y.median()).astype(float)
    pdf["three"] = np.digitize(pdf.y, np.quantile(pdf.y, [0.3, 0.7])).astype(float)
    pdf["fold"] = np.arange(n) % 3
    return pdf


FEATURES = ["a", "b", "c"]


def plain_boost(x, y, classes, s):
    """Margins (outputs, rows) after all rounds, by trying every value of every feature at every leaf."""
    outputs = classes if classes > 2 else 1
    if not classes:
        base = [y.mean()]
    elif outputs == 1:
        base = [np.log(y.mean() / (1 - y.mean()))]
    else:
        base = [np.log((y == k).mean()) for k in range(classes)]
    m = np.tile(np.array(base)[:, None], (1, len(y)))
    factor = s.curvature_factor or classes / max(classes - 1, 1)
    for _ in range(s.rounds):
        if not classes:
            g, h = m - y, np.ones_like(m)
        elif outputs == 1:
            p = 1 / (1 + np.exp(-m))
            g, h = p - y, p * (1 - p)
        else:
            p = np.exp(m) / np.exp(m).sum(0)
            g, h = p - (y == np.arange(classes)[:, None]), factor * p * (1 - p)
        for k in range(outputs):
            m[k] += plain_tree(x, g[k], h[k], s)
    return m


def plain_cut(x, g, h, s):
    score = lambda a, b: a**2 / (b + s.penalty)
    best = (1e-12, None)
    for f in range(x.shape[1]):
        for v in np.unique(x[:, f]):
            left = x[:, f] <= v
            if min(left.sum(), (~left).sum()) < max(s.min_rows, 1) or min(h[left].sum(), h[~left].sum()) < s.min_curvature:
                continue
            gain = score(g[left].sum(), h[left].sum()) + score(g[~left].sum(), h[~left].sum()) - score(g.sum(), h.sum())
            if gain > best[0] + 1e-9:
                best = (gain, (f, v))
    return best


def plain_tree(x, g, h, s):
    leaves = {0: (np.arange(len(g)), 0)}
    count = 1
    while True:
        found = {n: plain_cut(x[r], g[r], h[r], s) for n, (r, d) in leaves.items() if s.depth is None or d < s.depth}
        ready = sorted((n for n in found if found[n][1]), key=lambda n: (-found[n][0], n))
        if s.leaves is not None:
            left = s.leaves - len(leaves)
            ready = ready[: max(1, left // 2) if left > 0 else 0]
        if not ready:
            break
        for n in ready:
            r, d = leaves.pop(n)
            f, v = found[n][1]
            go = x[r, f] <= v
            leaves[count], leaves[count + 1] = (r[go], d + 1), (r[~go], d + 1)
            count += 2
    out = np.zeros(len(g))
    for r, _ in leaves.values():
        out[r] = -s.step * g[r].sum() / (h[r].sum() + s.penalty)
    return out


@pytest.mark.parametrize("target, classes", [("y", 0), ("two", 2), ("three", 3)])
@pytest.mark.parametrize("s", [boosting.Settings(rounds=3, depth=3, curvature_factor=2.0), boosting.Settings(rounds=3, step=0.2, depth=None, leaves=9, penalty=0.1, min_curvature=1e-3, min_rows=8)])
def test_boosting_equals_a_plain_version(spark, monkeypatch, target, classes, s):
    monkeypatch.setattr(packed, "BLOCK", 23)
    monkeypatch.setattr(packed, "FAN_IN", 2)
    pdf = table()
    df = spark.createDataFrame(pdf)
    fitted = boosting.train(df, FEATURES, ["true", "fold <> 1"], classes, s, target)
    for m, kept in zip(fitted, (pdf, pdf[pdf.fold != 1])):
        x = kept[FEATURES].to_numpy()
        want = plain_boost(x, kept[target].to_numpy(), classes, s)
        np.testing.assert_allclose(m.margins(x), want, rtol=1e-6, atol=1e-8)
        assert len(m.trees) == s.rounds and all(len(t) == len(want) for t in m.trees)
    got = fitted[0].transform(df.withColumn("prediction", df.a)).toPandas()
    np.testing.assert_allclose(got.prediction, fitted[0].predict(got[FEATURES].to_numpy()))
    assert fitted[0].importances().sum() == pytest.approx(1)


def test_boosting_of_degenerate_tables(spark):
    s = boosting.Settings(rounds=2)
    one = spark.createDataFrame([(1.0, 5.0), (1.0, 7.0)], "a double, label double")
    m = boosting.train(one, ["a"], ["true", "false"], 0, s)
    assert m[0].predict(np.array([[1.0], [3.0]])).tolist() == [6.0, 6.0]
    assert m[1].predict(np.array([[1.0]])).tolist() == [0.0]
    single = boosting.train(one.withColumn("label", one.a - 1), ["a"], ["true"], 1, s)[0]
    assert single.predict(np.array([[1.0]])).tolist() == [0.0]


def plain_extra_tree(x, y, classes, s, tree):
    """{node: (feature, cut)} grown node by node, level by level, with the same draws."""
    sums = lambda r: extra_trees.weights(y[r], classes).sum(0)
    most = max(1, int(len(x[0]) ** 0.5)) if classes else len(x[0])
    level, out, count, depth = [(0, np.arange(len(y)))], {}, 1, 0
    while level and depth < s.depth:
        below = []
        for n, r in level:
            whole = extra_trees.impurity(sums(r), classes)
            if whole <= 1e-12:
                continue
            order = sorted((extra_trees.draw(s.seed, tree, n, f, 1), f) for f in range(x.shape[1]) if x[r, f].min() < x[r, f].max())[:most]
            best = None
            for _, f in order:
                lo, hi = x[r, f].min(), x[r, f].max()
                v = lo + extra_trees.draw(s.seed, tree, n, f, 2) * (hi - lo)
                v = lo if v >= hi else v
                left = x[r, f] <= v
                gain = whole - extra_trees.impurity(sums(r[left]), classes) - extra_trees.impurity(sums(r[~left]), classes)
                if best is None or gain > best[0] + 1e-9 * whole:
                    best = (gain, f, v, r[left], r[~left])
            if best:
                out[n] = (best[1], best[2])
                below += [best[3], best[4]]
        level = list(zip(range(count, count + len(below)), below))
        count += len(below)
        depth += 1
    return out


@pytest.mark.parametrize("target, classes", [("y", 0), ("three", 3)])
def test_extra_trees_equal_a_plain_version(spark, monkeypatch, target, classes):
    monkeypatch.setattr(packed, "BLOCK", 31)
    monkeypatch.setattr(packed, "FAN_IN", 2)
    monkeypatch.setattr(extra_trees, "TREES_AT_ONCE", 3)
    pdf = table(2)
    s = extra_trees.Settings(trees=4, depth=4, seed=9)
    fitted = extra_trees.train(spark.createDataFrame(pdf), FEATURES, ["true", "fold <> 0"], classes, s, target)
    for forest, kept in zip(fitted, (pdf, pdf[pdf.fold != 0])):
        x, y = kept[FEATURES].to_numpy(), kept[target].to_numpy()
        for k, t in enumerate(forest.trees):
            got = {int(n): (int(t.feature[n]), t.cut[n]) for n in np.flatnonzero(t.feature >= 0)}
            assert got == plain_extra_tree(x, y, classes, s, k)
    assert len({str(t.cut.tolist()) for t in fitted[0].trees}) == 4
    x, y = pdf[FEATURES].to_numpy(), pdf[target].to_numpy()
    p = fitted[0].predict(x)
    assert (p == y).mean() > 0.8 if classes else 1 - ((p - y) ** 2).sum() / ((y - y.mean()) ** 2).sum() > 0.6


@pytest.mark.parametrize("name, target", [("xgboost", "three"), ("lightgbm", "y"), ("extra_trees", "three")])
def test_joint_learners_in_cross_validation(spark, name, target):
    pdf = table(3, 300).rename(columns={"fold": "id"})
    pdf["id"] = np.arange(300)
    df = spark.createDataFrame(pdf[["id", *FEATURES, target]])
    r = models.train_models(df, target, "id", [name], folds=3, rounds=5, trees=6, depth=4).first()
    assert r.error is None and len(r.cv_scores) == 3 and r.mean_score > 0.4
    task = "classification" if target == "three" else "regression"
    r = models.train_on_split(df, target, "id", [name], task, folds=3, rounds=5, trees=6, depth=4).first()
    assert r.error is None and (r.accuracy if target == "three" else r.r2) > 0.4 and r.cv_mean > 0.4
    top = models.feature_importance(df, target, "id", name, rounds=2, trees=3, depth=3).collect()
    assert len(top) == 3 and 0.99 < sum(t.importance for t in top) < 1.01


def test_all_rounds_of_boosting_are_one_job(spark):
    df = spark.createDataFrame(table(n=60))
    jobs = []
    for rounds in (1, 4):
        group = f"boosting-{rounds}"
        spark.sparkContext.setJobGroup(group, group)
        boosting.train(df, FEATURES, ["true"], 0, boosting.Settings(rounds=rounds, depth=2), "y")
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]


def test_extra_trees_with_one_candidate_take_one_pass_for_each_level(spark, monkeypatch):
    """Three features and classes: each node draws one candidate, which is its cut."""
    passes, reduce = [], extra_trees.reduce_by_slot
    monkeypatch.setattr(extra_trees, "reduce_by_slot", lambda *a: passes.append(1) or reduce(*a))
    pdf = table()
    depth = 3
    forest = extra_trees.train(spark.createDataFrame(pdf), FEATURES, ["fold <> 1"], 3, extra_trees.Settings(trees=2, depth=depth), "three")[0]
    assert len(passes) <= depth + 1
    x = pdf[pdf.fold != 1][FEATURES].to_numpy()
    y = pdf[pdf.fold != 1].three.to_numpy()
    for t in forest.trees:
        leaf = t.leaf_of(np.ascontiguousarray(x.T))
        assert (t.feature[leaf] == -1).all()
        for n in np.unique(leaf):
            assert t.sums[n].tolist() == np.bincount(y[leaf == n].astype(int), minlength=3).tolist()
        inner = np.flatnonzero(t.feature >= 0)
        below = extra_trees.impurity(t.sums[t.left[inner]], 3) + extra_trees.impurity(t.sums[t.left[inner] + 1], 3)
        assert np.allclose(t.gain[inner], np.maximum(extra_trees.impurity(t.sums[inner], 3) - below, 0))


def plain_forest_tree(x, y, weight, classes, s, tree, cuts):
    """{node: (feature, cut)} by trying every cut of the candidates of every node, with sibling leaves of one class put together."""
    sums = lambda r: np.bincount(y[r], weight[r], classes)
    most = int(np.ceil(x.shape[1] ** 0.5))
    level, out, count, of = [(0, np.flatnonzero(weight))], {}, 1, {}
    for _ in range(s.depth):
        below = []
        for n, r in level:
            whole, best = extra_trees.impurity(sums(r), classes), (0, None)
            of[n] = sums(r)
            for f in forest.candidates(s.seed, tree, np.array([n]), x.shape[1], most)[0]:
                for c in cuts[f]:
                    left = x[r, f] <= c
                    gain = whole - extra_trees.impurity(sums(r[left]), classes) - extra_trees.impurity(sums(r[~left]), classes)
                    if gain > best[0] + 1e-9 * len(y):
                        best = (gain, (f, c, r[left], r[~left]))
            if best[1]:
                out[n] = (best[1][0], best[1][1], count)
                for r in best[1][2:]:
                    of[count] = sums(r)
                    if extra_trees.impurity(of[count], classes) > 1e-9:
                        below.append((count, r))
                    count += 1
        level = below
    for n in sorted(out, reverse=True):
        a = out[n][2]
        if a not in out and a + 1 not in out and of[a].argmax() == of[a + 1].argmax():
            del out[n]
    return {n: v[:2] for n, v in out.items()}


@pytest.mark.parametrize("rows, sums", [(1 << 17, 1 << 18), (40, 500)])  # one part; several parts, with sums merged in steps
def test_random_forest_equals_a_plain_version(spark, monkeypatch, rows, sums):
    monkeypatch.setattr(forest, "PART_ROWS", rows)
    monkeypatch.setattr(forest, "SUMS", sums)
    monkeypatch.setattr(packed, "FAN_IN", 2)
    pdf = table(4, 160)
    pdf = pd.concat([pdf, pdf[:70], pdf[:40]])  # equal rows are drawn together
    s, conditions = forest.Settings(trees=5, depth=4, seed=9), ["true", "fold <> 0"]
    df = spark.createDataFrame(pdf)
    cuts = forest.bin_cuts(df, FEATURES)
    assert [len(c) for c in cuts[:2]] == [pdf.a.nunique() - 1, pdf.b.nunique() - 1]
    merged = forest.merged_rows(df, FEATURES, "three", conditions, cuts).selectExpr("x", "y", "sets", "n", "xxhash64(x, y, sets) AS key").toPandas()
    assert merged.n.sum() == len(pdf) > len(merged)
    fitted = forest.train(df, FEATURES, conditions, 3, s, "three")
    bins, y, key = np.array([list(x) for x in merged.x]), merged.y.to_numpy(), merged.key.to_numpy()
    values = np.column_stack([np.r_[c, np.inf][bins[:, i]] for i, c in enumerate(cuts)])
    for m, f in enumerate(fitted):
        own = merged.sets.to_numpy() >> m & 1
        for k, t in enumerate(f.trees):
            weight = forest.poisson(merged.n.to_numpy(), s.seed, k, key) * own
            got = {int(n): (int(t.feature[n]), t.cut[n]) for n in np.flatnonzero(t.feature >= 0)}
            reached, todo = set(), [0]
            while todo:
                if (n := todo.pop()) in got:
                    reached.add(n)
                    todo += [int(t.left[n]), int(t.left[n]) + 1]
            assert {n: got[n] for n in reached} == plain_forest_tree(values, y, weight, 3, s, k, cuts)
            assert t.sums[0].tolist() == np.bincount(y, weight, 3).tolist()
    x = pdf[FEATURES].to_numpy()
    assert (fitted[0].predict(x) == pdf.three.to_numpy()).mean() > 0.8


def test_merged_rows_of_a_forest_follow_bins_and_passes_follow_levels(spark):
    """Eight times the rows in the same bins make no larger table to pass over, and six training sets no more jobs than one."""
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"a": rng.random(4000), "b": rng.integers(0, 3, 4000), "label": rng.integers(0, 2, 4000)})
    few, many = (spark.createDataFrame(p) for p in (pdf[:500], pdf))
    cuts = forest.bin_cuts(few, ["a", "b"])
    sizes = [forest.merged_rows(d, ["a", "b"], "label", ["true"], cuts).count() for d in (few, many)]
    assert sizes[0] <= sizes[1] <= 32 * 3 * 2
    jobs = []
    learner = models._estimator("random_forest", models.Facts("classification", 500, ("a", "b"), 2, 1.0, 1.0, depth=3, trees=4))
    for sets in (1, 6):
        group = f"forest-{sets}"
        spark.sparkContext.setJobGroup(group, group)
        learner.train(few, ["a", "b"], [f"a > {k / 100}" for k in range(sets)], 2)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]


def test_random_forest_of_degenerate_tables(spark):
    s = forest.Settings(trees=3, depth=2)
    one = spark.createDataFrame([(1.0, 0.0)] * 9 + [(1.0, 1.0)] * 30, "a double, label double")
    flat = forest.train(one, ["a"], ["true", "label = 1"], 2, s)
    assert [f.predict(np.array([[1.0], [9.0]])).tolist() for f in flat] == [[1.0, 1.0]] * 2
    assert forest.train(one, ["a"], ["true"], 2, forest.Settings(trees=1, depth=0))[0].predict(np.array([[1.0]])).tolist() == [1.0]
    with pytest.raises(ValueError, match="without rows"):
        forest.train(one, ["a"], ["true", "false"], 2, s)


@pytest.mark.parametrize("mean", [1, 2, 10, 11, 300, 20_000])
def test_poisson_draws(mean):
    k = np.arange(100_000)
    got = forest.poisson(np.full(len(k), mean), 42, 7, k)
    assert abs(got.mean() - mean) < 5 * (mean / len(k)) ** 0.5
    assert abs(got.var() / mean - 1) < 0.03
    want = np.random.default_rng(1).poisson(mean, len(k))
    for q in (mean - mean**0.5, mean, mean + 2 * mean**0.5):
        assert abs((got <= q).mean() - (want <= q).mean()) < 0.01
    some = k[::7]
    assert np.array_equal(got[::7], forest.poisson(np.full(len(some), mean), 42, 7, some))  # nothing depends on the place


def test_random_forest_in_cross_validation(spark):
    test_joint_learners_in_cross_validation(spark, "random_forest", "three")


@pytest.mark.parametrize("rows, sums, repeats", [(1 << 20, 1 << 18, 1), (60, 500, 1), (1 << 20, 1 << 18, 12)])  # one part; several parts; rows added up by bins
def test_random_forest_for_numbers_equals_a_plain_version(spark, monkeypatch, rows, sums, repeats):
    monkeypatch.setattr(forest, "NUMBER_ROWS", rows)
    monkeypatch.setattr(forest, "SUMS", sums)
    monkeypatch.setattr(forest, "SLICE", 50)
    monkeypatch.setattr(packed, "FAN_IN", 2)
    pdf = pd.concat([table(3, 150).assign(y=lambda d, k=k: d.y + k) for k in range(repeats)])
    pdf = pd.concat([pdf, pdf[:40]])  # equal rows are drawn together
    s, conditions = forest.Settings(trees=4, depth=4, seed=9), ["true", "fold <> 0"]
    df = spark.createDataFrame(pdf)
    cuts, scale = forest.bin_cuts(df, FEATURES), forest.label_scale(df, "y")
    merged = forest.merged_rows(df, FEATURES, "y", conditions, cuts, scale).selectExpr("x", "y", "sets", "n", "xxhash64(x, y, sets) AS key").toPandas()
    assert merged.n.sum() == len(pdf) > len(merged)
    bins, y, key = np.array([list(x) for x in merged.x]), merged.y.to_numpy(), merged.key.to_numpy()
    order = np.lexsort(bins.T[::-1])
    points = forest._Points.of(np.ascontiguousarray(bins[order].T).astype(np.uint8), key[order], y[order].view(np.int64), merged.sets.to_numpy()[order], merged.n.to_numpy()[order])
    assert (points.cell is not None) == (repeats > 1)
    values = np.column_stack([np.r_[c, np.inf][bins[:, i]] for i, c in enumerate(cuts)])
    fitted = forest.train(df, FEATURES, conditions, 0, s, "y")
    for m, f in enumerate(fitted):
        own = merged.sets.to_numpy() >> m & 1
        for k, t in enumerate(f.trees):
            w = forest.poisson(merged.n.to_numpy(), s.seed, k, key) * own
            todo = [(0, np.flatnonzero(w), 0)]
            while todo:
                n, r, depth = todo.pop()
                assert np.allclose(t.sums[n], [w[r].sum(), (w * (y * scale[1] + scale[0]))[r].sum()])
                spread = lambda q: (w[q] * (y[q] - np.average(y[q], weights=w[q])) ** 2).sum() if len(q) else 0.0
                tried = {}
                for c in forest.candidates(s.seed, k, np.array([n]), 3, 1)[0]:
                    for v in cuts[c]:
                        left = values[r, c] <= v
                        if left.any() and not left.all():
                            tried[int(c), v] = spread(r) - spread(r[left]) - spread(r[~left])
                best = max(tried.values(), default=0.0)
                if depth == s.depth or best <= 1e-9 * w[r].sum():
                    assert t.feature[n] < 0
                    continue
                cut = (int(t.feature[n]), t.cut[n])
                assert tried[cut] == pytest.approx(best) == pytest.approx(t.gain[n])
                left, a = values[r, cut[0]] <= cut[1], int(t.left[n])
                todo += [(a, r[left], depth + 1), (a + 1, r[~left], depth + 1)]
    x = pdf[FEATURES].to_numpy()
    assert 1 - ((pdf.y - fitted[0].predict(x)) ** 2).sum() / ((pdf.y - pdf.y.mean()) ** 2).sum() > 0.5


def test_random_forest_for_numbers_of_degenerate_tables(spark):
    s = forest.Settings(trees=3, depth=2)
    df = spark.createDataFrame([(1.0, 7.0)] * 9 + [(2.0, 7.0)] * 3, "a double, label double")
    flat = forest.train(df, ["a"], ["true"], 0, s)[0]
    assert np.allclose(flat.predict(np.array([[1.0], [9.0]])), 7.0) and not flat.importances().any()
    with pytest.raises(ValueError, match="without rows"):
        forest.train(df, ["a"], ["true", "false"], 0, s)


def test_forests_for_numbers_grow_all_folds_at_once_and_explain_in_the_same_passes(spark):
    """The library's forest took its own passes for each fold, and kept all rows with a weight for each tree."""
    df = spark.range(400).selectExpr("id", "CAST(id % 7 AS DOUBLE) AS a", "rand(3) AS b", "id % 7 + rand(4) AS y")
    learner = models._estimator("random_forest", models.Facts("regression", 400, ("a", "b"), 0, 1.0, 1.0, depth=3, trees=4))
    jobs = []
    for sets in (1, 6):
        group = f"numbers-{sets}"
        spark.sparkContext.setJobGroup(group, group)
        forest.train(df, ["a", "b"], [f"id % 6 <> {k}" for k in range(sets)], 0, learner, "y")
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]
    got = {r.feature: r.importance for r in models.explain_last_numeric(df.select("a", "b", "y"), trees=8).collect()}
    assert got["a"] > got["b"] and sum(got.values()) == pytest.approx(1.0, abs=1e-3)
