"""Properties of sampling, balancing, splitting, the classifier and KMeans."""

from pyspark.sql import functions as F

from catalytics.operators import ml as M
from catalytics.operators import sampling as SM
from catalytics.plans.queries import catalog, listings, scored, training
from helpers import SF_SMALL, rows


def test_balance_exact_counts(spark):
    t = training(spark, SF_SMALL)
    before = {r["demand_level"]: r["count"] for r in rows(t.groupBy("demand_level").count())}
    after = {r["demand_level"]: r["count"] for r in rows(SM.balance_classes(t).groupBy("demand_level").count())}
    assert set(after) == set(before)
    assert set(after.values()) == {max(before.values())}
    # originals are kept: every (asin, level) of the input appears
    b = SM.balance_classes(t)
    assert b.select("asin").distinct().count() == t.count()


def test_stratified_split_fractions(spark):
    f = SM.model_frame(scored(spark, SF_SMALL))
    per = rows(f.groupBy("demand_level").agg(F.count("*").alias("n"),
                                              F.count_if(F.col("split") == "train").alias("train")))
    for r in per:
        assert r["train"] == int(r["n"] * 0.8)


def test_class_rank_is_dense_and_exact(spark):
    s = scored(spark, SF_SMALL)
    r = SM.class_rank(s)
    per = rows(r.groupBy("demand_level").agg(F.count("*").alias("n"), F.min("r").alias("lo"),
                                              F.max("r").alias("hi"), F.countDistinct("r").alias("d")))
    for x in per:
        assert x["lo"] == 1 and x["hi"] == x["n"] == x["d"]


def test_label_encode_unseen_category_is_zero(spark):
    s = scored(spark, SF_SMALL)
    codes = SM.label_codes(s, "categoryName", unknown="Unknown")
    df = spark.createDataFrame([(1, "Brand#2"), (2, "never seen")], "asin long, categoryName string")
    got = {r["categoryName"]: r["c"] for r in rows(SM.apply_label_codes(df, codes, "categoryName", "c"))}
    names = sorted(r["categoryName"] for r in rows(s.select("categoryName").distinct()))
    assert got == {"never seen": 0, "Brand#2": names.index("Brand#2")}


def test_standardize_train_moments(spark):
    z = SM.standardize(SM.model_frame(scored(spark, SF_SMALL)))
    m = rows(z.where(F.col("split") == "train").agg(F.avg("z_price_norm").alias("m"),
                                                     F.stddev_pop("z_price_norm").alias("s")))[0]
    assert abs(m["m"]) < 1e-9 and abs(m["s"] - 1) < 1e-9


def test_mlp_trains_and_predicts(spark):
    s = scored(spark, SF_SMALL)
    model, frame = M.train_demand_model(s, max_iter=40)
    stats = rows(M.classification_metrics(model.transform(frame.where(F.col("split") == "test")),
                                          "demand_level", "predicted_level"))
    assert stats and 0 <= stats[0]["accuracy"] <= 100
    from catalytics.operators.listings import listing_view
    pred = rows(M.predict_demand(model, catalog(spark, SF_SMALL), listing_view(listings(spark, SF_SMALL))))
    assert pred
    for p in pred:
        assert p["demand_level"] in ("High", "Medium", "Low")
        assert abs(sum(p["probabilities"].values()) - 100.0) < 0.5
        assert p["confidence"] == max(p["probabilities"].values())


def test_kmeans_segments_order(spark):
    s = scored(spark, SF_SMALL)
    seg = M.category_segments(s)
    assert seg.count() == s.where(F.col("categoryName").isNotNull()).count()
    means = rows(seg.join(s.drop("categoryName"), "asin").groupBy("categoryName", "segment")
                 .agg(F.avg("demand_score").alias("m")))
    by_cat = {}
    for r in means:
        by_cat.setdefault(r["categoryName"], {})[r["segment"]] = r["m"]
    order = ["Hot", "Warm", "Cold"]
    for segs in by_cat.values():
        present = [segs[k] for k in order if k in segs]
        assert present == sorted(present, reverse=True)
        assert set(segs) <= set(order) and "Hot" in segs


def test_training_summary_counts(spark):
    t = rows(M.training_summary(scored(spark, SF_SMALL), max_iter=5))[0]
    assert t["train_samples"] + t["test_samples"] == t["total_samples"] == 200
    assert t["layers"] == "5-128-64-32-3" and t["iterations_run"] >= 1


PRODUCTS = "asin long, title string, categoryName string, price double, stars double, boughtInLastMonth long, isBestSeller boolean"


def _score(spark, rows_):
    from catalytics.operators.catalog import score_catalog
    return score_catalog(spark.createDataFrame(rows_, PRODUCTS))


def test_two_level_catalog_and_a_saved_model(spark, tmp_path):
    """Without High products the model has two outputs; loaded again, it scores a grown catalog's requests the same way."""
    from pyspark.ml import PipelineModel
    data = [(i, f"t{i}", f"C{i % 3 + 1}", 10.0 + i, 1.5 + (i % 5) / 2, i * 3, False) for i in range(60)]
    s = _score(spark, data)
    assert {r["demand_level"] for r in rows(s)} == {"Medium", "Low"}
    model, _ = M.train_demand_model(s, max_iter=30)
    assert M.model_classes(model) == ["Low", "Medium"]
    plain = s.select("asin", "title", "categoryName", "price", "stars", "boughtInLastMonth", "isBestSeller")
    req = plain.limit(10).union(spark.createDataFrame([(900, "x", "", 20.0, 3.0, 5, True), (901, "x", "unseen", 20.0, 3.0, 5, True)], PRODUCTS))
    before = {r["asin"]: r for r in rows(M.predict_demand(model, plain, req))}
    assert len(before) == 12 and all(set(r["probabilities"]) == {"Low", "Medium"} for r in before.values())
    model.write().overwrite().save(f"{tmp_path}/model")
    loaded = PipelineModel.load(f"{tmp_path}/model")
    grown = plain.union(spark.createDataFrame([(950, "x", "A new first category", 20.0, 3.0, 5, True)], PRODUCTS))
    assert {r["asin"]: r for r in rows(M.predict_demand(loaded, grown, req))} == before


def _clusters(spark, points):
    df = spark.createDataFrame([(i, c, float(p), float(y)) for i, (c, p, y) in enumerate(points)],
                               "asin long, categoryName string, price double, demand_score double")
    return {r["asin"]: r for r in rows(M.category_segments(df))}


def test_kmeans_of_equal_scores_and_few_rows(spark):
    got = _clusters(spark, [("a", 10, 50), ("a", 500, 50), ("a", 1000, 50), ("b", 1, 1), ("c", 5, 9), ("c", 6, 90), ("d", 3, 3), ("d", 3, 3), ("d", 3, 3)])
    assert len({got[i]["cluster"] for i in (0, 1, 2)}) == 3 and len({got[i]["segment"] for i in (0, 1, 2)}) == 3
    assert got[3]["segment"] == "Hot"
    assert (got[4]["segment"], got[5]["segment"]) == ("Warm", "Hot")
    assert {got[i]["segment"] for i in (6, 7, 8)} == {"Hot"}


def test_kmeans_ends_at_a_fixed_point(spark):
    """Every point is nearest to its own cluster's mean, in units of the category's standard deviations."""
    import random
    rng = random.Random(3)
    points = [("a", rng.gauss(100 * g, 20), 20 + 30 * g + rng.gauss(0, 4)) for g in range(3) for _ in range(60)]
    got = _clusters(spark, points)
    mean = lambda v: sum(v) / len(v)
    sd = [(mean([p[k] ** 2 for p in points]) - mean([p[k] for p in points]) ** 2) ** 0.5 for k in (1, 2)]
    by = {}
    for i, p in enumerate(points):
        by.setdefault(got[i]["cluster"], []).append(p)
    centers = {c: (mean([p[1] for p in v]), mean([p[2] for p in v])) for c, v in by.items()}
    for i, p in enumerate(points):
        d = {c: ((p[1] - x) / sd[0]) ** 2 + ((p[2] - y) / sd[1]) ** 2 for c, (x, y) in centers.items()}
        assert d[got[i]["cluster"]] <= min(d.values()) + 1e-9


def _points(spark, seed=5):
    """Two categories of many and two of few points; half of the points occur several times."""
    import random
    rng = random.Random(seed)
    data = [(c, round(rng.gauss(g * 80, 25), 2), round(min(100.0, max(0.0, 20 + 25 * g + rng.gauss(0, 9))), 2))
            for c, n in (("a", 90), ("b", 60)) for g in range(3) for _ in range(n)]
    data += data[::2] + [("c", 1.0, 2.0), ("c", 1.0, 2.0), ("d", 4.0, 5.0), ("d", 6.0, 7.0), ("e", 4.0, 5.0)]
    return spark.createDataFrame([(i, *p) for i, p in enumerate(data)], "asin long, categoryName string, price double, demand_score double")


def _centers(spark, starts, in_task):
    from pyspark.sql import functions as F
    from catalytics.operators import clusters as K
    df = _points(spark).withColumns({"x": F.col("price"), "y": F.col("demand_score")})
    pts = df.groupBy("categoryName", "x", "y").agg(F.count("*").alias("m"))
    scale = df.groupBy("categoryName").agg(F.stddev_pop("x").alias("sp"), F.stddev_pop("y").alias("ss"))
    out = {}
    for r in rows(K.category_centers(pts, scale, 3, starts, in_task)):
        out.setdefault(r["categoryName"], {})[r["cid"]] = (round(r["cx"], 9), round(r["cy"], 9), round(r["inertia"], 6), round(r["first"], 6))
    return out


def test_kmeans_over_tasks_equals_kmeans_in_a_task_and_more_starts_never_lose(spark):
    inside, spread = _centers(spark, 10, 10_000), _centers(spark, 10, 20)     # a and b are over 20 points
    assert inside == spread and {c: len(v) for c, v in inside.items()} == {"a": 3, "b": 3, "c": 2, "d": 2, "e": 1}
    one = _centers(spark, 1, 10_000)
    for c, v in inside.items():
        assert all(x[2] <= x[3] == one[c][0][2] for x in v.values())           # inertia kept <= inertia of the first start


def test_kmeans_loop_reads_fewer_starts_at_every_step(spark, monkeypatch):
    from catalytics.operators import clusters as K
    seen, written = [], K._written

    def counting(df, name):
        out = written(df, name)
        if name == "kmeans-centers" and "start" in out.columns:
            seen.append(out.select("c", "start").distinct().count())
        return out

    monkeypatch.setattr(K, "_written", counting)
    _centers(spark, 4, 20)
    assert seen == sorted(seen, reverse=True) and seen[-1] < seen[0] == 8


def test_drawn_seeds_follow_the_squared_distance():
    """Of three places the far one is drawn second with the chance that its squared distance has."""
    import numpy as np
    from catalytics.operators.clusters import drawn_seeds
    x, y, m = np.array([0.0, 1.0, 3.0]), np.zeros(3), np.array([1e9, 1.0, 1.0])
    rng, far = np.random.default_rng(1), 0
    for _ in range(2000):
        centers = drawn_seeds(x, y, m, 1 - rng.random((2, 3)), 2, 1.0, 1.0)
        far += centers[1, 0] == 3
    assert abs(far / 2000 - 0.9) < 0.03


def test_perceptron_fit_follows_sparks_own(spark):
    """The loss of every early iteration is that of Spark's MultilayerPerceptronClassifier; later ones differ in the order of sums."""
    import numpy as np
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.linalg import Vectors
    from catalytics.operators import perceptron as PC
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 2))
    data = [(float(a), float(b), float(int(a + b > 0) + int(a * b > 0.5))) for a, b in x]
    df = spark.createDataFrame(data, "a double, b double, label double").coalesce(1).persist()
    vectors = spark.createDataFrame([(Vectors.dense(r[:2]), r[2]) for r in data], ["features", "label"]).coalesce(1)
    mlp = MultilayerPerceptronClassifier(layers=[2, 6, 4, 3], blockSize=64, seed=42)
    first = mlp.copy({mlp.maxIter: 0}).fit(vectors).weights.toArray()
    theirs = mlp.copy({mlp.maxIter: 12}).fit(vectors)
    weights, losses = PC.fit_weights(df, ["a", "b"], "label", [2, 6, 4, 3], first, 12, 64)
    expected = theirs.summary().objectiveHistory if callable(theirs.summary) else theirs.summary.objectiveHistory
    assert len(losses) == len(expected) == 13 and np.allclose(losses, list(expected), rtol=1e-6)
    assert np.allclose(weights, theirs.weights.toArray(), rtol=1e-4, atol=1e-6)


def test_perceptron_gradient_is_the_slope_of_the_loss():
    import numpy as np
    from catalytics.operators import mlp as T
    from catalytics.operators import perceptron as PC
    rng, widths = np.random.default_rng(1), [3, 5, 4, 3]
    x, y, share = rng.normal(size=(7, 3)), rng.integers(0, 3, 7), rng.uniform(0.1, 1, 7)
    flat = T.first_weights(widths, 2)
    _, g = PC.loss_and_gradient(x, y, share, flat, widths)
    for k in range(0, len(flat), 5):
        e = np.zeros_like(flat)
        e[k] = 1e-6
        slope = (PC.loss_and_gradient(x, y, share, flat + e, widths)[0] - PC.loss_and_gradient(x, y, share, flat - e, widths)[0]) / 2e-6
        assert abs(slope - g[k]) < 1e-6


def test_demand_model_is_not_fitted_by_rows_in_the_jvm(spark, monkeypatch):
    """Spark's classifier holds the weights and draws the first ones; it makes no iteration over the rows itself."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    seen, fit = [], MultilayerPerceptronClassifier.fit
    monkeypatch.setattr(MultilayerPerceptronClassifier, "fit", lambda self, df, *a: seen.append((self.getMaxIter(), df.count())) or fit(self, df, *a))
    model, _ = M.train_demand_model(_score(spark, [(i, f"t{i}", f"C{i % 3 + 1}", 10.0 + i, 1.5 + (i % 5) / 2, i * 3, False) for i in range(60)]), max_iter=3)
    assert seen == [(0, 1), (0, 1)] and len(model.losses) == 4 and model.losses[-1] < model.losses[0]


def test_a_feature_without_a_value_ends_the_fit(spark):
    """As Spark's own fit does: no model is made of such rows."""
    import pytest
    from catalytics.operators import perceptron as PC
    df = spark.createDataFrame([(1.0, 0.0), (None, 1.0)], "a double, label double")
    with pytest.raises(Exception, match="null or not a finite number"):
        PC.fit_weights(df, ["a"], "label", [1, 2, 2], PC.np.zeros(10), 2, 64)
