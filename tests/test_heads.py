import numpy as np
import pytest
from pyspark.sql import functions as F

from labelmill.operators import heads as HD
from labelmill.operators import vectors as K

RNG = np.random.default_rng(12)
N = 400
DATA = RNG.normal(size=(N, 6)) @ RNG.normal(size=(6, 6))
UNIT = DATA / np.linalg.norm(DATA, axis=1, keepdims=True)
KIND = np.where(UNIT[:, 0] + 0.2 * RNG.normal(size=N) > 0.3, "hi", np.where(UNIT[:, 1] > 0.1, "mid", "lo"))
TAGS = {t: UNIT[:, i % 6] + 0.3 * RNG.normal(size=N) > 0.2 + 0.02 * i for i, t in enumerate("abcdefghijkl")}
FLAG = UNIT[:, 2] > 0.5
SETS = {"tags": list("abc")}
CLASSES = {"kind": ["hi", "mid", "lo"]}


@pytest.fixture(scope="module")
def rows(spark):
    records = [(i, v.tolist(), str(KIND[i]), bool(FLAG[i]) or None, [t for t in TAGS if TAGS[t][i]]) for i, v in enumerate(UNIT)]
    return spark.createDataFrame(records, "id int, vector array<double>, kind string, flag boolean, tags array<string>").repartition(5).cache()


@pytest.fixture(scope="module")
def model(rows):
    return HD.fit(rows, ["flag"], SETS, CLASSES)


def balanced(y):
    values, counts = np.unique(y, return_counts=True)
    weight = {v: len(y) / (len(values) * c) for v, c in zip(values, counts)}
    return np.array([weight[v] for v in y])


def test_every_head_is_at_its_optimum(model):
    """The gradient of the balanced summed loss plus unit ridge vanishes."""
    targets = {"flag": FLAG, **{t: TAGS[t] for t in "abc"}}
    for head in model.heads[:4]:
        y = targets[head.labels[0]].astype(float)
        error = balanced(y) * (1 / (1 + np.exp(-(UNIT @ head.coefficients[0] + head.intercepts[0]))) - y)
        assert np.abs(UNIT.T @ error + head.coefficients[0]).max() < 1e-6 and abs(error.sum()) < 1e-6
    (head,) = model.of("kind")
    p = np.exp(UNIT @ head.coefficients.T + head.intercepts)
    p /= p.sum(axis=1, keepdims=True)
    y = np.array([[k == label for label in head.labels] for k in KIND], dtype=float)
    error = (p - y) * balanced(KIND)[:, None]
    assert np.abs(error.T @ UNIT + head.coefficients).max() < 1e-6 and np.abs(error.sum(axis=0)).max() < 1e-6


def test_coefficients_are_those_of_single_fits(rows, model):
    single = K.embed(rows.withColumnRenamed("vector", "embedding"), normalize=False)
    estimator = K._regression("vector", "__member", "binomial", 5000, 1.0 / N).setTol(1e-14)
    for head, member in [(model.of("flag")[0], F.coalesce("flag", F.lit(False))), (model.of("tags")[1], F.array_contains("tags", "b"))]:
        one = estimator.fit(K.balanced_weights(single.select("vector", member.cast("int").alias("__member")), "__member"))
        assert np.allclose(head.coefficients[0], one.coefficients.toArray(), atol=1e-6) and head.intercepts[0] == pytest.approx(one.intercept, abs=1e-6)


def test_predictions_agree_with_the_fits_one_by_one(rows, model):
    single = K.embed(rows.withColumnRenamed("vector", "embedding"), normalize=False)
    old = K.predict(single, K.fit(single, ["flag"], SETS, CLASSES), exclusive=()).select("id", "pred_flag", "pred_tags", "pred_kind")
    for vectors in (rows, single):  # arrays, and vectors of the library
        new = HD.predict(vectors, model, exclusive=()).select("id", "pred_flag", "pred_tags", "pred_kind")
        assert sum(a != b for a, b in zip(old.orderBy("id").collect(), new.orderBy("id").collect())) <= 2
    best = HD.predict(rows, model, exclusive=("tags",)).collect()
    assert max(len(r.pred_tags) for r in best) == 1 and best[0].__contains__("pred_flag")


def test_jobs_do_not_grow_with_labels(spark, rows, monkeypatch):
    jobs = {}
    for n in (1, 12):
        spark.sparkContext.setJobGroup(f"heads {n}", "count jobs")
        fitted = HD.fit(rows, sets={"tags": list(TAGS)[:n]})
        jobs[n] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"heads {n}"))
        assert len(fitted.heads) == n and fitted.passes < 40
    assert jobs[12] <= 1.5 * jobs[1] + 5
    monkeypatch.setattr(HD, "FEW_PARTS", 2)
    again = HD.fit(rows, sets={"tags": ["a"]})
    assert np.allclose(again.heads[0].coefficients, HD.fit(rows, sets={"tags": ["a"]}).heads[0].coefficients, atol=1e-8)


def test_stored_models_predict_the_same(spark, rows, model, tmp_path):
    HD.save(model, spark, str(tmp_path / "heads"))
    back = HD.load(spark, str(tmp_path / "heads"))
    one, two = (HD.predict(rows, m).orderBy("id").collect() for m in (model, back))
    assert one == two


def test_odd_tables(spark, rows):
    with pytest.raises(ValueError, match="kind has rows"):
        HD.fit(rows, classes={"kind": ["hi", "mid"]})
    with pytest.raises(ValueError, match="no rows"):
        HD.fit(rows.filter("false"), ["flag"])
    same = HD.fit(rows.withColumn("all", F.lit(True)), ["all"])
    assert {r.pred_all for r in HD.predict(rows, same).collect()} == {1}
    pair = HD.fit(rows.withColumn("kind", F.when(F.col("kind") == "hi", "hi").otherwise("lo")), classes={"kind": ["hi", "lo"]})
    assert {r.pred_kind for r in HD.predict(rows, pair).collect()} == {"hi", "lo"}
    assert HD.predict(rows.filter("false"), same).count() == 0
