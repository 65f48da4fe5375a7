import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from labelmill.operators import vectors as K

RNG = np.random.default_rng(11)
DATA = RNG.normal(size=(120, 4))
LABEL = np.where(DATA[:, 0] + 0.5 * RNG.normal(size=120) > 0.6, "hi", np.where(DATA[:, 1] > 0.3, "mid", "lo"))


@pytest.fixture(scope="module")
def rows(spark):
    records = [(i, [float(x) for x in v], str(l), bool(v[2] > 0.8), (["a"] if v[0] > 0 else []) + (["b"] if v[3] > 0.5 else []))
               for i, (v, l) in enumerate(zip(DATA, LABEL))]
    df = spark.createDataFrame(records, "id int, embedding array<double>, kind string, flag boolean, tags array<string>")
    return K.embed(df).cache()


UNIT = DATA / np.linalg.norm(DATA, axis=1, keepdims=True)


def sigmoid(z):
    return 1 / (1 + np.exp(-z))


def balanced(y):
    values, counts = np.unique(y, return_counts=True)
    weight = {v: len(y) / (len(values) * c) for v, c in zip(values, counts)}
    return np.array([weight[v] for v in y])


def test_vectors_are_normalised(spark, rows):
    got = np.array([r.vector.toArray() for r in rows.orderBy("id").collect()])
    assert np.allclose(got, UNIT)


def test_binary_model_is_the_balanced_ridge_optimum(rows):
    """At the optimum the gradient of the summed weighted loss plus unit ridge is 0."""
    fitted = K.fit(rows, binary=["flag"]).binary["flag"]
    y = (DATA[:, 2] > 0.8).astype(float)
    w, b = fitted.coefficients.toArray(), fitted.intercept
    error = balanced(y) * (sigmoid(UNIT @ w + b) - y)
    assert np.abs(UNIT.T @ error + w).max() < 1e-2 and abs(error.sum()) < 1e-2


def test_class_model_is_the_balanced_ridge_optimum(rows):
    space = ["hi", "mid", "lo"]
    _, fitted = K.fit(rows, classes={"kind": space}).classes["kind"]
    w, b = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    z = UNIT @ w.T + b
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    y = np.array([[l == s for s in space] for l in LABEL], dtype=float)
    assert np.abs(((p - y) * balanced(LABEL)[:, None]).T @ UNIT + w).max() < 1e-2


def test_predictions_threshold_and_best_label(rows):
    model = K.fit(rows, binary=["flag"], sets={"tags": ["a", "b"]}, classes={"kind": ["hi", "mid", "lo"]})
    both = K.predict(rows, model, exclusive=()).orderBy("id").collect()
    best = K.predict(rows, model, exclusive=("tags",)).orderBy("id").collect()
    z = {t: UNIT @ m.coefficients.toArray() + m.intercept for t, m in model.sets["tags"].items()}
    for i, (r, s) in enumerate(zip(both, best)):
        score = {t: sigmoid(z[t][i]) for t in "ab"}
        assert r.pred_tags == [t for t in "ab" if score[t] >= 0.5]
        top = max("ab", key=lambda t: score[t])
        assert s.pred_tags == ([top] if score[top] >= 0.5 else [])
    assert np.mean([r.kind == r.pred_kind for r in both]) > 0.6
    assert {r.pred_flag for r in both} == {0, 1}


def test_models_are_stored_and_loaded(rows, tmp_path):
    model = K.fit(rows, binary=["flag"], sets={"tags": ["a"]}, classes={"kind": ["hi", "mid", "lo"]})
    K.save(model, str(tmp_path))
    back = K.load(str(tmp_path), ["flag"], {"tags": ["a"]}, {"kind": ["hi", "mid", "lo"]})
    one, two = (K.predict(rows, m, ()).select("id", "pred_flag", "pred_tags", "pred_kind").orderBy("id").collect() for m in (model, back))
    assert one == two


def test_encoder_hook_and_content_cache(spark):
    @F.pandas_udf("array<double>")
    def length(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [float(len(t)), 1.0])

    df = spark.createDataFrame([(1, "aa"), (2, "b"), (3, "aa")], "id int, input string")
    out, fresh = K.cached_embeddings(df, None, length)
    assert sorted((r.id, r.embedding) for r in out.collect()) == [(1, [2.0, 1.0]), (2, [1.0, 1.0]), (3, [2.0, 1.0])]
    cache = spark.createDataFrame([(r.content_key, [9.0, 9.0]) for r in fresh.filter(F.col("embedding")[0] == 2.0).collect()], "content_key string, embedding array<double>")
    out, fresh = K.cached_embeddings(df, cache, length)
    assert sorted((r.id, r.embedding) for r in out.collect()) == [(1, [9.0, 9.0]), (2, [1.0, 1.0]), (3, [9.0, 9.0])] and fresh.count() == 1
    encoded = K.embed(df, length, "input", normalize=False).orderBy("id").first()
    assert list(encoded.vector.toArray()) == [2.0, 1.0]


def test_the_encoder_runs_once_per_text(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def encoder(text):
        calls.add(1)
        return [float(len(text))]

    df = spark.createDataFrame([(1, "aa"), (2, "b"), (3, "aa"), (4, None)], "id int, input string")
    rows, fresh = K.cached_embeddings(df, None, encoder)
    assert {r.id: r.embedding for r in rows.collect()} == {1: [2.0], 2: [1.0], 3: [2.0], 4: [0.0]}
    rows.collect()
    assert fresh.count() == 3 and calls.value == 3
    again, new = K.cached_embeddings(df, fresh, encoder)
    assert again.count() == 4 and new.count() == 0 and calls.value == 3


def test_labels_outside_the_space_are_told(spark):
    df = K.embed(spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.0, 1.0], "z"), (3, [1.0, 1.0], None)], "id int, embedding array<double>, kind string"))
    with pytest.raises(ValueError, match="kind"):
        K.fit(df, classes={"kind": ("a", "b")})
