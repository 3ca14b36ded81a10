"""Linear classifiers as relations: naive Bayes against plain arithmetic, an exported pipeline against transform."""

import math

import pytest
from pyspark.ml.functions import vector_to_array

from parley.operators import classify as CL
from parley.operators import linear as LN
from parley.operators import sessions as S
from parley.operators import tiers as TR

ROWS = [(1, "red apple apple pie", "a"), (2, "blue sky above", "b"), (3, "apple sky", "a"), (4, None, "b"), (5, "stone", None),
        (6, "stone", "other")]


def bayes(train, text, labels):
    terms = lambda t: [w for w in (t or "").split() if w != "above"]  # noqa: E731 (a stop word)
    vocabulary = {w for t, _ in train for w in terms(t)}
    out = []
    for c in labels:
        own = [w for t, x in train if x == c for w in terms(t)]
        n = sum(x == c for _, x in train)
        out.append(math.log((n + 1) / (len(train) + len(labels))) + sum(
            math.log((own.count(w) + 1) / (len(own) + len(vocabulary))) for w in terms(text) if w in vocabulary))
    e = [math.exp(s - max(out)) for s in out]
    return [x / sum(e) for x in e]


def test_bayes_equals_plain_arithmetic(spark):
    labels = ["a", "b", "never"]
    df = spark.createDataFrame(ROWS, "k int, t string, l string")
    model = LN.fit_bayes(df, "t", "l", labels)
    texts = [(1, "apple pie"), (2, "sky sky"), (3, ""), (4, None), (5, "unknown words"), (6, "red blue unknown")]
    got = {r.k: r.probs for r in model.probabilities(spark.createDataFrame(texts, "k int, t string"), ["k"], "t").collect()}
    train = [(t, l) for _, t, l in ROWS if l in labels]
    assert set(got) == {k for k, _ in texts}
    for k, t in texts:
        assert got[k] == pytest.approx(bayes(train, t, labels), abs=1e-12)
    assert model.probabilities(spark.createDataFrame([], "k int, t string"), ["k"], "t").count() == 0


def test_bayes_without_rows_is_even(spark):
    model = LN.fit_bayes(spark.createDataFrame([], "t string, l string"), "t", "l", ["a", "b"])
    got = model.probabilities(spark.createDataFrame([(1, "x y")], "k int, t string"), ["k"], "t").first()
    assert got.probs == pytest.approx([0.5, 0.5])


def test_exported_pipeline_equals_transform(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    rows = [(i, " ".join(words[(i * k) % 8] for k in range(1, 6)), float(i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, utterance string, label_id double")
    model = CL.label_pipeline(num_features=1 << 12, max_iter=10).fit(df)
    texts = df.select("k", "utterance").union(spark.createDataFrame([(100, "unseen words here"), (101, "the")], "k int, utterance string"))
    want = {r.k: r.p for r in model.transform(texts).select("k", vector_to_array("probability").alias("p")).collect()}
    exported = LN.export_logistic(model, texts, "utterance", ["x", "y", "z"])
    got = {r.k: r.probs for r in exported.probabilities(texts, ["k"], "utterance").collect()}
    assert set(got) == set(want)
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9)


def test_session_tiers_with_linear_model(spark):
    u = spark.createDataFrame([("a", 0, "client", "so dark"), ("a", 1, "counselor", "night"), ("b", 0, "client", "bright"),
                               ("b", 1, "counselor", "day"), ("c", 0, "counselor", "night")],
                              "session_id string, turn int, speaker string, utterance string")
    labels = [f"l{i}" for i in range(32)]
    train = spark.createDataFrame([("dark night", "l24")] * 90 + [("bright day", "l0")] * 90, "t string, l string")
    model = LN.fit_bayes(train, "t", "l", labels)
    got = {r.session_id: (r.emotion_tier, r.source) for r in TR.session_tiers(S.preprocess(u), model=model).collect()}
    assert got == {"a": (5, "model"), "b": (1, "model"), "c": (1, "model")}
