"""Topics without a vocabulary: every session gets topics out of its own words."""

import pytest

from parley.operators import topics as TP


def docs(spark):
    rows = [(f"s{i}", j, "sleep work sleep stress") for i in range(6) for j in range(3)]
    rows += [("rare", 0, "quokka quokka zyzzyva"), ("rare", 1, "axolotl"), ("none", 0, "the of"), ("none", 1, None)]
    return spark.createDataFrame(rows, "session_id string, segment_id int, segment_text string")


@pytest.mark.parametrize("buckets", [4, 1 << 10])
def test_session_of_rare_words_gets_topics(spark, buckets):
    got = TP.session_topics(docs(spark), k=3, n_words=2, buckets=buckets, max_iter=3).collect()
    by = {}
    for r in got:
        by.setdefault(r.session_id, {})[r.topic_rank] = r.words
    assert set(by) == {f"s{i}" for i in range(6)} | {"rare"}        # a session of stop words has no topics
    assert sorted(by["rare"]) == [1, 2] and sorted(by["s0"]) == [1, 2, 3]   # min(k, segments)
    assert all(set(w) <= {"quokka", "zyzzyva", "axolotl"} and len(w) == 2 for w in by["rare"].values())
    assert all(set(w) <= {"sleep", "work", "stress"} for w in by["s0"].values())
    assert by["s0"] == by["s5"]


def test_words_follow_counts_and_weights(spark):
    d = docs(spark)
    model = TP.fit_topic_model(TP.session_terms(d), k=2, buckets=1 << 12, max_iter=3)
    weights = {r.bucket: r.weights for r in TP.bucket_weights(model).collect()}
    assert len(weights) == 1 << 12 and all(len(w) == 2 for w in weights.values())
    column = {t: d.sparkSession.sql(f"SELECT pmod(xxhash64('{t}'), {1 << 12})").first()[0] for t in ("sleep", "work", "stress")}
    counts = {"sleep": 6, "work": 3, "stress": 3}
    for r in TP.session_topics(d, k=2, n_words=3, model=model).where("session_id = 's0'").collect():
        assert r.words == sorted(counts, key=lambda t: (-counts[t] * weights[column[t]][r.topic], t))


def test_empty_table(spark):
    d = docs(spark)
    model = TP.fit_topic_model(TP.session_terms(d), k=2, buckets=64, max_iter=2)
    assert TP.session_topics(d.limit(0), k=2, model=model).count() == 0


def test_fit_reads_counts_made_once_and_no_texts(spark, monkeypatch):
    """The model is fitted on held count vectors alone, with the same result as stage by stage."""
    from pyspark.ml.clustering import LDA

    seen, fit = [], LDA.fit
    monkeypatch.setattr(LDA, "fit", lambda self, df, *a: seen.append((df.columns, df.is_cached)) or fit(self, df, *a))
    terms = TP.session_terms(docs(spark)).coalesce(1).sortWithinPartitions("session_id", "segment_id").cache()
    model = TP.fit_topic_model(terms, k=2, buckets=64, max_iter=2)
    assert seen == [(["_counts"], True)]
    plain = fit(LDA(k=2, seed=TP.D.LDA_SEED, optimizer="online", maxIter=2, featuresCol="_counts",
                    topicDistributionCol="_topics", subsamplingRate=1.0),
                model.stages[1].transform(model.stages[0].transform(terms)))
    assert model.stages[2].topicsMatrix().toArray() == pytest.approx(plain.topicsMatrix().toArray())
