"""Topics per session with Spark ML (hashed term counts + online LDA).

One LDA model is fit over all segment documents of all sessions (the
original fits a small model per session, which does not scale out). Every term
has a column of the model, the one its hash names, so that no vocabulary is
collected and no term is too rare. A session's topics are the model topics ordered by the
mean topic weight of its segments, ``min(k, number of segments)`` of them, each
given by the session's own words that weigh most in it.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import CountVectorizerModel, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import defaults as D
from ..functions import text as T
from .segment import default_stop_words
from .sequence import shared, top_k


#: Columns of the model; terms whose hashes agree modulo this number share one.
BUCKETS = 1 << 16


def _bucket(term, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def session_terms(docs: DataFrame, text: str = "segment_text", max_features: int | None = D.COUNT_MAX_FEATURES,
                  stop_words=None) -> DataFrame:
    """``docs`` with ``_terms``: the document's tokens out of its session's ``max_features``
    most frequent terms (ties alphabetical), so that every session keeps its own words."""
    stop = list(default_stop_words() if stop_words is None else stop_words)
    toks = docs.select("session_id", "segment_id", F.explode(T.word_tokens(F.lower(F.col(text)))).alias("term"))
    counts = toks.filter(~F.col("term").isin(stop)).groupBy("session_id", "segment_id", "term").agg(F.count(F.lit(1)).alias("n"))
    if max_features:
        totals = counts.groupBy("session_id", "term").agg(F.sum("n").alias("total"))
        vocab = top_k(totals, ["session_id"], [F.desc("total"), F.asc("term")], max_features, "_vr")
        counts = counts.join(vocab.select("session_id", "term"), ["session_id", "term"])
    bags = counts.groupBy("session_id", "segment_id").agg(F.flatten(F.sort_array(F.collect_list(
        F.array_repeat("term", F.col("n").cast("int"))))).alias("_terms"))
    return docs.join(bags, ["session_id", "segment_id"], "left").withColumn(
        "_terms", F.coalesce("_terms", F.array().cast("array<string>")))


def fit_topic_model(docs: DataFrame, k: int = D.TOPIC_COUNT, buckets: int = BUCKETS, seed: int = D.LDA_SEED,
                    max_iter: int = 10, subsampling_rate: float = 1.0):
    """Hashed counts and LDA over documents with ``_terms`` (``session_terms``)."""
    named = SQLTransformer(statement=f"SELECT *, transform(_terms, x -> cast(pmod(xxhash64(x), {buckets}) AS string)) AS _hashed FROM __THIS__")
    # the "vocabulary" is the column numbers, whatever the corpus holds
    counts = CountVectorizerModel.from_vocabulary([str(i) for i in range(buckets)], inputCol="_hashed", outputCol="_counts")
    lda = LDA(k=k, seed=seed, optimizer="online", maxIter=max_iter, featuresCol="_counts",
              topicDistributionCol="_topics", subsamplingRate=subsampling_rate)
    # every iteration reads the counts; they are hashed and looked up once
    counted = shared(counts.transform(named.transform(docs.select("_terms"))).select("_counts"))
    return PipelineModel(stages=[named, counts, lda.fit(counted)])


def bucket_weights(model) -> DataFrame:
    """``bucket, weights``: the weight of every column in each topic, in topic order. As many rows as
    the model has columns, a number fixed by its parameter."""
    lda = model.stages[-1]
    long = lda.describeTopics(lda.vocabSize()).select("topic", F.explode(F.arrays_zip("termIndices", "termWeights")).alias("t"))
    return long.groupBy(F.col("t.termIndices").alias("bucket")).agg(F.transform(
        F.sort_array(F.collect_list(F.struct("topic", F.col("t.termWeights").alias("w")))), lambda x: x["w"]).alias("weights"))


def session_topics(segment_docs: DataFrame, k: int = D.TOPIC_COUNT, n_words: int = D.TOPIC_WORDS,
                   text: str = "segment_text", model=None, max_features: int | None = D.COUNT_MAX_FEATURES,
                   stop_words=None, **fit_kw) -> DataFrame:
    """``(session_id, topic_rank, topic, words)`` for each session's
    ``min(k, segments)`` strongest topics. ``words`` are the ``n_words`` terms of the session with the
    largest product of their number in the session and their column's weight in the topic, ties
    alphabetical. Sessions without any term get no topics."""
    # the texts are not carried along
    segment_docs = shared(session_terms(segment_docs, text, max_features, stop_words).select("session_id", "segment_id", "_terms"))
    model = model or fit_topic_model(segment_docs, k, **fit_kw)
    scored = model.transform(segment_docs)
    has_terms = F.size("_terms") > 0
    nseg = segment_docs.groupBy("session_id").agg(F.count(F.lit(1)).alias("_nseg"))
    weights = (scored.filter(has_terms)
               .select("session_id", F.posexplode(vector_to_array("_topics")).alias("topic", "w"))
               .groupBy("session_id", "topic").agg(F.avg("w").alias("weight")))
    ranked = top_k(weights, ["session_id"], [F.desc("weight"), F.asc("topic")], k, "topic_rank")
    ranked = ranked.join(nseg, "session_id").filter(F.col("topic_rank") <= F.col("_nseg"))
    # the words shown: a session's own terms, looked up by their column
    buckets = model.stages[-1].vocabSize()
    own = (segment_docs.select("session_id", F.explode("_terms").alias("term"))
           .groupBy("session_id", "term").agg(F.count(F.lit(1)).alias("n")).withColumn("bucket", _bucket("term", buckets)))
    by_topic = (own.join(bucket_weights(model), "bucket")
                .select("session_id", "term", "n", F.posexplode("weights").alias("topic", "w")))
    best = top_k(by_topic, ["session_id", "topic"], [F.desc(F.col("n") * F.col("w")), F.asc("term")], n_words, "_place")
    words = best.groupBy("session_id", "topic").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("_place", "term"))), lambda x: x["term"]).alias("words"))
    return ranked.join(words, ["session_id", "topic"]).select(
        "session_id", F.col("topic_rank").cast("int").alias("topic_rank"), "topic", "words")


def topics_array(topics: DataFrame) -> DataFrame:
    """``(session_id, topics)`` with ``topics`` = word lists in rank order (at most k per session)."""
    return topics.groupBy("session_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("topic_rank", "words"))), lambda x: x["words"])
        .alias("topics"))
