"""Per-session TF-IDF, adjacent-turn similarity and thematic segmentation.

Everything stays in long form ``(session_id, turn, term, ...)``: vectors are
never densified and no session is collected into one row. Adjacent turns
meet through an equi-join on ``(session_id, term, turn - 1)``; segment ids
come from a two-level running sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import defaults as D
from ..functions import text as T
from .sequence import ordered_concat, prefix_sum, shared, top_k
from .sessions import numbered

_STOP: list[str] | None = None


def default_stop_words() -> list[str]:
    global _STOP
    if _STOP is None:
        _STOP = D.spark_english_stop_words()
    return _STOP


def term_counts(utterances: DataFrame, text: str = "clean_text", stop_words=None) -> DataFrame:
    """``(session_id, turn, term, tf)`` for tokens of two or more word characters,
    stop words removed."""
    stop = default_stop_words() if stop_words is None else stop_words
    toks = utterances.select("session_id", "turn", F.explode(T.word_tokens(text)).alias("term"))
    if stop:
        toks = toks.filter(~F.col("term").isin(list(stop)))
    return toks.groupBy("session_id", "turn", "term").agg(F.count(F.lit(1)).alias("tf"))


def session_vocabulary(tc: DataFrame, max_features: int | None) -> DataFrame:
    """Per session: ``term, total, df``; capped to the ``max_features`` most
    frequent terms (ties: alphabetical)."""
    v = tc.groupBy("session_id", "term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df"))
    if max_features:
        v = top_k(v, ["session_id"], [F.desc("total"), F.asc("term")], max_features, "term_rank")
    return v


def tfidf(utterances: DataFrame, text: str = "clean_text", max_features: int | None = D.TFIDF_MAX_FEATURES,
          stop_words=None) -> DataFrame:
    """Per-session TF-IDF: each turn a document, vocabulary fit inside the
    session; raw tf, ``idf = ln((1 + n) / (1 + df)) + 1``, rows L2-normalised.

    Output ``(session_id, turn, term, weight)``; turns without vocabulary
    terms have no rows (zero vector).
    """
    n_docs = utterances.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_docs"))
    # term counts feed the vocabulary and the weights
    tc = shared(term_counts(utterances, text, stop_words))
    # idf is attached to the (capped, per-session bounded) vocabulary, so the
    # only join of the term-count rows is on the spread key (session, term)
    idf = (session_vocabulary(tc, max_features).join(n_docs, "session_id")
           .select("session_id", "term",
                   (F.log((F.col("n_docs") + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf")))
    raw = tc.join(idf, ["session_id", "term"]).withColumn("raw", F.col("tf") * F.col("idf"))
    w = Window.partitionBy("session_id", "turn")
    return raw.select("session_id", "turn", "term",
                      (F.col("raw") / F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(w))).alias("weight"))


def adjacent_similarity(utterances: DataFrame, weights: DataFrame | None = None, **kw) -> DataFrame:
    """Cosine similarity of each turn with the previous turn of its session.

    Output ``(session_id, turn, similarity)`` for every turn that has a
    previous turn; 0 when either vector is empty. The previous turn is the
    neighbouring row, whatever the gaps between turn numbers.

    Instead of a self-join, every weight row is emitted twice — as itself at
    ``turn`` and as the previous turn's value at ``turn + 1`` — and the pairs
    meet in one aggregation on ``(session_id, turn, term)`` (map-side
    combined); turn markers travel the same way, so the weights and the turn
    list are each read once.
    """
    d = shared(numbered(utterances))
    sim = _similarity(d.withColumn("turn", F.col("_pos")), weights, **kw)
    return (d.select("session_id", F.col("turn").alias("_turn"), F.col("_pos").alias("turn"))
            .join(sim, ["session_id", "turn"])
            .select("session_id", F.col("_turn").alias("turn"), "similarity"))


def _similarity(utterances: DataFrame, weights: DataFrame | None = None, **kw) -> DataFrame:
    """``adjacent_similarity`` where ``turn`` is dense and unique in its session."""
    w = weights if weights is not None else tfidf(utterances, **kw)
    both = F.array(
        F.struct(F.col("turn").alias("t"), F.col("weight").alias("cur"), F.lit(None).cast("double").alias("prev")),
        F.struct((F.col("turn") + 1).alias("t"), F.lit(None).cast("double").alias("cur"),
                 F.col("weight").alias("prev")))
    pairs = (w.select("session_id", "term", F.explode(both).alias("x"))
             .groupBy("session_id", F.col("x.t").alias("turn"), "term")
             .agg((F.max("x.cur") * F.max("x.prev")).alias("_p"))
             .groupBy("session_id", "turn").agg(F.sum("_p").alias("_dot")))
    marks = F.array(F.struct(F.col("turn").alias("t"), F.lit(1).alias("self"), F.lit(0).alias("prev")),
                    F.struct((F.col("turn") + 1).alias("t"), F.lit(0).alias("self"), F.lit(1).alias("prev")))
    turns = (utterances.select("session_id", F.explode(marks).alias("x"))
             .groupBy("session_id", F.col("x.t").alias("turn"))
             .agg(F.max("x.self").alias("_self"), F.max("x.prev").alias("_prev"))
             .filter((F.col("_self") == 1) & (F.col("_prev") == 1)))
    return (turns.join(pairs, ["session_id", "turn"], "left")
            .select("session_id", "turn", F.coalesce(F.col("_dot"), F.lit(0.0)).alias("similarity")))


def segment_sessions(utterances: DataFrame, threshold: float = D.SEGMENT_THRESHOLD,
                     similarity: DataFrame | None = None, **kw) -> DataFrame:
    """Add ``segment_id``: 0 at a session's first turn, +1 at every turn whose
    similarity with the previous turn is below ``threshold``."""
    d = shared(numbered(utterances).withColumnsRenamed({"turn": "_turn", "_pos": "turn"}))
    if similarity is None:
        sim = _similarity(d, **kw)
    else:
        sim = (similarity.withColumnRenamed("turn", "_turn").join(d.select("session_id", "_turn", "turn"), ["session_id", "_turn"])
               .select("session_id", "turn", "similarity"))
    flags = sim.select("session_id", "turn",
                       F.when(F.col("similarity") < threshold, F.lit(1)).otherwise(F.lit(0)).alias("_new"))
    d = shared(d.join(flags, ["session_id", "turn"], "left")
               .withColumn("_new", F.coalesce(F.col("_new"), F.lit(0))))
    # segmented turns are read by several later stages (text, terms, topics)
    out = prefix_sum(d, ["session_id"], "turn", "_new", "segment_id").withColumn(
        "segment_id", F.col("segment_id").cast("long")).drop("_new", "turn").withColumnRenamed("_turn", "turn")
    return shared(out.select(*utterances.columns, "segment_id"))


def segment_text(segmented: DataFrame, text: str = "clean_text") -> DataFrame:
    """``(session_id, segment_id, segment_text)``: texts of a segment joined in turn order."""
    d = segmented.select("session_id", "segment_id", "turn", F.coalesce(F.col(text), F.lit("")).alias("_t"))
    return ordered_concat(d, ["session_id", "segment_id"], "turn", "_t", " ", "segment_text")


def top_terms(segmented: DataFrame, k: int = D.TOPIC_WORDS, text: str = "clean_text",
              max_features: int | None = D.COUNT_MAX_FEATURES, stop_words=None) -> DataFrame:
    """Most frequent terms of each segment, restricted to the session's
    ``max_features`` vocabulary: ``(session_id, segment_id, rank, term, n)``."""
    stop = default_stop_words() if stop_words is None else stop_words
    toks = segmented.select("session_id", "segment_id", F.explode(T.word_tokens(text)).alias("term"))
    if stop:
        toks = toks.filter(~F.col("term").isin(list(stop)))
    # one aggregate to (session, segment, term); session totals come from it
    counts = shared(toks.groupBy("session_id", "segment_id", "term").agg(F.count(F.lit(1)).alias("n")))
    if max_features:
        totals = counts.groupBy("session_id", "term").agg(F.sum("n").alias("total"))
        vocab = top_k(totals, ["session_id"], [F.desc("total"), F.asc("term")], max_features, "_vr")
        counts = counts.join(vocab.select("session_id", "term"), ["session_id", "term"])
    return top_k(counts, ["session_id", "segment_id"], [F.desc("n"), F.asc("term")], k, "rank").select(
        "session_id", "segment_id", F.col("rank").cast("int").alias("rank"), "term", "n")


def segment_topics(terms: DataFrame, n_topics: int = D.TOPIC_COUNT) -> DataFrame:
    """Per session: ``topics`` = the top-term lists of its ``n_topics`` weightiest
    segments (by the total count of their terms, over the whole session; ties
    to the earlier segment), weightiest first."""
    per_seg = terms.groupBy("session_id", "segment_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("_rt"), F.sum("n").alias("_weight"))
    per_seg = per_seg.withColumn("words", F.transform("_rt", lambda x: x["term"]))
    per_seg = top_k(per_seg, ["session_id"], [F.desc("_weight"), F.asc("segment_id")], n_topics, "_r")
    return per_seg.groupBy("session_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_r", "words"))),
                    lambda x: x["words"]).alias("topics"))
