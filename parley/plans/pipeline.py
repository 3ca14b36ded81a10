"""The end-to-end job: preprocess, features, summaries, reports, evaluation.

``run`` builds one DAG keyed by ``session_id``. What runs while it is built are
only the model fits (topics, classifier) and TextRank's size check and steps.
Tables that several results read are held by ``sequence.shared``; call
``sequence.release_shared`` once the results are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import defaults as D
from ..operators import evaluate as EV
from ..operators import extract as X
from ..operators import report as R
from ..operators import segment as G
from ..operators import sessions as S
from ..operators import tiers as TR
from ..operators import topics as TP
from ..operators.sequence import shared


def extract_features(utterances: DataFrame, segmented: DataFrame, lexicon=None, model=None, topic_method: str = "lda",
                     k: int = D.TOPIC_COUNT, n_words: int = D.TOPIC_WORDS, labels=None,
                     n_topics: int = D.TOPIC_COUNT) -> DataFrame:
    """``session_id, emotion_tier, tier_label, topics`` — one row per session.

    ``topic_method``: ``lda`` (Spark ML LDA over segment texts) or ``terms``
    (top terms of the ``n_topics`` weightiest segments, deterministic)."""
    tiers = TR.session_tiers(utterances, lexicon, model, labels=labels).select(
        "session_id", "emotion_tier", "tier_label")
    if topic_method == "lda":
        docs = G.segment_text(segmented)
        topics = TP.topics_array(TP.session_topics(docs, k, n_words))
    else:
        topics = G.segment_topics(G.top_terms(segmented, n_words), n_topics)
    return (tiers.join(topics, "session_id", "left")
            .withColumn("topics", F.coalesce(F.col("topics"), F.array().cast("array<array<string>>"))))


def run(utterances: DataFrame, lexicon=None, model=None, rules=None, fallback: str = D.FALLBACK_SECTION,
        references: DataFrame | None = None, token_vectors: tuple[DataFrame, ...] | None = None, threshold: float = D.SEGMENT_THRESHOLD,
        topic_method: str = "lda", generator=None, role_keywords=None, fillers=None) -> dict[str, DataFrame]:
    """Run every stage; returns the result tables by name.

    ``utterances``: ``session_id, turn, speaker, utterance``.
    ``references``: optional ``session_id, reference`` for the evaluation; ``token_vectors``:
    optional vectors of the predictions' and references' tokens for the embedding match.
    Both leaderboards hold the published values where nothing was evaluated.
    """
    pre = shared(S.preprocess(utterances, fillers, role_keywords))
    seg = G.segment_sessions(pre, threshold)
    features = extract_features(pre, seg, lexicon, model, topic_method)
    prompts = S.build_prompts(pre, features)
    summaries = X.summarize_sessions(pre, generator, prompts)
    reports = R.build_reports(summaries.withColumnRenamed("generated_summary", "summary"), features,
                              "summary", rules, fallback)
    # without a generator the summaries already are the extractive baseline
    baseline = summaries if generator is None else X.summarize_sessions(pre)
    out = {"preprocessed": pre, "segments": seg, "features": features, "prompts": prompts,
           "summaries": summaries, "reports": reports, "baseline_summaries": baseline,
           "tier_metrics": EV.evaluate_tiers(features, pre, lexicon)}
    if references is not None:
        preds = (summaries.select("session_id", F.col("generated_summary").alias("prediction"))
                 .withColumn("model", F.lit("generator" if generator else "TF-IDF TextRank")))
        if generator is not None:
            preds = preds.unionByName(baseline.select("session_id", F.col("generated_summary").alias("prediction"))
                                      .withColumn("model", F.lit("TF-IDF TextRank")))
        out["model_scores"] = EV.evaluate_models(references, preds, token_vectors=token_vectors)
        out["leaderboard"] = EV.leaderboard(EV.published_scores(pre.sparkSession), out["model_scores"])
    out["tier_leaderboard"] = EV.tier_leaderboard(EV.published_tier_scores(pre.sparkSession), out["tier_metrics"])
    return out
