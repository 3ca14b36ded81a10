"""Severity tiers per session: lexicon first, optional text classifier behind it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import defaults as D
from ..functions import arrays as A
from ..functions import text as T
from .linear import LinearModel
from .sequence import number_rows, shared
from .sessions import role_texts


def lexicon_tiers(utterances: DataFrame, lexicon=None, method: str = "windows") -> DataFrame:
    """``session_id, emotion_tier`` from the lexicon on the role-ordered text
    (client turns, then counselor turns, joined by blanks).

    ``windows`` (default) never assembles a session's text: see
    ``lexicon_window_tiers``. ``text`` builds the role texts and tests them
    whole (needed anyway when a classifier scores them).
    """
    if method == "text":
        rt = role_texts(utterances)
        return rt.select("session_id", T.lexicon_tier("combined_text", lexicon).alias("emotion_tier"))
    return lexicon_window_tiers(utterances, lexicon)


def lexicon_window_tiers(utterances: DataFrame, lexicon=None, text: str = "clean_text",
                         order: str = "role") -> DataFrame:
    """Exact lexicon tier of the combined role text, evaluated on bounded windows.

    Any occurrence of a phrase of length at most ``L`` that starts inside
    piece ``k`` (a turn's text, or the blank after it) lies inside
    ``piece_k + ' ' + next_k``, where ``next_k`` is the first ``L - 1``
    characters of the combined text after that blank. ``next_k`` is built
    from the first ``L - 1`` characters of each of the following ``L - 1``
    pieces: each piece sends its head to the ``L - 1`` positions before it
    and the heads are joined per ``(session, position)`` — a bounded fan-out
    on an evenly spread key. The session tier is the max over its windows (a
    map-side partial aggregate). A missing role side is an empty piece, as
    in ``client_text + ' ' + counselor_text``. ``order="turn"`` tests the
    session text in plain turn order instead.
    """
    lex = lexicon or D.TIER_KEYWORDS
    longest = max([len(p) for ps in lex.values() for p in ps] or [1])
    h = max(longest - 1, 1)
    side = (F.when(F.col("role") == "counselor", F.lit(1)).otherwise(F.lit(0)) if order == "role"
            else F.lit(0))
    d = utterances.select(
        "session_id", "turn", side.alias("side"),
        F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    # read by the counts, the pieces and (through them) the heads and windows
    d = shared(number_rows(d, ["session_id", "side"], "turn", ["_t"], "_ord"))
    counts = d.groupBy("session_id").agg(
        F.sum(F.when(F.col("side") == 0, 1).otherwise(0)).alias("_nc"),
        F.sum(F.when(F.col("side") == 1, 1).otherwise(0)).alias("_nk"))
    two_sided = (F.col("_nc") == 0) | (F.col("_nk") == 0) if order == "role" else F.lit(False)
    virtual = (counts.filter(two_sided)
               .select("session_id", F.when(F.col("_nc") == 0, F.lit(0)).otherwise(F.lit(1)).alias("side"),
                       F.lit(0).cast("long").alias("_ord"), F.lit("").alias("_t")))
    pieces = (d.select("session_id", "side", F.col("_ord").cast("long").alias("_ord"), "_t")
              .unionByName(virtual))
    heads = pieces.select("session_id", "side", "_ord", F.substring("_t", 1, h).alias("_head"))
    # the head goes to the h pieces before it: same side at _ord - j, and for
    # the first counselor pieces also to the last client pieces (only those
    # rows, at most h per session, need the session's client count)
    same = (heads.select("session_id", "side", "_ord", "_head",
                         F.explode(F.sequence(F.lit(1), F.lit(h))).alias("_j"))
            .select("session_id", "side", (F.col("_ord") - F.col("_j")).alias("_ord"), "_j", "_head")
            .filter(F.col("_ord") >= 0))
    cross = (heads.filter((F.col("side") == 1) & (F.col("_ord") < h))
             .join(counts.select("session_id", "_nc"), "session_id")
             .select("session_id", "_ord", "_head", "_nc", F.explode(F.sequence(F.lit(1), F.lit(h))).alias("_j"))
             .filter(F.col("_j") > F.col("_ord"))
             .select("session_id", F.lit(0).alias("side"),
                     (F.greatest(F.col("_nc"), F.lit(1)) - (F.col("_j") - F.col("_ord"))).cast("long").alias("_ord"),
                     "_j", "_head")
             .filter(F.col("_ord") >= 0))
    following = same.unionByName(cross).groupBy("session_id", "side", "_ord").agg(
        F.substring(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_j", "_head"))),
                                             lambda x: x["_head"]), " "), 1, h).alias("_next"))
    windows = pieces.join(following, ["session_id", "side", "_ord"], "left").select(
        "session_id", F.when(F.col("_next").isNull(), F.col("_t"))
        .otherwise(F.concat(F.col("_t"), F.lit(" "), F.col("_next"))).alias("_w"))
    return windows.groupBy("session_id").agg(F.max(T.lexicon_tier("_w", lex)).alias("emotion_tier"))


def probability_tiers(probs: DataFrame, alpha: float = D.BLEND_ALPHA, **cuts) -> DataFrame:
    """Blend client/counselor probability vectors and map them to a tier.

    ``probs`` has ``client_probs`` and ``counselor_probs`` (array<double>,
    an all-zero vector for blank text)."""
    blended = A.blend("client_probs", "counselor_probs", alpha)
    return (probs.withColumn("blended", blended)
            .withColumn("crisis_score", A.index_sum("blended", cuts.get("crisis_idx") or D.CRISIS_IDX))
            .withColumn("negative_score", A.index_sum("blended", cuts.get("negative_idx") or D.NEGATIVE_IDX))
            .withColumn("emotion_tier", A.probability_tier("blended", **cuts)))


def score_texts(texts: DataFrame, model, text: str = "text", width: int = len(D.EMOTION_LABELS),
                batch_size: int = 64) -> DataFrame:
    """Class probabilities of ``text`` from a fitted Spark ML model, or from an
    external batch predictor (a function ``numpy array of str -> (n, k)
    array``) run through ``predict_batch_udf`` in Arrow batches, or a ``LinearModel``, whose
    result has the other columns, the texts' unique key, without ``text``.

    Blank texts are not sent to the model: they get an all-zero vector.
    Scored and unscored rows are split by a filter and unioned back, so the
    model runs only on the rows that need it.
    """
    from pyspark.ml.functions import predict_batch_udf, vector_to_array

    blank = F.trim(F.coalesce(F.col(text), F.lit(""))) == ""
    zeros = F.array_repeat(F.lit(0.0), width)
    to_score = texts.filter(~blank)
    keep = texts.columns
    if isinstance(model, LinearModel):
        # keyed by the other columns; the text itself need not come along
        keys = [c for c in keep if c != text]
        return model.probabilities(to_score, keys, text).unionByName(texts.filter(blank).select(*keys, zeros.alias("probs")))
    if hasattr(model, "transform"):
        scored = model.transform(to_score).select(*keep, vector_to_array("probability").alias("probs"))
    else:
        # an external batch predictor: numpy array of texts -> (n, classes) probabilities
        from pyspark.sql.types import ArrayType, DoubleType

        predict = predict_batch_udf(lambda: model, return_type=ArrayType(DoubleType()), batch_size=batch_size)
        scored = to_score.select(*keep, predict(F.col(text)).alias("probs"))
    empty = texts.filter(blank).withColumn("probs", zeros)
    return scored.unionByName(empty)


def model_input_col(model, default: str = "utterance") -> str:
    """Text column a fitted pipeline reads (its first stage's input column)."""
    stages = getattr(model, "stages", None) or [model]
    first = stages[0]
    if hasattr(first, "getInputCol"):
        try:
            return first.getInputCol()
        except Exception:  # noqa: BLE001
            return default
    return default


def session_tiers(utterances: DataFrame, lexicon=None, model=None, alpha: float = D.BLEND_ALPHA,
                  labels=None) -> DataFrame:
    """Tier per session: the lexicon decides when any phrase matches; only the
    remaining sessions go to ``model`` (client and counselor texts scored
    separately, blended, cut). Without a model unmatched sessions are tier 1.

    Output: ``session_id, emotion_tier, tier_label, source``.
    """
    lex = shared(lexicon_window_tiers(utterances, lexicon).withColumnRenamed("emotion_tier", "lex_tier"))
    matched = (lex.filter(F.col("lex_tier") > 1)
               .select("session_id", F.col("lex_tier").alias("emotion_tier"), F.lit("lexicon").alias("source")))
    rest = lex.filter(F.col("lex_tier") <= 1)
    if model is not None:
        # role texts only for the sessions the lexicon left open
        rest = role_texts(utterances.join(rest.select("session_id"), "session_id", "left_semi"))
    if model is None:
        unmatched = rest.select("session_id", F.lit(1).alias("emotion_tier"), F.lit("default").alias("source"))
    else:
        tcol = model_input_col(model) if hasattr(model, "transform") else "utterance"
        sides = (rest.select("session_id", F.lit(0).alias("side"), F.col("client_text").alias(tcol))
                 .unionByName(rest.select("session_id", F.lit(1).alias("side"),
                                          F.col("counselor_text").alias(tcol))))
        probs = score_texts(sides, model, tcol)
        wide = probs.groupBy("session_id").agg(
            F.max(F.when(F.col("side") == 0, F.col("probs"))).alias("client_probs"),
            F.max(F.when(F.col("side") == 1, F.col("probs"))).alias("counselor_probs"))
        unmatched = (probability_tiers(wide, alpha)
                     .select("session_id", "emotion_tier", F.lit("model").alias("source")))
    out = matched.unionByName(unmatched)
    return out.withColumn("tier_label", T.tier_label("emotion_tier", labels)).select(
        "session_id", "emotion_tier", "tier_label", "source")
