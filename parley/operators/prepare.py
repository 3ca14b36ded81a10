"""Training-data preparation: pair tables, label encoding, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import defaults as D
from ..functions import text as T
from .sessions import hash_split, positional_split


def training_pairs(main: DataFrame, aux: DataFrame | None = None, utterances: DataFrame | None = None,
                   per_utterance: bool = False) -> DataFrame:
    """Main (session) pairs followed by auxiliary pairs, as text, nulls dropped.

    ``main`` has ``session_id, transcript, reference_summary``; ``aux`` has
    ``transcript, reference_summary``. Default: one row per session. With
    ``per_utterance`` (and ``utterances``) each session pair is repeated once
    per utterance, as the original program does.
    """
    m = main.select(F.lit(0).alias("source_rank"), F.col("session_id").cast("string").alias("pair_key"),
                    F.col("session_id").cast("string").alias("session_id"),
                    F.col("transcript").cast("string").alias("transcript"),
                    F.col("reference_summary").cast("string").alias("reference_summary"))
    if per_utterance:
        if utterances is None:
            raise ValueError("per_utterance needs the utterance table")
        u = utterances.select(F.col("session_id").cast("string").alias("pair_key"), "turn")
        m = (m.join(u, "pair_key")
             .withColumn("pair_key", F.concat_ws(":", "pair_key", F.col("turn").cast("string"))).drop("turn"))
    out = m
    if aux is not None:
        # the order of the sources, and of rows inside them where a key is given, is kept
        rank = F.col("source_rank") + 1 if "source_rank" in aux.columns else F.lit(1)
        a = aux.select(rank.cast("int").alias("source_rank"),
                       (F.col("pair_key") if "pair_key" in aux.columns
                        else F.sha2(F.concat_ws("\u0001", "transcript", "reference_summary"), 256)).cast("string")
                       .alias("pair_key"),
                       (F.col("session_id").cast("string") if "session_id" in aux.columns
                        else F.lit(None).cast("string")).alias("session_id"),
                       F.col("transcript").cast("string").alias("transcript"),
                       F.col("reference_summary").cast("string").alias("reference_summary"))
        out = out.unionByName(a)
    return out.na.drop(subset=["transcript", "reference_summary"])


def split_pairs(pairs: DataFrame, fraction: float = D.SUMMARIZER_TRAIN_FRACTION, by: str = "position") -> DataFrame:
    """``split`` = train/validation. ``position``: first ``int(fraction*n)``
    rows in (source, key) order, as in the original; ``session``: by the hash of
    the session (of the pair's own key where it has none), so no session lands
    on both sides."""
    if by == "position":
        return positional_split(pairs, ["source_rank", "pair_key"], fraction)
    keyed = pairs.withColumn("_split_key", F.coalesce("session_id", "pair_key"))
    return hash_split(keyed, "_split_key", fraction).drop("_split_key")


def encode_labels(df: DataFrame, label: str = "emotion", labels=None, text: str = "utterance",
                  default: int = 0) -> DataFrame:
    """Drop rows without text, add ``label_id`` (unknown or null label -> ``default``)."""
    return (df.na.drop(subset=[text])
            .withColumn("label_id", T.encode_label(label, labels, default)))
