"""Row-wise stages on streaming DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import text as T


def preprocess_stream(stream: DataFrame, fillers=None, role_keywords=None, lexicon=None) -> DataFrame:
    """Clean text, role, sentences and the utterance's own lexicon tier."""
    return (stream.withColumn("clean_text", T.normalize_text("utterance", fillers))
            .withColumn("role", T.assign_role("speaker", role_keywords))
            .withColumn("sentences", T.split_sentences("clean_text"))
            .withColumn("utterance_tier", T.lexicon_tier("clean_text", lexicon)))
