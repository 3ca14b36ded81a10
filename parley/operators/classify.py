"""Text classifier for the probability tier: Spark ML pipeline, fit and score."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, StopWordsRemover
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import defaults as D
from .prepare import encode_labels
from .segment import default_stop_words
from .sessions import positional_split


def label_pipeline(text: str = "utterance", label: str = "label_id", num_features: int = 1 << 18,
                   max_iter: int = 50, reg: float = 0.0) -> Pipeline:
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="_tok", pattern=r"\b\w\w+\b", gaps=False, toLowercase=True),
        StopWordsRemover(inputCol="_tok", outputCol="_terms", stopWords=default_stop_words()),
        HashingTF(inputCol="_terms", outputCol="_tf", numFeatures=num_features),
        IDF(inputCol="_tf", outputCol="_features"),
        LogisticRegression(featuresCol="_features", labelCol=label, family="multinomial",
                           maxIter=max_iter, regParam=reg),
    ])


def fit_label_classifier(df: DataFrame, text: str = "utterance", label: str = "emotion", labels=None,
                         *, order: list[str], fraction: float = D.CLASSIFIER_TRAIN_FRACTION,
                         **kw):
    """Encode labels, split (first ``fraction`` in ``order``, the rows' own order, trains), fit.

    Returns ``(model, split_df)``; ``split_df`` carries ``label_id`` and
    ``split`` for evaluation on the validation rows.
    """
    enc = encode_labels(df, label, labels, text).withColumn("label_id", F.col("label_id").cast("double"))
    split = positional_split(enc, order, fraction)
    model = label_pipeline(text, "label_id", **kw).fit(split.filter(F.col("split") == "train"))
    return model, split
