"""Linear text classifiers as relations: weights in a long table, scores by explode, join and sum.

No feature vector, no vocabulary on the driver and no Python in the tasks: a model is
``weights (term, label, weight)`` and ``classes (label, intercept, per_term)``, so its size
is bounded by the cluster alone. A text's score for a class is ``intercept``, plus
``per_term`` for every known term occurrence, plus the weights of its terms; softmax over
the classes gives the probabilities.

Defined results: null text counts as empty and gets the intercepts' probabilities (callers
that want zeros, as ``tiers.score_texts``, filter blank texts first); terms without any
weight don't count; keys of scored texts must be unique; rows with a label outside
``labels``, or null, don't train.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as T
from .segment import default_stop_words
from .sequence import fixed_table, shared


def text_terms(text: str, stop_words: list[str] | None = None) -> Column:
    """Lower-case tokens of two or more of ``[a-z0-9]`` that are no stop words."""
    stop = default_stop_words() if stop_words is None else list(stop_words)
    return F.filter(T.overlap_tokens(text), lambda t: (F.length(t) > 1) & ~t.isin(stop))


@dataclass
class LinearModel:
    """``weights``, ``classes`` and the labels in the order of the probabilities; ``terms`` makes a
    text's array of terms."""

    weights: DataFrame
    classes: DataFrame
    labels: list[str]
    terms: object = text_terms

    def probabilities(self, texts: DataFrame, keys: list[str], text: str) -> DataFrame:
        """``keys, probs`` (array in the order of ``labels``) of every row.

        Terms are counted per text before they meet the weights, whose classes are one row
        a term; all that is collected is an array of the classes.
        """
        counts = (texts.select(*keys, F.explode(self.terms(text)).alias("_term"))
                  .groupBy(*keys, "_term").agg(F.count(F.lit(1)).alias("_tf")))
        # a row without label counts the known terms
        by_term = self.weights.groupBy(F.col("term").alias("_term")).agg(F.collect_list(F.struct("label", "weight")).alias("_w"))
        known = F.array(F.struct(F.lit(None).cast("string").alias("label"), F.lit(1.0).alias("weight")))
        sums = (counts.join(by_term, "_term").select(*keys, "_tf", F.explode(F.concat(known, "_w")).alias("x"))
                .groupBy(*keys, F.col("x.label").alias("label")).agg(F.sum(F.col("_tf") * F.col("x.weight")).alias("_s"))
                .groupBy(*keys).agg(F.sum(F.when(F.col("label").isNull(), F.col("_s"))).alias("_n"),
                                    F.map_from_entries(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("label", "_s"))))
                                    .alias("_sums")))
        position = fixed_table(texts.sparkSession, [(l, i) for i, l in enumerate(self.labels)], "label string, _at int")
        base = texts.select(*keys).join(sums, keys, "left").select(
            *keys, "_n", "_sums", F.explode(F.array(*[F.lit(l) for l in self.labels])).alias("label"))
        score = (F.col("intercept") + F.coalesce("_n", F.lit(0.0)) * F.col("per_term")
                 + F.coalesce(F.try_element_at("_sums", F.col("label")), F.lit(0.0)))
        scored = (base.join(F.broadcast(self.classes.join(position, "label")), "label")  # a row a class
                  .groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_at", score.alias("score")))).alias("x")))
        top = F.array_max(F.col("x.score"))
        return scored.select(*keys, A.softmax(F.transform(F.col("x.score"), lambda s: s - top)).alias("probs"))


def fit_bayes(rows: DataFrame, text: str, label: str, labels: list[str], smoothing: float = 1.0) -> LinearModel:
    """Multinomial naive Bayes: term counts per class, one pass and two aggregates.

    A weight is a term's log count over an unseen term's, so that only terms seen in a
    class have a row; ``per_term`` is what every known term gives the class.
    """
    rows = rows.where(F.col(label).isin(labels)).select(F.col(label).alias("label"), text_terms(text).alias("_terms"))
    counts = shared(rows.select("label", F.explode("_terms").alias("term")).groupBy("term", "label").agg(
        F.count(F.lit(1)).alias("_n")))
    weights = counts.select("term", "label", F.log((F.col("_n") + smoothing) / smoothing).alias("weight"))
    # one row a class: documents, tokens; totals are windows over these rows
    spark = rows.sparkSession
    known = fixed_table(spark, [(x,) for x in labels], "label string")
    per_class = (rows.groupBy("label").agg(F.count(F.lit(1)).alias("_docs"))
                 .join(counts.groupBy("label").agg(F.sum("_n").alias("_tokens")), "label", "left"))
    size = counts.agg(F.count_distinct("term").alias("_v")).select(F.explode(F.array(*[F.lit(x) for x in labels])).alias("label"), "_v")
    everything = rows.agg(F.count(F.lit(1)).alias("_all")).select(
        F.explode(F.array(*[F.lit(x) for x in labels])).alias("label"), "_all")
    docs, tokens = F.coalesce("_docs", F.lit(0)), F.coalesce("_tokens", F.lit(0))
    classes = (known.join(per_class, "label", "left").join(size, "label").join(everything, "label").select(
        "label", F.log((docs + smoothing) / (F.col("_all") + smoothing * len(labels))).alias("intercept"),
        F.log(smoothing / (tokens + smoothing * F.greatest("_v", F.lit(1)))).alias("per_term")))
    return LinearModel(weights, classes, list(labels))


def export_logistic(model, texts: DataFrame, text: str, labels: list[str]) -> LinearModel:
    """The fitted pipeline of ``classify.label_pipeline`` as a ``LinearModel`` for the terms of ``texts``.

    The pipeline's own stages map every distinct term to its hashed column once; a weight is
    the column's coefficient times its inverse document frequency. Probabilities equal those of
    the pipeline's ``transform``.
    """
    spark = texts.sparkSession
    tokenizer, stop, hashing, idf, regression = model.stages
    pattern, remove = tokenizer.getPattern(), stop.getStopWords()

    def terms(col: str) -> Column:
        found = F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit(pattern), 0)
        return F.filter(found, lambda t: ~t.isin(remove))

    distinct = texts.select(F.explode(terms(text)).alias("term")).distinct()
    hashed = hashing.transform(distinct.withColumn(hashing.getInputCol(), F.array("term")))
    column = F.get_json_object(F.to_json(F.struct(F.col(hashing.getOutputCol()).alias("v"))), "$.v.indices[0]").cast("long")
    matrix, scale = regression.coefficientMatrix.toArray(), idf.idf.toArray()
    used = [i for i in range(matrix.shape[1]) if matrix[:, i].any()]  # at most the hashed columns
    by_column = fixed_table(spark, [(i, [float(c * scale[i]) for c in matrix[:, i]]) for i in used], "_at long, _c array<double>")
    names = F.array(*[F.lit(x) for x in labels])
    # the pipeline has no class for labels after the last one it was fitted on
    weights = (hashed.select("term", column.alias("_at")).join(by_column, "_at")
               .select("term", F.explode(F.arrays_zip(F.slice(names, 1, matrix.shape[0]).alias("label"), F.col("_c").alias("weight"))).alias("x"))
               .select("term", "x.label", "x.weight"))
    classes = spark.createDataFrame([(x, float(b), 0.0) for x, b in zip(labels, regression.interceptVector.toArray())],
                                    "label string, intercept double, per_term double")
    return LinearModel(weights, classes, list(labels)[:matrix.shape[0]], terms)
