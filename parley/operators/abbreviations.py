"""Abbreviations learned from a corpus, for ``text.split_sentences``.

Method: the published unsupervised statistics of sentence-boundary detection. A word type that
nearly always carries a final dot is one with its dot; short words and inner dots speak
for that, occurrences without a dot against it. Two aggregates, no word list.

Defined results: null texts have no words; words are ASCII, lower case and start with a letter; one
that ends in several dots (an ellipsis) counts neither way; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A word with this score or more is taken for an abbreviation (fixed value of the method).
THRESHOLD = 0.3
WORD = r"[a-z][a-z0-9.]*"


def abbreviation_statistics(texts: DataFrame, text: str = "text") -> DataFrame:
    """``word, n_dot, n_plain, log_likelihood, score, abbreviation`` of every word that has a final dot somewhere.

    ``log_likelihood`` compares "the dot belongs to the word" (probability 0.99) with the dots'
    share among all words. ``score`` scales it by e to the minus length, by inner dots + 1, and
    by length to the minus number of occurrences without a dot.
    """
    found = texts.select(F.explode(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD), F.lit(0))).alias("_w"))
    words = (found.where(~F.col("_w").endswith("..")).groupBy("_w").agg(F.count(F.lit(1)).alias("_n"))
             .select(F.rtrim("_w", F.lit(".")).alias("word"), F.col("_w").endswith(".").alias("_dot"), "_n"))
    counts = words.groupBy("word").agg(F.sum(F.when(F.col("_dot"), F.col("_n")).otherwise(0)).alias("n_dot"),
                                       F.sum(F.when(F.col("_dot"), 0).otherwise(F.col("_n"))).alias("n_plain"))
    share = words.agg((F.sum(F.when(F.col("_dot"), F.col("_n")).otherwise(0)) / F.sum("_n")).alias("p")).scalar()
    rows = counts.where("n_dot > 0").withColumn("_p", share)
    dot, plain = F.col("n_dot"), F.col("n_plain")
    against = F.when(plain > 0, plain * (F.log(1 - F.col("_p")) - F.log(F.lit(0.01)))).otherwise(F.lit(0.0))
    length = F.length(F.replace("word", F.lit("."), F.lit(""))).cast("double")
    inner = F.length("word") - length + 1
    rows = rows.withColumn("log_likelihood", -2 * (dot * (F.log("_p") - F.log(F.lit(0.99))) + against))
    rows = rows.withColumn("score", F.col("log_likelihood") * F.exp(-length) * inner * F.pow(length, -plain))
    return rows.select("word", "n_dot", "n_plain", "log_likelihood", "score", (F.col("score") >= THRESHOLD).alias("abbreviation"))
