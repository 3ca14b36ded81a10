"""Line dedup over overlapping three-line windows (operator 9), DataFrame functions only.

Method: consecutive lines are hashed in overlapping windows of ``window`` lines;
windows found twice or more anywhere in the table are repeated; the first
occurrence (smallest id, then text hash, then position) stays, and all lines
that a later occurrence covers are removed, overlaps merged.

Only the windows' hashes are shuffled to find repeats; counting is
pre-aggregated, so a window that a third of all documents share costs one row
a map task. Positions are gathered by document, never by window.

Defined results:
* lines are what ``\\n`` separates; texts with fewer than ``window`` lines have no
  window and stay as they are; null text stays null, empty text empty;
* a document whose lines are all removed keeps its row with an empty text;
* rows with equal id and equal text count as one document: all are returned, and
  a window is not a repeat of itself in the repeated row;
* null ids are ids of their own that sort first; an empty table gives no rows;
* all columns are kept; helper columns have names that start with ``_ld_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def _windows(hashes: Column, window: int) -> Column:
    """Position and 128-bit hash of every window over an array of line hashes."""
    def one(i, h):
        part = [F.get(h, i + k) for k in range(window)]
        return F.struct(i.alias("pos"), F.xxhash64(*part).alias("w1"), F.xxhash64(F.lit(window), *part[::-1]).alias("w2"))

    # the inner lambda binds the array once
    return F.flatten(F.transform(F.array(hashes), lambda h: F.transform(
        F.when(F.size(h) >= window, F.sequence(F.lit(0), F.size(h) - window)).otherwise(F.array().cast("array<int>")),
        lambda i: one(i, h))))


def repeated_windows(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """``_ld_id, _ld_text`` (hash) and ``_ld_starts`` of the later occurrences, by document."""
    hashes = F.transform(_lines(text_col), lambda x: F.xxhash64(x))
    found = (docs.where(F.col(text_col).contains("\n"))
             .select(F.col(id_col).alias("_ld_id"), F.xxhash64(F.col(text_col)).alias("_ld_text"),
                     F.explode(_windows(hashes, window)).alias("x"))
             .select("_ld_id", "_ld_text", "x.pos", "x.w1", "x.w2"))
    place = F.struct("_ld_id", "_ld_text", "pos")
    first = (found.groupBy("w1", "w2").agg(F.count("*").alias("n"), F.min(place).alias("first"))
             .where("n > 1").drop("n"))
    later = found.join(first, ["w1", "w2"]).where(~(
        F.col("_ld_id").eqNullSafe(F.col("first._ld_id")) & (F.col("_ld_text") == F.col("first._ld_text"))
        & (F.col("pos") == F.col("first.pos"))))
    return later.groupBy("_ld_id", "_ld_text").agg(F.collect_set("pos").alias("_ld_starts"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3,
               counts: bool = False) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text_col``; with ``counts``
    also the columns ``n_lines`` and ``n_removed``, in place of any of those names."""
    starts = repeated_windows(docs, id_col, text_col, window)
    rows = docs.withColumn("_ld_hash", F.xxhash64(F.col(text_col)))
    rows = rows.join(starts, F.col(id_col).eqNullSafe(F.col("_ld_id"))
                     & (F.col("_ld_hash") == F.col("_ld_text")), "left")
    covered = F.array_distinct(F.flatten(F.transform("_ld_starts", lambda s: F.sequence(s, s + (window - 1)))))
    n = F.size(_lines(text_col))
    kept = F.array_except(F.sequence(F.lit(0), n - 1), covered)
    text = F.flatten(F.transform(F.array(_lines(text_col)), lambda ls: F.transform(kept, lambda i: F.get(ls, i))))
    hit = F.col("_ld_starts").isNotNull()
    out = {text_col: F.when(hit, F.array_join(text, "\n")).otherwise(F.col(text_col))}
    extra = {}
    if counts:
        extra = {"n_lines": F.when(F.col(text_col).isNull(), 0).otherwise(n).cast("long"),
                 "n_removed": F.when(hit, F.size(covered)).otherwise(0).cast("long")}
    return rows.select(*[out.get(c, F.col(c)).alias(c) for c in docs.columns if c not in extra],
                       *[v.alias(k) for k, v in extra.items()])
