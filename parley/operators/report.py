"""Routing summary sentences into a fixed-section report."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import defaults as D
from ..functions import text as T
from .sequence import ordered_concat


def section_column(name: str) -> str:
    """Column name for a section: lower case, non-alphanumerics to ``_``."""
    return re.sub(r"[^0-9a-z]+", "_", name.lower()).strip("_")


def route_sentences(summaries: DataFrame | None, text: str = "summary", rules=None,
                    fallback: str = D.FALLBACK_SECTION, sentences: DataFrame | None = None) -> DataFrame:
    """One row per summary sentence with the section it is routed to.

    A sentence goes to the first section, in rule order, having a pattern
    found in it (case-insensitive search); each sentence is routed once;
    unmatched sentences go to ``fallback`` after that section's own ones
    (``order_key`` = (matched first, position)). ``sentences`` (``session_id,
    sent_pos, sentence``) may be given instead of texts to split.
    """
    sents = sentences if sentences is not None else summaries.select(
        "session_id", F.posexplode(T.split_sentences(text)).alias("sent_pos", "sentence"))
    sec = T.section_of("sentence", rules)
    return (sents.withColumn("_matched", sec)
            .select("session_id", "sent_pos", "sentence",
                    F.coalesce(F.col("_matched"), F.lit(fallback)).alias("section"),
                    F.col("_matched").isNotNull().alias("matched")))


def build_reports(summaries: DataFrame, features: DataFrame | None = None, text: str = "summary",
                  rules=None, fallback: str = D.FALLBACK_SECTION,
                  empty_text: str = D.EMPTY_SECTION_TEXT, sentences: DataFrame | None = None) -> DataFrame:
    """One row per summary: a column per section (sentences joined by a blank,
    ``empty_text`` when none), plus ``tier_score`` / ``tier_label`` when
    ``features`` is given (0 and '' for sessions without features). With
    ``sentences`` the texts are never assembled, and ``summaries`` only names the
    sessions. A section's sentences are joined on two levels, in blocks."""
    rules = rules or D.SECTION_PATTERNS
    names = [n for n, _ in rules]
    if fallback not in names:
        names.append(fallback)
    # matched sentences first: unmatched ones are shifted past every position
    place = F.col("sent_pos").cast("long") + F.when(F.col("matched"), 0).otherwise(1 << 40)
    routed = route_sentences(summaries, text, rules, fallback, sentences).withColumn("_place", place)
    per_section = ordered_concat(routed, ["session_id", "section"], "_place", "sentence", " ", "_txt")
    wide = per_section.groupBy("session_id").agg(
        *[F.max(F.when(F.col("section") == n, F.col("_txt"))).alias(section_column(n)) for n in names])
    base = summaries.select("session_id").join(wide, "session_id", "left")
    out = base.select("session_id", *[F.coalesce(F.col(section_column(n)), F.lit(empty_text))
                                      .alias(section_column(n)) for n in names])
    if features is not None:
        f = features.select("session_id", F.col("emotion_tier").alias("_tier"),
                            F.col("tier_label").alias("_label"))
        out = (out.join(f, "session_id", "left")
               .withColumn("tier_score", F.coalesce(F.col("_tier").cast("int"), F.lit(0)))
               .withColumn("tier_label", F.coalesce(F.col("_label"), F.lit("")))
               .drop("_tier", "_label"))
    return out
