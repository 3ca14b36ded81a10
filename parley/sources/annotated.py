"""Annotated session files: one CSV per session, metadata rows mixed in.

``read_annotated_sessions`` scans whole folders in one multi-file read;
``split_meta_rows``, ``session_reference``, ``speaker_from_type`` and
``annotated_to_utterances`` turn the rows into the utterance table and a
per-session table of transcript and reference summary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from .. import defaults as D
from ..operators.sequence import ordered_concat, prefix_sum
from ..operators.sessions import first_per_session

ANNOTATED_SCHEMA = Ty.StructType([Ty.StructField(c, Ty.StringType(), True) for c in D.ANNOTATED_COLUMNS])


def _strip(c) -> F.Column:
    """Python-style strip: leading and trailing whitespace of any kind."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def read_annotated_sessions(spark: SparkSession, dirs, glob: str = D.ANNOTATED_GLOB,
                            prefix: str = D.ANNOTATED_PREFIX) -> DataFrame:
    """All annotated files of the given folders (empty entries skipped).

    Columns are taken by position (the header line is skipped, its names
    ignored). ``multiLine`` keeps quoted line breaks inside one value and one
    file inside one task, so ``monotonically_increasing_id`` follows the
    file's row order; ``row_pos`` is that id minus the file's smallest id.
    Every file is a session of its own. Its id is the decoded file name without
    ``prefix`` and ``.csv``; where files of several folders share a name, it is
    preceded by the folder's path. ``session_name`` is the name alone.
    """
    paths = [d for d in ([dirs] if isinstance(dirs, str) else list(dirs)) if d]
    if not paths:
        return spark.createDataFrame([], Ty.StructType(ANNOTATED_SCHEMA.fields).add("session_name", "string").add("session_id", "string").add("row_pos", "long"))
    raw = (spark.read.schema(ANNOTATED_SCHEMA)
           .option("header", True).option("multiLine", True).option("escape", '"')
           .option("pathGlobFilter", glob)
           .csv(paths)
           .withColumn("_file", F.col("_metadata.file_path"))
           .withColumn("_name", F.col("_metadata.file_name"))
           .withColumn("_id", F.monotonically_increasing_id()))
    name = F.url_decode(F.replace(F.col("_name"), F.lit("+"), F.lit("%2B")))
    sid = F.replace(F.replace(name, F.lit(prefix), F.lit("")), F.lit(".csv"), F.lit(""))
    # one row per file; how it is joined is left to the planner
    files = (raw.groupBy("_file").agg(F.min("_id").alias("_first"), F.first(sid).alias("session_name"))
             .withColumn("_same", F.count(F.lit(1)).over(Window.partitionBy("session_name"))))
    folder = F.url_decode(F.replace(F.regexp_replace("_file", r"[^/]*$", ""), F.lit("+"), F.lit("%2B")))
    files = files.withColumn("session_id", F.when(F.col("_same") > 1, F.concat(folder, F.col("session_name")))
                             .otherwise(F.col("session_name")))
    return (raw.join(files.drop("_same"), "_file")
            .withColumn("row_pos", F.col("_id") - F.col("_first"))
            .drop("_id", "_first", "_name"))


def split_meta_rows(rows: DataFrame, keywords=None) -> DataFrame:
    """Add ``is_meta``: the lower-cased ``Utterance`` is a metadata keyword
    (null utterances are ordinary rows)."""
    kws = keywords or D.META_KEYWORDS
    return rows.withColumn("is_meta", F.coalesce(F.lower(F.col("Utterance")).isin(kws), F.lit(False)))


def session_reference(rows: DataFrame) -> DataFrame:
    """``session_id, reference_summary``: ``Sub_topic`` of the first ``summary``
    row; sessions whose reference is missing or blank are left out."""
    s = rows.filter(F.lower(F.col("Utterance")) == "summary")
    ref = first_per_session(s, "Sub_topic", "row_pos", "reference_summary")
    return ref.filter(F.col("reference_summary").isNotNull() & (_strip(F.col("reference_summary")) != ""))


def speaker_from_type(c="Type", code: str = D.COUNSELOR_TYPE_CODE) -> F.Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.when(_strip(col) == code, F.lit("counselor")).otherwise(F.lit("client"))


def annotated_to_utterances(rows: DataFrame) -> DataFrame:
    """Utterance table from annotated rows: metadata rows removed, ``turn``
    renumbered 0.. over the remaining rows (row position minus the metadata
    rows before it, by a two-level running sum)."""
    m = split_meta_rows(rows).withColumn("_m", F.col("is_meta").cast("long"))
    m = prefix_sum(m, ["session_id"], "row_pos", "_m", "_meta_before", inclusive=False)
    return (m.filter(~F.col("is_meta"))
            .select("session_id", (F.col("row_pos") - F.col("_meta_before")).cast("long").alias("turn"),
                    speaker_from_type("Type").alias("speaker"), F.col("Utterance").alias("utterance")))


def load_sessions(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(utterances, sessions)``: the utterance table of sessions that have a
    reference, and per session its raw transcript and reference summary."""
    refs = session_reference(split_meta_rows(rows))
    utt = annotated_to_utterances(rows).join(refs.select("session_id"), "session_id", "left_semi")
    d = utt.select("session_id", "turn", F.coalesce(F.col("utterance"), F.lit("")).alias("_u"))
    tr = ordered_concat(d, ["session_id"], "turn", "_u", " ", "transcript")
    return utt, tr.join(refs, "session_id")
