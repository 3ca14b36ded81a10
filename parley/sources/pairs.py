"""Training-pair and labelled-text sources, tolerant multi-source loading, sinks."""

from __future__ import annotations

import json
import logging
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import defaults as D

log = logging.getLogger(__name__)

PAIR_SCHEMA = "transcript string, reference_summary string"


def read_labelled_text(spark: SparkSession, path: str, text_col: str = "Situation",
                       label_col: str = "emotion") -> DataFrame:
    """Labelled text CSV -> ``utterance, emotion`` without nulls."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return (df.withColumnRenamed(text_col, "utterance")
            .select("utterance", F.col(label_col).alias("emotion"))
            .na.drop(subset=["utterance", "emotion"]))


def read_qa_pairs(spark: SparkSession, path: str, question: str = "questionText", answer: str = "answerText",
                  fmt: str = "csv", min_answer_chars: int | None = D.MIN_ANSWER_CHARS) -> DataFrame:
    """Question/answer file -> ``transcript, reference_summary``; answers of
    ``min_answer_chars`` characters or fewer are dropped (``None``: keep all)."""
    reader = spark.read
    if fmt == "csv":
        df = reader.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    else:
        df = reader.format(fmt).load(path)
    out = (df.select(F.col(question).cast("string").alias("transcript"),
                     F.col(answer).cast("string").alias("reference_summary"))
           .na.drop(subset=["transcript", "reference_summary"]))
    if min_answer_chars is not None:
        out = filter_short(out, "reference_summary", min_answer_chars)
    return out


def read_corpus_pairs(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A published corpus exported as files with ``Context`` / ``Response``."""
    return read_qa_pairs(spark, path, "Context", "Response", fmt=fmt, min_answer_chars=None)


def filter_short(df: DataFrame, col: str, min_chars: int) -> DataFrame:
    """Keep rows whose ``col`` is longer than ``min_chars`` characters."""
    return df.filter(F.length(F.col(col)) > min_chars)


def load_training_pairs(spark: SparkSession, sources) -> DataFrame:
    """Union of the sources that resolve; a failing source is logged and skipped.

    ``sources`` is a list of zero-argument callables returning DataFrames
    with ``transcript, reference_summary`` (e.g. ``lambda: read_qa_pairs(...)``).
    Failures caught here are those Spark raises while resolving the source
    (missing path, missing column); row-level problems are the readers' mode.
    Nothing loads -> an empty frame with the right columns.
    """
    frames = []
    for i, make in enumerate(sources):
        try:
            df = make().select("transcript", "reference_summary")
            df.schema  # noqa: B018 — forces analysis
            frames.append(df.withColumn("source_rank", F.lit(i)))
        except Exception as e:  # noqa: BLE001
            log.warning("training source %d failed: %s", i, e)
    if not frames:
        return spark.createDataFrame([], PAIR_SCHEMA + ", source_rank int")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def read_checked_pairs(spark: SparkSession, source: str, path: str, columns: list[str], question: str, answer: str,
                       min_answer_chars: int | None = D.MIN_ANSWER_CHARS, header: bool = True) -> DataFrame:
    """Every record of a CSV file or folder: ``source, transcript, reference_summary, record, reason``.

    ``columns`` names the file's columns in order. ``reason`` is null for a pair that can be used,
    else the first that holds of ``malformed`` (the number of fields differs), ``no question``, ``no answer``
    (missing) and ``short answer`` (``min_answer_chars`` characters or fewer; ``None``: any length).
    ``record`` keeps what was read of a refused record: the raw text if malformed, else its fields
    as JSON.
    """
    schema = ", ".join(f"`{c}` string" for c in columns) + ", `_bad` string"
    raw = (spark.read.schema(schema).option("header", header).option("multiLine", True).option("escape", '"')
           .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").csv(path))
    reason = (F.when(F.col("_bad").isNotNull(), "malformed").when(F.col(f"`{question}`").isNull(), "no question")
              .when(F.col(f"`{answer}`").isNull(), "no answer"))
    if min_answer_chars is not None:
        reason = reason.when(F.length(f"`{answer}`") <= min_answer_chars, "short answer")
    fields = F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]))
    out = raw.select(F.lit(source).alias("source"), F.col(f"`{question}`").alias("transcript"),
                     F.col(f"`{answer}`").alias("reference_summary"), F.coalesce("_bad", fields).alias("record"), reason.alias("reason"))
    return out.withColumn("record", F.when(F.col("reason").isNotNull(), F.col("record")))


def load_checked_pairs(spark: SparkSession, sources: dict[str, dict]) -> tuple[DataFrame, DataFrame]:
    """``(pairs, quarantine)`` of the union of the sources; nothing is dropped silently.

    ``sources`` maps a name to the arguments of ``read_checked_pairs``. ``pairs`` has ``source,
    transcript, reference_summary``; ``quarantine`` has ``source, record, reason``, one row for every
    record that is no pair and one, without a record, for a source that cannot be read
    (``unreadable``). Records = pairs + quarantined records.
    """
    both = spark.createDataFrame([], "source string, transcript string, reference_summary string, record string, reason string")
    for name, args in sources.items():
        try:
            rows = read_checked_pairs(spark, name, **args)
            rows.schema  # noqa: B018 — forces analysis
        except AnalysisException as e:
            log.warning("training source %s failed: %s", name, e)
            rows = spark.range(1).select(F.lit(name).alias("source"), *[F.lit(None).cast("string").alias(c) for c in (
                "transcript", "reference_summary", "record")], F.lit("unreadable").alias("reason"))
        both = both.unionByName(rows)
    return (both.where("reason IS NULL").select("source", "transcript", "reference_summary"),
            both.where("reason IS NOT NULL").select("source", "record", "reason"))


MANIFEST = "_manifest"
MANIFEST_SCHEMA = "run long, name string, folder string, n_rows long, columns string"


def _manifest(spark: SparkSession, path: str):
    """``(run, rows)`` of the newest complete run under ``path``; ``(-1, [])`` if there is none."""
    try:
        listed = spark.read.schema(MANIFEST_SCHEMA).json(f"{path.rstrip('/')}/{MANIFEST}")
        newest = listed.agg(F.max("run")).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return -1, []
    return (-1, []) if newest is None else (newest, listed.where(F.col("run") == newest).collect())


def write_results(results: dict[str, DataFrame], path: str) -> dict[str, str]:
    """Write every result table as Parquet into a fresh folder under ``path``; the folders by name.

    The run's manifest (row counts, seen while writing, and columns) is appended last, as one
    file in one commit. Until then ``read_results`` returns the run before, so that a job that
    dies half-way, or is repeated, leaves no mixed state. One writer at a time; folders of older
    runs stay.
    """
    if not results:
        return {}
    spark = next(iter(results.values())).sparkSession
    run = _manifest(spark, path)[0] + 1
    base = f"{path.rstrip('/')}/run-{run:06d}-{uuid.uuid4().hex}"
    rows = []
    for name, df in results.items():
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("error").parquet(f"{base}/{name}")
        rows.append((run, name, f"{base}/{name}", seen.get["n"], df.schema.json()))
    spark.createDataFrame(rows, MANIFEST_SCHEMA).coalesce(1).write.mode("append").json(f"{path.rstrip('/')}/{MANIFEST}")
    return {name: folder for _, name, folder, _, _ in rows}


def read_results(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the newest complete run of ``write_results``; empty if there is none."""
    return {r["name"]: spark.read.schema(StructType.fromJson(json.loads(r["columns"]))).parquet(r["folder"])
            for r in _manifest(spark, path)[1]}
