"""Views of the provided parquet tables in the engine's input schemas.

``conversations`` plays the utterance table, and an annotated view of it plays
the per-session annotated files; ``events`` plays a trainer log; ``documents``
with ``labels`` the labelled text; ``embeddings`` token vectors and class
probabilities. Only column renames and derived columns — the work of every
query grows with these tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binary import bytes_of
from ..session import ensure_checkpoint_dir, ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as (session_id, turn, speaker, utterance)."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("session_id"), F.col("turn"),
                    F.col("role").alias("speaker"), F.col("text").alias("utterance"))


def annotated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as annotated-file rows: a ``system`` turn is the
    session's ``Summary`` metadata row (its text in ``Sub_topic``), an
    ``assistant`` turn has type code ``T``."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").alias("session_id"),
        F.col("turn").alias("row_pos"),
        F.when(F.col("role") == "system", F.lit("Summary")).otherwise(F.col("text")).alias("Utterance"),
        F.when(F.col("role") == "system", F.col("text")).otherwise(F.lit(None).cast("string")).alias("Sub_topic"),
        F.when(F.col("role") == "assistant", F.lit("T")).otherwise(F.lit("P")).alias("Type"))


def trainer_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a trainer log: seq, epoch = hour / 6, loss from ``click``
    rows, eval_loss from ``view`` rows."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("seq"),
        (F.hour("ts") / F.lit(6.0)).alias("epoch"),
        F.when(F.col("event_type") == "click", F.col("value")).alias("loss"),
        F.when(F.col("event_type") == "view", F.col("value")).alias("eval_loss"))


def labelled_text(spark: SparkSession, sf_dir: str, label: str = "event_type") -> DataFrame:
    """``events`` as labelled rows (utterance = props, emotion = event type)."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("row_id"), F.col("props").alias("utterance"),
                    F.col(label).alias("emotion"))


def class_probabilities(spark: SparkSession, sf_dir: str, scale: float = 10.0, width: int = 32) -> DataFrame:
    """``embeddings`` as per-pair class probabilities: softmax(scale * first
    ``width`` entries); vector 2k is the client side of pair k, 2k+1 the
    counselor side."""
    from ..functions.arrays import softmax

    e = table(spark, sf_dir, "embeddings")
    p = e.select((F.col("vec_id") / 2).cast("long").alias("pair_id"),
                 (F.col("vec_id") % 2).alias("side"),
                 softmax(F.slice(F.col("embedding"), 1, width), scale).alias("probs"))
    client = p.filter("side = 0").select("pair_id", F.col("probs").alias("client_probs"))
    counselor = p.filter("side = 1").select("pair_id", F.col("probs").alias("counselor_probs"))
    return client.join(counselor, "pair_id")


#: Bytes of text whose words are looked for together; a longer text is looked at alone.
WORDS_BYTES = 1 << 18


def _runs(data: np.ndarray, ends: np.ndarray, every: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs start and end (``word_runs``) in rows that end at ``ends``, the first one's start before them."""
    letter = (data >= ord("a")) & (data <= ord("z"))
    first, last = letter.copy(), letter.copy()
    first[1:] &= ~letter[:-1]
    last[:-1] &= ~letter[1:]
    edge = ends[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]  # words end with the row
    first[edge], last[edge - 1] = letter[edge], letter[edge - 1]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(ends[1:], start, side="right")
    linked = np.zeros(len(start) + 2, np.bool_)  # to the next word, by one blank
    linked[:len(start)][:-1] = (start[1:] - stop[:-1] == 1) & (data[stop[:-1]] == ord(" ")) & (row[1:] == row[:-1])
    number = np.arange(len(start))
    opens = np.r_[True, ~linked[:len(start)][:-1]][:len(start)]
    within = number - np.maximum.accumulate(np.where(opens, number, 0))
    runs = np.flatnonzero((within % 3 == 0) & linked[:-2] & linked[1:-1])
    # their numbers in the row
    before = np.searchsorted(row[runs], row[runs], side="left")
    runs = runs[(np.arange(len(runs)) - before) % every == 0]
    return start[runs], stop[runs + 2]


def word_runs(texts: DataFrame, text: str, every: int, size: int = WORDS_BYTES) -> DataFrame:
    """``phrase``: the first and every ``every``-th run after it of each lower-cased text. A run is what ``[a-z]+ [a-z]+ [a-z]+``
    matches, one after the other; words are found in numpy, as the pattern tries each letter of a word anew."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = bytes_of(batch.column("_bytes"))
            k = 0
            while k < batch.num_rows:
                to = max(k + 1, int(np.searchsorted(ends, ends[k] + size, side="right")) - 1)
                some = data[ends[k]:ends[to]]
                start, stop = _runs(some, ends[k:to + 1] - ends[k], every)
                yield pa.RecordBatch.from_arrays([pa.array([some[a:b].tobytes().decode() for a, b in zip(start.tolist(), stop.tolist())], pa.string())], ["phrase"])
                k = to

    ship_package(texts.sparkSession)
    return texts.select(F.lower(F.coalesce(F.col(text), F.lit(""))).cast("binary").alias("_bytes")).mapInArrow(run, "phrase string")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own beside the checkpoints, in the file system that the cluster shares."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def csv_folder(df: DataFrame, name: str) -> str:
    """``df`` as CSV files with a header in a fresh folder of the shared file system."""
    path = new_folder(df.sparkSession, name)
    (df.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


def faulty_pairs_folder(spark: SparkSession, sf_dir: str) -> str:
    """``documents`` as lines ``id,questionText,answerText`` (question ``q`` + id, answer the quoted text; a null
    text is an empty field) without header. Texts whose length modulo 8 is 0 get a fourth field,
    those with 1 no question."""
    d = table(spark, sf_dir, "documents")
    kind = F.length("text") % 8
    line = F.concat(F.col("doc_id").cast("string"), F.lit(","), F.when(kind == 1, "").otherwise(F.concat(F.lit("q"), "doc_id")), F.lit(","),
                    F.coalesce(F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"')), F.lit("")),
                    F.when(kind == 0, ",x").otherwise(""))
    path = new_folder(spark, "faulty-pairs")
    d.select(line.alias("value")).write.text(path)
    return path
