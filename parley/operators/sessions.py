"""Session-level operators over the utterance table.

The utterance table has one row per utterance: ``session_id``, ``turn``
(non-negative position inside the session), ``speaker``, ``utterance``.
Every ordered operation sorts by ``turn``; nothing relies on row order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import defaults as D
from ..session import ensure_checkpoint_dir
from ..functions import text as T
from .sequence import number_rows, ordered_concat, prefix_sum, shared

UTTERANCE_COLUMNS = ["session_id", "turn", "speaker", "utterance"]


def require_columns(df: DataFrame, cols: list[str], what: str = "input") -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"{what} is missing columns {missing}; has {df.columns}")


def preprocess(df: DataFrame, fillers=None, role_keywords=None, mode: str = "strict",
               with_sentences: bool = False) -> DataFrame:
    """Add ``clean_text`` and ``role`` (and ``sentences`` on request).

    Rows without a session key are rejected (dropped): a session-keyed job has
    no place for them.
    """
    require_columns(df, UTTERANCE_COLUMNS, "utterance table")
    out = (df.filter(F.col("session_id").isNotNull())
           .withColumn("clean_text", T.normalize_text("utterance", fillers, mode))
           .withColumn("role", T.assign_role("speaker", role_keywords)))
    if with_sentences:
        out = out.withColumn("sentences", T.split_sentences("clean_text"))
    return out


def numbered(utterances: DataFrame, out: str = "_pos") -> DataFrame:
    """Add the dense position of every utterance in its session: gaps in ``turn``
    close up, repeated turns follow each other by speaker and text."""
    ties = [c for c in ("speaker", "utterance", "clean_text") if c in utterances.columns]
    return number_rows(utterances, ["session_id"], "turn", ties, out)


def sentence_rows(df: DataFrame, text: str = "clean_text", keys=("session_id", "turn"),
                  abbreviations=None) -> DataFrame:
    """One row per sentence: keys, ``sent_pos`` (0-based), ``sentence``."""
    return df.select(*keys, F.posexplode(T.split_sentences(text, abbreviations)).alias("sent_pos", "sentence"))


def session_text(df: DataFrame, text: str = "clean_text", out: str = "session_text") -> DataFrame:
    """All texts of a session joined by one blank, in turn order."""
    d = df.select("session_id", "turn", F.coalesce(F.col(text), F.lit("")).alias("_t"))
    return ordered_concat(d, ["session_id"], "turn", "_t", " ", out)


def role_texts(df: DataFrame, text: str = "clean_text") -> DataFrame:
    """Per session: client text, counselor text (each in turn order) and
    ``combined_text = client_text + ' ' + counselor_text``."""
    d = df.select("session_id", "turn", "role", F.coalesce(F.col(text), F.lit("")).alias("_t"))
    per_role = ordered_concat(d, ["session_id", "role"], "turn", "_t", " ", "_rt")
    wide = per_role.groupBy("session_id").agg(
        F.max(F.when(F.col("role") == "client", F.col("_rt"))).alias("client_text"),
        F.max(F.when(F.col("role") == "counselor", F.col("_rt"))).alias("counselor_text"))
    return (wide
            .withColumn("client_text", F.coalesce("client_text", F.lit("")))
            .withColumn("counselor_text", F.coalesce("counselor_text", F.lit("")))
            .withColumn("combined_text", F.concat_ws(" ", "client_text", "counselor_text")))


def transcript(df: DataFrame, text: str = "utterance", out: str = "transcript") -> DataFrame:
    """Raw utterances of a session joined in order (null treated as empty)."""
    return session_text(df, text, out)


def session_lengths(df: DataFrame, col: str = "utterance") -> DataFrame:
    """Number of non-null utterances per session."""
    return df.groupBy("session_id").agg(F.count(col).alias("n_utterances"))


def histogram(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """Equal-width histogram between min and max (last bin closed on the right).

    One row per bin, empty bins included; ``mean`` repeats the column mean.
    A constant column is widened by 0.5 on each side. The edges are scalar
    subqueries over one global (map-side partial) aggregate, so no join is
    needed to bring them to the rows.
    """
    x = F.col(col).cast("double")
    stats = df.agg(F.min(x).alias("mn"), F.max(x).alias("mx"), F.avg(x).alias("mean"))
    same = F.col("mn") == F.col("mx")
    lo = stats.select(F.when(same, F.col("mn") - 0.5).otherwise(F.col("mn"))).scalar()
    hi = stats.select(F.when(same, F.col("mx") + 0.5).otherwise(F.col("mx"))).scalar()
    mean = stats.select("mean").scalar()
    width = (hi - lo) / F.lit(bins)
    counts = (df.select(x.alias("_x")).filter(F.col("_x").isNotNull())
              .select(F.least(F.floor((F.col("_x") - lo) * F.lit(bins) / (hi - lo)).cast("int"),
                              F.lit(bins - 1)).alias("bin"))
              .groupBy("bin").agg(F.count(F.lit(1)).alias("n")))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (grid.join(F.broadcast(counts), "bin", "left")
            .select("bin",
                    (lo + F.col("bin") * width).alias("bin_lo"),
                    F.when(F.col("bin") == bins - 1, hi).otherwise(lo + (F.col("bin") + 1) * width).alias("bin_hi"),
                    F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"),
                    mean.alias("mean")))


def corpus_profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """Number of utterances and of distinct sessions (one row)."""
    sessions = (F.countDistinct("session_id") if exact
                else F.approx_count_distinct("session_id"))
    return df.agg(F.count(F.lit(1)).alias("n_utterances"), sessions.alias("n_sessions"))


def first_per_session(df: DataFrame, value: str, order: str = "turn", out: str | None = None) -> DataFrame:
    """The value of the first row (lowest ``order``) of each session."""
    return df.groupBy("session_id").agg(F.min_by(F.col(value), F.col(order)).alias(out or value))


def transcript_head(df: DataFrame, text: str = "clean_text", max_chars: int = D.PROMPT_TRANSCRIPT_CHARS,
                    out: str = "transcript_head") -> DataFrame:
    """First ``max_chars`` characters of the session text, joining only the
    turns that start inside the budget (turn offsets by a two-level prefix sum)."""
    d = df.select("session_id", "turn", F.coalesce(F.col(text), F.lit("")).alias("_t"))
    d = d.withColumn("_len", F.length("_t") + F.lit(1))
    d = prefix_sum(d, ["session_id"], "turn", "_len", "_start", inclusive=False)
    # a turn starting exactly at ``max_chars`` still contributes the
    # separator before it, which is inside the budget
    kept = d.filter(F.col("_start") <= max_chars)
    return (ordered_concat(kept, ["session_id"], "turn", "_t", " ", "_h")
            .select("session_id", F.substring("_h", 1, max_chars).alias(out)))


def build_prompts(utterances: DataFrame, features: DataFrame | None = None,
                  text: str = "clean_text", max_chars: int = D.PROMPT_TRANSCRIPT_CHARS,
                  n_topics: int = D.PROMPT_TOPICS) -> DataFrame:
    """Conditioned generator input per session.

    ``features`` has ``session_id``, ``tier_label`` and ``topics``
    (array<array<string>>); sessions without features get the unknown tier
    and no topics.
    """
    heads = transcript_head(utterances, text, max_chars)
    if features is None:
        spark = utterances.sparkSession
        features = spark.createDataFrame(
            [], "session_id " + dict(utterances.dtypes)["session_id"]
            + ", tier_label string, topics array<array<string>>")
    f = features.select("session_id", "tier_label", "topics")
    topics = F.array_join(
        F.transform(F.slice(F.coalesce(F.col("topics"), F.array().cast("array<array<string>>")),
                            1, n_topics),
                    lambda t: F.array_join(t, ", ")), "; ")
    return (heads.join(f, "session_id", "left")
            .select("session_id",
                    F.concat(F.lit(D.PROMPT_PREFIX),
                             F.lit("[emotional_intensity: "),
                             F.coalesce(F.col("tier_label"), F.lit(D.PROMPT_UNKNOWN_TIER)),
                             F.lit("] [main_topics: "), topics,
                             F.lit("] [transcript: "), F.col("transcript_head"), F.lit("]"))
                    .alias("prompt")))


def quick_subset(df: DataFrame, k: int = D.QUICK_SESSIONS, order: str = "turn") -> DataFrame:
    """Rows of the first ``k`` sessions in order of first appearance.

    Appearance order is the smallest ``order`` value of the session, ties
    broken by the session key. The ``limit`` is the feature; the subset is
    applied with a semi join.
    """
    first = (df.groupBy("session_id").agg(F.min(order).alias("_first"))
             .orderBy("_first", "session_id").limit(k).select("session_id"))
    return df.join(F.broadcast(first), "session_id", "left_semi")


def sample_rows(df: DataFrame, n: int, seed: int = D.SAMPLE_SEED, key: list[str] | None = None) -> DataFrame:
    """Deterministic sample of ``n`` rows: the ``n`` smallest seeded MD5 hashes of ``key``
    (a hash that other engines have too)."""
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key or df.columns]
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), *cols))).limit(n)


def _compare(order: list[str], cut) -> tuple[F.Column, F.Column]:
    """Conditions "before the row ``cut``" and "equal to it" in ``order`` (nulls first)."""
    before, same = F.lit(False), F.lit(True)
    for c in order:
        at = F.lit(cut[c])
        before = before | (same & ((F.col(c) < at) | (F.col(c).isNull() & at.isNotNull())))
        same = same & F.col(c).eqNullSafe(at)
    return before, same


def _cut_at(keys: DataFrame, order: list[str], position=None, fraction: float = 1.0):
    """``(cut, left)``: the key at ``position`` (from 0; default ``int(fraction * rows)``) of ``keys``
    in ``order``, and how many rows that repeat it lie before the position; ``(None, 0)`` beyond
    the end.

    The keys are range partitioned and checkpointed (stable partition ids); the partition
    counts (one row per partition) name the one that holds the position, and its keys are
    counted before they are sorted, so that a key that many rows repeat is one row.
    """
    n_parts = max(1, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counted = keys.groupBy(*order).agg(F.count(F.lit(1)).alias("_n"))
    counted = counted.repartitionByRange(n_parts, *order).withColumn("_pid", F.spark_partition_id()).checkpoint()
    sizes = sorted((r["_pid"], r["n"]) for r in counted.groupBy("_pid").agg(F.sum("_n").alias("n")).collect())
    left = int(fraction * sum(n for _, n in sizes) + 1e-9) if position is None else position
    for pid, n in sizes:
        if left < n:
            break
        left -= n
    else:
        return None, 0
    # running count inside that one partition: the last key that begins at or before the position
    upto = F.sum("_n").over(Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    part = counted.filter(F.col("_pid") == pid).withColumn("_begin", upto - F.col("_n"))
    cut = part.filter(F.col("_begin") <= left).orderBy(F.desc("_begin")).limit(1).collect()[0]
    return cut, left - cut["_begin"]


def positional_split(df: DataFrame, order: list[str], fraction: float, out: str = "split") -> DataFrame:
    """First ``int(fraction * n)`` rows in ``order`` are ``train``, the rest ``validation``: exactly
    that many, also where rows repeat the cut key.

    Only the order columns move: they are counted per key and range partitioned to find the
    key at the cut (``_cut_at``), and the rows are split by comparing keys. If some rows with
    the cut key belong to ``train``, those rows alone are ranked by a SHA-256 of the row (only
    the digests move). Rows that are equal in all columns are interchangeable: the ones at the
    cut become one row, which is written out as often as it occurs.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    train, rest = F.lit("train"), F.lit("validation")
    cut, left = _cut_at(df.select(*order), order, fraction=fraction)
    if cut is None:
        return df.withColumn(out, train)
    before, same = _compare(order, cut)
    if left == 0:
        return df.withColumn(out, F.when(before, train).otherwise(rest))
    digest = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])), 256)
    tied = df.filter(same).select(digest.alias("_digest"))
    row, copies = _cut_at(tied, ["_digest"], position=left)
    before = before | (same & (digest < row["_digest"]))
    if copies == 0:
        return df.withColumn(out, F.when(before, train).otherwise(rest))
    at_cut = same & (digest == row["_digest"])
    one = F.broadcast(df.filter(at_cut).limit(1).withColumn("_zero", F.lit(0).cast("long")))
    n_parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    numbers = spark.range(0, row["_n"], 1, n_parts).select(F.col("id").alias("_i"), (F.col("id") * 0).alias("_at"))
    equal = numbers.join(one, F.col("_at") == F.col("_zero")).withColumn(
        out, F.when(F.col("_i") < copies, train).otherwise(rest))
    return (df.filter(~at_cut).withColumn(out, F.when(before, train).otherwise(rest))
            .unionByName(equal.select(*[F.col(f"`{c}`") for c in df.columns], out)))


def hash_split(df: DataFrame, key: str, fraction: float, seed: int = D.SAMPLE_SEED, out: str = "split") -> DataFrame:
    """Split by key hash (the first 32 bits of a seeded MD5, which other engines have
    too): all rows of a key land on the same side."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    bucket = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 10_000
    return df.withColumn(out, F.when(bucket < int(round(fraction * 10_000)), F.lit("train"))
                         .otherwise(F.lit("validation")))


def session_sentences(utterances: DataFrame, text: str = "clean_text", abbreviations=None) -> DataFrame:
    """Sentences of the session text (turns joined by one blank, split after
    ``.``/``!``/``?`` + blanks, trimmed, blanks dropped) without assembling the
    session text: ``(session_id, sent_pos, sentence)``.

    Each turn is split on its own. A turn's first fragment continues the
    previous turn's last sentence unless that turn ended with ``.``/``!``/``?``
    (clean text has no leading or trailing blanks, so the joining blank is
    then part of a break). Sentence ids are a running count of sentence starts
    (two-level, per session) and a sentence is its fragments joined by a
    blank in (turn, fragment) order.
    """
    # neighbours are found by dense positions, so gaps and repeats in ``turn`` do no harm
    d = numbered(utterances.select("session_id", "turn", *[c for c in ("speaker",) if c in utterances.columns],
                                   F.coalesce(F.col(text), F.lit("")).alias("clean_text")))
    d = shared(d.select("session_id", F.col("_pos").alias("turn"), F.col("clean_text").alias("_t")))
    d = d.select("session_id", "turn", F.split(F.col("_t"), T.sentence_break(abbreviations)).alias("_frags"),
                 T.ends_sentence("_t", abbreviations).alias("_ends"))
    # does the previous turn end a sentence? (turn - 1 sends its flag forward)
    prev = d.select("session_id", (F.col("turn") + 1).alias("turn"), F.col("_ends").alias("_prev_ends"))
    d = d.join(prev, ["session_id", "turn"], "left")
    first_starts = F.coalesce(F.col("_prev_ends"), F.lit(True)).cast("int")
    d = d.withColumn("_fs", first_starts).withColumn("_nstart", F.col("_fs") + F.size("_frags") - 1)
    d = prefix_sum(d, ["session_id"], "turn", "_nstart", "_off", inclusive=False)
    frags = d.select("session_id", "turn", "_off", "_fs", F.posexplode("_frags").alias("_k", "_frag"))
    frags = frags.withColumn("_sid", (F.col("_off") + F.col("_k") + F.col("_fs") - 1).cast("long"))
    sents = (frags.groupBy("session_id", "_sid")
             .agg(F.trim(F.expr("listagg(_frag, ' ') WITHIN GROUP (ORDER BY turn, _k)")).alias("sentence")))
    # For clean text only a session's last sentence can be blank (a run of
    # empty turns after a sentence end, up to the end of the session): every
    # later non-empty turn would continue it. So dropping blanks leaves the
    # ids of all kept sentences contiguous from 0.
    return (sents.filter(F.col("sentence") != "")
            .select("session_id", F.col("_sid").cast("int").alias("sent_pos"), "sentence"))
