"""Evaluation: n-gram / subsequence overlap, greedy embedding match,
per-class precision/recall/F1, leaderboard and training-log roll-up."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from .. import defaults as D
from ..functions import arrays as A
from ..functions import text as T
from ..functions.stem import stem_table
from ..session import ensure_checkpoint_dir, ship_package
from .sequence import fixed_table, shared


# ------------------------------------------------------------------ ROUGE-N

def _f1(p, r):
    return F.when(p + r > 0, F.lit(2.0) * p * r / (p + r)).otherwise(F.lit(0.0))


def _ngrams(toks, n: int):
    idx = F.sequence(F.lit(0), F.size(toks) - F.lit(n))
    grams = F.transform(idx, lambda i: F.array_join(F.slice(toks, i + 1, n), " "))
    return F.when(F.size(toks) >= n, grams).otherwise(F.array().cast("array<string>"))


def rouge_n(pairs: DataFrame, n: int, keys: list[str] | None = None, candidate: str = "candidate",
            reference: str = "reference", token_table: DataFrame | None = None) -> DataFrame:
    """Per pair: precision, recall and F1 of clipped n-gram overlap.

    Tokens: lower case, runs outside ``[a-z0-9]`` separate. ``token_table``
    (``token, stem``) optionally maps tokens longer than 3 characters to
    stems. The n-grams of both sides are exploded with a side tag; one aggregate
    on ``(pair, n-gram)`` counts them per side and one on the pair sums up, so
    nothing is joined and no pair is collected anywhere.
    """
    keys = keys or ["session_id"]
    if token_table is None:
        tagged = pairs.select(*keys, F.explode(F.array(
            F.struct(F.lit(1).alias("c"), T.overlap_tokens(candidate).alias("toks")),
            F.struct(F.lit(0).alias("c"), T.overlap_tokens(reference).alias("toks")))).alias("s"))
        grams = tagged.select(*keys, F.col("s.c").alias("c"), F.explode_outer(_ngrams(F.col("s.toks"), n)).alias("gram"))
    else:
        grams = _stemmed_ngrams(pairs, keys, candidate, n, token_table, 1).unionByName(
            _stemmed_ngrams(pairs, keys, reference, n, token_table, 0))
        grams = grams.unionByName(pairs.select(*keys, F.lit(0).alias("c"), F.lit(None).cast("string").alias("gram")))
    real = F.col("gram").isNotNull()
    counts = grams.groupBy(*keys, "gram").agg(
        F.sum(F.when(real, F.col("c")).otherwise(0)).alias("_nc"), F.sum(F.when(real, 1 - F.col("c")).otherwise(0)).alias("_nr"))
    sums = counts.groupBy(*keys).agg(F.sum(F.least("_nc", "_nr")).cast("double").alias("_ov"),
                                     F.sum("_nc").alias("_tc"), F.sum("_nr").alias("_tr"))
    p = F.col("_ov") / F.greatest(F.col("_tc"), F.lit(1))
    r = F.col("_ov") / F.greatest(F.col("_tr"), F.lit(1))
    return sums.select(*keys, p.alias("precision"), r.alias("recall"), _f1(p, r).alias("f1"))


def pair_stems(pairs: DataFrame, candidate: str = "candidate", reference: str = "reference") -> DataFrame:
    """``token, stem`` of the distinct tokens of both sides, as ``rouge_n(token_table=...)`` takes it."""
    tokens = pairs.select(F.explode(T.overlap_tokens(candidate)).alias("token")).unionByName(
        pairs.select(F.explode(T.overlap_tokens(reference)).alias("token")))
    return stem_table(tokens)


def _stemmed_ngrams(pairs: DataFrame, keys: list[str], col: str, n: int, token_table: DataFrame, side: int) -> DataFrame:
    """n-grams over stemmed tokens: tokens exploded with their position, stems
    joined on the token, n-grams assembled by equi-joins on ``(pair, pos + k)``."""
    toks = pairs.select(*keys, F.posexplode(T.overlap_tokens(col)).alias("_pos", "token"))
    stems = token_table.select("token", "stem")
    toks = (toks.join(stems, "token", "left")
            .select(*keys, "_pos", F.when((F.length("token") > 3) & F.col("stem").isNotNull(), F.col("stem"))
                    .otherwise(F.col("token")).alias("_g0")))
    grams = toks
    for k in range(1, n):
        nxt = toks.select(*keys, (F.col("_pos") - k).alias("_pos"), F.col("_g0").alias(f"_g{k}"))
        grams = grams.join(nxt, [*keys, "_pos"])
    return grams.select(*keys, F.lit(side).alias("c"), F.concat_ws(" ", *[F.col(f"_g{k}") for k in range(n)]).alias("gram"))


# ------------------------------------------------------------------ ROUGE-L

def lcs_length(a, b) -> int:
    """Length of the longest common subsequence of two token sequences
    (bit-parallel: one big-integer step per token of ``a``)."""
    if a is None or b is None or len(a) == 0 or len(b) == 0:
        return 0
    masks: dict = {}
    for j, t in enumerate(b):
        masks[t] = masks.get(t, 0) | (1 << j)
    full = (1 << len(b)) - 1
    v = full
    for t in a:
        m = masks.get(t)
        if m is None:
            continue
        u = v & m
        v = ((v + u) | (v - u)) & full
    return len(b) - bin(v).count("1")


@F.pandas_udf(Ty.LongType())
def _lcs_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_length(x, y) for x, y in zip(a, b)], dtype="int64")


def lcs_tile(a, b, above: bytes | None, left: bytes | None) -> tuple[bytes, bytes, int]:
    """One tile of the bit-parallel LCS: tokens ``a`` (rows) against the block ``b`` (columns).

    ``above`` is the block's bit vector after the earlier rows, ``left`` the carry
    that each row brings from the block before. Returns both for the
    neighbouring tiles, and the block's matches so far.
    """
    n = len(b)
    masks: dict = {}
    for j, t in enumerate(b):
        masks[t] = masks.get(t, 0) | (1 << j)
    full = (1 << n) - 1
    v = full if above is None else int.from_bytes(above, "little")
    incoming = np.zeros(len(a), np.uint8) if left is None else np.unpackbits(np.frombuffer(left, np.uint8), count=len(a))
    carries = np.zeros(len(a), np.uint8)
    for k, (t, carry) in enumerate(zip(a, incoming.tolist())):
        m = masks.get(t, 0)
        if m or carry:
            u = v & m
            total = v + u + carry
            carries[k] = total >> n
            v = (total & full) | (v - u)
    return v.to_bytes(-(-n // 8), "little"), np.packbits(carries).tobytes(), n - v.bit_count()


@F.pandas_udf(Ty.StructType([Ty.StructField("above", Ty.BinaryType()), Ty.StructField("left", Ty.BinaryType()),
                             Ty.StructField("matched", Ty.LongType())]))
def _tile_udf(a: pd.Series, b: pd.Series, above: pd.Series, left: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([lcs_tile(*x) for x in zip(a, b, above, left)], columns=["above", "left", "matched"])


def tiled_lcs(tokens: DataFrame, keys: list[str], candidate: str, reference: str, tile: int) -> DataFrame:
    """``keys, _lcs`` of the pairs that have tokens on both sides, tile by tile.

    Both sides are cut into blocks of ``tile`` tokens. The tiles of one diagonal don't depend
    on each other: each is a row keyed by the pair and its place, so the tiles of a long
    pair spread over tasks, and no row holds more than two blocks, a bit vector and the
    carries. A step per diagonal; its bit vectors and carries are checkpointed and joined
    to the tiles below and to the right.
    """
    ensure_checkpoint_dir(tokens.sparkSession)

    def blocks(col: str, at: str, out: str) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.ceil(F.size(col) / tile).cast("int") - 1),
                          lambda k: F.struct(k.alias(at), F.slice(F.col(col), k * tile + 1, tile).alias(out)))
        return F.explode(cut).alias("x")

    both = tokens.where((F.size(candidate) > 0) & (F.size(reference) > 0))
    last = (F.ceil(F.size(candidate) / tile).cast("int") - 1).alias("_last")
    rows = both.select(*keys, last, blocks(candidate, "_i", "_a")).select(*keys, "_last", "x.*").checkpoint()
    columns = both.select(*keys, blocks(reference, "_j", "_b")).select(*keys, "x.*").checkpoint()
    steps = (rows.agg(F.max("_i")).first()[0] or 0) + (columns.agg(F.max("_j")).first()[0] or 0) + 1
    place, before, done = [*keys, "_i", "_j"], None, []
    for d in range(steps):
        tiles = rows.withColumn("_j", F.lit(d) - F.col("_i")).join(columns, [*keys, "_j"])
        if before is None:
            tiles = tiles.withColumns({"above": F.lit(None).cast("binary"), "left": F.lit(None).cast("binary")})
        else:
            tiles = (tiles.join(before.select(*keys, (F.col("_i") + 1).alias("_i"), "_j", "above"), place, "left")
                     .join(before.select(*keys, "_i", (F.col("_j") + 1).alias("_j"), "left"), place, "left"))
        before = (tiles.select(*place, "_last", _tile_udf("_a", "_b", "above", "left").alias("x"))
                  .select(*place, "_last", "x.*").checkpoint())
        done.append(before.where(F.col("_i") == F.col("_last")).select(*keys, "matched"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.groupBy(*keys).agg(F.sum("matched").alias("_lcs"))


def rouge_l(pairs: DataFrame, keys: list[str] | None = None, candidate: str = "candidate",
            reference: str = "reference", tile: int | None = None) -> DataFrame:
    """Per pair: precision, recall and F1 of the longest common subsequence.

    Tokenisation is native; the subsequence length runs in Python, by default as
    an Arrow-batched pandas UDF over the two token arrays of each row, so that a pair is
    one task's work. With ``tile`` a pair of any length is worked off in tiles of so many tokens
    a side (``tiled_lcs``); keys must then be unique. Both give the same numbers.
    """
    ship_package(pairs.sparkSession)
    keys = keys or ["session_id"]
    d = pairs.select(*keys, T.overlap_tokens(candidate).alias("_c"), T.overlap_tokens(reference).alias("_r"))
    if tile is None:
        d = d.withColumn("_lcs", _lcs_udf("_c", "_r").cast("double"))
    else:
        d = d.join(tiled_lcs(d, keys, "_c", "_r", tile), keys, "left").withColumn(
            "_lcs", F.coalesce("_lcs", F.lit(0)).cast("double"))
    p = F.when(F.size("_c") > 0, F.col("_lcs") / F.size("_c")).otherwise(F.lit(0.0))
    r = F.when(F.size("_r") > 0, F.col("_lcs") / F.size("_r")).otherwise(F.lit(0.0))
    return d.select(*keys, p.alias("precision"), r.alias("recall"), _f1(p, r).alias("f1"))


# ------------------------------------------------------------------ embedding match

def _unit(vectors) -> np.ndarray:
    """The vectors at length 1 (a zero vector stays one), as the rows of a matrix."""
    m = np.stack(vectors).astype(float)
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    with np.errstate(invalid="ignore"):
        return np.where(norm == 0, 0.0, m / np.where(norm == 0, 1.0, norm))


def _best(x, y) -> tuple[np.ndarray, np.ndarray]:
    """Largest cosine of each vector of a block with those of the other block, for both; None for null vectors."""
    known = [np.array([v is not None for v in s]) for s in (x, y)]
    if known[0].all() and known[1].all():
        product = _unit(x) @ _unit(y).T
        return product.max(axis=1), product.max(axis=0)
    found = [np.full(len(s), None, object) for s in (x, y)]
    if known[0].any() and known[1].any():
        product = _unit([v for v in x if v is not None]) @ _unit([v for v in y if v is not None]).T
        found[0][known[0]], found[1][known[1]] = product.max(axis=1), product.max(axis=0)
    return found[0], found[1]


@F.pandas_udf(Ty.StructType([Ty.StructField("c", Ty.ArrayType(Ty.DoubleType())), Ty.StructField("r", Ty.ArrayType(Ty.DoubleType()))]))
def _best_udf(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_best(x, y) for x, y in zip(a, b)], columns=["c", "r"])


#: Blocks of a pair's references that meet its candidates in one task at most.
BLOCKS_AT_ONCE = 16


def embedding_match(candidate_tokens: DataFrame, reference_tokens: DataFrame, key: str = "pair_id",
                    token: str = "token_id", vector: str = "vector", block: int = 256, salt: int = 1,
                    vectors: DataFrame | None = None) -> DataFrame:
    """Greedy cosine matching of token vectors (as in BERTScore).

    P = mean over candidate tokens of the best cosine with a reference token
    of the same pair; R the reverse; F1 harmonic. The tokens of either side are
    dealt by hash into blocks of about ``block`` vectors; every
    block of a pair meets every block of its other side once, as one small matrix product
    (Arrow-batched numpy) whose rows' and columns' best values are reduced with ``max``, so a
    long pair is never held in one row. Vectors are carried as they are given and normalised block by block.
    They are shuffled once: by the pair and by ``BLOCKS_AT_ONCE`` of its reference blocks, which serves the collection of the
    blocks and their join; a pair of more blocks sends its candidates to each such group.
    ``salt > 1`` spreads each pair's candidate blocks over ``salt`` join keys (the other side's
    tokens are repeated per salt) for pairs known to be hot.

    A column ``weight`` of the tokens, if they have one, is how often a token occurs: its best
    match then is found once and counts so many times. A null vector matches nothing (without weights its token is
    left out of the mean); one with null entries counts as zero.

    With ``vectors`` (``place``, unique, and ``vector``) the tokens have a ``place`` instead of their vector, which is
    joined when they are dealt already.
    """
    given = vectors is None
    held = "_v" if given else "_place"

    def usable(df: DataFrame) -> Column:
        kind = df.schema[vector].dataType.elementType
        # one with a null entry has no length
        return F.when(F.exists(vector, F.isnull), F.transform(vector, lambda x: F.lit(0).cast(kind))).otherwise(F.col(vector)).alias("_v")

    def side(df: DataFrame) -> DataFrame:
        weight = F.col("weight") if "weight" in df.columns else F.lit(1)
        return df.select(key, token, usable(df) if given else F.col("place").alias("_place"), weight.cast("double").alias("_wt"))

    c, r = side(candidate_tokens), side(reference_tokens)
    if not given:  # counted, then dealt
        c, r = shared(c), shared(r)
    weighted = "weight" in candidate_tokens.columns or "weight" in reference_tokens.columns

    ship_package(candidate_tokens.sparkSession)

    def count(df: DataFrame, out: str) -> DataFrame:
        return df.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).alias(out))

    def dealt(df: DataFrame, n: str) -> DataFrame:
        # by token and vector, so that equal rows, which count once, come into one block
        return df.join(counts, key).withColumn("_blk", F.pmod(F.xxhash64(token, held), F.col(n)))

    counts = count(c, "_nc").join(count(r, "_nr"), key)
    groups = F.floor((F.col("_nr") - 1) / BLOCKS_AT_ONCE)
    c = dealt(c, "_nc").withColumn("_grp", F.explode(F.sequence(F.lit(0).cast("long"), groups)))
    r = dealt(r, "_nr").withColumn("_grp", F.floor(F.col("_blk") / BLOCKS_AT_ONCE))
    keys = [key, "_grp"]
    if salt > 1:
        r = r.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
        c = c.withColumn("_salt", F.pmod(F.col("_blk"), F.lit(salt)).cast("int"))
        keys = [*keys, "_salt"]

    def blocks(df: DataFrame, name: str) -> DataFrame:
        if not given:
            df = df.join(vectors.select(F.col("place").alias("_place"), usable(vectors)), "_place")
        # an exchange on the join's keys also serves the collection by block
        return (df.select(*keys, "_blk", F.struct(token, "_wt", "_v").alias("_t")).repartition(*keys)
                .groupBy(*keys, "_blk").agg(F.collect_set("_t").alias(name)).drop("_blk"))

    met = blocks(c, "_c").join(blocks(r, "_r"), keys).select(key, "_c", "_r", _best_udf("_c._v", "_r._v").alias("_m"))

    def told(ts: str, best: str) -> Column:
        return F.arrays_zip(F.col(f"{ts}.{token}").alias("t"), F.col(f"{ts}._wt").alias("w"), F.col(best).alias("m"))

    sides = F.array(F.struct(F.lit(True).alias("c"), told("_c", "_m.c").alias("ts")), F.struct(F.lit(False).alias("c"), told("_r", "_m.r").alias("ts")))
    best = (met.select(key, F.explode(sides).alias("s")).select(key, F.col("s.c").alias("_is_c"), F.explode("s.ts").alias("x"))
            .groupBy(key, "_is_c", F.col("x.t").alias(token), F.col("x.w").alias("_wt")).agg(F.max("x.m").alias("_best")))

    def score(own: Column) -> Column:
        counted = own if weighted else own & F.col("_best").isNotNull()
        return F.try_divide(F.sum(F.when(own, F.col("_best") * F.col("_wt"))), F.sum(F.when(counted, F.col("_wt"))))

    return (best.groupBy(key).agg(score(F.col("_is_c")).alias("precision"), score(~F.col("_is_c")).alias("recall"))
            .select(key, "precision", "recall", _f1(F.col("precision"), F.col("recall")).alias("f1")))


# ------------------------------------------------------------------ model comparison

def evaluate_models(references: DataFrame, predictions: DataFrame, metrics=("ROUGE-1", "ROUGE-2", "ROUGE-L"),
                    key: str = "session_id", token_vectors: tuple[DataFrame, ...] | None = None) -> DataFrame:
    """Long result ``(model, metric, value, n_pairs)``: mean F1 x 100 rounded
    to one decimal, over the ids common to references and predictions.

    ``references``: ``key, reference``; ``predictions``: ``model, key, prediction``.
    ``token_vectors`` (``model, key, token_id, vector`` of the predictions' tokens and
    ``key, token_id, vector`` of the references', both with ``weight`` if tokens are distinct)
    adds the metric ``BERTScore F1``:
    the mean greedy embedding match, rounded to three decimals. A third table ``place, vector`` holds the
    vectors apart: the tokens then have a ``place`` (see ``embedding_match``).
    """
    pairs = (predictions.select("model", key, F.col("prediction").alias("candidate"))
             .join(references.select(key, "reference"), key))
    # in as many tasks as a shuffle has: predictions may come in one partition, and a broadcast join leaves them there
    n_parts = max(1, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pairs = shared(pairs.repartition(n_parts, "model", key))
    keys = ["model", key]
    parts = []
    for m in metrics:
        if m == "ROUGE-L":
            s = rouge_l(pairs, keys)
        else:
            s = rouge_n(pairs, int(m.split("-")[1]), keys)
        parts.append(s.groupBy("model").agg(F.round(F.avg("f1") * 100, 1).alias("value"),
                                            F.count(F.lit(1)).alias("n_pairs"))
                     .withColumn("metric", F.lit(m)))
    if token_vectors is not None:
        tokens, vectors = token_vectors[:2], token_vectors[2:]
        parts.append(embedding_scores(*tokens, key=key, vectors=vectors[0] if vectors else None))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("model", "metric", "value", "n_pairs")


def embedding_scores(candidate_tokens: DataFrame, reference_tokens: DataFrame, key: str = "pair_id",
                     vectors: DataFrame | None = None) -> DataFrame:
    """``(model, metric, value, n_pairs)``: mean embedding-match F1 of each model, 3 decimals."""
    pair = F.struct("model", key).alias("pair_id")
    models = candidate_tokens.select("model", key).distinct()
    weight = ["weight"] if "weight" in candidate_tokens.columns and "weight" in reference_tokens.columns else []
    held = "vector" if vectors is None else "place"
    c = candidate_tokens.select(pair, "token_id", held, *weight)
    r = reference_tokens.join(models, key).select(pair, "token_id", held, *weight)
    return (embedding_match(c, r, vectors=vectors).groupBy(F.col("pair_id.model").alias("model"))
            .agg(F.round(F.avg("f1"), 3).alias("value"), F.count(F.lit(1)).alias("n_pairs"))
            .select("model", F.lit("BERTScore F1").alias("metric"), "value", "n_pairs"))


# ------------------------------------------------------------------ classification metrics

def classification_metrics(df: DataFrame, y_true: str, y_pred: str, labels=(1, 2, 3, 4, 5)) -> DataFrame:
    """Per label: precision, recall, F1 and support; zero denominators give 0.

    One global aggregate of conditional sums (map-side partial), unpivoted
    over the fixed label list.
    """
    aggs = []
    for i, lab in enumerate(labels):
        t = F.col(y_true) == F.lit(lab)
        p = F.col(y_pred) == F.lit(lab)
        aggs += [F.sum(F.when(t & p, 1).otherwise(0)).alias(f"tp{i}"),
                 F.sum(F.when(p, 1).otherwise(0)).alias(f"pp{i}"),
                 F.sum(F.when(t, 1).otherwise(0)).alias(f"tt{i}")]
    wide = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(lab).alias("label"), F.col(f"tp{i}").alias("tp"),
                              F.col(f"pp{i}").alias("pp"), F.col(f"tt{i}").alias("tt"))
                     for i, lab in enumerate(labels)])
    long = wide.select(F.explode(rows).alias("x")).select("x.*")
    tp = F.coalesce(F.col("tp"), F.lit(0)).cast("double")
    prec = F.coalesce(F.try_divide(tp, F.col("pp").cast("double")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(tp, F.col("tt").cast("double")), F.lit(0.0))
    return long.select("label", prec.alias("precision"), rec.alias("recall"), _f1(prec, rec).alias("f1"),
                       F.coalesce(F.col("tt"), F.lit(0)).cast("long").alias("support"))


def evaluate_tiers(features: DataFrame, utterances: DataFrame, lexicon=None, text: str = "clean_text") -> DataFrame:
    """Tier metrics: truth = lexicon tier of the session text in turn order,
    prediction = the features' ``emotion_tier``; sessions without features
    are skipped (inner join)."""
    from .tiers import lexicon_window_tiers

    truth = lexicon_window_tiers(utterances, lexicon, text, order="turn").withColumnRenamed(
        "emotion_tier", "true_tier")
    pairs = truth.join(features.select("session_id", F.col("emotion_tier").alias("pred_tier")), "session_id")
    return classification_metrics(pairs, "true_tier", "pred_tier").withColumnRenamed("label", "tier")


# ------------------------------------------------------------------ leaderboard

def published_scores(spark) -> DataFrame:
    """The published model-quality numbers as ``(model, metric, value)``."""
    rows = []
    for model, vals in D.PUBLISHED_ROUGE.items():
        for metric, v in zip(["ROUGE-1", "ROUGE-2", "ROUGE-L"], vals):
            rows.append((model, metric, float(v)))
    for model, v in D.PUBLISHED_BERTSCORE.items():
        rows.append((model, "BERTScore F1", float(v)))
    return fixed_table(spark, rows, "model string, metric string, value double")


def leaderboard(published: DataFrame, live: DataFrame, targets: dict | None = None) -> DataFrame:
    """Per published model and metric: the live value when there is one, else the
    published one; ``position`` sorts models ascending by score within a
    metric; ``meets_target`` compares with the metric's target, if any."""
    tg = targets or D.TARGETS
    lv = live.select("model", "metric", F.col("value").alias("_live"))
    j = published.join(lv, ["model", "metric"], "left")
    value = F.coalesce(F.col("_live"), F.col("value"))
    target = F.lit(None).cast("double")
    for m, t in tg.items():
        target = F.when(F.col("metric") == m, F.lit(float(t))).otherwise(target)
    out = j.select("model", "metric", value.alias("value"),
                   F.when(F.col("_live").isNotNull(), F.lit("live")).otherwise(F.lit("published")).alias("source"),
                   target.alias("target"))
    w = Window.partitionBy("metric").orderBy(F.asc("value"), F.asc("model"))
    return (out.withColumn("position", F.row_number().over(w))
            .withColumn("meets_target", F.when(F.col("target").isNull(), F.lit(None).cast("boolean"))
                        .otherwise(F.col("value") >= F.col("target"))))


def published_tier_scores(spark) -> DataFrame:
    """Published per-tier precision / recall / F1 as ``(tier, precision, recall, f1)``."""
    rows = [(i + 1, float(p), float(r), float(f)) for i, (p, r, f) in
            enumerate(zip(D.PUBLISHED_TIER_PRECISION, D.PUBLISHED_TIER_RECALL, D.PUBLISHED_TIER_F1))]
    return fixed_table(spark, rows, "tier int, precision double, recall double, f1 double")


def tier_leaderboard(published: DataFrame, live: DataFrame | None, target: float = D.TARGETS["tier F1"]) -> DataFrame:
    """Per tier: the live precision/recall/F1 set when one is given (it
    replaces the published set as a whole), else the published one; plus the
    support-weighted F1 of the live set and whether it reaches ``target``."""
    if live is None:
        out = published.select("tier", "precision", "recall", "f1", F.lit("published").alias("source"),
                               F.lit(None).cast("long").alias("support"))
    else:
        out = live.select("tier", "precision", "recall", "f1", F.lit("live").alias("source"), "support")
    weighted = out.agg((F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("w"))
    w = weighted.select("w").scalar()
    return out.select("tier", "precision", "recall", "f1", "source", w.alias("weighted_f1"),
                      F.when(w.isNull(), F.lit(None).cast("boolean")).otherwise(w >= F.lit(target))
                      .alias("meets_target"))


# ------------------------------------------------------------------ training log

def rollup_training_log(log: DataFrame) -> DataFrame:
    """Per epoch rounded half-to-even: mean ``loss`` and the last ``eval_loss``
    (highest ``seq``); only epochs having both, ascending."""
    ep = F.bround(F.col("epoch"), 0).cast("long")
    seen = F.col("eval_loss").isNotNull()
    return (log.filter(F.col("epoch").isNotNull()).groupBy(ep.alias("epoch"))
            .agg(F.avg("loss").alias("train_loss"),
                 F.max_by(F.when(seen, F.col("eval_loss")), F.when(seen, F.col("seq"))).alias("eval_loss"))
            .filter(F.col("train_loss").isNotNull() & F.col("eval_loss").isNotNull()).orderBy("epoch"))
