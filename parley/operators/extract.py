"""Extractive summaries: sentence graph and TextRank, plus the summary hook.

Graph weights between sentences i and j of a session are
``shared(i, j) / (ln L_i + ln L_j)`` where ``shared`` counts equal word
pairs (sum over words of ``c_i(w) * c_j(w)``, self pairs included) and ``L``
is the number of words; when both sentences have one word the weight is the
count itself. The weight depends on ``j`` only through its words and its
length ``L_j``, so every product ``W x`` is computed without forming pairs:

    (W x)_i = sum_w c_i(w) * sum_b f(L_i, b) * A_x(w, b),
    A_x(w, b) = sum over sentences j with L_j = b of c_j(w) * x_j

``A_x`` is an aggregate keyed by ``(session, word, length)`` and the outer
sum a join on ``(session, word)`` — at most one row per distinct sentence
length per word occurrence, never one per sentence pair.

TextRank is the power method on ``(1-d)/n + d * W / (rowsum + 1e-7)`` from the
uniform vector until the change is at most ``epsilon``, per session. Sessions
up to a checked size (sentences and words) run it with numpy inside
``applyInArrow`` (the group size is checked first); larger sessions run the
same iteration as Spark joins and aggregates, checkpointing every step.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import defaults as D
from ..session import ensure_checkpoint_dir, ship_package
from ..functions import text as T
from .sequence import listagg_ordered, shared, top_k

ZERO_DIVISION_PREVENTION = 1e-7


def sentence_table(texts: DataFrame, text: str = "text", key: str = "session_id",
                   abbreviations=None) -> DataFrame:
    """``(key, sent_pos, sentence, n_words)`` from a text per key."""
    s = texts.select(key, F.posexplode(T.split_sentences(text, abbreviations)).alias("sent_pos", "sentence"))
    return s.withColumn("n_words", F.size(T.graph_words("sentence")).cast("long"))


def sentence_words(sentences: DataFrame, key: str = "session_id") -> DataFrame:
    """``(key, sent_pos, word, c, n_words)``: word counts per sentence."""
    w = sentences.select(key, "sent_pos", "n_words", F.explode(T.graph_words("sentence")).alias("word"))
    return w.groupBy(key, "sent_pos", "word", "n_words").agg(F.count(F.lit(1)).alias("c"))


def _pair_factor(l_i, l_j) -> F.Column:
    both_one = (l_i == 1) & (l_j == 1)
    return F.when(both_one, F.lit(1.0)).otherwise(F.lit(1.0) / (F.log(l_i.cast("double")) + F.log(l_j.cast("double"))))


def graph_product(sw: DataFrame, x: DataFrame, key: str = "session_id", xcol: str = "x") -> DataFrame:
    """``(key, sent_pos, y)`` with ``y = W x`` for a per-sentence value ``x``."""
    agg = (sw.join(x.select(key, "sent_pos", xcol), [key, "sent_pos"])
           .groupBy(key, "word", F.col("n_words").alias("b"))
           .agg(F.sum(F.col("c") * F.col(xcol)).alias("_a")))
    return (sw.join(agg, [key, "word"])
            .groupBy(key, "sent_pos")
            .agg(F.sum(F.col("c") * _pair_factor(F.col("n_words"), F.col("b")) * F.col("_a")).alias("y")))


def sentence_graph(sentences: DataFrame, key: str = "session_id") -> DataFrame:
    """Weighted degree of every sentence: ``(key, sent_pos, n_words, degree)``
    with ``degree = sum_j w_ij`` (self edge included)."""
    sw = shared(sentence_words(sentences, key))
    ones = sentences.select(key, "sent_pos", F.lit(1.0).alias("x"))
    deg = graph_product(sw, ones, key)
    return (sentences.select(key, "sent_pos", "n_words").join(deg, [key, "sent_pos"], "left")
            .select(key, "sent_pos", "n_words", F.coalesce(F.col("y"), F.lit(0.0)).alias("degree")))


# ------------------------------------------------------------------ local path

#: A word in sentences of more lengths than this is a row of a dense matrix, others are lists of pairs of lengths.
COMMON_WORD = 16


def _graph_product(lens: np.ndarray, ids: np.ndarray):
    """The function ``x -> W x`` of one session, factored as in the module's doc.

    ``A_x`` is held for the words and lengths that occur together. Words of few lengths combine them by pairs (at most ``COMMON_WORD``
    for each of their places), others as rows of a matrix with a column per length, of which
    ``w`` words in all allow ``sqrt(2 w)``: no n x n matrix, and memory follows the words."""
    n = len(lens)
    lengths, length = np.unique(lens, return_inverse=True)
    entry, count = np.unique(ids.astype(np.int64) * n + np.repeat(np.arange(n), lens), return_counts=True)
    sentence, count = entry % n, count.astype(float)
    slots, slot = np.unique(entry // n * len(lengths) + length[sentence], return_inverse=True)
    column = slots % len(lengths)
    begin = np.flatnonzero(np.diff(slots // len(lengths), prepend=-1))
    held = np.diff(begin, append=len(slots))
    logs = np.log(np.maximum(lengths, 1))
    norm = logs[:, None] + logs[None, :]
    factor = np.where(norm == 0, 1.0, 1.0 / np.where(norm == 0, 1.0, norm))  # both of one word: the count itself
    few = held <= COMMON_WORD
    pairs = held[few] ** 2
    k = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
    first, size = np.repeat(begin[few], pairs), np.repeat(held[few], pairs)
    i, j = first + k // size, first + k % size
    weight = factor[column[i], column[j]]
    common = np.flatnonzero(np.repeat(~few, held))
    row, column = np.repeat(np.cumsum(~few) - 1, held)[common], column[common]

    def product(x: np.ndarray) -> np.ndarray:
        a = np.bincount(slot, weights=count * x[sentence], minlength=len(slots))
        g = np.bincount(i, weights=weight * a[j], minlength=len(slots))
        if len(common):
            dense = np.zeros((row[-1] + 1, len(lengths)))
            dense[row, column] = a[common]
            g[common] = (dense @ factor)[row, column]
        return np.bincount(sentence, weights=count * g[slot], minlength=n)

    return product


def _textrank_numpy(lens: np.ndarray, ids: np.ndarray, damping: float, epsilon: float) -> np.ndarray:
    """Power-method ranks for one session (the distributed path's iteration).

    ``lens`` are the sentences' numbers of words, ``ids`` numbers for their words, one sentence after the other."""
    n = len(lens)
    product = _graph_product(lens, ids)
    degree = product(np.ones(n))
    p = np.full(n, 1.0 / n)
    lam = 1.0
    while lam > epsilon:
        nxt = (1.0 - damping) / n * p.sum() + damping * product(p / (degree + ZERO_DIVISION_PREVENTION))
        lam = float(np.linalg.norm(nxt - p))
        p = nxt
    return p


def _local_ranks(sentences: DataFrame, key: str, damping: float, epsilon: float) -> DataFrame:
    ship_package(sentences.sparkSession)
    key_type = dict(sentences.dtypes)[key]
    schema = f"{key} {key_type}, sent_pos int, rank double"

    def fn(table: pa.Table) -> pa.Table:
        table = table.sort_by("sent_pos")
        words = table.column("words").combine_chunks()
        ranks = _textrank_numpy(pc.list_value_length(words).to_numpy(), words.flatten().dictionary_encode().indices.to_numpy(),
                                damping, epsilon)
        return pa.table({key: table.column(key), "sent_pos": table.column("sent_pos").cast(pa.int32()), "rank": ranks})

    d = sentences.select(key, "sent_pos", T.graph_words("sentence").alias("words"))
    return d.groupBy(key).applyInArrow(fn, schema)


# ------------------------------------------------------------------ distributed path

def _distributed_ranks(sentences: DataFrame, key: str, damping: float, epsilon: float,
                       max_iter: int = 10_000) -> DataFrame:
    ensure_checkpoint_dir(sentences.sparkSession)
    sw = sentence_words(sentences, key).persist()
    deg = sentence_graph(sentences, key).select(key, "sent_pos", "n_words", "degree")
    n = sentences.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    base = deg.join(n, key).persist()
    p = base.select(key, "sent_pos", (F.lit(1.0) / F.col("_n")).alias("p"))
    p = p.checkpoint()
    finals = []
    it = 0
    while it < max_iter:
        it += 1
        q = p.join(base, [key, "sent_pos"]).select(
            key, "sent_pos", (F.col("p") / (F.col("degree") + ZERO_DIVISION_PREVENTION)).alias("x"))
        wq = graph_product(sw, q, key)
        ps = p.groupBy(key).agg(F.sum("p").alias("_ps"))
        live = base.join(ps, key)
        nxt = (live.join(wq, [key, "sent_pos"], "left")
               .join(p, [key, "sent_pos"])
               .select(key, "sent_pos", "p",
                       ((F.lit(1.0 - damping) / F.col("_n")) * F.col("_ps")
                        + F.lit(damping) * F.coalesce(F.col("y"), F.lit(0.0))).alias("p_next")))
        lam = nxt.groupBy(key).agg(F.sqrt(F.sum((F.col("p_next") - F.col("p")) ** 2)).alias("_lam"))
        step = nxt.join(lam, key).select(key, "sent_pos", F.col("p_next").alias("p"), "_lam")
        # ``p`` is used three times per step, so the lineage is cut at every
        # step (reliable checkpoint to the cluster's checkpoint directory).
        step = step.checkpoint()
        finals.append(step.filter(F.col("_lam") <= epsilon).select(key, "sent_pos", F.col("p").alias("rank")))
        p = step.filter(F.col("_lam") > epsilon).select(key, "sent_pos", "p")
        if p.isEmpty():
            break
    else:
        finals.append(p.withColumnRenamed("p", "rank"))  # not converged: the rank as far as it came
    sw.unpersist()
    base.unpersist()
    out = finals[0]
    for f in finals[1:]:
        out = out.unionByName(f)
    return out.select(key, F.col("sent_pos").cast("int").alias("sent_pos"), "rank")


def textrank_ranks(sentences: DataFrame, key: str = "session_id", damping: float = D.TEXTRANK_DAMPING,
                   epsilon: float = D.TEXTRANK_EPSILON, local_max_sentences: int = 200_000,
                   local_max_words: int = 200_000) -> DataFrame:
    """``(key, sent_pos, rank)``: stationary TextRank score of each sentence.

    A session goes to the numpy path only when it has at most
    ``local_max_sentences`` sentences and ``local_max_words`` words (its
    memory is linear in both); all others run distributed."""
    size = sentences.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.sum("n_words").alias("_w"))
    fits = (F.col("_n") <= local_max_sentences) & (F.col("_w") <= local_max_words)
    small = sentences.join(size.filter(fits).select(key), key, "left_semi")
    ranks = _local_ranks(small, key, damping, epsilon)
    large_keys = size.filter(~fits).select(key)
    if not large_keys.isEmpty():
        large = sentences.join(large_keys, key, "left_semi")
        ranks = ranks.unionByName(_distributed_ranks(large, key, damping, epsilon))
    return ranks


def textrank_summary(texts: DataFrame, text: str = "text", n: int = D.TEXTRANK_SENTENCES,
                     key: str = "session_id", out: str = "summary", sentences: DataFrame | None = None,
                     **kw) -> DataFrame:
    """The ``n`` best-ranked sentences of each text (ties: earlier first),
    joined by a blank in text order. Texts without sentences give ''.
    ``sentences`` (``key, sent_pos, sentence``) may be given instead of
    splitting ``text``; ``texts`` then only supplies the keys."""
    if sentences is None:
        sents = sentence_table(texts, text, key)
    else:
        sents = sentences.withColumn("n_words", F.size(T.graph_words("sentence")).cast("long"))
    # read by the size check, the rank computation and the final selection
    sents = shared(sents)
    ranks = textrank_ranks(sents, key, **kw)
    # equal sentences have equal ranks but for the order of summation
    best = top_k(ranks, [key], [F.desc(F.round("rank", 12)), F.asc("sent_pos")], n, "_r")
    chosen = sents.join(best.select(key, "sent_pos"), [key, "sent_pos"])
    summ = chosen.groupBy(key).agg(listagg_ordered("sentence", "sent_pos", " ").alias(out))
    return texts.select(key).join(summ, key, "left").select(key, F.coalesce(F.col(out), F.lit("")).alias(out))


def summarize_sessions(utterances: DataFrame, generator=None, prompts: DataFrame | None = None,
                       text: str = "clean_text", n: int = D.TEXTRANK_SENTENCES) -> DataFrame:
    """``session_id, generated_summary``.

    Default: TextRank over the session's clean text. ``generator`` is a
    batch text generator ``pandas.Series[str] -> pandas.Series[str]``; it is
    applied to ``prompts`` (``session_id, prompt``) as an Arrow-batched
    pandas UDF, one batch of sessions per call.
    """
    from .sessions import session_sentences

    if generator is None:
        keys = utterances.select("session_id").distinct()
        return textrank_summary(keys, n=n, sentences=session_sentences(utterances, text)).withColumnRenamed(
            "summary", "generated_summary")
    if prompts is None:
        raise ValueError("a generator needs prompts")
    ship_package(prompts.sparkSession)
    gen = F.pandas_udf(generator, "string")
    return prompts.select("session_id", gen(F.col("prompt")).alias("generated_summary"))



def lead_sentence_generator(prompts: pd.Series) -> pd.Series:
    """A stand-in batch generator: the first sentence of each prompt's transcript."""
    body = prompts.fillna("").str.split("[transcript: ", n=1, regex=False).str[-1].str.removesuffix("]")
    return body.str.extract(r"^(.*?[.!?])(?=\s|$)", expand=False).fillna(body)
