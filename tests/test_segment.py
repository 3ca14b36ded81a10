import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from parley.operators import segment as G
from parley.operators import sessions as S
from tests.conftest import utt


def seg_ids(spark, rows, threshold=0.15):
    u = S.preprocess(utt(spark, rows))
    out = G.segment_sessions(u, threshold).select("session_id", "turn", "segment_id").collect()
    return {(r.session_id, r.turn): r.segment_id for r in out}


def test_fixture_sessions(spark):
    rows = [("a", 0, "x", "hello there world"),
            ("b", 0, "x", "the of"), ("b", 1, "x", "and it"), ("b", 2, "x", "is"),
            ("c", 0, "x", "alpha beta"), ("c", 1, "x", ""), ("c", 2, "x", "alpha beta"), ("c", 3, "x", "alpha beta")]
    got = seg_ids(spark, rows)
    assert [got[("a", 0)]] == [0]
    assert [got[("b", i)] for i in range(3)] == [0, 1, 2]
    assert [got[("c", i)] for i in range(4)] == [0, 1, 2, 2]


def test_order_and_interleaving_do_not_matter(spark):
    rows = [("c", 3, "x", "alpha beta"), ("b", 1, "x", "and it"), ("c", 0, "x", "alpha beta"),
            ("b", 0, "x", "the of"), ("c", 2, "x", "alpha beta"), ("b", 2, "x", "is"), ("c", 1, "x", "")]
    got = seg_ids(spark, rows)
    assert [got[("c", i)] for i in range(4)] == [0, 1, 2, 2]
    assert [got[("b", i)] for i in range(3)] == [0, 1, 2]


def test_single_session_many_turns(spark):
    rows = [("only", i, "x", "same words here") for i in range(5)]
    assert set(seg_ids(spark, rows, 0.75).values()) == {0}


def test_block_boundaries(spark):
    # more turns than a prefix-sum block: the running sum crosses blocks
    rows = [("s", i, "x", "alpha" if i % 3 else "beta gamma") for i in range(40)]
    u = S.preprocess(utt(spark, rows))
    sim = G.adjacent_similarity(u)
    from parley.operators.sequence import prefix_sum
    flags = sim.select("session_id", "turn", F.when(F.col("similarity") < 0.15, 1).otherwise(0).alias("f"))
    d = u.join(flags, ["session_id", "turn"], "left").fillna(0, ["f"])
    small = {r.turn: r.seg for r in prefix_sum(d, ["session_id"], "turn", "f", "seg", block=7).collect()}
    big = {r.turn: r.seg for r in prefix_sum(d, ["session_id"], "turn", "f", "seg").collect()}
    assert small == big


def numpy_tfidf_similarity(texts, stop):
    """Per-session TF-IDF (each text a document) and adjacent cosine, in numpy."""
    import re
    toks = [[t for t in re.findall(r"\b\w\w+\b", x) if t not in stop] for x in texts]
    total = Counter(t for ts in toks for t in ts)
    vocab = sorted(total, key=lambda t: (-total[t], t))[:500]
    idx = {t: i for i, t in enumerate(vocab)}
    n = len(texts)
    tf = np.zeros((n, len(vocab)))
    for i, ts in enumerate(toks):
        for t in ts:
            if t in idx:
                tf[i, idx[t]] += 1
    df = (tf > 0).sum(axis=0)
    w = tf * (np.log((1 + n) / (1 + df)) + 1)
    norms = np.linalg.norm(w, axis=1)
    w = np.divide(w, norms[:, None], out=np.zeros_like(w), where=norms[:, None] > 0)
    return [float(w[i - 1] @ w[i]) for i in range(1, n)]


def test_similarity_against_numpy(spark):
    conv = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    u = S.preprocess(conv.select(F.col("conv_id").alias("session_id"), "turn", F.col("role").alias("speaker"),
                                 F.col("text").alias("utterance")))
    got = {(r.session_id, r.turn): r.similarity for r in G.adjacent_similarity(u).collect()}
    stop = set(G.default_stop_words())
    by = {}
    for r in u.select("session_id", "turn", "clean_text").collect():
        by.setdefault(r.session_id, []).append((r.turn, r.clean_text))
    for sid, items in by.items():
        items.sort()
        expect = numpy_tfidf_similarity([t for _, t in items], stop)
        for (turn, _), e in zip(items[1:], expect):
            assert math.isclose(got[(sid, turn)], e, abs_tol=1e-9)


def test_top_terms_ties_alphabetical(spark):
    rows = [("s", 0, "x", "zeta alpha alpha beta"), ("s", 1, "x", "zeta")]
    u = G.segment_sessions(S.preprocess(utt(spark, rows)), 0.0)
    got = [(r.rank, r.term, r.n) for r in G.top_terms(u, k=2).orderBy("rank").collect()]
    assert got == [(1, "alpha", 2), (2, "zeta", 2)]
