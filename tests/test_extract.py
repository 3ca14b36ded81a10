import math
import re

import numpy as np
import pytest

from parley.operators import extract as X


def sumy_like_ranks(sentences_words, damping=0.85, eps=1e-4):
    """TextRank exactly as the published library defines it, pair by pair."""
    n = len(sentences_words)
    w = np.zeros((n, n))
    for i in range(n):
        for j in range(i, n):
            a, b = sentences_words[i], sentences_words[j]
            rank = sum(b.count(x) for x in a)
            if rank == 0:
                val = 0.0
            else:
                norm = math.log(len(a)) + math.log(len(b))
                val = float(rank) if np.isclose(norm, 0.0) else rank / norm
            w[i, j] = w[j, i] = val
    w /= (w.sum(axis=1)[:, None] + 1e-7)
    m = np.full((n, n), (1 - damping) / n) + damping * w
    p = np.full(n, 1.0 / n)
    lam = 1.0
    while lam > eps:
        nxt = m.T @ p
        lam = np.linalg.norm(nxt - p)
        p = nxt
    return p


TEXTS = [
    ("a", "the cat sat. the cat ran away fast. dogs bark. cat. cat. the dog and the cat play!"),
    ("b", "one. two two. three three three? nothing here 123."),
    ("c", "single sentence only"),
    ("d", ""),
]


def test_graph_degree_against_pairs(spark):
    texts = spark.createDataFrame(TEXTS, "session_id string, text string")
    sents = X.sentence_table(texts)
    rows = sents.select("session_id", "sent_pos", "sentence").collect()
    words = {(r.session_id, r.sent_pos): [w for w in re.findall(r"[\w'-]+", r.sentence.lower())
                                          if re.fullmatch(r"[a-z][a-z'-]*", w)] for r in rows}
    deg = {(r.session_id, r.sent_pos): r.degree for r in X.sentence_graph(sents).collect()}
    for (sid, i), a in words.items():
        expect = 0.0
        for (sid2, j), b in words.items():
            if sid2 != sid:
                continue
            rank = sum(b.count(x) for x in a)
            if rank:
                norm = math.log(len(a)) + math.log(len(b))
                expect += rank if np.isclose(norm, 0.0) else rank / norm
        assert deg[(sid, i)] == pytest.approx(expect)


@pytest.mark.parametrize("local_limit", [2048, 0])
def test_ranks_match_reference_algorithm(spark, local_limit):
    texts = spark.createDataFrame(TEXTS[:3], "session_id string, text string")
    sents = X.sentence_table(texts)
    got = {(r.session_id, r.sent_pos): r.rank
           for r in X.textrank_ranks(sents, local_max_sentences=local_limit).collect()}
    for sid, text in TEXTS[:3]:
        ss = [s for s in re.split(r"(?<=[.!?])\s+", text) if s.strip()]
        ws = [[w for w in re.findall(r"[\w'-]+", s.lower()) if re.fullmatch(r"[a-z][a-z'-]*", w)] for s in ss]
        expect = sumy_like_ranks(ws)
        assert [got[(sid, i)] for i in range(len(ss))] == pytest.approx(list(expect), abs=1e-12)


def test_summary_picks_top_three_in_text_order(spark):
    texts = spark.createDataFrame(TEXTS, "session_id string, text string")
    got = {r.session_id: r.summary for r in X.textrank_summary(texts).collect()}
    assert got["d"] == ""
    assert got["c"] == "single sentence only"
    assert len(got["a"].split(". ")) <= 4
    parts = ["the cat sat.", "the cat ran away fast.", "dogs bark.", "cat.", "cat.", "the dog and the cat play!"]
    chosen = [p for p in parts if p in got["a"]]
    assert got["a"].startswith(chosen[0])


def test_long_session_runs_in_numpy(spark, monkeypatch):
    """Thousands of sentences take no n x n matrix, so that they need not go through Spark's iteration."""
    rng = np.random.default_rng(3)
    words = [[f"w{chr(97 + k % 26)}{'x' * (k // 26)}" for k in rng.integers(0, 60 if i % 3 else 400, i % 23 + 1)] for i in range(2100)]
    sents = spark.createDataFrame([(1, i, " ".join(w), len(w)) for i, w in enumerate(words)],
                                  "session_id long, sent_pos int, sentence string, n_words long")

    def refuse(*a, **k):
        raise AssertionError("a session of 2,100 sentences fits numpy")

    monkeypatch.setattr(X, "_distributed_ranks", refuse)
    got = {r.sent_pos: r.rank for r in X.textrank_ranks(sents).collect()}
    ids = {w: k for k, w in enumerate(sorted({w for s in words for w in s}))}
    counts = np.zeros((len(words), len(ids)))
    for i, s in enumerate(words):
        for w in s:
            counts[i, ids[w]] += 1
    logs = np.log([len(s) for s in words])
    norm = logs[:, None] + logs[None, :]
    m = counts @ counts.T / np.where(norm == 0, 1.0, norm)
    m = 0.15 / len(words) + 0.85 * m / (m.sum(axis=1, keepdims=True) + X.ZERO_DIVISION_PREVENTION)
    p, lam = np.full(len(words), 1 / len(words)), 1.0
    while lam > 1e-4:
        p, last = m.T @ p, p
        lam = np.linalg.norm(p - last)
    assert [got[i] for i in range(len(words))] == pytest.approx(list(p), abs=1e-12)
