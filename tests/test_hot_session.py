"""One session far larger than a block: block boundaries must not change results."""

import random


from parley.operators import segment as G
from parley.operators import sessions as S
from parley.operators import tiers as TR
from tests.conftest import utt

N = 9000
WORDS = ["alpha", "beta", "gamma", "delta", "not", "great", "a", "little", "", "ok"]


def hot_rows():
    rnd = random.Random(5)
    rows = []
    for i in range(N):
        k = rnd.randint(0, 3)
        rows.append(("hot", i, "client" if i % 3 else "counselor", " ".join(rnd.choice(WORDS) for _ in range(k))))
    rows += [("cold", i, "client", "alpha beta") for i in range(3)]
    return rows


def test_hot_session(spark):
    rows = hot_rows()
    u = S.preprocess(utt(spark, rows)).persist()
    # segment ids vs a sequential pass over the similarities
    sim = {r.turn: r.similarity for r in G.adjacent_similarity(u).filter("session_id = 'hot'").collect()}
    seg = {r.turn: r.segment_id for r in G.segment_sessions(u, 0.15).filter("session_id = 'hot'").collect()}
    cur = 0
    for t in range(N):
        if t > 0 and sim[t] < 0.15:
            cur += 1
        assert seg[t] == cur
    # transcript head vs the joined text
    clean = {r.turn: r.clean_text for r in u.filter("session_id = 'hot'").select("turn", "clean_text").collect()}
    full = " ".join(clean[t] for t in range(N))
    head = S.transcript_head(u, max_chars=3000).filter("session_id = 'hot'").first()[1]
    assert head == full[:3000]
    # window tiers vs the whole-text rule
    lex = {2: ["not great", "a little"], 3: ["great a little"]}
    a = {r[0]: r[1] for r in TR.lexicon_tiers(u, lex).collect()}
    b = {r[0]: r[1] for r in TR.lexicon_tiers(u, lex, method="text").collect()}
    assert a == b
    # session text assembled over several blocks keeps turn order
    st = S.session_text(u).filter("session_id = 'hot'").first()[1]
    assert st == full
    u.unpersist()
