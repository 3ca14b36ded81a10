import math
import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parley.operators import evaluate as EV


def dp_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            t[i][j] = t[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(t[i - 1][j], t[i][j - 1])
    return t[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcde"), max_size=40), st.lists(st.sampled_from("abcde"), max_size=70))
def test_lcs_matches_dp(a, b):
    assert EV.lcs_length(a, b) == dp_lcs(a, b)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcde"), min_size=1, max_size=40), st.lists(st.sampled_from("abcde"), min_size=1, max_size=40),
       st.integers(1, 20))
def test_tiles_match_dp(a, b, tile):
    below, total = {}, 0
    for i in range(0, len(a), tile):
        left = None
        for j in range(0, len(b), tile):
            below[j], left, matched = EV.lcs_tile(a[i:i + tile], b[j:j + tile], below.get(j), left)
            total += matched * (i + tile >= len(a))
    assert total == dp_lcs(a, b)


def pairs(spark, rows):
    return spark.createDataFrame(rows, "session_id string, candidate string, reference string")


def test_rouge_fixture(spark):
    p = pairs(spark, [("s", "the cat sat on the mat", "the cat is on a mat"),
                      ("same", "Hello world, again!", "hello WORLD again"),
                      ("empty", "", "something")])
    r1 = {r.session_id: r for r in EV.rouge_n(p, 1).collect()}
    r2 = {r.session_id: r for r in EV.rouge_n(p, 2).collect()}
    rl = {r.session_id: r for r in EV.rouge_l(p).collect()}
    assert r1["s"].precision == pytest.approx(4 / 6) and r1["s"].f1 == pytest.approx(4 / 6)
    assert r2["s"].f1 == pytest.approx(1 / 5)
    assert rl["s"].f1 == pytest.approx(4 / 6)
    for r in (r1, r2, rl):
        assert r["same"].f1 == pytest.approx(1.0)
        assert r["empty"].f1 == 0.0


def test_rouge_l_in_tiles_equals_whole_rows(spark):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice("a b c d e f g h".split()) for _ in range(n))
    p = pairs(spark, [("long", text(20_000), text(17_000)), ("short", text(5), text(9)), ("one", "a", "a"),
                      ("wide", text(3), text(9000)), ("empty", "", "x"), ("null", None, "x")])
    whole = sorted(EV.rouge_l(p).collect())
    for tile in (4096, 10_000, 1 << 20):
        assert sorted(EV.rouge_l(p, tile=tile).collect()) == whole
    assert EV.rouge_l(p.limit(0), tile=8).count() == 0


def test_rouge_with_stem_table(spark):
    p = pairs(spark, [("s", "running dogs", "run dog")])
    stems = spark.createDataFrame([("running", "run"), ("dogs", "dog")], "token string, stem string")
    r = EV.rouge_n(p, 1, token_table=stems).first()
    assert r.f1 == pytest.approx(1.0)   # 'dogs' (4 chars) stems, 'running' stems
    r2 = EV.rouge_n(p, 2, token_table=stems).first()
    assert r2.f1 == pytest.approx(1.0)


def test_classification_metrics_fixture(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (5, 4)], "t int, p int")
    got = {r.label: r for r in EV.classification_metrics(df, "t", "p").collect()}
    assert [got[i].precision for i in range(1, 6)] == pytest.approx([1, 0.5, 0, 0, 0])
    assert [got[i].recall for i in range(1, 6)] == pytest.approx([0.5, 1, 0, 0, 0])
    assert [got[i].f1 for i in range(1, 6)] == pytest.approx([2 / 3, 2 / 3, 0, 0, 0])


def test_histogram_constant(spark):
    from parley.operators.sessions import histogram
    df = spark.createDataFrame([(4,), (4,), (4,)], "x int")
    rows = sorted(histogram(df, "x").collect(), key=lambda r: r.bin)
    assert [r.n for r in rows] == [0, 0, 0, 0, 0, 3, 0, 0, 0, 0]
    assert rows[0].bin_lo == pytest.approx(3.5) and rows[-1].bin_hi == pytest.approx(4.5)


def test_histogram_matches_numpy(spark):
    from parley.operators.sessions import histogram
    vals = [random.Random(7).randint(1, 50) for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in vals], "x int")
    got = [r.n for r in sorted(histogram(df, "x").collect(), key=lambda r: r.bin)]
    assert got == list(np.histogram(vals, bins=10)[0])


def test_training_log_fixture(spark):
    log = spark.createDataFrame([(1, 0.5, 4.0, None), (2, 1.5, 2.0, None), (3, 2.5, 1.0, None),
                                 (4, 2.0, None, 9.0), (5, 2.1, None, 8.0)],
                                "seq long, epoch double, loss double, eval_loss double")
    rows = EV.rollup_training_log(log).collect()
    assert [(r.epoch, r.train_loss, r.eval_loss) for r in rows] == [(2, 1.5, 8.0)]


def test_embedding_match_against_numpy(spark):
    rng = np.random.default_rng(3)
    cand = [(p, i, rng.normal(size=8).tolist()) for p in range(3) for i in range(5 + p)]
    ref = [(p, i, rng.normal(size=8).tolist()) for p in range(3) for i in range(700 if p == 0 else 4)]
    schema = "pair_id int, token_id long, vector array<double>"
    got = {r.pair_id: r for r in EV.embedding_match(spark.createDataFrame(cand, schema),
                                                     spark.createDataFrame(ref, schema), block=64).collect()}
    for p in range(3):
        c = np.array([v for q, _, v in cand if q == p])
        r = np.array([v for q, _, v in ref if q == p])
        c /= np.linalg.norm(c, axis=1, keepdims=True)
        r /= np.linalg.norm(r, axis=1, keepdims=True)
        s = c @ r.T
        pr, rc = s.max(axis=1).mean(), s.max(axis=0).mean()
        assert got[p].precision == pytest.approx(pr) and got[p].recall == pytest.approx(rc)
        assert got[p].f1 == pytest.approx(2 * pr * rc / (pr + rc))


def test_leaderboard_live_wins(spark):
    live = spark.createDataFrame([("TF-IDF TextRank", "ROUGE-2", 30.0)], "model string, metric string, value double")
    out = {(r.model, r.metric): r for r in EV.leaderboard(EV.published_scores(spark), live).collect()}
    r = out[("TF-IDF TextRank", "ROUGE-2")]
    assert (r.value, r.source, r.meets_target, r.position) == (30.0, "live", True, 4)
    assert out[("Pegasus-Large", "ROUGE-2")].meets_target is False
    assert out[("Pegasus-Large", "ROUGE-1")].meets_target is None
    assert math.isclose(out[("T5-Base (Proposed)", "BERTScore F1")].value, 0.902)


def test_tier_leaderboard_published_and_live(spark):
    pub = EV.tier_leaderboard(EV.published_tier_scores(spark), None).collect()
    assert [r.f1 for r in sorted(pub, key=lambda r: r.tier)] == [0.89, 0.83, 0.81, 0.75, 0.90]
    assert all(r.source == "published" and r.weighted_f1 is None for r in pub)
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (5, 4)], "t int, p int")
    live = EV.classification_metrics(df, "t", "p").withColumnRenamed("label", "tier")
    rows = EV.tier_leaderboard(EV.published_tier_scores(spark), live).collect()
    assert all(r.source == "live" for r in rows)
    assert rows[0].weighted_f1 == pytest.approx((2 / 3 * 2 + 2 / 3 * 1 + 0 * 1) / 4)
    assert rows[0].meets_target is False


def test_embedding_match_salted_equals_plain(spark):
    rng = np.random.default_rng(4)
    cand = [(0, i, rng.normal(size=6).tolist()) for i in range(300)]
    ref = [(0, i, rng.normal(size=6).tolist()) for i in range(90)]
    schema = "pair_id int, token_id long, vector array<double>"
    c, r = spark.createDataFrame(cand, schema), spark.createDataFrame(ref, schema)
    a = EV.embedding_match(c, r, block=16).first()
    b = EV.embedding_match(c, r, block=16, salt=5).first()
    assert (a.precision, a.recall) == pytest.approx((b.precision, b.recall))


def test_embedding_scores_against_numpy(spark):
    """Distinct tokens with weights score as all tokens do, model by model."""
    rng = np.random.default_rng(5)
    vocab = rng.normal(size=(30, 6))
    texts = {("a", s): rng.integers(0, 30, 12 + s) for s in range(3)} | {("b", s): rng.integers(0, 30, 5) for s in range(2)}
    refs = {s: rng.integers(0, 30, 40) for s in range(3)}
    schema = "session_id int, token_id long, vector array<double>, weight long"

    def rows(tokens, keys, weighted):
        if weighted:
            return [(*keys, int(t), vocab[t].tolist(), int(n)) for t, n in zip(*np.unique(tokens, return_counts=True))]
        return [(*keys, i, vocab[t].tolist(), 1) for i, t in enumerate(tokens)]

    unit = vocab / np.linalg.norm(vocab, axis=1, keepdims=True)
    want = {}
    for model in "ab":
        f1 = []
        for (m, s), c in texts.items():
            if m == model:
                sim = unit[c] @ unit[refs[s]].T
                p, r = sim.max(axis=1).mean(), sim.max(axis=0).mean()
                f1.append(2 * p * r / (p + r))
        want[model] = (round(float(np.mean(f1)), 3), len(f1))
    for weighted in (False, True):
        c = spark.createDataFrame([x for k, t in texts.items() for x in rows(t, k, weighted)], "model string, " + schema)
        r = spark.createDataFrame([x for s, t in refs.items() for x in rows(t, (s,), weighted)], schema)
        got = {x.model: (x.value, x.n_pairs) for x in EV.embedding_scores(c, r, "session_id").collect()}
        assert got == want


def test_norm_is_summed_up_once(spark):
    """The sum over the entries stands outside the function that is called for every entry."""
    from parley.functions import arrays as A

    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([1.0, None],), (None,)], "v array<double>")
    out = df.select(A.l2_normalize("v").alias("u"))
    assert [r.u for r in out.collect()] == [[0.6, 0.8], [0.0, 0.0], [0.0, 0.0], None]
    entries = 3000  # once for every entry: nine million steps a row, minutes for these rows
    rows = spark.range(200).select(A.l2_normalize(F.transform(F.sequence(F.lit(1), F.lit(entries)), lambda i: i.cast("double"))).alias("u"))
    start = time.monotonic()
    assert rows.agg(F.sum(F.size(F.filter("u", lambda x: x > 0)))).first()[0] == 200 * entries
    assert time.monotonic() - start < 30


def test_match_carries_vectors_as_given_and_meets_blocks_once(spark):
    schema = "pair_id int, token_id long, vector array<float>, weight long"
    c = spark.createDataFrame([(0, i, [float(i + 1), 1.0], 1) for i in range(40)], schema)
    r = spark.createDataFrame([(0, i, [1.0, float(i)], 2) for i in range(30)] + [(1, 5, [1.0, 1.0], 1)], schema)
    out = EV.embedding_match(c, r, block=8)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "array<double>" not in plan.split("ArrowEvalPython")[1]
    assert [x.pair_id for x in out.collect()] == [0]


def test_null_vectors_match_nothing(spark):
    schema = "pair_id int, token_id long, vector array<double>"
    c = spark.createDataFrame([(0, 1, [1.0, 0.0]), (0, 2, None), (1, 1, None)], schema)
    r = spark.createDataFrame([(0, 1, [1.0, 0.0]), (0, 2, None), (0, 3, [0.0, 1.0]), (1, 1, [1.0, 0.0])], schema)
    got = {x.pair_id: (x.precision, x.recall, x.f1) for x in EV.embedding_match(c, r).collect()}
    assert got == {0: (1.0, 0.5, pytest.approx(2 / 3)), 1: (None, None, 0.0)}


def test_vectors_apart_match_as_vectors_in_the_rows(spark):
    """Also with references of more blocks than meet the candidates at once."""
    rng = np.random.default_rng(5)
    table = [[float(x) for x in rng.normal(size=4)] for _ in range(50)] + [None, [0.0] * 4, [1.0, None, 1.0, 1.0]]
    vectors = spark.createDataFrame(list(enumerate(table)), "place long, vector array<double>")
    schema = "pair_id int, token_id long, place long, weight long"
    side = lambda n: spark.createDataFrame([(p, t, int(rng.integers(0, len(table))), int(rng.integers(1, 4)))
                                            for p, k in enumerate((n, 3, 0 if n > 100 else 2)) for t in range(k)], schema)
    c, r = side(40), side(200)
    apart = EV.embedding_match(c, r, block=4, vectors=vectors)
    joined = EV.embedding_match(*(x.join(vectors, "place").drop("place") for x in (c, r)), block=4)
    got, want = ({x.pair_id: x for x in df.collect()} for df in (apart, joined))
    assert set(got) == set(want) == {0, 1}
    for p in got:
        assert [got[p][m] for m in ("precision", "recall", "f1")] == pytest.approx([want[p][m] for m in ("precision", "recall", "f1")])


def test_pairs_of_one_partition_are_dealt_to_all_tasks(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(EV, "shared", lambda df: kept.append(df) or df)
    preds = spark.createDataFrame([("m", i, f"w{i} a b") for i in range(40)], "model string, session_id int, prediction string").coalesce(1)
    refs = spark.createDataFrame([(i, f"w{i} a c") for i in range(40)], "session_id int, reference string").coalesce(1)
    assert EV.evaluate_models(refs, preds).where("metric = 'ROUGE-1'").first().value == 66.7
    assert kept[0].rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
