"""Gaps, repeats and sparse positions in ``turn``; limits and files that must lose nothing."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from parley.operators import extract as X
from parley.operators import segment as G
from parley.operators import sessions as S
from parley.operators import prepare as PR
from parley.operators.sequence import fixed_table, number_rows
from parley.sources import annotated as AN
from tests.conftest import utt

TEXTS = ["alpha beta one", "gamma delta two", "alpha beta one", "alpha beta one", "zeta eta three"]


def segments(spark, turns):
    u = S.preprocess(utt(spark, [("s", t, "client", x) for t, x in zip(turns, TEXTS)]))
    return {r.turn: r.segment_id for r in G.segment_sessions(u, 0.15).collect()}


def test_gaps_do_not_change_segments(spark):
    dense = segments(spark, range(5))
    assert list(dense.values()).count(2) == 2
    for turns in ([0, 2, 4, 6, 8], [3, 9, 10, 50_000, 10**12]):
        assert segments(spark, turns) == dict(zip(turns, (dense[k] for k in range(5))))


def test_gaps_do_not_change_sentences(spark):
    def sentences(turns):
        u = S.preprocess(utt(spark, [("s", t, "client", x) for t, x in zip(turns, ["one two", "three. four", "five."])]))
        return [r.sentence for r in S.session_sentences(u).orderBy("sent_pos").collect()]

    assert sentences([0, 1, 2]) == sentences([0, 2, 4]) == sentences([5, 70, 10**12]) == ["one two three.", "four five."]


def test_repeated_turns_follow_each_other(spark):
    rows = [("s", 0, "client", "gamma delta."), ("s", 0, "client", "alpha."), ("s", 1, "client", "beta.")]
    u = S.preprocess(utt(spark, rows))
    assert [r.sentence for r in S.session_sentences(u).orderBy("sent_pos").collect()] == ["alpha.", "gamma delta.", "beta."]
    assert G.segment_sessions(u, 0.15).count() == 3


def test_number_rows_on_sparse_hot_key(spark):
    rnd = random.Random(4)
    turns = rnd.sample(range(10**13), 4000) + list(range(5000, 6000))
    df = spark.createDataFrame([("hot", t) for t in turns] + [("cold", 7)], "k string, t long").repartition(5)
    got = {(r.k, r.t): r.p for r in number_rows(df, ["k"], "t", out="p").collect()}
    want = {("hot", t): i for i, t in enumerate(sorted(turns))} | {("cold", 7): 0}
    assert got == want


def test_topics_come_from_all_segments(spark):
    """The weightiest segment is the last of twelve."""
    rows = [("s", t, "client", f"word{t}x word{t}y") for t in range(11)] + [("s", 11, "client", "mountain " * 9 + "river " * 5)]
    u = S.preprocess(utt(spark, rows))
    topics = G.segment_topics(G.top_terms(G.segment_sessions(u, 0.15)), 3).first().topics
    assert topics[0] == ["mountain", "river"] and len(topics) == 3
    prompt = S.build_prompts(u, spark.createDataFrame([("s", "x", topics)], "session_id string, tier_label string, topics array<array<string>>"))
    assert "[main_topics: mountain, river; " in prompt.first().prompt


def test_ranks_survive_the_iteration_limit(spark):
    sents = spark.createDataFrame([("s", i, t) for i, t in enumerate(TEXTS)], "session_id string, sent_pos int, sentence string")
    sents = sents.withColumn("n_words", F.size(X.T.graph_words("sentence")).cast("long"))
    assert X._distributed_ranks(sents, "session_id", 0.85, 1e-9, max_iter=1).count() == 5


def test_files_of_one_name_are_sessions_of_their_own(spark, tmp_path):
    for folder, word in (("Train", "hello"), ("Test", "bye")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "SummAnnotated - 7.csv").write_text(
            f"Utterance,Sub_topic,ID,Type,Dialogue_Act,Emotion\n{word} one,,1,T,,\n{word} two,,2,P,,\nsummary,about {word},,,,\n")
    (tmp_path / "Test" / "SummAnnotated - 8.csv").write_text(
        "Utterance,Sub_topic,ID,Type,Dialogue_Act,Emotion\nx,,1,T,,\nsummary,about x,,,,\n")
    rows = AN.read_annotated_sessions(spark, [str(tmp_path / "Train"), str(tmp_path / "Test")])
    got = {(r.transcript, r.reference_summary) for r in AN.load_sessions(rows)[1].collect()}
    assert got == {("hello one hello two", "about hello"), ("bye one bye two", "about bye"), ("x", "about x")}
    ids = {r.session_id for r in rows.select("session_id").distinct().collect()}
    assert "8" in ids and len(ids) == 3 and {i.rsplit("/", 1)[-1] for i in ids} == {"7", "8"}


def test_session_split_keeps_sessions_together(spark):
    main = spark.createDataFrame([(f"s{i}", "t", "r") for i in range(50)], "session_id string, transcript string, reference_summary string")
    turns = spark.createDataFrame([(f"s{i}", t) for i in range(50) for t in range(6)], "session_id string, turn int")
    pairs = PR.training_pairs(main, utterances=turns, per_utterance=True)
    split = PR.split_pairs(pairs, 0.5, by="session")
    assert split.count() == 300
    sides = split.groupBy("session_id").agg(F.countDistinct("split").alias("n")).agg(F.max("n")).first()[0]
    assert sides == 1 and split.select("split").distinct().count() == 2


@pytest.mark.parametrize("n,fraction", [(11, 0.9), (1, 0.5), (0, 0.5), (1000, 0.333), (10, 1.0)])
def test_positional_split_counts(spark, n, fraction):
    df = spark.createDataFrame([(i % 3, f"k{i:04d}") for i in range(n)], "a int, b string")
    rows = S.positional_split(df, ["a", "b"], fraction).orderBy("a", "b").collect()
    cut = int(fraction * n)
    assert [r.split for r in rows] == ["train"] * cut + ["validation"] * (n - cut)


def test_large_parameter_tables_are_not_broadcast(spark):
    big = fixed_table(spark, [(i,) for i in range(20)], "a int", max_rows=10)
    assert "ResolvedHint" not in big._jdf.queryExecution().analyzed().toString() and big.count() == 20


@pytest.mark.parametrize("rows", [
    [(7, "same", None)] * 25,                                            # equal in all columns
    [(7, f"text {i}", None) for i in range(25)],                         # one key, different rows
    [(7, f"text {i % 3}", i % 2 or None) for i in range(25)],            # one key, groups of equal rows
    [(None, "x", 1)] * 9 + [(i % 4, "y", i % 2) for i in range(31)],     # null key first, ties elsewhere
])
@pytest.mark.parametrize("fraction", [0.0, 0.3, 0.5, 0.9, 1.0])
def test_positional_split_is_exact_with_repeated_keys(spark, rows, fraction):
    df = spark.createDataFrame(rows, "k long, text string, v long")
    got = S.positional_split(df, ["k"], fraction).collect()
    train = [tuple(r)[:3] for r in got if r["split"] == "train"]
    assert len(train) == int(fraction * len(rows) + 1e-9)
    assert Counter(tuple(r)[:3] for r in got) == Counter(rows)
    rest = [r["k"] for r in got if r["split"] != "train"]
    place = lambda k: (k is not None, k or 0)
    if train and rest:
        assert max(place(r[0]) for r in train) <= min(map(place, rest))
