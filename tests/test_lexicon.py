"""The phrase index against the chain of ``contains``."""

import random

import pytest
from pyspark.sql import functions as F

from parley import defaults as D
from parley.functions import text as T
from parley.operators import lexicon as L
from parley.sources import testdata as TD

SCHEMA = "k long, text string"
PHRASES = "phrase string, tier int"


def by_chain(df, lexicon):
    return {r.k: r.t for r in df.groupBy("k").agg(F.max(T.lexicon_tier("text", lexicon)).alias("t")).collect()}


def by_index(spark, df, rows):
    out = L.indexed_lexicon_tiers(df, spark.createDataFrame(rows, PHRASES), "k")
    assert out.columns == ["k", "emotion_tier"]
    return {r.k: r.emotion_tier for r in out.collect()}


def random_texts(rng, n=60):
    words = ["a", "de", "été", "naïve", "in the", "x\ny", "hopeless", "😀 ok", "worry", "zz"]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 80, 400])))) for i in range(n)]


@pytest.mark.parametrize("piece", [256, 4])
def test_index_equals_chain(spark, monkeypatch, piece):
    monkeypatch.setattr(L, "PIECE", piece)
    rng = random.Random(3)
    texts = random_texts(rng) + [(100, None), (101, ""), (None, "Hopeless"), (None, "a"), (5, "WORRY ZZ"), (102, "no" * 3000 + "zz été")]
    lexicon = {5: ["zz été", "😀 ok a de 😀 ok"], 4: ["x\ny naïve", "hopeless hopeless"], 3: ["worry zz worry", "absent phrase"],
               2: ["é", "zz", "de a"]}
    df = spark.createDataFrame(texts, SCHEMA)
    assert by_index(spark, df, [(p, t) for t, ps in lexicon.items() for p in ps]) == by_chain(df, lexicon)


def test_default_lexicon(spark):
    phrases = [p for ps in D.TIER_KEYWORDS.values() for p in ps]
    df = spark.createDataFrame([(i, f"well {p.upper()}, you see") for i, p in enumerate(phrases)] + [(999, "calm")], SCHEMA)
    assert by_index(spark, df, [(p, t) for t, ps in D.TIER_KEYWORDS.items() for p in ps]) == by_chain(df, D.TIER_KEYWORDS)


def test_edges(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None)], SCHEMA)
    assert by_index(spark, df, []) == {1: 1, 2: 1}
    assert by_index(spark, df, [("", 3), (None, 5), ("abc", None)]) == {1: 3, 2: 3}
    assert by_index(spark, df, [("abc", 2), ("abc", 4), ("abcd", 5)]) == {1: 4, 2: 1}
    assert by_index(spark, df.limit(0), [("abc", 2)]) == {}


def test_anchor_is_the_rarest_gram(spark):
    df = spark.createDataFrame([(i, "in the house") for i in range(20)] + [(20, "in the zoo")], SCHEMA)
    index = {r.phrase: (r.gram, r.n) for r in L.phrase_anchors(
        df, spark.createDataFrame([("the zoo", 5), ("the sea", 5), ("in", 2)], PHRASES), "k").collect()}
    assert set(index) == {"the zoo", "in"}                # "the sea" has a gram that no text holds
    assert index["the zoo"][1] == 1 and index["in"] == ("in", 21)


def test_texts_emit_the_phrases_they_hold_and_nothing_around_them(spark):
    text = "so well then the house by the sea is old " * 40
    lexicon = spark.createDataFrame([("the house", 3), ("the sea", 4), ("the house by the", 5), ("by the lake", 5)], PHRASES)
    rows = L._candidates(spark.createDataFrame([(1, text), (2, None)], SCHEMA), L._openings(lexicon), "k", "text")
    assert rows.columns == ["k", "phrase"]
    assert {(r.k, r.phrase): r["count"] for r in rows.groupBy("k", "phrase").count().collect()} == {
        (1, p): 40 for p in ("the house", "the sea", "the house by the")}


def test_all_lengths_of_phrases(spark):
    rng = random.Random(5)
    texts = [(i, "".join(rng.choice("ab😀é ?") for _ in range(700))) for i in range(4)]
    lengths = [1, 2, 3, 4, 7, 8, 9, 16, 31, 32, 62, 63, 64, 65, 130, 300]
    lexicon = {5: [t[k * 17:k * 17 + n] for _, t in texts[:2] for k, n in enumerate(lengths[6:])], 4: ["? ?" * 4, "?b?a", "a" * 64],
               3: [texts[2][1][-n:] for n in lengths[4:]], 2: [texts[3][1][5:5 + n] for n in lengths]}
    df = spark.createDataFrame([*texts, (9, "b" * 63 + "a" * 64), (10, "")], SCHEMA)
    assert by_index(spark, df, [(p, t) for t, ps in lexicon.items() for p in ps]) == by_chain(df, lexicon)


def test_texts_first_emit_the_phrases_of_their_highest_tier_once(spark):
    df = spark.createDataFrame([(1, "so well then the house by the sea is old " * 40), (2, None), (3, "the sea " * 9)], SCHEMA)
    lexicon = spark.createDataFrame([("the house", 3), ("the sea", 4), ("house by the", 5), ("is old so", 5), ("by the lake", 5)], PHRASES)
    rows = L._scan(df, L._index(L._openings(lexicon)), "k", "text", highest=True)
    # text 3 holds phrases of one tier alone, none is left out
    assert sorted((r.k, r.phrase, r.least) for r in rows.collect()) == [(1, "house by the", 5), (1, "is old so", 5), (3, "the sea", None)]


def test_phrases_across_blocks_but_not_across_rows(spark):
    df = spark.createDataFrame([(i, "x" * (L.BLOCK - i) + "needle" + "y" * (2 * L.BLOCK)) for i in range(8)] + [(8, "nee"), (9, "dle")], SCHEMA)
    lexicon = {5: ["needle"], 4: ["xneedley"], 2: ["neey"]}
    assert by_index(spark, df.coalesce(1), [(p, t) for t, ps in lexicon.items() for p in ps]) == {i: 5 if i < 8 else 1 for i in range(10)}


def test_a_table_too_full_to_tell_costs_no_right_row(spark, monkeypatch):
    monkeypatch.setattr(L, "MOST_WORDS", L.LEAST_WORDS)
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(12))
    tiers = {word(): rng.choice([1, 2, 2, 3, 5, 9]) for _ in range(60_000)}
    some = list(tiers)
    texts = [(i % 50 or None, " ".join(word() if rng.random() < 0.8 else rng.choice(some) for _ in range(i % 7))) for i in range(60)]
    expected = {}
    for k, text in texts:
        held = [tiers[text[i:i + 12]] for i in range(len(text)) if text[i:i + 12] in tiers]
        expected[k] = max([expected.get(k, 1), *held])
    assert by_index(spark, spark.createDataFrame(texts, SCHEMA), list(tiers.items())) == expected


def test_many_tiers(spark):
    tiers = {f"phrase {i:03}.": i for i in range(200)}
    texts = [(i, " ".join(f"Phrase {j:03}." for j in range(i % 13, i + 1, 7))) for i in range(200)]
    expected = {k: max([1, *[t for p, t in tiers.items() if p in text.lower()]]) for k, text in texts}
    assert by_index(spark, spark.createDataFrame(texts, SCHEMA), list(tiers.items())) == expected


@pytest.mark.parametrize("size", [1, 1 << 18])
def test_word_runs_are_what_the_pattern_matches(spark, size):
    rng = random.Random(11)
    words = ["a", "of", "The", "house,", "x.", "9", "é", "b ", "\n", "sea", "by", "İs", "zz-z"]
    texts = [(i, " ".join(rng.choice(words[:rng.choice([3, 13])]) for _ in range(rng.choice([0, 1, 3, 40, 300])))) for i in range(80)]
    texts += [(100, None), (101, ""), (102, "ends in "), (103, "one more"), (104, "a b"), (105, " c d e f"), (106, "abc"), (107, "def ghi jkl")]
    df = spark.createDataFrame(texts, SCHEMA).coalesce(1)
    for every in (1, 2, 25):
        runs = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+ [a-z]+ [a-z]+"), 0), lambda x, i: i % every == 0)
        expected = sorted(r[0] for r in df.select(F.explode(runs)).collect())
        assert sorted(r.phrase for r in TD.word_runs(df, "text", every, size).collect()) == expected and expected
