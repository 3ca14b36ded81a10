import math

import pytest

from parley.functions import text as T
from parley.operators import abbreviations as AB


def test_planted_abbreviations_change_the_split(spark):
    rows = [(i, f"we saw dr. lee{i} today. today they spoke of work{i}. the day was long") for i in range(40)]
    df = spark.createDataFrame(rows + [(99, None), (98, ""), (97, "wait... e.g. this")], "doc_id int, text string")
    got = {r.word: r for r in AB.abbreviation_statistics(df).collect()}
    assert got["dr"].abbreviation and not got["today"].abbreviation and not got["work3"].abbreviation
    assert "wait" not in got and got["e.g"].n_dot == 1 and "saw" not in got
    learned = [r.word + "." for r in got.values() if r.abbreviation]
    one = df.where("doc_id = 3")
    assert one.select(T.split_sentences("text")).first()[0][0] == "we saw dr."
    assert one.select(T.split_sentences("text", learned)).first()[0] == [
        "we saw dr. lee3 today.", "today they spoke of work3.", "the day was long"]


def test_statistics_by_hand(spark):
    df = spark.createDataFrame([("ab. ab. ab x y z. x",)], "text string")
    got = {r.word: r for r in AB.abbreviation_statistics(df).collect()}
    p = 3 / 7
    want = -2 * (2 * (math.log(p) - math.log(0.99)) + math.log(1 - p) - math.log(0.01))
    assert got["ab"].log_likelihood == pytest.approx(want)
    assert got["ab"].score == pytest.approx(want * math.exp(-2) / 2)
    assert set(got) == {"ab", "z"}
    assert AB.abbreviation_statistics(df.limit(0)).count() == 0
