"""Every registered query: Spark result equals the DuckDB oracle at sf0.001."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as E
from tools.check_oracle import TABLES, digest

SF = "/root/testdata/sf0.001"
SQL = E.oracle_sql()
# the operators of the training-data subpackage are checked in tests/llm
NAMES = sorted(n for n in E.queries() if not re.match(r"op\d+_|pipeline$", n))
SQL = {n: q for n, q in SQL.items() if n in NAMES}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_every_query_has_oracle_or_is_listed():
    no_oracle = {"session_topics", "label_classifier", "session_tier_model", "pipeline_report", "normalize_repaired",
                 "generator_summaries"}
    assert set(NAMES) - set(SQL) == no_oracle


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(SQL[name])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(rows, df.columns)[0] == digest(orows, ocols)[0]


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns[0] == "session_id"


@pytest.mark.parametrize("name", ["segment_sessions", "session_report", "rouge_2", "split_pairs"])
def test_partition_count_independent(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        a = E.queries()[name](spark, SF)
        ra = digest([tuple(r) for r in a.collect()], a.columns)[0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    b = E.queries()[name](spark, SF)
    assert ra == digest([tuple(r) for r in b.collect()], b.columns)[0]


def test_rows_only_queries_run(spark):
    for name in ["normalize_repaired", "generator_summaries"]:
        assert E.queries()[name](spark, SF).count() > 0


def test_leaderboard_follows_the_input(spark, monkeypatch):
    """TextRank's row holds its scores on the sessions, and moves with their texts."""
    from parley.sources import testdata as TD

    def textrank():
        rows = E.queries()["leaderboard"](spark, SF).collect()
        assert len(rows) == 16 and {r.source for r in rows if r.model != "TF-IDF TextRank"} == {"published"}
        mine = {r.metric: r.value for r in rows if r.model == "TF-IDF TextRank" and r.source == "live"}
        assert set(mine) == {"ROUGE-1", "ROUGE-2", "ROUGE-L", "BERTScore F1"}
        return mine

    before, read = textrank(), TD.table

    def shortened(spark, sf_dir, name):
        df = read(spark, sf_dir, name)
        return df.where("turn < 2") if name == "conversations" else df

    monkeypatch.setattr(TD, "table", shortened)
    assert textrank() != before
