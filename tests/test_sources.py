import os
import tempfile

import pytest
from pyspark.sql import functions as F

from parley.operators import prepare as PR
from parley.sources import annotated as AN
from parley.sources import pairs as PS

HEADER = "Utterance,Sub topic,Id,Type,Dialogue act,Emotion\n"


def write(d, name, body):
    with open(os.path.join(d, name), "w", encoding="utf-8") as f:
        f.write(HEADER + body)


def test_annotated_folders(spark):
    d1, d2 = tempfile.mkdtemp(prefix="ann-a-"), tempfile.mkdtemp(prefix="ann-b-")
    write(d1, "SummAnnotated - s 1.csv",
          'hello there,x,1, T ,q,n\n"line one\nline two",x,2,P,q,n\nsummary,"First summary.",3,,q,n\n'
          'summary,Second summary.,4,,q,n\nok,x,5,,q,n\n')
    write(d1, "SummAnnotated - nosum.csv", "hi,x,1,T,q,n\n")
    write(d2, "SummAnnotated - blank.csv", "hi,x,1,T,q,n\nSummary,   ,2,,q,n\n")
    write(d2, "other.csv", "x,x,1,T,q,n\nsummary,should not load,2,,q,n\n")
    rows = AN.read_annotated_sessions(spark, [d1, None, d2])
    assert sorted(r[0] for r in rows.select("session_id").distinct().collect()) == ["blank", "nosum", "s 1"]
    utts, sessions = AN.load_sessions(rows)
    s = sessions.collect()
    assert len(s) == 1 and s[0].session_id == "s 1"
    assert s[0].reference_summary == "First summary."
    assert s[0].transcript == "hello there line one\nline two ok"
    u = {r.turn: (r.speaker, r.utterance) for r in utts.collect()}
    assert u == {0: ("counselor", "hello there"), 1: ("client", "line one\nline two"), 2: ("client", "ok")}


def test_meta_split_nulls(spark):
    df = spark.createDataFrame([("s", 0, None, None, "T"), ("s", 1, "PRIMARY_TOPIC", "x", None)],
                               "session_id string, row_pos long, Utterance string, Sub_topic string, Type string")
    got = [r.is_meta for r in AN.split_meta_rows(df).orderBy("row_pos").collect()]
    assert got == [False, True]
    sp = [r[0] for r in df.select(AN.speaker_from_type("Type")).collect()]
    assert sp == ["counselor", "client"]


def test_labelled_and_qa_and_corpus(spark):
    d = tempfile.mkdtemp(prefix="pairs-")
    with open(os.path.join(d, "emo.csv"), "w") as f:
        f.write("Situation,emotion,extra\nI won,Joyful,1\n,sad,2\nlost it,,3\n")
    lab = PS.read_labelled_text(spark, os.path.join(d, "emo.csv")).collect()
    assert [(r.utterance, r.emotion) for r in lab] == [("I won", "Joyful")]
    with open(os.path.join(d, "qa.csv"), "w") as f:
        f.write("questionText,answerText\nq1," + "a" * 100 + "\nq2," + "b" * 101 + "\n")
    qa = PS.read_qa_pairs(spark, os.path.join(d, "qa.csv")).collect()
    assert [r.transcript for r in qa] == ["q2"]
    corpus = spark.createDataFrame([("c", "r"), (None, "r2")], "Context string, Response string")
    corpus.write.parquet(os.path.join(d, "corpus"))
    cp = PS.read_corpus_pairs(spark, os.path.join(d, "corpus")).collect()
    assert [(r.transcript, r.reference_summary) for r in cp] == [("c", "r")]
    loaded = PS.load_training_pairs(spark, [lambda: PS.read_corpus_pairs(spark, os.path.join(d, "missing")),
                                            lambda: PS.read_qa_pairs(spark, os.path.join(d, "qa.csv"))])
    assert [r.source_rank for r in loaded.collect()] == [1]
    empty = PS.load_training_pairs(spark, [lambda: PS.read_corpus_pairs(spark, os.path.join(d, "missing"))])
    assert empty.count() == 0 and {"transcript", "reference_summary"} <= set(empty.columns)


def test_positional_split_counts(spark):
    df = spark.range(11).withColumnRenamed("id", "k")
    got = {r.k: r.split for r in PR.positional_split(df, ["k"], 0.9).collect()}
    assert [got[i] for i in range(11)] == ["train"] * 9 + ["validation"] * 2


def test_training_pairs_per_utterance(spark):
    main = spark.createDataFrame([("s", "t", "r")], "session_id string, transcript string, reference_summary string")
    utt = spark.createDataFrame([("s", 0), ("s", 1)], "session_id string, turn long")
    aux = spark.createDataFrame([("q", None), ("q2", "a2")], "transcript string, reference_summary string")
    assert PR.training_pairs(main, aux).count() == 2
    assert PR.training_pairs(main, aux, utt, per_utterance=True).count() == 3


def test_write_results(spark):
    d = tempfile.mkdtemp(prefix="sink-")
    assert PS.read_results(spark, d) == {}
    out = PS.write_results({"a": spark.range(3), "b": spark.range(0)}, d)
    assert spark.read.parquet(out["a"]).count() == 3
    got = PS.read_results(spark, d)
    assert got["a"].count() == 3 and got["b"].columns == ["id"] and got["b"].count() == 0
    PS.write_results({"a": spark.range(5)}, d)
    got = PS.read_results(spark, d)
    assert set(got) == {"a"} and got["a"].count() == 5
    assert [r["n_rows"] for r in PS._manifest(spark, d)[1]] == [5]
    assert PS.write_results({}, d) == {}


def test_write_that_dies_half_way_leaves_the_run_before(spark):
    d = tempfile.mkdtemp(prefix="sink-dies-")
    dies = spark.range(9).select(F.when(F.col("id") > 7, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        PS.write_results({"a": spark.range(4), "b": dies}, d)
    assert PS.read_results(spark, d) == {}
    PS.write_results({"a": spark.range(3), "b": spark.range(2)}, d)
    with pytest.raises(Exception, match="lost"):
        PS.write_results({"a": spark.range(4), "b": dies}, d)
    assert {n: t.count() for n, t in PS.read_results(spark, d).items()} == {"a": 3, "b": 2}
    PS.write_results({"a": spark.range(4), "b": spark.range(6)}, d)
    assert {n: t.count() for n, t in PS.read_results(spark, d).items()} == {"a": 4, "b": 6}


def test_bad_records_are_kept(spark):
    d = tempfile.mkdtemp(prefix="checked-")
    with open(os.path.join(d, "qa.csv"), "w") as f:
        f.write('id,questionText,answerText\n1,q1,' + "a" * 101 + '\n2,"q2\nsecond line",' + "b" * 101 + "\n"
                "3,q3,short\n4,,answer\n5,q5,\n6,q6,one,two\n7,q7\n")
    args = dict(columns=["id", "questionText", "answerText"], question="questionText", answer="answerText")
    pairs, quarantine = PS.load_checked_pairs(spark, {"qa": dict(path=os.path.join(d, "qa.csv"), **args),
                                                      "gone": dict(path=os.path.join(d, "missing"), **args)})
    assert sorted((r.source, r.transcript) for r in pairs.collect()) == [("qa", "q1"), ("qa", "q2\nsecond line")]
    bad = sorted((r.source, r.reason, r.record) for r in quarantine.collect() if r.record)
    assert [b[:2] for b in bad] == [("qa", "malformed")] * 2 + [("qa", "no answer"), ("qa", "no question"), ("qa", "short answer")]
    assert bad[0][2] == "6,q6,one,two" and bad[1][2] == "7,q7" and '"q3"' in bad[4][2]
    assert [tuple(r) for r in quarantine.where("record IS NULL").collect()] == [("gone", None, "unreadable")]


def test_streaming_preprocess(spark):
    from parley.streaming import preprocess_stream
    src = tempfile.mkdtemp(prefix="stream-src-")
    spark.createDataFrame([("s", 0, "Dr. A", "Um I feel hopeless.")],
                          "session_id string, turn long, speaker string, utterance string").write.mode(
        "overwrite").parquet(os.path.join(src, "b0"))
    stream = spark.readStream.schema("session_id string, turn long, speaker string, utterance string").parquet(
        os.path.join(src, "b0"))
    q = preprocess_stream(stream).writeStream.format("memory").queryName("pp").start()
    q.processAllAvailable()
    q.stop()
    r = spark.sql("select * from pp").first()
    assert (r.clean_text, r.role, r.utterance_tier) == ("i feel hopeless.", "counselor", 5)


def test_hash_split_keeps_keys_together(spark):
    df = spark.range(2000).select((F.col("id") % 97).alias("session_id"), F.col("id").alias("row"))
    out = PR.hash_split(df, "session_id", 0.8)
    sides = out.groupBy("session_id").agg(F.countDistinct("split").alias("n")).filter("n > 1").count()
    assert sides == 0
    share = out.filter("split = 'train'").select("session_id").distinct().count() / 97
    assert 0.6 < share < 0.95


def test_sample_rows_is_deterministic(spark):
    from parley.operators.sessions import sample_rows
    df = spark.range(1000).withColumnRenamed("id", "k")
    a = sorted(r.k for r in sample_rows(df, 50, key=["k"]).collect())
    b = sorted(r.k for r in sample_rows(df.repartition(7), 50, key=["k"]).collect())
    assert a == b and len(a) == 50
