"""Stems against the published examples; stemmed overlap against a count by hand."""

from parley.functions.stem import stem_table
from parley.operators import evaluate as EV

EXAMPLES = """caresses caress ponies poni caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor
sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail
filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit
conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic
operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit
sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope
goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust
defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog
communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat
rate rate cease ceas controll control roll roll dies die ties tie dying die using use news news by by s s yes ye yelling yell
toys toy enjoyment enjoy""".split()


def test_published_examples(spark):
    want = dict(zip(EXAMPLES[::2], EXAMPLES[1::2]))
    df = spark.createDataFrame([(t,) for t in [*want, *want, None]], "token string")
    rows = stem_table(df).collect()
    assert len(rows) == len(want)
    assert {r.token: r.stem for r in rows} == want


def test_empty_and_odd_tokens(spark):
    df = spark.createDataFrame([("",), ("42",), ("1980s",), ("yyyy",), ("e" * 5000,)], "token string")
    got = {r.token: r.stem for r in stem_table(df).collect()}
    assert got[""] == "" and got["42"] == "42" and got["1980s"] == "1980" and len(got) == 5
    assert stem_table(df.limit(0)).count() == 0


def test_stemmed_overlap(spark):
    pairs = spark.createDataFrame([("a", "She was hopping and falling", "he hopped, and falls was"), ("b", None, "x")],
                                  "session_id string, candidate string, reference string")
    plain = {r.session_id: r for r in EV.rouge_n(pairs, 1).collect()}
    got = {r.session_id: r for r in EV.rouge_n(pairs, 1, token_table=EV.pair_stems(pairs)).collect()}
    assert (round(plain["a"].f1, 6), round(got["a"].f1, 6)) == (0.4, 0.8)
    assert got["b"].f1 == 0
