"""Operators 11 and 12 against brute force, 13 on held-out rows, and joins with hot keys."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from parley.llm import language, negatives, vectorcodes
from parley.llm.attach import attach

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int, code string, number int"


def vector_rows(n=260, dim=16, seed=4):
    """Clusters, ties, repeats, nulls and broken vectors."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 6] * 0.3 + rng.normal(size=dim) * 0.1], int(i % 4)) for i in range(n)]
    rows[30] = (30, rows[31][1], rows[30][2])
    rows += [rows[50], rows[50], rows[100], (100, rows[7][1], 0), (150, rows[3][1], 2)]  # repeated rows and ids
    rows += [(None, rows[8][1], 1), (n, rows[9][1], None), (n + 1, None, 1), (n + 2, [0.1] * (dim - 1) + [NAN], 1),
             (n + 3, [INF] + [0.0] * (dim - 1), 2), (n + 4, [None] + [0.0] * (dim - 1), 2), (n + 5, [0.25] * (dim - 3), 3), (n + 6, [], 3)]
    return rows


def complete(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)


# ---------------------------------------------------------------- codes

def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if complete(v)]
    size = -(-max(len(v) for _, v, _ in kept) // parts) * parts
    kept = [(i, tuple(v) + (0,) * (size - len(v)), label) for i, v, label in kept]
    w = size // parts
    cut = lambda v: [v[p * w:(p + 1) * w] for p in range(parts)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(r[1])[p] for r in first] for p in range(parts)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        members = defaultdict(list)
        for _, v, _ in kept:
            for p, x in enumerate(cut(v)):
                members[p, near(p, x)[1]].append(x)
        for (p, k), xs in members.items():
            books[p][k] = tuple(sum(c) // len(xs) for c in zip(*xs))
    out, totals = [], Counter()
    for i, v, label in kept:
        found = [near(p, x) for p, x in enumerate(cut(v))]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
        totals[label] += out[-1][2]
    sha = vectorcodes.digest(np.array(books))
    return Counter((i, code, error, totals[label], sha) for i, code, error, label in out)


def test_codes_equal_brute_force(spark, monkeypatch):
    rows = vector_rows()
    assert Counter(map(tuple, vectorcodes.compress(frame(spark, rows)).collect())) == plain_codes(rows)
    monkeypatch.setattr(vectorcodes, "ROWS", 7)
    few = rows[:9] + rows[-8:]
    assert Counter(map(tuple, vectorcodes.compress(frame(spark, few)).collect())) == plain_codes(few)
    assert vectorcodes.compress(frame(spark, rows).limit(0)).count() == 0
    assert vectorcodes.compress(frame(spark, [r for r in rows if not complete(r[1])])).count() == 0


@pytest.mark.parametrize("step", [1, 40, None, 100_000])
def test_grid_is_exact_for_any_cell_width_and_memo(step, monkeypatch):
    rng = np.random.default_rng(1)
    parts = np.vstack([rng.integers(-900, 900, (600, 3)), np.repeat(rng.integers(-5, 5, (50, 3)), 4, axis=0)])
    entries = np.vstack([parts[:9], parts[:3], [[0, 0, 0]]])  # equal entries: the lower number wins
    monkeypatch.setattr(vectorcodes, "MEMO_CELLS", 100)
    grid = vectorcodes.Grid(entries)
    grid.step = step or grid.step
    full = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
    for _ in range(2):
        best, distance = grid.nearest(parts)
        assert (best == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()
    # no entry that is nearest somewhere in a box is left out of its cell
    if step == 40:
        assert grid.evaluated < 2 * full.size / 2


def test_grid_separates_cells_that_share_a_key():
    grid = vectorcodes.Grid(np.array([[0, 0], [50, 50]]))
    grid.step, grid.mul = 10, np.zeros(2, np.uint64)
    parts = np.array([[1, 1], [49, 49], [-30, 2], [26, 26]])
    assert grid.nearest(parts)[0].tolist() == [0, 1, 0, 1]


def test_codes_refuse_what_does_not_fit(spark):
    df = spark.createDataFrame([(1, [1e30], 0)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="exceeds"):
        vectorcodes.compress(df).collect()


# ---------------------------------------------------------------- hard negatives

def plain_negatives(rows, every=50):
    rows = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if label is not None and complete(v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = Counter()
    for k, (i, v, label) in enumerate(rows):
        if i is None or i % every:
            continue
        scored = sorted(((-dot(v, w), j is None, j or 0, j, other) for m, (j, w, other) in enumerate(rows) if m != k), key=lambda s: s[:3])
        for s, _, _, j, _ in [s for s in scored if s[4] == label][:5]:
            inside = [n for n in scored if n[4] != label and 50 * -s <= 100 * -n[0] <= 95 * -s][:3]
            for rank, n in enumerate(inside, 1):
                out[i, j, rank, n[3], -s, -n[0]] += 1
    return out


@pytest.mark.parametrize("dim,every", [(16, 10), (70, 50)])
def test_negatives_equal_brute_force(spark, monkeypatch, dim, every):
    rows = vector_rows(dim=dim)
    want = plain_negatives(rows, every)
    assert len(want) > 20
    assert Counter(map(tuple, negatives.mine(frame(spark, rows), anchor_every=every).collect())) == want
    # several blocks and parts, rows in small pieces
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", 4)
    monkeypatch.setattr(negatives, "PART_ROWS", 60)
    monkeypatch.setattr(negatives, "ROWS", 13)
    assert Counter(map(tuple, negatives.mine(frame(spark, rows), anchor_every=every).collect())) == want


def test_negatives_of_little_input(spark):
    rows = vector_rows()
    assert negatives.mine(frame(spark, rows).limit(0)).count() == 0
    assert negatives.mine(frame(spark, rows[:1])).count() == 0
    zero = [(0, [0.0, 0.0], 1), (1, [0.0, 0.0], 1), (2, [0.0, 0.0], 2)]
    assert [tuple(r) for r in negatives.mine(frame(spark, zero)).collect()] == [(0, 1, 1, 2, 0, 0)]
    far = [(0, [1.0], 1), (1, [-1.0], 1), (2, [-0.6], 2)]
    assert negatives.mine(frame(spark, far)).count() == 0


def test_intervals_hold_every_score_and_narrow():
    rng = np.random.default_rng(2)
    ints = np.vstack([rng.integers(-300, 300, (400, 128)), np.zeros((1, 128), np.int64), rng.integers(-2**25, 2**25, (20, 128))])
    turn = negatives.rotation(128)
    rows = negatives.encode(ints, turn)
    for k in (0, 1, 400, 410):
        anchor, widths = negatives.Anchor(ints[k], turn), []

        def keep(chosen, low, high, k=k, widths=widths):
            exact = np.array([sum(int(a) * int(b) for a, b in zip(ints[c], ints[k])) for c in chosen], dtype=float)
            assert ((low <= exact) & (exact <= high)).all()
            widths.append(float((high - low).mean()))
            return np.ones(len(chosen), bool)

        anchor.narrowed(rows, np.arange(len(ints)), keep)
        assert len(widths) == negatives.LEVELS and (k == 400 or widths == sorted(widths, reverse=True))


def test_relabelling(spark):
    df = spark.createDataFrame([(0, 9), (7, 3), (8, 3), (14, None)], "vec_id long, label int")
    assert [r.label for r in negatives.relabelled(df).orderBy("vec_id").collect()] == [0, 4, 3, None]


# ---------------------------------------------------------------- language

def tongues(n=400):
    """Invented words over related and unrelated languages."""
    rng = random.Random(8)
    parts = {"en": "the ing and tion ough", "de": "der ung sch keit und", "fr": "eau les oir ment que", "es": "ción los ado que ñar", "xx": "qat uqp zqa qqo qen"}
    rows = []
    for i in range(n):
        lang = list(parts)[i % 5]
        words = ["".join(rng.choice(parts[lang].split()) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(2, 40))]
        rows.append((i, " ".join(words), lang))
    return rows


def test_language_held_out(spark):
    rows = tongues()
    rows += [(900, None, "en"), (901, "", "en"), (902, "12 34 !?\n_", "de"), (None, "the ing and", None), (903, "sch" * 50_000, None), (7, *rows[7][1:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'a' AS source", "1 AS score").repartition(3)
    model = language.fit(docs)
    assert [g for g in model.families] == [["de", "en"], ["xx"], ["es", "fr"]] and set(model.by_pair) == {("de", "en"), ("es", "fr")}
    got = language.predict(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in got if r.held_out and r.lang_pred != "und"]
    assert len(held) > 60 and all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[k].lang_pred == "und" and by_id[k].score == 0 for k in (900, 901, 902))
    assert by_id[None].lang_pred == "en" and not by_id[None].held_out and by_id[903].lang_pred == "de"
    # held-out rows, their languages and the order of rows teach nothing
    other = docs.selectExpr("doc_id", "text", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2 THEN 'fr' ELSE lang END AS lang")
    again = {r.doc_id: tuple(r) for r in language.predict(docs, language.fit(other.repartition(2))).collect()}
    assert again == {r.doc_id: tuple(r) for r in got}
    assert language.predict(docs.limit(0), model).count() == 0


def test_language_with_little_to_learn(spark):
    one = spark.createDataFrame([(1, "der und", "de")], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in language.predict(one, language.fit(one)).collect()] == ["de"]
    none = one.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")
    assert [tuple(r)[2:] for r in language.predict(one, language.fit(none)).collect()] == [("und", 0.0)]
    assert [tuple(r)[2:] for r in language.predict(one, language.fit(one.limit(0))).collect()] == [("und", 0.0)]


def test_language_sample_is_bounded_and_fair(spark):
    rows = [(i, "der und", "de") for i in range(300)] + [(1000 + i, "the and", "en") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []

    def caught(sample, families):
        seen.extend(sample)
        return language.Model([], np.zeros((language.BUCKETS, 0)), np.zeros(0), [], {})

    original, language.train = language.train, caught
    try:
        language.fit(docs, sample_rows=20)
    finally:
        language.train = original
    folds = [zlib.crc32(str(1000 + i).encode()) % 4 != 2 for i in range(5)]
    assert len(seen) == 20 and sum(lang == "en" for lang, _ in seen) == sum(folds)


def test_scores_do_not_depend_on_memo_or_pieces(monkeypatch):
    rows = [(lang, text) for _, text, lang in tongues(120)]
    model, texts = language.train(rows), [t for _, t in rows] + [None, "", "the " * 500]
    a = language.Scorer(model).predict_all(texts)
    assert a == [language.Scorer(model).predict(language.words_of(t)) for t in texts]
    monkeypatch.setattr(language, "MEMO_WORDS", 10)
    monkeypatch.setattr(language, "NEW_WORDS", 3)
    assert a == language.Scorer(model).predict_all(texts)
    monkeypatch.setattr(language, "PIECE", 7)
    b = language.Scorer(model).predict_all(texts)
    assert [x[0] for x in a] == [x[0] for x in b] and np.allclose([x[1] for x in a], [x[1] for x in b])


def test_word_features_depend_on_the_word_alone():
    words = ["a", "été", "straße", "x" * 32, "日本語", "a", "ab"]
    found, starts = language.features(words)
    assert starts.tolist() == [0, *np.cumsum([4 * len(w) + 1 for w in words])[:-1].tolist()]
    for w, got in zip(words, np.split(found, starts[1:])):
        assert got.tolist() == language.features([w])[0].tolist() and len(got) == 4 * len(w) + 1
    assert len(set(found.tolist())) > 60


# ---------------------------------------------------------------- joins with hot keys

@pytest.mark.parametrize("how", ["inner", "left"])
def test_attach_with_hot_null_and_missing_keys(spark, how):
    rng = random.Random(2)
    rows = [(rng.choice(["hot"] * 9 + [None, "b", f"c{k}"]), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "key string, k int").repartition(4)
    values = df.groupBy("key").agg({"*": "count", "k": "sum"}).toDF("key", "n", "total").where("key IS NULL OR key <> 'b'")
    total = defaultdict(int)
    for key, k in rows:
        total[key] += k
    want = Counter((key, k, None if key == "b" else total[key]) for key, k in rows if how == "left" or key != "b")
    assert Counter(map(tuple, attach(df, values, ["key"], "n", how).collect())) == want
    assert attach(df.limit(0), values.limit(0), ["key"], "n", how).count() == 0
