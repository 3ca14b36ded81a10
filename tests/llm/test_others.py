"""Operators 1, 4, 5 and 8, the registered queries and the pipeline."""

import base64
import gzip
import hashlib
import io
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import __spark_entry__ as E
import corpus_pipeline
from parley.llm import hamming, quality, simhash, suffix, toxicity, warc
from tools.check_oracle import TABLES, digest

SF = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- quality

def plain_statistics(text):
    word = re.compile("[^\x20\x09-\x0D]+")
    text = text or ""
    w = word.findall(text)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    count, covered, seen, dup = Counter(grams), set(), set(), 0
    for i, g in enumerate(grams):
        if count[g] > 1:
            covered |= {i, i + 1, i + 2}
    for line in text.split("\n"):
        if word.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def quality_rows():
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    text = lambda n, extra="": " ".join(rng.choice(words) + extra for _ in range(n))
    rows = [text(60), text(200, "%%%"), text(80, "!!").upper(), "a b " * 40, text(49), "", None, "x\x0by\x85z　w " * 3, text(30_000),
            "\n".join(rng.choice(["one two three four", "five six seven"]) for _ in range(60)), "#" * 300, "1 2 3 4 " + " ".join(map(str, range(200)))]
    return list(enumerate(rows)) + [(None, rows[0]), (0, rows[0])]


def test_quality_statistics_and_verdict(spark):
    rows = quality_rows()
    df = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, kept boolean").repartition(3)
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept)
                  for r in quality.quality(df).collect())
    want = Counter()
    for i, t in rows:
        s = plain_statistics(t)
        failed = s[0] < 50 or 100 * s[4] > 50 * s[0]
        passes = not failed and not any(rule(quality.read(t)) for rule in quality.RULES.values())
        want[(i, *s, failed, passes)] += 1
    assert got == want
    assert quality.quality(df.limit(0)).count() == 0


def test_order_is_by_rejection_per_cost_and_verdict_is_not():
    seen = [{"rule": "symbols", "seconds": 1.0, "seen": 100, "rejected": 10}, {"rule": "upper", "seconds": 10.0, "seen": 100, "rejected": 50},
            {"rule": "packed", "seconds": 0.5, "seen": 100, "rejected": 20}]
    order = quality.order_rules(seen)
    assert order[:3] == ["packed", "symbols", "upper"] and sorted(order) == sorted(quality.RULES)
    for _, t in quality_rows():
        d = quality.read(t)
        if not d.base_failed:
            assert len({quality.cascade(d, o) for o in (order, order[::-1], list(quality.RULES))}) == 1


def test_cascade_stops_at_the_first_rejection(monkeypatch):
    called = []
    monkeypatch.setattr(quality, "RULES", {n: (lambda d, n=n: called.append(n) or n == "b") for n in "abc"})
    assert not quality.cascade(None, ["a", "b", "c"]) and called == ["a", "b"]


# ---------------------------------------------------------------- exact top-k

def test_search_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    codes = [int(x) for x in rng.integers(-2**63, 2**63, 300)]
    codes += [codes[0] ^ (1 << int(b)) for b in rng.integers(0, 62, 40)] + [codes[1]] * 60 + [0, -1, None]
    rows = [(i, c, 0) for i, c in enumerate(codes)] + [(None, 5, 0), (3, codes[3], 0)]
    df = spark.createDataFrame(rows, "id long, code long, distance int").repartition(3)
    got = {(r.query_id, r["rank"]): (r.neighbour_id, r.distance) for r in hamming.search(df, df.where("id % 20 = 0"), 10).collect()}
    want = {}
    mask = (1 << 64) - 1
    for q, c in enumerate(codes):
        if q % 20 == 0 and c is not None:
            near = sorted((((c ^ x) & mask).bit_count(), i) for i, x in enumerate(codes) if x is not None and i != q)[:10]
            want |= {(q, k + 1): (i, d) for k, (d, i) in enumerate(near)}
    assert got == want


def test_search_with_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, -1.0]), (100, [1.0, 1.0]), (1, None), (2, [])], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, hamming.nearest(df).collect()))
    assert got == [(0, 1, 2, 1), (0, 2, 100, 1), (100, 1, 0, 1), (100, 2, 2, 2)]
    assert hamming.nearest(df.limit(0)).count() == 0


def test_search_of_ids_with_several_codes(spark):
    rng = random.Random(11)
    mask = (1 << 64) - 1
    signed = lambda c: c - (1 << 64) if c >> 63 else c
    rows, near = [], rng.getrandbits(64)
    for i in range(60):
        for _ in range(rng.randint(1, 6)):
            far = rng.getrandbits(64)
            close = near
            for _ in range(rng.randint(0, 4)):
                close ^= 1 << rng.randrange(64)
            rows.append((i, signed(far if rng.random() < 0.3 else close)))
    rows += [(1000 + i, signed(near)) for i in range(30)] + rows[:5] + [(None, 5), (3, None)]
    df = spark.createDataFrame(rows, "id long, code long")
    got = {}
    for r in hamming.search(df, df.where("id % 10 = 0"), 10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.neighbour_id, r.distance))
    whole = [r for r in rows if None not in r]
    for q in {i for i, _ in whole if i % 10 == 0}:
        least = {}
        for own in (c for i, c in whole if i == q):
            for i, c in whole:
                if i != q:
                    d = ((own ^ c) & mask).bit_count()
                    least[i] = min(d, least.get(i, 64))
        want = sorted((d, i) for i, d in least.items())[:10]
        assert sorted(got.pop(q)) == [(k + 1, i, d) for k, (d, i) in enumerate(want)]
    assert not got


# ---------------------------------------------------------------- toxicity

INSULTS = ["grumblehead", "snotface", "dunderpate"]


def toxic_rows(n=400):
    rng = random.Random(5)
    words = {"en": "the of and to in is".split(), "fr": "le les des et est une".split()}
    rows, labels = [], []
    for i in range(n):
        lang = ("en", "fr")[i % 2]
        w = [rng.choice(words[lang]) if rng.random() < 0.4 else "".join(rng.choice("abcdefg") for _ in range(4)) for _ in range(rng.randint(5, 80))]
        toxic = int(rng.random() < 0.25)
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(INSULTS) + rng.choice(["", "s", "er"]))
        rows.append((i, " ".join(w), lang))
        labels.append((i, toxic))
    return rows, labels


def test_toxicity_held_out(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "LEAST_STEPS", 60)
    rows, labels = toxic_rows()
    rows += [(500, None, "en"), (501, "", "en"), (None, "snotface " * 3, "en"), (502, "le les des " * 40_000, "fr"), (7, rows[7][1], "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3)
    table = spark.createDataFrame(labels + [(None, 1), (600, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, table)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    truth = dict(labels)
    held = [r for r in got if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held) and len(held) > 60
    assert sum(r.predicted == truth.get(r.doc_id, 0) for r in held) >= 0.97 * len(held)
    by_id = {r.doc_id: r for r in got}
    assert not by_id[500].predicted and not by_id[501].predicted and not by_id[502].predicted and by_id[None].predicted
    assert not by_id[None].held_out and by_id[502].language == "fr"
    kept = {r.doc_id for r in toxicity.drop_toxic(docs, model).collect()}
    assert kept == {r.doc_id for r in got if not r.predicted}


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()] == [0.0]
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), none)).count() == 0


def test_calibration_is_monotone_and_meets_the_threshold():
    m = toxicity.Model(None, np.zeros((1, 1)), None, None, 0.0, {"": 0.5, "de": 0.9})
    for lang, t in (("de", 0.9), ("en", 0.5)):
        mapped = [m.calibrated(x, lang) for x in np.linspace(0, 1, 101)]
        assert mapped == sorted(mapped) and mapped[0] == 0 and abs(mapped[-1] - 1) < 1e-12
        assert m.calibrated(t, lang) == pytest.approx(0.3)


# ---------------------------------------------------------------- WARC

def test_warc_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    rows = [(i, f"http://x/{i} ü", t) for i, t in enumerate(["aa", "aa", "", None, "é" * 70_000, "\r\n\r\nWARC/1.1", "b"])]
    rows += [(4, None, "é" * 70_000), (None, "n", "aa"), (9, "n", "b"), (9, "n", "other")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'z' AS sha", "1 AS payload").repartition(3)
    got = Counter(map(tuple, warc.archived(pages, f"file://{tmp_path}/a").collect()))
    first = {}
    for i, _, t in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    want = Counter()
    for i, _, t in rows:
        data, least = (t or "").encode(), first[t or ""]
        again = i != least
        want[(i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", least if again else None)] += 1
    assert got == want
    full = warc.read_archives(spark, spark.read.parquet(f"file://{tmp_path}/a/manifest"))
    assert {r.payload.decode() for r in full.collect() if r.record_type == "response"} == {t or "" for _, _, t in rows}
    assert warc.archived(pages.limit(0), f"file://{tmp_path}/b").count() == 0


def test_warc_smallest_revisit_size(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "bbbb"), (4, "u", "bbbb")], "page_id long, url string, html string")
    got = {r.page_id: r.refers_to for r in warc.archived(pages, f"file://{tmp_path}/c", min_revisit_bytes=3).collect()}
    assert got == {1: None, 2: None, 3: None, 4: 3}


def test_warc_reader_is_a_standard_gzip_reader_and_detects_damage():
    records = [warc.record(i, "http://u", b"x" * n) for i, n in enumerate((0, 5, 200_000))]
    data = b"".join(map(warc.member, records))
    assert gzip.decompress(data) == b"".join(records)
    assert [m for _, m in warc.members(io.BytesIO(data), 7)] == records
    for bad in (records[1].replace(b"xxxxx", b"xxxxy"), records[1][:-1], records[1].replace(b"WARC/1.1", b"HTTP/1.1")):
        with pytest.raises(ValueError):
            warc.parse(bad)
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(data[:-3])))


# ---------------------------------------------------------------- queries and pipeline

@pytest.mark.parametrize("name", sorted(n for n in E.oracle_sql() if n.startswith("op")))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = E.queries()[name](spark, SF)
    cur = con.execute(E.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    rows, want = [tuple(r) for r in df.collect()], cur.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert digest(rows, df.columns)[0] == digest(want, names)[0]


def test_thirteen_operators_and_the_pipeline_are_registered():
    names = list(E.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names


def test_pipeline_stages(spark, monkeypatch):
    """Every stage on its own input: columns, and what it may drop or cut."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen, columns = docs, docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, SF)
        assert out.columns == columns, name
        rows = out.collect()
        kept.append(rows)
        seen = spark.createDataFrame(rows, docs.schema)
    toxic, lines, near, spans = kept
    assert len(lines) == len(toxic) <= docs.count() and len(spans) == len(near)
    prints = {r.doc_id: simhash.fingerprint(r.text) for r in near}
    ids = sorted(prints)
    assert not any((prints[a] ^ prints[b]).bit_count() <= 2 for a in ids for b in ids if a < b)
    w = corpus_pipeline.SPAN_BYTES
    data = {r.doc_id: r.text.encode() for r in near}
    windows = Counter(t[k:k + w] for t in data.values() for k in range(len(t) - w + 1))
    want = {}
    for i, t in data.items():
        gone = bytearray(len(t))
        for k in range(len(t) - w + 1):
            if windows[t[k:k + w]] > 1:
                gone[k:k + w] = b"\1" * w
        want[i] = bytes(c for c, g in zip(t, gone) if not g).decode("utf-8", "ignore")
    assert {r.doc_id: r.text for r in spans} == want
    packed = corpus_pipeline.STAGES[-1][1](spark, seen, SF).collect()
    room = defaultdict(int)
    for r in packed:
        room[r.sequence_id] += r.length
    assert {r.doc_id for r in packed} == {r.doc_id for r in spans} and max(room.values()) <= 4096


def test_pipeline_run(spark):
    assert E.queries()["pipeline"](spark, SF).columns == [
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_cut_merges_overlaps():
    assert suffix.cut(b"0123456789", [(2, 4), (3, 6), (8, 9), (6, 7)]) == (b"0179", 2)
    assert suffix.cut(b"01", []) == (b"01", 0)
