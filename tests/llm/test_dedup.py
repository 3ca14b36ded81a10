"""Operators 7, 9 and 10 against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
import xxhash

from parley.llm import linededup, simhash, suffix

RND = random.Random(4)
WORDS = ["".join(RND.choice("abcdefgh") for _ in range(RND.randint(2, 6))) for _ in range(300)]


# ---------------------------------------------------------------- SimHash

def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


def near_texts():
    base = [" ".join(RND.choice(WORDS) for _ in range(RND.randint(60, 200))) for _ in range(12)]
    texts = []
    for b in base:
        for _ in range(6):
            w = b.split()
            w[RND.randrange(len(w))] = RND.choice(WORDS)
            texts.append(" ".join(w))
        texts += [b, b.upper()]
    return texts + ["", None, "  \t", "one", "ONE", "one two", "one two three", "é É"]


def test_simhash_equals_brute_force(spark):
    texts = near_texts()
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, fp string").repartition(4)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()}
    prints = [plain_fingerprint(t) for t in texts]
    want = {i: (f"{p:016x}", c) for (i, p), c in zip(enumerate(prints), plain_components(prints))}
    assert got == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("group", [1, 16])
def test_links_connect_all_close_values(spark, monkeypatch, group):
    """Values in a dense cloud; with a pair limit of 1 all keys take the path of hot keys."""
    from parley.llm.components import connected_components

    monkeypatch.setattr(simhash, "PAIR_GROUP", group)
    rng = random.Random(9)
    values = {0, (1 << 64) - 1}
    for _ in range(4):
        x = rng.getrandbits(64)
        for _ in range(40):
            x ^= 1 << rng.randrange(64)
            if rng.random() < 0.7:
                x ^= 1 << rng.randrange(64)
            values.add(x)
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    found = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"))
    mask = (1 << 64) - 1
    assert all(((r.a ^ r.b) & mask).bit_count() <= 2 for r in found.collect())
    label = {r.node: r.label for r in connected_components(found).collect()}
    want = plain_components([v & mask for v in values])
    assert [label.get(v, v) for v in values] == [values[i] for i in want]


def test_keep_one_keeps_the_smallest_id(spark):
    rows = [(7, "a b c d", 1), (3, "A b c d", 2), (3, "A b c d", 2), (5, "other words here now", 3), (None, "quite another text again", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[1], rows[3], rows[4]], key=str)


def test_keep_one_keeps_a_row_of_every_component(spark):
    """Null ids and repeated ids stand in several components; each component keeps its smallest row."""
    texts = ["first text of its own", "second one about other things", "third thing nobody wrote yet", "fourth and last of them"]
    rows = [(None, texts[0], 1), (None, texts[1], 2), (None, texts[1], 3), (None, texts[2], 4), (8, texts[2].upper(), 5),
            (4, texts[3], 6), (4, "one id names an unrelated text", 7), (None, None, 8), (None, "", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(4)
    kept = sorted(r.n for r in simhash.keep_one(df).collect())
    assert kept[:2] == [1, 2] and kept[2:5] == [5, 6, 7] and kept[5:] in ([8], [9])


def test_keep_one_leaves_as_many_rows_as_components(spark):
    texts = near_texts()
    rows = [(None if i % 3 == 0 else i // 5, t) for i, t in enumerate(texts)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    root = plain_components([plain_fingerprint(t) for t in texts])
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    groups = {}
    for (i, t), c in zip(rows, root):
        groups.setdefault(c, []).append((i, digest(t)))
    want = sorted((min(g, key=order) for g in groups.values()), key=order)
    assert sorted(((r.doc_id, digest(r.text)) for r in kept), key=order) == want


# ---------------------------------------------------------------- lines

def plain_line_dedup(rows, window=3):
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = text.split("\n") if text is not None else []
        gone = set()
        for k in range(len(lines) - window + 1):
            gram = tuple(lines[k:k + window])
            if gram in seen:
                gone.update(range(k, k + window))
            seen.add(gram)
        out.append((i, None if text is None else "\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines), len(gone)))
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(2)
    pool = [f"line {k}" for k in range(12)] + ["", "", " "]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "\n\n\n\n\n"), (None, "line 1\nline 2\nline 3\nnew"), (103, "x\n" * 4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS pos", "'w' AS w1", "2L AS n").repartition(5)
    got = linededup.line_dedup(df, counts=True)
    assert got.columns == [*df.columns, "n_lines", "n_removed"]
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted([(r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()], key=key) == sorted(plain_line_dedup(rows), key=key)
    assert linededup.line_dedup(df.limit(0)).count() == 0


def test_repeated_row_does_not_repeat_itself(spark):
    text = "a\nb\nc\nd"
    df = spark.createDataFrame([(1, text), (1, text), (2, "z\n" + text)], "doc_id long, text string")
    assert sorted(map(tuple, linededup.line_dedup(df).collect())) == [(1, text), (1, text), (2, "z")]


def test_line_dedup_is_native(spark):
    df = spark.createDataFrame([(1, "a\nb\nc")], "doc_id long, text string")
    plan = linededup.line_dedup(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


# ---------------------------------------------------------------- byte strings

def plain_repeats(rows, window):
    data = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(t[k:k + window] for _, t in data for k in range(len(t) - window + 1))
    out = []
    for i, t in data:
        gone = bytearray(len(t))
        for k in range(len(t) - window + 1):
            if count[t[k:k + window]] > 1:
                gone[k:k + window] = b"\1" * window
        kept = bytes(c for c, g in zip(t, gone) if not g)
        runs = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def repeat_rows(seed, n=50):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choice("abcdé \n") for _ in range(k))
    pool = [text(rng.randint(100, 900)) for _ in range(6)]
    part = lambda: rng.choice([text(rng.randint(0, 400)), rng.choice(pool), rng.choice(pool)[rng.randint(0, 90):], "x" * rng.randint(0, 500)])
    rows = [(i, "".join(part() for _ in range(rng.randint(0, 5)))) for i in range(n)]
    return rows + [(900, None), (901, ""), (902, pool[0] * 3), (None, pool[1] + "tail"), (5, rows[5][1]), (5, rows[5][1])]


@pytest.mark.parametrize("tree_group,buffer", [(256, 1 << 20), (3, 700)])
def test_removal_equals_brute_force(spark, monkeypatch, tree_group, buffer):
    monkeypatch.setattr(suffix, "TREE_GROUP", tree_group)
    monkeypatch.setattr(suffix, "BUFFER", buffer)
    rows = repeat_rows(tree_group)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS start", "1 AS gram", "2 AS bytes").repartition(4)
    got = suffix.remove_repeats(df, counts=True)
    assert got.columns == [*df.columns, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    found = sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()], key=str)
    assert found == sorted(plain_repeats(rows, 400), key=str)
    assert next(r.text for r in got.collect() if r.doc_id == 900) is None
    assert suffix.remove_repeats(df.limit(0)).count() == 0


@pytest.mark.parametrize("tree_group", [256, 3])
def test_repeat_groups_have_all_occurrences(spark, monkeypatch, tree_group):
    monkeypatch.setattr(suffix, "TREE_GROUP", tree_group)
    rows = repeat_rows(7, 30)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    groups = defaultdict(Counter)
    for r in suffix.repeat_groups(df).collect():
        groups[r.group, r.length][r.doc_id, r.start] += 1
    assert len(groups) > 10
    data = [(i, (t or "").encode()) for i, t in rows]
    text, covered = dict(data), defaultdict(set)
    for (_, length), places in groups.items():
        i, start = next(iter(places))
        string = text[i][start:start + length]
        want = Counter((j, k) for j, t in data for k in range(len(t) - length + 1) if t[k:k + length] == string)
        assert length >= 400 and sum(want.values()) > 1 and places == want
        for j, k in places:
            covered[j] |= set(range(k, k + length))
    assert {(i, len(covered[i])) for i, _ in data} == {(i, n) for i, _, n, _, _ in plain_repeats(rows, 400)}
    assert suffix.repeat_groups(df.limit(0)).count() == 0


def test_large_groups_are_split_by_shared_strings(spark, monkeypatch):
    """One passage in many documents, whole, cut off or changed inside: far more contexts than a
    task takes; no level makes more than ``SPLIT`` rows of a context."""
    monkeypatch.setattr(suffix, "TREE_GROUP", 8)
    rng = random.Random(4)
    text = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    passage, rows = text(900), []
    for i in range(120):
        p = passage
        if i % 3 == 0:
            p = p[:rng.randint(450, 900)]
        if i % 4 == 0:
            at = rng.randint(0, len(p) - 1)
            p = p[:at] + "#" + p[at + 1:]
        rows.append((i, text(rng.randint(0, 300)) + p + text(rng.randint(0, 300))))
    sizes, original = [], suffix._split

    def counted(contexts, window):
        out = original(contexts, window)
        sizes.append((contexts.count(), out.count()))
        return out

    monkeypatch.setattr(suffix, "_split", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(df, counts=True).collect())
    assert found == sorted(plain_repeats(rows, 400))
    assert sizes and all(after <= suffix.SPLIT * before for before, after in sizes)


def test_scratch_tables_are_dropped(spark):
    import os

    from parley.session import ensure_checkpoint_dir

    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    df = spark.createDataFrame(repeat_rows(1, 10), "doc_id long, text string")
    suffix.remove_repeats(df).count()
    left = [n for n in os.listdir(folder) if n.startswith("suffix-") and not n.startswith("suffix-spans")]
    assert not [n for n in left if not n.startswith("suffix-groups")]


def test_counts_replace_columns_of_their_names(spark):
    df = spark.createDataFrame([(1, "a\nb\nc", "x")], "doc_id long, text string, n_removed string")
    for out in (linededup.line_dedup(df, counts=True), suffix.remove_repeats(df, counts=True)):
        assert len(out.columns) == len(set(out.columns)) and [r.n_removed for r in out.collect()] == [0]


def test_maximal_repeats_have_all_occurrences():
    """Every reported group is maximal on both sides and names all members that share it."""
    rng = random.Random(8)
    anchor = "ANCHOR"
    contexts = []
    for _ in range(40):
        left = "".join(rng.choice("ab") for _ in range(rng.randint(0, 6)))
        right = "".join(rng.choice("ab") for _ in range(rng.randint(0, 6)))
        contexts.append(((left + anchor + right).encode(), len(left)))
    window = 10
    got = {(c[0][c[1] - m:c[1] + d], m, tuple(sorted(who))) for m, d, who in suffix.maximal_repeats(contexts, window)
           for c in [contexts[who[0]]]}
    want = set()
    strings = {(c[o - m:o + d], m) for c, o in contexts for m in range(o + 1) for d in range(len(anchor), len(c) - o + 1) if m + d >= window}
    for s, m in strings:
        who = [i for i, (c, o) in enumerate(contexts) if o >= m and c[o - m:o - m + len(s)] == s]
        before = {contexts[i][0][contexts[i][1] - m - 1:contexts[i][1] - m] if contexts[i][1] > m else (b"", i) for i in who}
        after = {contexts[i][0][contexts[i][1] - m + len(s):][:1] or (b"", i) for i in who}
        if len(who) > 1 and len(before) > 1 and len(after) > 1:
            want.add((s, m, tuple(who)))
    assert got == want


def test_simhash_refuses_distances_it_can_not_link_exactly(spark):
    prints = spark.createDataFrame([(1,), (3,)], "fp long")
    for bits in (-1, 1, 3):
        with pytest.raises(ValueError):
            simhash.links(prints, bits)


def test_sliding_min_and_intervals():
    import numpy as np

    v = np.random.default_rng(0).integers(0, 1 << 60, 1000).astype(np.uint64)
    for w in (1, 7, 336, 1000):
        assert (suffix.sliding_min(v, w) == [v[i:i + w].min() for i in range(1000 - w + 1)]).all()
    assert list(suffix.intervals([0, 2, 3, 1, 0, 2])) == [(3, 1, 2), (2, 0, 2), (1, 0, 3), (2, 4, 5)]
