"""Removal of repeated byte strings with an enhanced suffix array (operator 10).

Every byte that a string of ``window`` bytes covers is removed if that string also
starts anywhere else in the table. All strings are judged on the input.

Method, in three steps:

1. *Anchors.* Each window of ``window`` bytes is assigned to its minimizer: the
   place inside it whose next ``GRAM`` bytes have the smallest hash. Equal windows
   have their anchor at the same distance, so two copies of a string always meet
   under the hash of that gram, and one row stands for the run of windows (its
   *context*) that share an anchor. Anchors are found once; those whose gram repeats
   are written to a table that everything else reads. Equal contexts are merged by
   hash and count first: a passage that a third of all documents share is one row.
2. *Interval tree.* Under each gram with different contexts, the suffixes that start
   at the anchors are sorted (a suffix array sampled at the anchors), neighbours'
   common prefixes are taken, and a stack scan yields the tree of common-prefix
   intervals. In every interval the texts to the left are tested in the same way
   for the diversity of their left extensions; intervals that are diverse on
   both sides are the maximal repeats.
3. *Removal.* Spans of what repeats go back to their documents, are merged and cut out.
   ``repeat_groups`` returns the groups themselves with all their occurrences.

A group of more than ``TREE_GROUP`` different contexts is not gathered in one task. It is
split by longer shared strings: its windows are cut into ``SPLIT`` ranges, from those that
reach furthest right of the anchor to those that reach furthest left, and a context goes
on in each range under the bytes that all windows of the range hold. Two equal windows
stay together in their range. Contexts that are equal as far as the windows of a range
reach are merged again, and the parts go through step 2, or are split once more: ``SPLIT``
rows at most for each context and level, and after five levels one window is left,
whose equal contexts are all merged.

Defined results:
* null text counts as empty; texts shorter than ``window`` bytes keep all bytes;
* bytes are those of UTF-8; the text that ``remove_repeats`` returns leaves out the
  remains of a character that was cut (a null text stays null);
* rows that repeat id and text are two documents, so each repeats the other;
* null ids are ids like others; an empty table gives no rows;
* all columns are kept; helper columns have names that start with ``_sa_``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.attach import attach
from parley.llm.batches import shipped, slices
from parley.llm.scratch import Scratch

#: Bytes of a gram (a power of two, less than the window).
GRAM = 64
#: Bytes hashed at once; a position inside them and a hash share 64 bits.
BUFFER, POSITION_BITS = 1 << 20, 21
#: Most different contexts of a group that one task sorts; larger groups are split.
TREE_GROUP = 256
#: Ranges into which a large group's windows are cut.
SPLIT = 4

_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes at every position, by doubling."""
    h, m, mul = data.astype(np.uint64) + np.uint64(1), 1, _MUL
    with np.errstate(over="ignore"):
        while m < GRAM:
            h = h[:-m] * mul + h[m:]
            m, mul = 2 * m, mul * mul
        h ^= h >> np.uint64(32)
        h *= _MIX
        h ^= h >> np.uint64(29)
        h *= _MUL
        h ^= h >> np.uint64(32)
    return h


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, in linear time."""
    n = len(v) - width + 1
    rows = -(-len(v) // width)
    grid = np.full(rows * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    grid[:len(v)] = v
    grid = grid.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


def anchors(texts: list[bytes], window: int) -> Iterator[tuple[int, int, int, int, int, bytes]]:
    """``(text number, anchor, first window, bytes of the context, gram hash, context hash)``."""
    held, size = [], 0
    for k, text in enumerate(texts):
        for start in range(0, len(text) - window + 1, BUFFER):
            part = text[start:start + BUFFER + window - 1]
            if size + len(part) > BUFFER + window - 1 and held:
                yield from _anchors(held, window)
                held, size = [], 0
            held.append((k, start, part))
            size += len(part)
    if held:
        yield from _anchors(held, window)


def _anchors(held: list[tuple[int, int, bytes]], window: int) -> Iterator[tuple[int, int, int, int, int, bytes]]:
    joined = b"".join(p for _, _, p in held)
    h = gram_hashes(np.frombuffer(joined, np.uint8))
    low = np.uint64((1 << POSITION_BITS) - 1)
    least = sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), window - GRAM + 1)
    at = 0
    view = memoryview(joined)
    for k, start, part in held:
        runs = least[at:at + len(part) - window + 1]
        first = np.concatenate(([0], np.flatnonzero(runs[1:] != runs[:-1]) + 1))
        last = np.append(first[1:], len(runs)) - 1
        place = (runs[first] & low).astype(np.int64)
        grams = h[place].view(np.int64).tolist()
        shift = start - at
        for p, a, b, g in zip(place.tolist(), (first + at).tolist(), (last + at).tolist(), grams):
            yield k, p + shift, a + shift, b - a + window, g, xxhash.xxh3_128_digest(view[a:b + window])
        at += len(part)


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """``(depth, first, last)`` of the common-prefix intervals of a sorted list whose
    neighbours ``i - 1, i`` share ``lcp[i]`` bytes, children before parents."""
    stack = [(0, 0)]
    n = len(lcp)
    for i in range(1, n + 1):
        shared = lcp[i] if i < n else 0
        first = i - 1
        while stack[-1][0] > shared:
            depth, first = stack.pop()
            yield depth, first, i - 1
        if stack[-1][0] < shared:
            stack.append((shared, first))


def _sorted_with_lcp(strings: list[bytes], members: list[int]) -> tuple[list[int], list[int]]:
    order = sorted(members, key=strings.__getitem__)
    return order, [0, *(common_prefix(strings[x], strings[y]) for x, y in zip(order, order[1:]))]


def maximal_repeats(contexts: list[tuple[bytes, int]], window: int) -> Iterator[tuple[int, int, list[int]]]:
    """``(left, right, members)`` of the maximal repeats of ``window`` bytes or more that
    contain the anchor: its members share ``left`` bytes before and ``right`` bytes
    from the anchor on, and differ on both sides. Contexts are ``(bytes, anchor)``."""
    right = [c[o:] for c, o in contexts]
    left = [c[:o][::-1] for c, o in contexts]
    suffixes, lcp = _sorted_with_lcp(right, list(range(len(contexts))))
    rank = {x: i for i, x in enumerate(suffixes)}
    for depth, first, last in intervals(lcp):
        members = suffixes[first:last + 1]
        before, shared = _sorted_with_lcp(left, members)
        groups = list(intervals(shared))
        if min(shared[1:]) == 0:
            groups.append((0, 0, len(before) - 1))  # they differ right before the anchor
        for more, lo, hi in groups:
            if more + depth < window:
                continue
            found = before[lo:hi + 1]
            ranks = sorted(rank[x] for x in found)
            # right-diverse: not all of them inside one child of the interval
            if min(lcp[ranks[0] + 1:ranks[-1] + 1]) == depth:
                yield more, depth, found


def _reaches(rows: list[tuple[bytes, int]], window: int) -> Iterator[tuple[int, int, int]]:
    """``(row, left, right)``: how far the repeats of each row reach from its anchor."""
    far: dict[int, list[int]] = {}
    for left, right, members in maximal_repeats(rows, window):
        for x in members:
            reach = far.setdefault(x, [0, 0])
            reach[0] = max(reach[0], left)
            reach[1] = max(reach[1], right)
    for x, (left, right) in far.items():
        yield x, left, right


def _key_type(docs: DataFrame, id_col: str) -> str:
    return docs.schema[id_col].dataType.simpleString()


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("_sa_id"), F.xxhash64(text_col).alias("_sa_text"), F.col(text_col).alias("text"))


def anchor_table(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """One row per anchor: its document, place, context and hashes. A narrow map over the scan."""
    types = f"_sa_id {_key_type(docs, id_col)}, _sa_text bigint, at bigint, first bigint, size int, gram bigint, c1 bigint, c2 bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            texts = [(t or "").encode("utf-8", "replace") for t in part.column(2).to_pylist()]
            found = list(anchors(texts, window))
            if not found:
                continue
            k, at, first, size, gram, context = zip(*found)
            halves = np.frombuffer(b"".join(context), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([
                part.column(0).take(pa.array(k)), part.column(1).take(pa.array(k)), pa.array(at, pa.int64()), pa.array(first, pa.int64()),
                pa.array(size, pa.int32()), pa.array(gram, pa.int64()), pa.array(np.ascontiguousarray(halves[:, 0])), pa.array(np.ascontiguousarray(halves[:, 1]))],
                ["_sa_id", "_sa_text", "at", "first", "size", "gram", "c1", "c2"])

    rows = _keyed(shipped(docs), id_col, text_col).where(F.octet_length("text") >= window)
    return rows.mapInArrow(run, types)


#: A group of contexts: gram, windows (by distance of the anchor from their start), shared bytes.
GROUP = ["gram", "lo", "hi", "core"]
#: A context of a group, and a place in a document.
CONTEXT = [*GROUP, "c1", "c2"]
PLACE = ["_sa_id", "_sa_text", "at"]
#: The context that one of a split group was cut from (of the same gram).
PARENT = [f"p_{c}" for c in CONTEXT[1:]]


def _digest(data: bytes) -> tuple[int, int]:
    full = xxhash.xxh3_128_digest(data)
    return int.from_bytes(full[:8], "little", signed=True), int.from_bytes(full[8:], "little", signed=True)


def _with_bytes(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``wanted`` contexts with their ``bytes``, which begin at ``first``; gathered by document."""
    carried = [c for c in wanted.columns if c not in ("_sa_id", "_sa_text")]
    by_doc = wanted.groupBy("_sa_id", "_sa_text").agg(F.collect_list(F.struct(*carried)).alias("places")).select(
        F.col("_sa_id").alias("id"), F.col("_sa_text").alias("hash"), "places")
    texts = _keyed(docs, id_col, text_col).where(F.col("text").isNotNull())
    # a context names one row of its document; of repeated rows any supplies the same bytes
    rows = texts.join(by_doc, F.col("_sa_id").eqNullSafe(F.col("id")) & (F.col("_sa_text") == F.col("hash")))
    types = {c: wanted.schema[c].dataType.simpleString() for c in wanted.columns}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 2 << 20):
            data: dict[str, list] = {c: [] for c in [*carried, "bytes"]}
            owner = []
            for k, (text, places) in enumerate(zip(part.column("text").to_pylist(), part.column("places").to_pylist())):
                text = text.encode("utf-8", "replace")
                for p in places:
                    for c in carried:
                        data[c].append(p[c])
                    owner.append(k)
                    data["bytes"].append(text[p["first"]:p["first"] + p["size"]])
            if owner:
                rows = pa.array(owner, pa.int64())
                kinds = {"int": pa.int32(), "bigint": pa.int64()}
                yield pa.RecordBatch.from_arrays(
                    [part.column("_sa_id").take(rows), part.column("_sa_text").take(rows)]
                    + [pa.array(data[c], kinds[types[c]]) for c in carried] + [pa.array(data["bytes"], pa.binary())],
                    ["_sa_id", "_sa_text", *carried, "bytes"])

    schema = ", ".join(f"{c} {types[c]}" for c in ["_sa_id", "_sa_text", *carried])
    return rows.select("_sa_id", "_sa_text", "text", "places").mapInArrow(run, schema + ", bytes binary")


def _tree(contexts: DataFrame, window: int, every: bool) -> DataFrame:
    """The contexts' ``left, right`` reach by the interval tree of their group; with ``every``, one
    row for each maximal repeat of the group instead, named by the hash of its bytes."""
    out_columns = [*CONTEXT, *PLACE, "left", "right", "g1", "g2"]
    types = {c: contexts.schema[c].dataType.simpleString() for c in [*CONTEXT, *PLACE]}

    def found(rows: list[tuple]) -> Iterator[tuple]:
        seen = [(r[0], r[1]) for r in rows]
        if len(seen) < 2:
            return
        if every:
            for left, right, members in maximal_repeats(seen, window):
                data, at = seen[members[0]]
                name = _digest(data[at - left:at + right])
                yield from ((x, left, right, *name) for x in members)
        else:
            yield from ((x, left, right, None, None) for x, left, right in _reaches(seen, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, key, held, kinds = [], None, [], None

        def close() -> None:
            held.extend((*group[x][2], left, right, g1, g2) for x, left, right, g1, g2 in found(group))

        def sent() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*held), kinds)], out_columns)
            held.clear()
            return batch

        for batch in batches:
            kinds = [batch.schema.field(c).type for c in [*CONTEXT, *PLACE]] + [pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            cols = [batch.column(c).to_pylist() for c in [*CONTEXT, *PLACE]]
            for row, data, at, first in zip(zip(*cols), batch.column("bytes").to_pylist(), batch.column("at").to_pylist(),
                                            batch.column("first").to_pylist()):
                if row[:len(GROUP)] != key:
                    close()
                    group, key = [], row[:len(GROUP)]
                    if len(held) > 10_000:
                        yield sent()
                group.append((data, at - first, row))
        close()
        if held:
            yield sent()

    schema = ", ".join(f"{c} {types[c]}" for c in [*CONTEXT, *PLACE]) + ", left int, right int, g1 bigint, g2 bigint"
    return contexts.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(run, schema)


def _split(contexts: DataFrame, window: int) -> DataFrame:
    """Contexts of large groups in the ranges of their windows: each row is cut to the bytes that
    the range's windows reach, and grouped by those that all of them hold."""
    carried = ["_sa_id", "_sa_text", "at", "weight", *PARENT]
    names = [*CONTEXT, *carried, "first", "size", "bytes"]
    types = {c: contexts.schema[c].dataType.simpleString() for c in names if c not in PARENT}
    types |= {f"p_{c}": types[c] for c in CONTEXT[1:]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(x, 2000) for x in range(0, whole.num_rows, 2000)):
                out, owner = [], []
                cols = [batch.column(c).to_pylist() for c in ("gram", "lo", "hi", "at", "first", "bytes")]
                for k, (gram, lo, hi, at, first, data) in enumerate(zip(*cols)):
                    o = at - first
                    step = -(-(hi - lo + 1) // SPLIT)
                    for a in range(lo, hi + 1, step):
                        b = min(a + step - 1, hi)
                        # windows that the context has: their start lies s bytes before the anchor
                        s, e = max(a, o - (len(data) - window)), min(b, o)
                        if s <= e:
                            reach = data[o - e:o - s + window]
                            out.append((gram, a, b, _digest(data[o - a:o - b + window])[0], *_digest(reach), at - e, len(reach), reach))
                            owner.append(k)
                if out:
                    gram, a, b, core, c1, c2, first, size, reach = (list(c) for c in zip(*out))
                    rows = pa.array(owner, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(gram, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(core, pa.int64()),
                         pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), *[batch.column(c.removeprefix("p_")).take(rows) for c in carried],
                         pa.array(first, pa.int64()), pa.array(size, pa.int32()), pa.array(reach, pa.binary())], names)

    return contexts.where("lo < hi").select(*[c for c in names if c not in PARENT]).mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in names))


def _repeats(docs: DataFrame, id_col: str, text_col: str, window: int, every: bool, scratch: Scratch) -> list[tuple[DataFrame, DataFrame]]:
    """By level of splitting: the occurrences of contexts, and what repeats of them.

    Occurrences have ``CONTEXT``, ``PLACE`` and, below the first level, ``PARENT``.
    Repeats have ``CONTEXT``, a ``PLACE`` (null: all places of the context), ``left, right`` and,
    with ``every``, the group's name ``g1, g2``; those of a large group are then all found in its
    parts, where a context counts for all its copies.
    """
    if window < 2 * GRAM:
        raise ValueError(f"window must be {2 * GRAM} bytes or more")
    found = scratch.table(anchor_table(docs, id_col, text_col, window), "anchors")
    grams = scratch.table(found.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"), "grams")
    rows = scratch.table(attach(found, grams, ["gram"], "n").select(
        "gram", F.lit(0).alias("lo"), F.lit(window - GRAM).alias("hi"), F.lit(0).cast("long").alias("core"), "c1", "c2",
        *PLACE, "first", "size", F.lit(1).cast("long").alias("weight")), "level0")
    scratch.drop("anchors")
    levels = []
    for level in range(window.bit_length() + 2):
        values = [c for c in rows.columns if c not in (*CONTEXT, *PARENT, "weight")]
        merged = scratch.table(rows.groupBy(*CONTEXT).agg(F.sum("weight").alias("copies"), *[F.first(c).alias(c) for c in values]), f"merged{level}")
        # all windows of a context with copies repeat
        copied = merged.where("copies > 1").select(
            *CONTEXT, *[F.lit(None).cast(merged.schema[c].dataType).alias(c) for c in PLACE], (F.col("at") - F.col("first")).cast("int").alias("left"),
            (F.col("first") + F.col("size") - F.col("at")).cast("int").alias("right"), F.col("c1").alias("g1"), F.col("c2").alias("g2"), "copies")
        groups = scratch.table(merged.groupBy(*GROUP).agg(F.count("*").alias("n"), F.count("*").alias("contexts")).where("n > 1"), f"groups{level}")
        wanted = attach(merged, groups, GROUP, "n")
        contexts = wanted if "bytes" in wanted.columns else _with_bytes(docs, wanted, id_col, text_col)
        contexts = scratch.table(contexts.withColumn("weight", F.col("copies") if every else F.lit(1).cast("long")), f"contexts{level}")
        if every:
            copied = copied.join(groups.where(F.col("contexts") > TREE_GROUP).select(*GROUP), GROUP, "left_anti")
        tree = _tree(contexts.where(F.col("contexts") <= TREE_GROUP), window, every).withColumn("copies", F.lit(None).cast("long"))
        levels.append((rows, tree.unionByName(copied)))
        large = contexts.where(F.col("contexts") > TREE_GROUP)
        if groups.where(F.col("contexts") > TREE_GROUP).isEmpty():
            return levels
        rows = scratch.table(_split(large, window), f"level{level + 1}")
    raise AssertionError("windows of one place differ")


def spans_by_document(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 400) -> DataFrame:
    """``_sa_id, _sa_text, spans``: byte spans ``(start, end)`` whose union is what repeats of a document."""
    scratch = Scratch(docs.sparkSession, "suffix")
    spans = []
    for rows, repeats in _repeats(docs, id_col, text_col, window, False, scratch):
        names = [*PLACE[:2], (F.col("at") - F.col("left")).alias("start"), (F.col("at") + F.col("right")).alias("end")]
        # a context with copies repeats as a whole wherever it is, so the tree's reach matters for single ones
        whole = repeats.where("copies IS NOT NULL").drop(*PLACE, "g1", "g2")
        spans += [repeats.where("copies IS NULL").select(*names), attach(rows, whole, CONTEXT, "copies").select(*names)]
    union = spans[0]
    for more in spans[1:]:
        union = union.unionByName(more)
    by_doc = union.groupBy(*PLACE[:2]).agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    kept = Scratch(docs.sparkSession, "suffix-spans").table(by_doc, "spans")  # the result reads it
    scratch.drop()
    return kept


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 400) -> DataFrame:
    """All maximal repeats with all their occurrences: ``group`` (hash of the repeated bytes),
    ``length``, ``<id_col>`` and the byte ``start`` of each. A string that repeats beyond its
    anchor's windows is reported anchor by anchor. Rows that repeat id and text occur once each.
    """
    scratch = Scratch(docs.sparkSession, "suffix-groups")
    levels = _repeats(docs, id_col, text_col, window, True, scratch)
    told = ["left", "right", "g1", "g2"]
    named = None
    for level in range(len(levels) - 1, -1, -1):
        rows, repeats = levels[level]
        here = repeats.select(*CONTEXT, *told)
        named = (here if named is None else named.unionByName(here)).distinct()
        if level:  # to all contexts of the level above that were cut to these
            up = rows.select(*CONTEXT, *PARENT).distinct()
            named = named.join(up, CONTEXT).select("gram", *[F.col(p).alias(c) for p, c in zip(PARENT, CONTEXT[1:])], *told)
    found = named.join(levels[0][0].select(*CONTEXT, *PLACE), CONTEXT).select(
        *PLACE[:2], (F.col("at") - F.col("left")).alias("start"), (F.col("left") + F.col("right")).alias("length"), "g1", "g2")
    group = F.concat(F.lpad(F.hex("g2"), 16, "0"), F.lpad(F.hex("g1"), 16, "0")).alias("group")
    # several anchors may show the same repeat; repeated rows of a document are told apart by count
    key = [*PLACE[:2], "start", "length", "g1", "g2"]
    once = found.distinct()
    copies = _keyed(docs, id_col, text_col).groupBy(*PLACE[:2]).agg(F.count("*").alias("rows")).where("rows > 1")
    extra = once.join(copies.select(F.col("_sa_id").alias("i"), F.col("_sa_text").alias("t"), "rows"),
                      F.col("_sa_id").eqNullSafe(F.col("i")) & (F.col("_sa_text") == F.col("t")), "left")
    expanded = extra.withColumn("k", F.explode(F.sequence(F.lit(1), F.coalesce("rows", F.lit(1))))).select(*key)
    return expanded.select(group, "length", F.col("_sa_id").alias(id_col), "start")


def cut(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """The bytes outside the spans, and the number of maximal runs cut out."""
    kept, at, runs, end = [], 0, 0, -1
    for s, e in sorted(spans):
        if s > end:
            kept.append(data[at:s])
            runs += 1
        end = max(end, e)
        at = end
    kept.append(data[at:])
    return b"".join(kept), runs


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 400,
                   counts: bool = False) -> DataFrame:
    """``docs`` with the repeated bytes cut out of ``text_col``; with ``counts`` also
    ``n_bytes, n_removed, n_spans, kept_sha256`` (of the bytes that remain), in place of
    any columns of those names."""
    spans = spans_by_document(docs, id_col, text_col, window).withColumnRenamed("spans", "_sa_spans")
    rows = docs.withColumn("_sa_hash", F.xxhash64(text_col)).join(
        spans, F.col(id_col).eqNullSafe(F.col("_sa_id")) & (F.col("_sa_hash") == F.col("_sa_text")), "left")

    # an Arrow batch is held at once as the engine makes it; each text is cut on its own
    @F.pandas_udf("text string, n_removed bigint, n_spans bigint, kept_sha256 string")
    def cut_udf(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for t, found in zip(text, spans):
            if t is None or found is None:
                out.append((None, 0, 0, None))
                continue
            data = t.encode("utf-8", "replace")
            kept, runs = cut(data, [(s["start"], s["end"]) for s in found])
            out.append((kept.decode("utf-8", "ignore"), len(data) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
        return pd.DataFrame(out, columns=["text", "n_removed", "n_spans", "kept_sha256"])

    # only the texts that lose bytes go through Python
    hit = F.col("_sa_spans").isNotNull()
    rows = rows.withColumn("_sa_cut", cut_udf(F.when(hit, F.col(text_col)), F.col("_sa_spans")))
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    extra = [
        F.octet_length(data).cast("long").alias("n_bytes"), F.col("_sa_cut.n_removed").alias("n_removed"),
        F.col("_sa_cut.n_spans").alias("n_spans"), F.coalesce("_sa_cut.kept_sha256", F.sha2(data, 256)).alias("kept_sha256"),
    ] if counts else []
    text = F.when(hit, F.col("_sa_cut.text")).otherwise(F.col(text_col)).alias(text_col)
    own = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] if counts else []
    return rows.select(*[text if c == text_col else F.col(c) for c in docs.columns if c not in own], *extra)
