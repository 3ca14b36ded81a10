"""Severity tiers from a phrase lexicon of any size (a table, not a ``CASE`` chain).

Phrases of up to ``WINDOW`` bytes are found by their openings. The opening of a phrase is its
first 1, 2, 4, 8, ... bytes, the largest such number that it has. One numpy pass over the bytes of the
texts takes the hash of every stretch of an opening's size (sums of a prefix, so that a
stretch of any length costs the same). Where that may be an opening, the stretches as long as its phrases
are looked at. Those that may be phrases are emitted, no text around them, and meet the
phrases in an equi-join; the highest tier stays.

"May it be an opening, or a phrase, or a phrase of these tiers" is answered by a bit table that grows with the
lexicon up to ``MOST_WORDS``, a scalar subquery that the first row of a partition carries. It lets all of
them pass, and others only where all their bits happen to be set; those find no partner in the join.

Since only the highest tier counts, a text at first emits the candidates of its highest tiers alone. A key for
which the join finds none of those so high has had others' bits; its texts are gone through again and emit all.

A longer phrase is filed under one anchor: the one of its grams of ``LONG_GRAM`` characters that the
texts hold least often. Pieces that overlap by the longest phrase emit those of their grams that are
anchors, meet the phrases in an equi-join and are searched for the phrase itself.
``phrase_anchors`` gives the anchors of any phrases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from ..functions.binary import bytes_of
from ..session import ship_package
from .sequence import shared

#: Characters of an anchor, least length of a piece, bits of the anchors' table (16 MB).
GRAM, PIECE, BITS = 5, 256, 1 << 27
#: Bytes of the longest phrase that is found by its opening, characters of the anchor of a longer one.
WINDOW, LONG_GRAM = 255, 32
#: Words of 64 bits that one row holds while a table is gathered.
CHUNK = 1 << 13
#: Words of the openings' table: a power of two, as many as there are phrases or more, up to 64 MB.
LEAST_WORDS, MOST_WORDS = 1 << 13, 1 << 23
#: Groups of neighbouring tiers that the table tells apart; so many tiers are a group each.
GROUPS = 32
#: Places that are looked at together, and stretches (a place and a length).
BLOCK, STRETCHES = 1 << 15, 1 << 20


def _grams(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with ``gram``: the substring of ``_len`` characters at every position of ``text``,
    cut by one look-ahead pass (a ``substring`` a position would count from the start each time)."""
    pattern = F.concat(F.lit("(?s)(?=(.{"), F.col("_len").cast("string"), F.lit("}))"))
    return rows.withColumn("gram", F.explode(F.regexp_extract_all(F.col(text), pattern, 1))).drop("_len")


def _bits(hashed: Column) -> list[Column]:
    return [F.pmod(hashed, F.lit(BITS)), F.pmod(F.shiftright(hashed, 32), F.lit(BITS))]


def _gather(rows: DataFrame) -> DataFrame:
    """``chunk, ws``: the words of every chunk that ``rows`` (``chunk, at, w``) set bits of."""
    def run(group: pa.Table) -> pa.Table:
        words = np.zeros(CHUNK, np.int64)
        np.bitwise_or.at(words, group.column("at").to_numpy(), group.column("w").to_numpy())
        return pa.table({"chunk": group.column("chunk").slice(0, 1), "ws": pa.array([words], pa.list_(pa.int64()))})

    ship_package(rows.sparkSession)
    return rows.select("chunk", "at", "w").groupBy("chunk").applyInArrow(run, "chunk bigint, ws array<bigint>")


def _bit_table(grams: DataFrame) -> Column:
    """The bits of ``gram`` as one array of 64-bit words (a scalar subquery); empty if there is none."""
    bits = grams.select(F.explode(F.array(*_bits(F.xxhash64("gram")))).alias("b")).distinct()
    chunks = _gather(bits.select(F.expr(f"b div {64 * CHUNK}").alias("chunk"), F.expr(f"b div 64 % {CHUNK}").alias("at"),
                                 F.expr("shiftleft(1L, cast(b % 64 as int))").alias("w")))
    ordered = F.sort_array(F.collect_list(F.struct("id", "ws")))
    none = F.array_repeat(F.lit(0).cast("long"), CHUNK)
    every = grams.sparkSession.range(BITS // 64 // CHUNK).join(chunks, F.col("id") == F.col("chunk"), "left")
    words = every.agg(F.count("chunk").alias("n"), ordered.alias("all"))
    filled = F.transform(F.filter("all", lambda x: F.col("n") > 0), lambda x: F.coalesce(x["ws"], none))
    return words.select(F.flatten(filled).alias("bits")).scalar()


def _has_bit(table: Column, gram: str) -> Column:
    return _has_bits(table, F.xxhash64(gram))


def _has_bits(table: Column, hashed: Column) -> Column:
    def one(b: Column) -> Column:
        word = F.get(table, F.shiftright(b, 6).cast("int"))
        return F.call_function("shiftrightunsigned", word, b.bitwiseAND(F.lit(63).cast("long")).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1

    first, second = _bits(hashed)
    return one(first) & one(second)


def _pieces(texts: DataFrame, key: str, text: str, longest: Column) -> DataFrame:
    """``key, piece``: stretches of the lower-cased text, each followed by the first ``longest - 1``
    characters of the next one. A stretch is no shorter than the longest phrase, so that any
    occurrence of a phrase lies whole in one piece."""
    step = F.greatest(F.lit(PIECE), longest)
    cut = texts.select(F.col(key), F.regexp_extract_all(
        F.lower(F.coalesce(F.col(text), F.lit(""))), F.concat(F.lit("(?s).{1,"), step.cast("string"), F.lit("}")), 0).alias("_cut"))
    pairs = cut.select(key, F.explode(F.transform("_cut", lambda x, i: F.concat(
        x, F.coalesce(F.get(F.col("_cut"), i + 1), F.lit(""))))).alias("_two"))
    return pairs.select(key, F.substring(F.col("_two"), F.lit(1), step + longest - 1).alias("piece"))


def phrase_anchors(texts: DataFrame, phrases: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``phrase, tier, gram, n``: the index. ``n`` counts the anchor's occurrences in
    the pieces of the texts; a phrase with a gram that no text holds cannot occur and is left out."""
    return _anchors(*_prepare(texts, phrases, key, text))


def _prepare(texts: DataFrame, phrases: DataFrame, key: str, text: str):
    # read by the lengths, the grams and the tier of the empty phrase
    lex = shared(phrases.where("phrase IS NOT NULL AND tier IS NOT NULL").groupBy("phrase").agg(F.max("tier").alias("tier")))
    return _filed(texts, lex.where("phrase != ''"), key, text, GRAM)


def _filed(texts: DataFrame, lex: DataFrame, key: str, text: str, gram: int):
    some = lex.withColumn("_len", F.least(F.length("phrase"), F.lit(gram)))
    longest = lex.agg(F.greatest(F.coalesce(F.max(F.length("phrase")), F.lit(1)), F.lit(1)).alias("n")).scalar()
    lengths = some.agg(F.collect_set("_len").alias("n")).scalar()  # at most as many numbers as a gram has characters
    # without phrases no text is cut
    pieces = _pieces(texts.where(F.size(lengths) > 0), key, text, longest)
    return some, pieces, lengths


def _text_grams(pieces: DataFrame, lengths: Column) -> DataFrame:
    return _grams(pieces.select("*", F.explode(lengths).alias("_len")), "piece")


def _anchors(some: DataFrame, pieces: DataFrame, lengths: Column) -> DataFrame:
    candidates = _grams(some, "phrase")
    table = _bit_table(candidates.select("gram"))
    held = _text_grams(pieces, lengths).where(_has_bit(table, "gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    counted = candidates.join(held, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    rarest = counted.groupBy("phrase", "tier").agg(F.min(F.struct("n", "gram")).alias("a"))
    return rarest.select("phrase", "tier", F.col("a.gram").alias("gram"), F.col("a.n").alias("n")).where("n > 0")


def _by_anchor(texts: DataFrame, lex: DataFrame, key: str, text: str) -> DataFrame:
    """``key, tier`` of the long phrases that a text holds."""
    some, pieces, lengths = _filed(texts, lex, key, text, LONG_GRAM)
    anchors = shared(_anchors(some, pieces, lengths))  # read by the bit table and the join
    emitted = _text_grams(pieces, lengths).where(_has_bit(_bit_table(anchors.select("gram")), "gram"))
    return emitted.join(anchors, "gram").where(F.contains("piece", "phrase")).select(key, "tier")


def _openings(lex: DataFrame) -> DataFrame:
    """``phrase, tier, size``: phrases of up to ``WINDOW`` bytes and the sizes of their openings."""
    n = F.octet_length("phrase")
    return lex.withColumn("size", F.greatest(*[F.when(n >= 1 << k, F.lit(1 << k)).otherwise(0) for k in range(WINDOW.bit_length())]))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


class _Hashes:
    """Hashes of stretches of bytes: every byte stands for a number, the hash of a stretch is their
    polynomial modulo 2 ** 64."""

    #: An odd base and its inverse, odd numbers to mix with and to tell openings, phrases and tiers apart.
    BASE, MIX, APART = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F
    INVERSE = pow(BASE, -1, 1 << 64)
    #: Bits of a word that one string sets.
    SET = 5
    OPENING, PHRASE, TIERS = 1, 2, 3

    def __init__(self, words: int, longest: int = BLOCK):
        self.shift = np.uint64(65 - words.bit_length())
        self.values = np.random.default_rng(7).integers(0, 1 << 64, 256, np.uint64, endpoint=False)
        self.up, self.down = (_powers(b, BLOCK + longest) for b in (self.BASE, self.INVERSE))

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.up[:len(data)], out=out[1:])
        return out

    def mixed(self, hashed: np.ndarray, kind: int) -> np.ndarray:
        """``hashed``, overwritten: the word in the high bits, its bits in the low ones."""
        hashed += np.uint64(kind * self.APART % (1 << 64))
        hashed ^= hashed >> np.uint64(32)
        hashed *= np.uint64(self.MIX)
        return hashed

    def at(self, mixed: np.ndarray) -> np.ndarray:
        return (mixed >> self.shift).view(np.int64)

    def mask(self, mixed: np.ndarray) -> np.ndarray:
        out = np.zeros(len(mixed), np.uint64)
        for k in range(self.SET):
            out |= np.uint64(1) << (mixed >> np.uint64(6 * k) & np.uint64(63))
        return out


def _group_of(tier: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The number of the group that a tier is in; ``bounds`` are the groups' lowest tiers."""
    return np.searchsorted(bounds, tier, side="right") - 1


def _index(opened: DataFrame) -> DataFrame:
    """``words, sizes, bounds, table`` as one struct in one row: words of the table, sizes of the openings
    with the lengths of their phrases, the lowest tier of every group, the chunks of the table."""
    n = F.octet_length("phrase")
    phrases = F.greatest(F.lit(1), F.count(F.lit(1)))
    words = opened.agg(F.least(F.lit(MOST_WORDS), F.greatest(F.lit(LEAST_WORDS), F.pow(2, F.ceil(F.log2(phrases))).cast("int"))).alias("n")).scalar()
    # at most as many numbers as WINDOW has
    sizes = (opened.groupBy("size").agg(F.collect_set(n).alias("lengths"))
             .agg(F.collect_list(F.struct("size", "lengths")).alias("n")).scalar())
    # of up to GROUPS tiers, all of them
    bounds = (opened.select("tier").distinct().agg(F.coalesce(F.array_sort(F.array_distinct(
        F.percentile_approx("tier", [k / GROUPS for k in range(GROUPS)] + [1.0]))), F.array().cast("array<int>")).alias("n")).scalar())
    about = F.struct(words.alias("words"), bounds.alias("bounds"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if hashes is None:
                known = batch.column("_about")[0].as_py()
                hashes, bounds = _Hashes(known["words"]), np.array(known["bounds"], np.int64)
            data, ends = bytes_of(batch.column("phrase"))
            groups = _group_of(batch.column("tier").to_numpy(), bounds)
            for first in range(0, batch.num_rows, BLOCK // WINDOW):
                edge = ends[first:first + BLOCK // WINDOW + 1]
                start, some = edge[:-1] - edge[0], groups[first:first + BLOCK // WINDOW]
                sums = hashes.sums(data[edge[0]:edge[-1]])
                size = batch.column("size").to_numpy()[first:first + len(some)]
                opening, phrase = ((sums[start + k] - sums[start]) * hashes.down[start] for k in (size, np.diff(edge)))
                of_tiers = phrase + (some.astype(np.uint64) + np.uint64(_Hashes.TIERS)) * np.uint64(_Hashes.APART)
                # the tiers' kind is added beforehand, as it differs by row
                mixed = np.unique(np.concatenate([hashes.mixed(opening, _Hashes.OPENING), hashes.mixed(phrase.copy(), _Hashes.PHRASE),
                                                  hashes.mixed(of_tiers, 0)]))
                at = hashes.at(mixed)
                yield pa.RecordBatch.from_arrays([pa.array(at // CHUNK), pa.array(at % CHUNK), pa.array(hashes.mask(mixed).view(np.int64))], ["chunk", "at", "w"])

    ship_package(opened.sparkSession)
    rows = opened.select(F.col("phrase").cast("binary").alias("phrase"), F.col("tier").cast("int").alias("tier"), "size",
                         _once(about).alias("_about")).mapInArrow(run, "chunk bigint, at bigint, w bigint")
    table = _gather(rows).agg(F.collect_list(F.struct("chunk", "ws")).alias("table"))
    # one row, read by both passes over the texts
    return shared(table.select(F.struct(words.alias("words"), sizes.alias("sizes"), bounds.alias("bounds"), "table").alias("index")))


def _once(value: Column) -> Column:
    """``value`` in the first row of every partition, null in the others."""
    return F.when(F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0, value)


class _Scan:
    """The index as a task has it."""

    def __init__(self, index: pa.StructScalar):
        self.sizes = sorted((x["size"], np.sort(np.array(x["lengths"], np.int64))) for x in index["sizes"].as_py())
        self.bounds = np.array(index["bounds"].as_py(), np.int64)
        self.longest = max([int(n[-1]) for _, n in self.sizes], default=0)
        words = index["words"].as_py()
        self.hashes, self.table = _Hashes(words, self.longest), np.zeros((words // CHUNK, CHUNK), np.uint64)
        for chunk in index["table"]:
            self.table[chunk["chunk"].as_py()] = chunk["ws"].values.to_numpy().view(np.uint64)
        self.table = self.table.ravel()

    def has(self, hashed: np.ndarray, kind: int) -> np.ndarray:
        """Numbers of those of ``hashed`` (overwritten) that have all their bits."""
        mixed = self.hashes.mixed(hashed, kind)
        word = self.table.take(self.hashes.at(mixed), mode="clip")  # all of them are within
        first = mixed & np.uint64(63)  # most have not even the first bit
        np.right_shift(word, first, out=first)
        first &= np.uint64(1)
        some = np.flatnonzero(first.astype(np.bool_))
        word, mask = word[some], self.hashes.mask(mixed[some])
        return some[word & mask == mask]

    def found(self, data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """``place, length, hash, row`` of what may be a phrase in the rows of a column, block by block."""
        down = self.hashes.down
        for start in range(int(ends[0]), int(ends[-1]), BLOCK):
            sums = self.hashes.sums(data[start:min(start + BLOCK + self.longest, int(ends[-1]))])
            for size, lengths in self.sizes:
                places = min(BLOCK, len(sums) - size)
                if places <= 0:
                    continue
                at = self.has((sums[size:size + places] - sums[:places]) * down[:places], _Hashes.OPENING)
                row = np.searchsorted(ends[1:], start + at, side="right")
                room = ends[1:][row] - start - at
                whole = room >= size
                at, row, room = at[whole], row[whole], room[whole]
                some = max(1, STRETCHES // max(1, len(at)))
                for k in range(0, len(lengths) if len(at) else 0, some):
                    place, n = np.nonzero(room[:, None] >= lengths[None, k:k + some])
                    a, n = at[place], lengths[k + n]
                    hashed = (sums[a + n] - sums[a]) * down[a]
                    hit = self.has(hashed.copy(), _Hashes.PHRASE)
                    yield start + a[hit], n[hit], hashed[hit], row[place[hit]]

    def group(self, hashed: np.ndarray) -> np.ndarray:
        """The highest group that a candidate may be in, -1 if there is none."""
        out = np.full(len(hashed), -1)
        for group in range(len(self.bounds) - 1, -1, -1):
            left = np.flatnonzero(out < 0)
            out[left[self.has(hashed[left], _Hashes.TIERS + group)]] = group
        return out


def _together(parts: Iterator[tuple[np.ndarray, ...]], least: int = BLOCK) -> Iterator[list[np.ndarray]]:
    """The parts, as many joined as give ``least`` candidates."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= least:
            yield [np.concatenate(x) for x in zip(*held)]
            held, n = [], 0
    if n:
        yield [np.concatenate(x) for x in zip(*held)]


def _scan(texts: DataFrame, index: DataFrame, key: str, text: str, highest: bool) -> DataFrame:
    """``key, phrase, least``: what may be a phrase. With ``highest``, of every text those of its highest group, each
    once; ``least`` is that group's lowest tier where others were left out. Without, all places."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = None
        for batch in batches:
            if not batch.num_rows:
                continue
            scan = scan or _Scan(batch.column("_index")[0])
            data, ends = bytes_of(batch.column("_bytes"))
            if highest:
                kept = []
                best, worst = np.full(batch.num_rows, -1), np.full(batch.num_rows, len(scan.bounds))
                for place, length, hashed, row in _together(scan.found(data, ends)):
                    group = scan.group(hashed)
                    real = group >= 0
                    place, length, row, group = place[real], length[real], row[real], group[real]
                    np.maximum.at(best, row, group)
                    np.minimum.at(worst, row, group)
                    kept.append((place, length, row, group))
                parts = [[x[i[3] == best[i[2]]] for x in i[:3]] for i in kept]
            else:
                parts = ([place, length, row] for place, length, _, row in _together(scan.found(data, ends)))
            for part in ([np.concatenate(x) for x in zip(*parts)],) if highest and parts else parts:
                place, length, row = part
                begin, stop, row = place.tolist(), (place + length).tolist(), row.tolist()
                pairs = list(zip(row, (data[a:b].tobytes() for a, b in zip(begin, stop))))
                pairs = list(dict.fromkeys(pairs)) if highest else pairs
                if not pairs:
                    continue
                rows = np.array([r for r, _ in pairs])
                least = pa.array(scan.bounds[best[rows]], pa.int32(), mask=worst[rows] == best[rows]) if highest else pa.nulls(len(rows), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(rows)), pa.array([p for _, p in pairs], pa.binary()), least],
                                                 [key, "phrase", "least"])

    ship_package(texts.sparkSession)
    fields = [texts.schema[key], StructField("phrase", BinaryType()), StructField("least", IntegerType())]
    return texts.select(F.col(key), F.lower(F.coalesce(F.col(text), F.lit(""))).cast("binary").alias("_bytes"),
                        _once(index.scalar()).alias("_index")).mapInArrow(run, StructType(fields)).withColumn("phrase", F.col("phrase").cast("string"))


def _candidates(texts: DataFrame, opened: DataFrame, key: str, text: str) -> DataFrame:
    """``key, phrase``: at every place of the texts, what may be a phrase, all phrases among them."""
    return _scan(texts, _index(opened), key, text, highest=False).select(key, "phrase")


def _by_opening(texts: DataFrame, lex: DataFrame, key: str, text: str) -> DataFrame:
    """``key, tier`` of phrases that a text holds, the highest of each key among them."""
    opened = _openings(lex)
    index, tiers = _index(opened), lex.select("phrase", "tier")
    # read for its tiers and for the keys that go on
    first = shared(_scan(texts, index, key, text, highest=True).join(tiers, "phrase", "left")
                   .groupBy(key).agg(F.max("tier").alias("tier"), F.max("least").alias("least")))
    missed = first.where("least IS NOT NULL AND (tier IS NULL OR tier < least)").select(F.col(key).alias("_missed"))
    again = texts.join(F.broadcast(missed), F.col(key).eqNullSafe(F.col("_missed")), "left_semi")
    rest = _scan(again, index, key, text, highest=False).join(tiers, "phrase")
    return first.where("tier IS NOT NULL").select(key, "tier").unionByName(rest.select(key, "tier"))


def indexed_lexicon_tiers(texts: DataFrame, phrases: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, emotion_tier``: per key the highest tier of a phrase that its lower-cased text contains,
    1 if none does; ``phrases`` is a table ``phrase, tier`` (int).

    Same tiers as ``functions.text.lexicon_tier``. A null text is empty; the empty phrase is
    in every text; null phrases or tiers are left out, a phrase with several tiers counts with
    the highest; rows that share a key (null is one) give one row with their highest tier.
    """
    # read by the openings, the lengths, the bit table and the joins
    lex = shared(phrases.where("phrase IS NOT NULL AND tier IS NOT NULL").groupBy("phrase").agg(F.max("tier").alias("tier")))
    short = _by_opening(texts, lex.where((F.col("phrase") != "") & (F.octet_length("phrase") <= WINDOW)), key, text)
    long = _by_anchor(texts, lex.where(F.octet_length("phrase") > WINDOW), key, text)
    found = short.unionByName(long).select(key, F.col("tier").cast("int").alias("emotion_tier"))
    least = lex.where("phrase = ''").agg(F.coalesce(F.max("tier"), F.lit(1)).cast("int").alias("n")).scalar()
    return (texts.select(key, least.alias("emotion_tier")).unionByName(found)
            .groupBy(key).agg(F.max("emotion_tier").alias("emotion_tier")))
