"""Packing of tokenised documents into sequences (operator 3).

Method: a grouping genetic algorithm. An individual is a set of bins; crossover
injects whole well-filled bins of one parent into the other, drops the bins that
hold one of the injected items a second time, and puts the displaced items back
by best fit, largest first. Islands evolve apart, and after every epoch each
sends its elite to the next island.

At scale the items are dealt into blocks of about ``BLOCK_ITEMS``: in order of length,
one to every block in turn, so that each block is a small likeness of all items. A block
has ``ISLANDS`` islands, and an island is one row, so memory is that of a block
whatever the input. The items of bins that are not well filled are dealt again, level by
level, down to one block, or until a level lowers the number of such bins by less
than ``LEAST_GAIN``: then no dealing fills them. A block never takes more
bins than best fit, largest first, takes for it. Islands are checkpointed between epochs.

Tokens are those of the tokenizers library. It sees every different word once per
worker and slice; the ids of a text are put together from its words' ids.

Defined results:
* null text counts as empty; every document ends with ``END``, so an empty one has
  length 1; only documents longer than ``CAPACITY`` are cut;
* repeated rows are packed one by one; null ids are ids like others;
* ties go to the lower bin; the seed is fixed, results do not depend on the number
  of partitions beyond the dealing of the items;
* an empty table gives no rows; other columns are not carried.
"""

from __future__ import annotations

import math
import random
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from parley.llm.batches import shared_text, slices
from parley.llm.bpe import MEMO_CHARS, MEMO_WORDS, load, read_vocabulary
from parley.session import ensure_checkpoint_dir

CAPACITY, END = 4096, 1
BLOCK_ITEMS, ISLANDS, EPOCHS, GENERATIONS, POPULATION = 4000, 2, 2, 12, 4
#: A bin filled to this share is left alone by the next level.
WELL_FILLED = 0.998
#: A level that lowers the number of badly filled bins by a smaller share is the last.
LEAST_GAIN = 0.1
#: Range partitions of a dealing, at most; each then holds a run for every block.
DEAL_PARTITIONS = 1000
#: Bins that a block's part of a sequence id leaves room for; a block holds fewer items.
BLOCK_BINS = 1 << 14
#: Sequence ids end with the level; full pieces have the highest one.
MAX_LEVELS = 1024
SEED = 11


class Packer:
    """Packed ids of whole texts; unknown words of a slice are tokenised in one call."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.bpe = load(spec)
        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = True  # texts are cut at special strings beforehand
        self.final = np.zeros(len(self.bpe.strings), bool)
        self.final[self.bpe.final] = True
        for i, s in enumerate(self.bpe.strings):
            self.final[i] |= s.endswith("</w>")
        self.memo: dict[str, bytes] = {}

    def _learn(self, pieces: set[str]) -> None:
        memo = self.memo
        made = {p: self.bpe.words(p) for p in pieces}
        words = [w for w in dict.fromkeys(w for ws in made.values() for w in ws) if w not in memo]
        for at in range(0, len(words), 20_000):
            some = words[at:at + 20_000]
            ids = np.array(self.library.encode(" ".join(some), add_special_tokens=False).ids, dtype="<u4")
            ends = np.flatnonzero(self.final[ids]) + 1  # a word ends with its only final symbol
            if len(ends) != len(some):
                raise ValueError("the vocabulary does not mark the ends of words")
            data, start = ids.tobytes(), 0
            for w, end in zip(some, (4 * ends).tolist()):
                memo[w] = data[start:end]
                start = end
        for p, ws in made.items():
            if len(ws) != 1:
                memo[p] = b"".join([memo[w] for w in ws])

    def pack(self, texts: list[str | None]) -> list[bytes]:
        bpe, memo = self.bpe, self.memo
        parts: list[list] = []  # of each text: pieces, or the id of a special string
        for text in texts:
            own = []
            if text and bpe.special_pattern is not None and "<" in text:
                for k, x in enumerate(bpe.special_pattern.split(text)):
                    own.append(bpe.special[x] if k % 2 else bpe.pieces(x))
            elif text:
                own.append(bpe.pieces(text))
            parts.append(own)
        if len(memo) > MEMO_WORDS:
            memo.clear()
        unknown = {p for own in parts for x in own if isinstance(x, list) for p in x if p not in memo}
        self._learn(unknown)
        out = [b"".join([array("I", [x]).tobytes() if isinstance(x, int) else b"".join(map(memo.__getitem__, x)) for x in own])
               for own in parts]
        for p in unknown:
            if len(p) > MEMO_CHARS:
                memo.pop(p, None)
        return out


def pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
           end: int = END) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: every document's ids, cut only where they
    are more than ``capacity``. A map over the scan, no shuffle."""
    spec = shared_text(docs.sparkSession, read_vocabulary(vocabulary))
    key = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, tail = Packer(spec.value), array("I", [end]).tobytes()
        for part in slices(batches, "text", 4 << 20):
            rows = {n: [] for n in ("k", "piece", "start", "length", "ids_crc32")}
            for k, data in enumerate(packer.pack(part.column(1).to_pylist())):
                data += tail
                for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                    own = data[at:at + 4 * capacity]
                    for n, v in zip(rows, (k, piece, at // 4, len(own) // 4, zlib.crc32(own))):
                        rows[n].append(v)
            ids = part.column(0).take(pa.array(rows.pop("k"), pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids] + [pa.array(v, pa.int32() if n == "piece" else pa.int64()) for n, v in rows.items()], ["doc_id", *rows])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {key}, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit(bins: list[list[int]], items: list[int], sizes: list[int], capacity: int) -> list[list[int]]:
    """Put ``items`` into ``bins`` (or new ones), largest first, each where least room stays."""
    room = sorted((capacity - sum(sizes[i] for i in b), k) for k, b in enumerate(bins))
    for i in sorted(items, key=lambda i: (-sizes[i], i)):
        at = bisect_left(room, (sizes[i], -1))
        if at < len(room):
            left, k = room.pop(at)
            bins[k].append(i)
        else:
            left, k = capacity, len(bins)
            bins.append([i])
        insort(room, (left - sizes[i], k))
    return bins


def fitness(bins: list[list[int]], sizes: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then unevenly filled ones (their room is of use)."""
    return -len(bins), sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins)


def crossover(a: list[list[int]], b: list[list[int]], sizes: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """Inject well-filled bins of ``b`` into ``a``, drop the bins that repeat their items and
    best-fit what is displaced."""
    ranked = sorted(b, key=lambda x: -sum(sizes[i] for i in x))
    best = ranked[:max(1, len(ranked) // 2)]
    injected = rng.sample(best, max(1, rng.randint(len(best) // 4, max(1, len(best) // 2))))
    there = {i for x in injected for i in x}
    kept = [x[:] for x in a if there.isdisjoint(x)]
    displaced = [i for x in a if not there.isdisjoint(x) for i in x if i not in there]
    # the emptiest bins give up their items too
    kept.sort(key=lambda x: sum(sizes[i] for i in x))
    for x in kept[:2]:
        displaced += x
    return best_fit([x[:] for x in injected] + kept[2:], displaced, sizes, capacity)


def first_individual(sizes: list[int], capacity: int, rng: random.Random, plain: bool) -> list[list[int]]:
    """Best fit, largest first; other individuals start from some random full bins."""
    items = list(range(len(sizes)))
    bins: list[list[int]] = []
    if not plain:
        rng.shuffle(items)
        some, items = items[:len(items) // 5], items[len(items) // 5:]
        best_fit(bins, some, sizes, capacity)
    return best_fit(bins, items, sizes, capacity)


def evolve(sizes: list[int], people: list[list[list[int]]], capacity: int, rng: random.Random) -> list[list[list[int]]]:
    """One epoch of an island; stops at the bound that no packing can beat."""
    bound = math.ceil(sum(sizes) / capacity)
    score = lambda x: fitness(x, sizes, capacity)
    people = sorted(people, key=score, reverse=True)
    while len(people) < POPULATION and len(people[0]) > bound:
        people.append(first_individual(sizes, capacity, rng, False))
    for _ in range(GENERATIONS):
        if len(people[0]) <= bound:
            break
        people.sort(key=score, reverse=True)
        a, b = rng.sample(people, 2)
        children = [crossover(a, b, sizes, capacity, rng), crossover(b, a, sizes, capacity, rng)]
        people = sorted(people + children, key=score, reverse=True)[:POPULATION]
    return sorted(people, key=score, reverse=True)


def _assignment(bins: list[list[int]], n: int) -> list[int]:
    out = [0] * n
    for k, b in enumerate(bins):
        for i in b:
            out[i] = k
    return out


def _bins(assignment: list[int]) -> list[list[int]]:
    bins: dict[int, list[int]] = {}
    for i, k in enumerate(assignment):
        bins.setdefault(k, []).append(i)
    return list(bins.values())


STATE = "block bigint, island int, sizes array<int>, people array<array<int>>, n_bins int, fill double"


def _epoch(state: DataFrame, capacity: int, epoch: int) -> DataFrame:
    schema = pa.schema([("block", pa.int64()), ("island", pa.int32()), ("sizes", pa.list_(pa.int32())),
                        ("people", pa.list_(pa.list_(pa.int32()))), ("n_bins", pa.int32()), ("fill", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes = row["sizes"]
                rng = random.Random(f"{SEED} {epoch} {row['block']} {row['island']}")
                people = [_bins(x) for x in row["people"] or []] or [first_individual(sizes, capacity, rng, True)]
                people = evolve(sizes, people, capacity, rng)
                bins, fill = fitness(people[0], sizes, capacity)
                yield pa.RecordBatch.from_pylist([{
                    "block": row["block"], "island": row["island"], "sizes": sizes, "n_bins": -bins, "fill": fill,
                    "people": [_assignment(x, len(sizes)) for x in people]}], schema=schema)

    return state.mapInArrow(run, STATE)


def deal(items: DataFrame, n_blocks: int) -> DataFrame:
    """``items`` with their ``block``: neighbours by length go to different blocks. Equal lengths
    are ordered by the random ``_pk_u``, so a frequent length spreads over range partitions."""
    if n_blocks == 1:
        return items.withColumn("block", F.lit(0).cast("long"))
    order = ["length", "_pk_u", "piece", "ids_crc32"]
    shuffle = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranked = items.repartitionByRange(min(shuffle, DEAL_PARTITIONS), *order).sortWithinPartitions(*order)
    row = F.col("_pk_row").bitwiseAND(F.lit((1 << 33) - 1))  # in its partition
    turn = F.xxhash64(F.shiftright("_pk_row", 33), F.floor(row / n_blocks))  # every run starts elsewhere
    return (ranked.withColumn("_pk_row", F.monotonically_increasing_id())
            .withColumn("block", F.pmod(row + F.pmod(turn, F.lit(n_blocks)), F.lit(n_blocks)).cast("long")).drop("_pk_row"))


def pack_blocks(items: DataFrame, n_blocks: int, capacity: int, level: int) -> DataFrame:
    """Deal ``items`` (with ``length`` and the random ``_pk_u``) into blocks and pack each:
    all columns, and the key ``block, bin``."""
    island = F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)]))
    columns = items.columns
    blocks = deal(items, n_blocks).groupBy("block").agg(F.collect_list(F.struct(*columns)).alias("items")).checkpoint()
    # few blocks' worth of state in a task: an epoch is long, a row small
    spread = max(1, min(n_blocks * ISLANDS, 10_000))
    state = (blocks.select("block", F.transform("items", lambda x: x["length"].cast("int")).alias("sizes"))
             .select("block", island.alias("island"), "sizes", F.lit(None).cast("array<array<int>>").alias("people")))
    for epoch in range(EPOCHS):
        state = _epoch(state.repartition(spread, "block", "island"), capacity, 10 * level + epoch).checkpoint()
        if epoch + 1 < EPOCHS:
            elite = state.select("block", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("people")[0].alias("elite"))
            state = state.join(elite, ["block", "island"]).select(
                "block", "island", "sizes", F.concat(F.array("elite"), "people").alias("people"))
    best = state.groupBy("block").agg(F.min_by(F.col("people")[0], F.struct("n_bins", -F.col("fill"), "island")).alias("bins"))
    return (blocks.join(best, "block").select("block", F.explode(F.arrays_zip("items", "bins")).alias("x"))
            .select("block", F.col("x.bins").alias("bin"), "x.items.*"))


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         end: int = END) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    return pack_pieces(pieces(docs, vocabulary, id_col, text_col, capacity, end), capacity)


def pack_pieces(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces (as ``pieces`` returns them) with their ``sequence_id`` and ``offset``."""
    ensure_checkpoint_dir(found.sparkSession)
    names = found.columns
    found = found.withColumn("_pk_u", F.rand(SEED)).checkpoint()
    # a full piece is a sequence of its own
    done = [found.where(F.col("length") == capacity).select(
        *names, (F.monotonically_increasing_id() * MAX_LEVELS + MAX_LEVELS - 1).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"))]
    items, badly = found.where(F.col("length") < capacity), None
    for level in range(MAX_LEVELS - 1):
        n_blocks = math.ceil(items.count() / BLOCK_ITEMS)
        if not n_blocks:
            break
        within = _offsets(pack_blocks(items, n_blocks, capacity, level), names, ["block", "bin"], level)
        if n_blocks == 1:
            done.append(within.select(*names, "sequence_id", "offset"))
            break
        within = within.checkpoint()
        filled = F.col("fill") >= WELL_FILLED * capacity
        before, badly = badly, within.where(~filled & (F.col("offset") == 0)).count()
        if level == MAX_LEVELS - 2 or before is not None and badly > (1 - LEAST_GAIN) * before:
            done.append(within.select(*names, "sequence_id", "offset"))
            break
        done.append(within.where(filled).select(*names, "sequence_id", "offset"))
        items = within.where(~filled).select(*names, F.rand(SEED + level + 1).alias("_pk_u")).checkpoint()
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _offsets(packed: DataFrame, names: list[str], own: list[str], level: int) -> DataFrame:
    """Offsets inside the bins (at most ``CAPACITY`` rows each), and how full they are."""
    bins = packed.groupBy(*own).agg(F.sort_array(F.collect_list(F.struct(*names, "_pk_u"))).alias("rows"))
    lengths = F.transform("rows", lambda x: x["length"])
    placed = F.transform("rows", lambda x, i: F.struct(
        x.alias("row"), F.aggregate(F.slice(lengths, 1, i), F.lit(0).cast("long"), lambda s, v: s + v).alias("offset")))
    fill = F.aggregate(lengths, F.lit(0).cast("long"), lambda s, v: s + v)
    return (bins.select(*own, fill.alias("fill"), F.explode(placed).alias("x"))
            .select("x.row.*", "x.offset", "fill", ((F.col("block") * BLOCK_BINS + F.col("bin")) * MAX_LEVELS + level).alias("sequence_id")))


def sequences_summary(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Sequences, tokens and the share of room that is used."""
    return packed.agg(F.countDistinct("sequence_id").alias("n_sequences"), F.sum("length").alias("n_tokens")).select(
        "n_sequences", "n_tokens", (F.col("n_tokens") / (F.col("n_sequences") * capacity)).alias("used"))
