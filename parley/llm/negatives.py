"""Hard negatives by one-bit codes with provable intervals (operator 12).

Every row's vector becomes integers ``floor(scale * x)``; a row's score for an anchor is
their integer inner product, higher first, ties by smaller id. An anchor's positives
are its first ``POSITIVES`` other rows of its label; for each of them the first
``NEGATIVES`` rows of other labels whose score lies between half and 95 % of the
positive's score are its hard negatives.

Method: rotated one-bit codes. A vector is rotated by a fixed orthogonal matrix; the signs
of the result are its code, and its alignment with the unit vector along the code is
stored with it, as is the length of what the code leaves over (the residual). The
residual is coded in the same way, ``LEVELS`` times in all, each level narrowing the next
interval. An anchor's rotated vector is cut into bit planes of whole numbers, so that its
product with a code is a sum of popcounts. The true score differs from this estimate by
the product of the anchor and the residual, plus that of the planes' rounding error and
the coded vector; Cauchy-Schwarz bounds both, always, not just with high probability.
Level by level, rows whose whole interval lies under the k-th best lower end, or outside
the band, go; only the survivors are scored in integers. The result is exact.

The anchors (a stated query set) meet all rows in blocks: anchors are dealt into blocks of
about ``ANCHOR_BLOCK``, rows into parts, and each pair of a block and a part is one cell,
in which the anchors come first and the rows stream past. A cell sends its best rows of
every anchor, and a ranking with a map-side limit merges them. Nothing depends on
labels or groups being small.

Defined results:
* rows with a null label, a null vector or null, NaN or infinite components take no part;
* a vector shorter than the longest counts as filled up with zeros; an empty one scores 0;
* ids may be null: such a row is no anchor and comes last among equal scores;
* a repeated row, and a row that repeats an id with another vector, are rows of their own:
  each is an anchor if its id is, and the others are its possible positives;
* a positive with a negative score has an empty band; one with score 0 takes score 0;
* fewer rows than asked for give fewer; an empty table gives no rows;
* components beyond ``vectors.LARGEST / scale`` in size raise an error;
* other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.batches import shipped
from parley.llm.vectors import complete, filled, longest, matrix, scaled
from parley.session import ensure_checkpoint_dir

SCALE, POSITIVES, NEGATIVES, ANCHOR_EVERY = 256, 5, 3, 50
#: Successive one-bit codes of a vector, and bits of an anchor's whole numbers.
LEVELS, PLANES = 5, 8
#: Anchors of a block (bounded by the number of blocks), and least rows of a part.
ANCHOR_BLOCK, PART_ROWS = 16_384, 8192
#: Rows of a part worked on at once.
ROWS = 8192
#: Relative allowance for rounding in 64-bit floats, well above what the sums can lose.
SLACK = 1e-9


def rotation(size: int, seed: int = 12) -> np.ndarray:
    """A fixed orthogonal matrix."""
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(size, size)))[0] if size else np.zeros((0, 0))


def layout(size: int) -> np.dtype:
    """A coded row: integers, codes by level, alignments and residuals by level."""
    return np.dtype([("ints", "<i4", (size,)), ("codes", "<u8", (LEVELS, size // 64)), ("align", "<f8", (LEVELS,)),
                     ("left", "<f8", (LEVELS,)), ("norm", "<f8")])


def encode(ints: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Rows of ``layout`` for a matrix of integers."""
    size = ints.shape[1]
    out = np.zeros(len(ints), layout(size))
    out["ints"] = ints
    rest = ints.astype(np.float64) @ turn
    out["norm"] = np.sqrt((rest ** 2).sum(axis=1))
    unit = 1 / np.sqrt(size) if size else 0.0
    for level in range(LEVELS):
        signs = rest >= 0
        along = np.where(signs, unit, -unit)
        out["align"][:, level] = (rest * along).sum(axis=1)
        rest = rest - out["align"][:, level, None] * along
        out["left"][:, level] = np.sqrt((rest ** 2).sum(axis=1))
        out["codes"][:, level] = np.packbits(signs, axis=1, bitorder="little").view("<u8")
    return out


class Anchor:
    """A vector's bit planes for products with codes, and its exact integers."""

    def __init__(self, ints: np.ndarray, turn: np.ndarray):
        self.ints = ints.astype(np.int64)
        self.size = len(ints)
        z = ints.astype(np.float64) @ turn
        self.norm = float(np.sqrt((z ** 2).sum()))
        self.half = 1 << (PLANES - 1)
        self.step = float(np.abs(z).max()) / (self.half - 1) if self.size and self.norm else 1.0
        whole = np.rint(z / self.step).astype(np.int64)
        self.error = float(np.sqrt(((z - self.step * whole) ** 2).sum()))
        bits = ((whole + self.half)[None] >> np.arange(PLANES)[:, None]) & 1
        self.planes = np.packbits(bits.astype(np.uint8), axis=1, bitorder="little").view("<u8")
        self.ones = bits.sum(axis=1)

    def along(self, codes: np.ndarray) -> np.ndarray:
        """Products of the whole numbers with the codes' sign vectors, by popcounts."""
        total = np.zeros(len(codes), np.int64)
        for j, plane in enumerate(self.planes):
            shared = np.bitwise_count(codes & plane).sum(axis=1, dtype=np.int64)
            total += (2 * shared - self.ones[j]) << j
        return total - self.half * (2 * np.bitwise_count(codes).sum(axis=1, dtype=np.int64) - self.size)

    def narrowed(self, rows: np.ndarray, chosen: np.ndarray, keep) -> np.ndarray:
        """The ``chosen`` rows that ``keep(chosen, low, high)`` leaves, level by level, where the
        interval from ``low`` to ``high`` is sure to hold the score."""
        estimate = np.zeros(len(chosen))
        unit = self.step / np.sqrt(self.size) if self.size else 0.0
        for level in range(LEVELS if self.size else 0):
            if not len(chosen):
                break
            estimate = estimate + rows["align"][chosen, level] * (unit * self.along(rows["codes"][chosen, level]))
            left = rows["left"][chosen, level]
            norm = rows["norm"][chosen]
            reach = left * self.norm + self.error * (norm + left) + SLACK * (1 + self.norm * norm)
            stays = keep(chosen, estimate - reach, estimate + reach)
            chosen, estimate = chosen[stays], estimate[stays]
        return chosen

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return rows["ints"].astype(np.int64) @ self.ints


def _kth_largest(values: np.ndarray, k: int) -> float:
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


class Best:
    """The k best rows met so far, by score, then id (null last)."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    @property
    def floor(self) -> float:
        return self.rows[-1][0] if len(self.rows) == self.k else -np.inf

    def add(self, scores: np.ndarray, ids: list, own: list) -> None:
        found = self.rows + list(zip(scores.tolist(), ids, own))
        found.sort(key=lambda r: (-r[0], r[1] is None, r[1] or 0, not r[2]))
        self.rows = found[:self.k]


class PositiveSearch:
    """Best rows of the anchor's label, itself (if met) among them."""

    def __init__(self, anchor: Anchor, wanted: dict):
        self.anchor, self.number, self.label, self.id = anchor, wanted["number"], wanted["label"], wanted["id"]
        self.best = Best(POSITIVES + 1)

    def meet(self, rows: np.ndarray, labels: np.ndarray, ids: pa.Array) -> None:
        k = self.best.k

        def keep(_, low, high):
            return high >= max(self.best.floor, _kth_largest(low, k))

        chosen = self.anchor.narrowed(rows, np.flatnonzero(labels == self.label), keep)
        scores = self.anchor.scores(rows[chosen])
        top = scores >= max(self.best.floor, _kth_largest(scores, k))
        chosen, scores = chosen[top], scores[top]
        names = ids.take(pa.array(chosen)).to_pylist()
        own = [n == self.id and bool((rows["ints"][c] == self.anchor.ints).all()) for n, c in zip(names, chosen)]
        self.best.add(scores, names, own)

    def found(self) -> Iterator[tuple]:
        for score, name, own in self.best.rows:
            yield self.number, name, score, own


class NegativeSearch:
    """Best rows of other labels in the bands of the anchor's positives."""

    def __init__(self, anchor: Anchor, wanted: dict):
        self.anchor, self.number, self.label = anchor, wanted["number"], wanted["label"]
        # 50 p <= 100 n <= 95 p in whole numbers
        self.bands = {p: (-(-p // 2), 95 * p // 100, Best(NEGATIVES)) for p in set(wanted["scores"]) if p >= 0}

    def meet(self, rows: np.ndarray, labels: np.ndarray, ids: pa.Array) -> None:
        if not self.bands:
            return

        def keep(_, low, high):
            stays = np.zeros(len(low), bool)
            for least, most, best in self.bands.values():
                sure = low[(low >= least) & (high <= most)]
                stays |= (low <= most) & (high >= max(least, best.floor, _kth_largest(sure, NEGATIVES)))
            return stays

        chosen = self.anchor.narrowed(rows, np.flatnonzero(labels != self.label), keep)
        scores = self.anchor.scores(rows[chosen])
        for least, most, best in self.bands.values():
            inside = (scores >= max(least, best.floor)) & (scores <= most)
            top = np.flatnonzero(inside)
            top = top[scores[top] >= _kth_largest(scores[top], NEGATIVES)]
            best.add(scores[top], ids.take(pa.array(chosen[top])).to_pylist(), [False] * len(top))

    def found(self) -> Iterator[tuple]:
        for p, (_, _, best) in self.bands.items():
            for score, name, _ in best.rows:
                yield self.number, name, score, p


def coded(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int, size: int, turn) -> DataFrame:
    """``id, label, packed`` of the rows that take part: a narrow map over the scan."""
    rows = _taking_part(vectors, id_col, vector_col, label_col, scale).withColumn("ints", filled("ints", size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                packed = encode(matrix(part.column("ints"), size), turn.value)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("label"), pa.array([r.tobytes() for r in packed], pa.binary())], ["id", "label", "packed"])

    return rows.mapInArrow(run, "id bigint, label bigint, packed binary")


def _taking_part(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    return vectors.where(F.col(label_col).isNotNull() & complete(vector_col)).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), scaled(vector_col, scale).alias("ints"))


def _cells(anchors: DataFrame, rows: DataFrame, blocks: int, parts: int) -> DataFrame:
    """Every anchor block with every part of the rows; in a cell, anchors come first."""
    many = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = F.pmod(F.xxhash64("number"), F.lit(blocks))
    part = F.pmod(F.xxhash64("id", "packed"), F.lit(parts))
    ask = anchors.select(block.alias("block"), many(parts).alias("part"), F.lit(0).alias("kind"), "id", "label", "packed", "number", "scores")
    meet = rows.select(many(blocks).alias("block"), part.alias("part"), F.lit(1).alias("kind"), "id", "label", "packed",
                       F.lit(None).cast("long").alias("number"), F.lit(None).cast("array<bigint>").alias("scores"))
    both = ask.select(F.col("block").cast("int"), F.col("part").cast("int"), *ask.columns[2:]).unionByName(
        meet.select(F.col("block").cast("int"), F.col("part").cast("int"), *meet.columns[2:]))
    cell = F.col("block") * parts + F.col("part")
    return both.repartitionById(blocks * parts, cell).sortWithinPartitions("block", "part", "kind")


def _searched(cells: DataFrame, search: type, size: int, turn, last: str) -> DataFrame:
    """Best rows of every anchor in every cell: ``number, other, score`` and ``last``."""
    kind = layout(size)

    def unpacked(column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, searches = None, []

        def found() -> Iterator[pa.RecordBatch]:
            out = [r for s in searches for r in s.found()]
            for at in range(0, len(out), 50_000):
                number, other, score, more = zip(*out[at:at + 50_000])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(number, pa.int64()), pa.array(other, pa.int64()), pa.array(score, pa.int64()),
                     pa.array(more, pa.bool_() if last == "own" else pa.int64())], ["number", "other", "score", last])

        for batch in batches:
            place = batch.column("block").to_numpy().astype(np.int64) << 32 | batch.column("part").to_numpy()
            kinds = batch.column("kind").to_numpy()
            turns = np.flatnonzero((place[1:] != place[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for a, b in zip(np.concatenate(([0], turns)).tolist(), np.append(turns, len(place)).tolist()):
                if place[a] != cell:
                    yield from found()
                    cell, searches = place[a], []
                if kinds[a] == 0:
                    some = batch.slice(a, b - a)
                    for r, packed in zip(some.select(["id", "label", "number", "scores"]).to_pylist(), unpacked(some.column("packed"))):
                        searches.append(search(Anchor(packed["ints"], turn.value), r))
                elif searches:
                    for at in range(a, b, ROWS):
                        some = batch.slice(at, min(ROWS, b - at))
                        rows, labels = unpacked(some.column("packed")), some.column("label").to_numpy()
                        for s in searches:
                            s.meet(rows, labels, some.column("id"))
        yield from found()

    return cells.mapInArrow(run, f"number bigint, other bigint, score bigint, {last} {'boolean' if last == 'own' else 'bigint'}")


def mine(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
         scale: int = SCALE, anchor_every: int = ANCHOR_EVERY) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``; anchors are the
    rows whose id is divisible by ``anchor_every``. Ids and labels are whole numbers."""
    spark = vectors.sparkSession
    ensure_checkpoint_dir(spark)
    base = _taking_part(vectors, id_col, vector_col, label_col, scale)
    is_anchor = F.coalesce(F.col("id") % anchor_every == 0, F.lit(False))
    seen = base.agg(F.count("*").alias("rows"), F.count(F.when(is_anchor, 1)).alias("anchors"), longest(base, "ints").alias("size")).first()
    size = max(64, -(-seen["size"] // 64) * 64)
    turn = shipped(vectors).sparkSession.sparkContext.broadcast(rotation(size))  # of fixed size
    rows = coded(vectors, id_col, vector_col, label_col, scale, size, turn)
    blocks = max(1, -(-seen["anchors"] // ANCHOR_BLOCK))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(-(-seen["rows"] // PART_ROWS), -(-width // blocks)))
    # numbered once: the written table keeps the numbers when a task is repeated
    anchors = rows.where(is_anchor).withColumn("number", F.monotonically_increasing_id()).checkpoint()

    none = anchors.withColumn("scores", F.lit(None).cast("array<bigint>"))
    met = _searched(_cells(none, rows, blocks, parts), PositiveSearch, size, turn, "own")
    order = [F.desc("score"), F.asc_nulls_last("other"), F.desc("own")]
    by_anchor = Window.partitionBy("number")
    near = met.withColumn("place", F.row_number().over(by_anchor.orderBy(*order))).where(F.col("place") <= POSITIVES + 1)
    # the anchor itself is one of its equals; one of them leaves
    near = near.withColumn("self", F.min(F.when(F.col("own"), F.col("place"))).over(by_anchor))
    positives = (near.where(F.col("self").isNull() | (F.col("place") != F.col("self")))
                 .withColumn("place", F.col("place") - F.when(F.col("place") > F.col("self"), 1).otherwise(0))
                 .where(F.col("place") <= POSITIVES)
                 .select("number", F.col("other").alias("positive_id"), F.col("score").alias("positive_score")).checkpoint())

    bands = positives.groupBy("number").agg(F.collect_set("positive_score").alias("scores"))  # POSITIVES at most
    asked = anchors.join(bands, "number")
    met = _searched(_cells(asked, rows, blocks, parts), NegativeSearch, size, turn, "positive_score")
    by_band = Window.partitionBy("number", "positive_score").orderBy(F.desc("score"), F.asc_nulls_last("other"))
    hard = (met.withColumn("rank", F.row_number().over(by_band)).where(F.col("rank") <= NEGATIVES)
            .select("number", "positive_score", "rank", F.col("other").alias("negative_id"), F.col("score").alias("negative_score")))
    named = positives.join(anchors.select("number", F.col("id").alias("anchor_id")), "number")
    return named.join(hard, ["number", "positive_score"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def relabelled(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label") -> DataFrame:
    """Labels ``l`` of ids divisible by 7 become ``(l + 1) mod 10``: noise to be mined around."""
    label = F.col(label_col)
    return vectors.withColumn(label_col, F.when(F.col(id_col) % 7 == 0, F.pmod(label + 1, F.lit(10))).otherwise(label))
