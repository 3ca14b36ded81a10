"""Compression of vectors to short codes (operator 11).

Every vector becomes integers ``floor(scale * x)``, is cut into ``PARTS`` equal consecutive
parts, and each part is replaced by the number of its nearest codebook entry. The
codebooks start from the parts of the smallest ids and are refined for ``ROUNDS`` rounds
of assignment and integer means.

Method of assignment: memoised grid cells. A part falls into a coarse cell of a grid; the
cell's coordinates are the key of a memo that holds the entries worth looking at for any
part inside the cell's box. An entry is left out of the memo if another one's largest
distance to the box is below its own smallest distance, so it can be nearest nowhere in
the box. Only the entries that the memo keeps are evaluated exactly, ties going to the
lower number. The grid only saves work: every result equals a full comparison.

Each round is one map over the table that adds up its parts in the task and sends one row
per part position and entry; the driver holds the codebooks alone (fixed size). A lost
executor repeats its tasks of that round.

Defined results:
* rows whose vector is null or holds null, NaN or infinite components are dropped;
* vectors shorter than the longest one, and lengths that ``PARTS`` does not divide, are
  filled up with zeros; empty vectors therefore count as zeros;
* repeated rows and ids are rows like others; null ids come last in the order that starts
  the codebooks; among equal ids the vector with the smaller integers comes first;
* fewer kept rows than entries give fewer entries; an empty table gives no rows;
* components beyond ``vectors.LARGEST / scale`` in size raise an error, as their distances
  would not fit 64 bits;
* other columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.attach import attach
from parley.llm.batches import shipped
from parley.llm.vectors import complete, filled, longest, matrix, scaled
from parley.session import ensure_checkpoint_dir

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Cells that a task remembers for each part position; a full memo starts again.
MEMO_CELLS = 100_000
#: Vectors worked on at once.
ROWS = 8192


class Grid:
    """Nearest entries of one codebook, by memoised cells."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.step = self._step(entries)
        self.memo: dict[bytes, int] = {}
        rng = np.random.default_rng(11)
        self.mul = rng.integers(1, 1 << 62, entries.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.evaluated = 0

    @staticmethod
    def _step(entries: np.ndarray) -> int:
        """Width of a cell: its diagonal is about the distance between neighbouring entries."""
        if not entries.shape[1]:
            return 1
        gaps = ((entries[:, None] - entries[None]) ** 2).sum(axis=2).astype(np.float64)
        gaps[gaps == 0] = np.inf
        near = gaps.min(axis=1)
        near = near[np.isfinite(near)]
        return max(1, int(np.sqrt(np.median(near) / entries.shape[1]))) if len(near) else 1 << 20

    def _cells(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct cells of the parts, and which of them each part lies in."""
        cells = parts // self.step
        with np.errstate(over="ignore"):
            keys = (cells.astype(np.uint64) * self.mul).sum(axis=1, dtype=np.uint64)
        _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        if not np.array_equal(cells[first][inverse], cells):  # two cells under one key
            distinct, inverse = np.unique(cells, axis=0, return_inverse=True)
            return distinct, inverse.ravel()
        return cells[first], inverse

    def worth(self, cells: np.ndarray) -> np.ndarray:
        """Bit masks of the entries that no other one dominates across the cells' boxes."""
        low = (cells * self.step)[:, None]
        high = low + self.step - 1
        e = self.entries[None]
        least = (np.maximum(0, np.maximum(low - e, e - high)) ** 2).sum(axis=2)
        most = (np.maximum(np.abs(e - low), np.abs(e - high)) ** 2).sum(axis=2)
        keep = least <= most.min(axis=1)[:, None]
        return (keep << np.arange(len(self.entries))).sum(axis=1)

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest entry of every part, and the squared distance."""
        if not parts.shape[1]:
            return np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        cells, inverse = self._cells(parts)
        keys = [c.tobytes() for c in cells]
        if len(self.memo) + len(keys) > MEMO_CELLS:
            self.memo.clear()
        new = [i for i, k in enumerate(keys) if k not in self.memo]
        if new:
            self.memo.update(zip((keys[i] for i in new), self.worth(cells[new]).tolist()))
        masks = np.fromiter(map(self.memo.__getitem__, keys), np.int64, len(keys))[inverse]
        row, entry = np.nonzero((masks[:, None] >> np.arange(len(self.entries))) & 1)
        self.evaluated += len(row)
        distance = ((parts[row] - self.entries[entry]) ** 2).sum(axis=1)
        starts = np.searchsorted(row, np.arange(len(parts)))
        best = np.minimum.reduceat(distance, starts)
        hit = np.flatnonzero(distance == best[row])
        _, first = np.unique(row[hit], return_index=True)  # entries ascend within a row
        return entry[hit[first]], best


def _parts(batch: pa.RecordBatch, size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for at in range(0, batch.num_rows, ROWS):
        part = batch.slice(at, ROWS)
        yield part, matrix(part.column("ints"), size).reshape(part.num_rows, PARTS, size // PARTS)


def _refined(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: assign all parts, then the floor of every entry's mean part."""
    shared = shipped(rows).sparkSession.sparkContext.broadcast(books)  # of fixed size
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = [Grid(b) for b in shared.value]
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for _, x in _parts(batch, parts * width):
                for p, grid in enumerate(grids):
                    best, _ = grid.nearest(x[:, p])
                    np.add.at(sums[p], best, x[:, p])
                    counts[p] += np.bincount(best, minlength=entries)
        part, entry = np.nonzero(counts)
        if len(part):
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry], pa.int64()),
                 pa.array(sums[part, entry].tolist(), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    added = rows.select("ints").mapInArrow(run, "part int, entry int, n bigint, sums array<bigint>").groupBy("part", "entry").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)])
    books = books.copy()
    for r in added.collect():  # one row an entry
        books[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    shared.unpersist()
    return books


def fit(rows: DataFrame, size: int, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks ``(part, entry, component)`` of ``rows(id, ints)``, ``ints`` of ``size`` numbers."""
    first = rows.orderBy(F.asc_nulls_last("id"), "ints").limit(ENTRIES).select("ints").collect()
    books = np.array([r["ints"] for r in first], np.int64).reshape(len(first), PARTS, size // PARTS).transpose(1, 0, 2)
    for _ in range(rounds):
        books = _refined(rows, books)
    return books


def assign(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """``rows(id, label, ints)`` as ``id, label, code, error``."""
    shared = shipped(rows).sparkSession.sparkContext.broadcast(books)  # of fixed size
    size = books.shape[0] * books.shape[2]
    types = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("id", "label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = [Grid(b) for b in shared.value]
        for batch in batches:
            for part, x in _parts(batch, size):
                found = [grid.nearest(x[:, p]) for p, grid in enumerate(grids)]
                codes = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
                error = np.sum([f[1] for f in found], axis=0)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("label"), pa.array([c.tobytes().hex() for c in codes], pa.string()),
                     pa.array(error, pa.int64())], ["id", "label", "code", "error"])

    return rows.select("id", "label", "ints").mapInArrow(run, types + ", code string, error bigint")


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components in the order of parts, entries and positions."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
             scale: int = SCALE) -> DataFrame:
    """``<id_col>, code, error, label_error, codebooks_sha256`` of every complete vector."""
    ensure_checkpoint_dir(vectors.sparkSession)
    rows = vectors.where(complete(vector_col)).select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"), scaled(vector_col, scale).alias("ints"))
    size = -(-rows.agg(longest(rows, "ints")).first()[0] // PARTS) * PARTS
    rows = rows.withColumn("ints", filled("ints", size))
    books = fit(rows, size)
    coded = assign(rows, books).checkpoint()
    totals = coded.groupBy("label").agg(F.count("*").alias("n"), F.sum("error").alias("label_error"))
    return attach(coded, totals, ["label"], "n").select(
        F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
