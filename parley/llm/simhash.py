"""SimHash near-duplicate groups (operator 7).

Method: pigeonhole blocks. The 64 fingerprint bits are cut into
``max_bits + 2`` blocks; fingerprints that differ in at most ``max_bits`` bits
agree on at least two blocks, so they meet under the key "these two blocks".
Fingerprints of a key are verified by their Hamming distance.

Copies are merged into one fingerprint before any join, so a group of equal
texts of any size is one row. A key under which more than ``PAIR_GROUP``
different fingerprints meet is never paired off: its members meet under the
values that lie one flipped bit away from them. Two fingerprints share such a
value exactly if they differ in two bits or fewer, and at most 1 + free bits
fingerprints can share one, so the hottest key costs rows in proportion to its
members, and no link is lost.

Defined results:
* null text counts as empty; texts without words have fingerprint zero and are
  linked like any other;
* the component is the smallest id that the links reach; null ids are passed over
  unless a component has no other;
* repeated rows and repeated ids each get their row; a repeated row links to itself;
* an empty table returns no rows; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.batches import shipped, slices
from parley.llm.components import connected_components
from parley.session import ensure_checkpoint_dir

#: Largest number of different fingerprints under one key that are compared in pairs.
PAIR_GROUP = 16
SEED = 42


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Majority bits of the XXH64 hashes of all word shingles, repeats included."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # lowers A-Z only, splits at ASCII blanks
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    grams = map(b" ".join, zip(*(words[i:i + n] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), dtype="<u8", count=n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 14):  # bounded for very long texts
        bits = np.unpackbits(hashes[at:at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                 text_hash: bool = False) -> DataFrame:
    """``doc_id`` and ``fp`` (the fingerprint's 64 bits as a long) of every row, on request
    with ``text_hash`` (SHA-256 of the text, null as empty)."""
    more = ["text_hash"] if text_hash else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = np.array([fingerprint(t, shingle) for t in part.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.view(np.int64)), *part.columns[2:]], ["doc_id", "fp", *more])

    rows = shipped(df).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                              *[_text_hash(text_col).alias(c) for c in more])
    return rows.mapInArrow(run, f"doc_id {df.schema[id_col].dataType.simpleString()}, fp bigint" + "".join(f", {c} binary" for c in more))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def block_masks(max_bits: int) -> list[int]:
    """The masks of all choices of two blocks out of ``max_bits + 2``."""
    blocks = np.array_split(np.arange(64), max_bits + 2)
    return [sum(1 << int(b) for k in pick for b in blocks[k]) for pick in combinations(range(max_bits + 2), 2)]


def links(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """Links ``(a, b)``, a < b, that connect all different values of ``fp`` within
    ``max_bits`` bits of each other (``max_bits`` of 2 or 0: the path of hot keys links
    stars of one-bit neighbours, whose members may be 2 bits apart)."""
    if max_bits not in (0, 2):
        raise ValueError("max_bits must be 0 or 2")
    masks = block_masks(max_bits)
    keys = F.array(*[F.struct(F.lit(c).alias("c"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
                     for c, m in enumerate(masks)])
    blocks = prints.select("fp", F.explode(keys).alias("k")).select("fp", "k.c", "k.key")
    met = blocks.groupBy("c", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = blocks.join(met, ["c", "key"])
    small = (met.where(F.col("n") <= PAIR_GROUP).groupBy("c", "key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
             .select(F.explode(F.transform("fps", lambda a: F.struct(
                 a.alias("a"), F.filter("fps", lambda b: (b > a) & (_distance(a, b) <= max_bits)).alias("bs")))).alias("x"))
             .select("x.a", F.explode("x.bs").alias("b")))
    # one flipped bit outside the key's blocks, or none
    flips = F.element_at(F.array(*[F.array(*[F.lit(_signed(1 << i)) for i in range(64) if not m >> i & 1], F.lit(0).cast("long"))
                                   for m in masks]), F.col("c") + 1)
    hot = (met.where(F.col("n") > PAIR_GROUP)
           .select("fp", "c", F.explode(flips).alias("flip"))
           .groupBy("c", F.col("fp").bitwiseXOR(F.col("flip")).alias("near")).agg(F.collect_set("fp").alias("fps"))
           .where(F.size("fps") > 1)
           .select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
           .where((F.col("a") < F.col("b")) & (_distance(F.col("a"), F.col("b")) <= max_bits)))
    return small.unionByName(hot).distinct()


def _labelled(rows: DataFrame, max_bits: int) -> DataFrame:
    """``rows`` (``doc_id, fp``, others) with ``label``, the smallest fingerprint of the row's
    component, and ``component_id``."""
    prints = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    labels = connected_components(links(prints, max_bits))
    grouped = (labels.join(prints, labels["node"] == prints["fp"]).select("fp", "label", "least"))
    least = grouped.groupBy("label").agg(F.min("least").alias("component_id"))
    member = grouped.join(least, "label").select(F.col("fp").alias("of_fp"), "label", "component_id")
    alone = prints.join(member, prints["fp"] == member["of_fp"], "left").select(
        prints["fp"], F.coalesce("label", "fp").alias("label"), F.coalesce("component_id", "least").alias("component_id"))
    return rows.join(alone, "fp")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    max_bits: int = 2) -> DataFrame:
    """``doc_id, fp, fingerprint`` (16 hex digits) and ``component_id`` of every row."""
    ensure_checkpoint_dir(df.sparkSession)
    rows = fingerprints(df, id_col, text_col, shingle).checkpoint()
    return _labelled(rows, max_bits).select(
        "doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _text_hash(text_col: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
             max_bits: int = 2) -> DataFrame:
    """One row of ``df``, all columns, of every component.

    A component is told by its fingerprints and not by an id, so null and repeated ids
    that stand in several components lose nothing. Of a component stays the row with
    the smallest id (nulls last), then the smallest SHA-256 of the text, then the
    smallest JSON form of the row.
    """
    ensure_checkpoint_dir(df.sparkSession)
    rows = fingerprints(df, id_col, text_col, shingle, text_hash=True).checkpoint()
    best = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    # equal texts have one fingerprint: an id and a text hash stand in one component only
    chosen = (_labelled(rows, max_bits).groupBy("label", "doc_id", "text_hash").agg(F.count("*").alias("n"))
              .groupBy("label").agg(F.min_by(F.struct("doc_id", "text_hash", "n"), best).alias("x"))
              .select(F.col("x.doc_id").alias("_sh_id"), F.col("x.text_hash").alias("_sh_text"), F.col("x.n").alias("_sh_n")))
    found = df.join(chosen, F.col(id_col).eqNullSafe(F.col("_sh_id")) & (_text_hash(text_col) == F.col("_sh_text")))
    copies = (found.where("_sh_n > 1").groupBy("_sh_id", "_sh_text")
              .agg(F.min_by(F.struct(*df.columns), F.to_json(F.struct(*df.columns))).alias("row")).select("row.*"))
    return found.where("_sh_n = 1").select(*df.columns).unionByName(copies)
