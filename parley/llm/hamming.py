"""Exact top-k search over binary codes (operator 4).

Method: incremental multi-index hashing. A 64-bit code is cut into four segments,
and every segment value is an index entry. A query probes the values within a
growing radius of its own segments, radius by radius and, once a radius is
dear, segment by segment. When all segments have been searched up to radius
``r`` and the first ``j`` of them up to ``r + 1``, every code within ``4 r + 3 + j`` bits
has been met; a query is done as soon as its k-th verified distance is within
that. No bucket is capped and every row is indexed, so the result is exact.

Equal codes are one entry with their number and their ``k + 1`` smallest ids (all
that a result can show), found with a map-side limit; a code that a third of
all rows share therefore costs one entry. A candidate is counted at the first
step that meets it, so nothing needs to be made distinct but the ids that have
several codes: of those a query keeps the nearest occurrence, and it is done only
when ``k + 1`` different ids (its own may be one) are that near.

Defined results:
* neighbours are ordered by distance, then id; rows with the query's own id are
  not its neighbours; fewer than k other rows give fewer neighbours;
* null vectors or codes and null ids are neither found nor searched; missing numbers
  inside a vector count as not positive; an empty vector has code 0;
* a repeated row (id and code) is one row; an id with several codes searches with
  each of them, in which case its best neighbours over all are returned;
* an empty table or query set gives no rows; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.attach import attach
from parley.llm.batches import shipped
from parley.session import ensure_checkpoint_dir

SEGMENTS, WIDTH = 4, 16
#: Radii searched in all segments at once, before segment by segment.
TOGETHER = ((0, 1, 2), (3,))
K, QUERY_EVERY = 10, 100


def sign_code(vector: str) -> Column:
    """64-bit code of a vector of at most 64 numbers: a bit is 1 where the number is positive."""
    bits = F.expr(f"aggregate(transform(`{vector}`, (x, i) -> if(x > 0, shiftleft(1L, i), 0L)), 0L, (a, b) -> a | b)")
    return F.when(F.size(vector) > 64, F.raise_error(F.lit("vectors of more than 64 numbers have no 64-bit code"))).otherwise(bits)


def _segment(code: Column, s: int) -> Column:
    return F.shiftrightunsigned(code, WIDTH * s).bitwiseAND(F.lit((1 << WIDTH) - 1))


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def steps() -> Iterator[tuple[tuple[int, ...], tuple[int, ...], int]]:
    """Radii, segments, and the distance covered once they have been searched."""
    every = tuple(range(SEGMENTS))
    for radii in TOGETHER:
        yield radii, every, SEGMENTS * (radii[-1] + 1) - 1
    for radius in range(TOGETHER[-1][-1] + 1, WIDTH + 1):
        for s in every:
            yield (radius,), (s,), SEGMENTS * radius + s


def _probes(active: DataFrame, radii: tuple[int, ...], segments: tuple[int, ...]) -> DataFrame:
    """Segment values within the radii of every active query code."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = np.arange(1 << WIDTH, dtype=np.uint64)
        masks = values[np.isin(np.bitwise_count(values), radii)]
        at_once = max(1, 500_000 // (len(masks) * len(segments)))
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                part = batch.slice(at, at_once)
                q, reach = part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False)
                for s in segments:
                    own = (q.view(np.uint64) >> np.uint64(WIDTH * s)) & np.uint64((1 << WIDTH) - 1)
                    value = (own[:, None] ^ masks[None]).astype(np.int64).ravel()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(q, len(masks))), pa.array(np.repeat(reach, len(masks))),
                         pa.array(np.full(len(value), s, np.int32)), pa.array(value)], ["q", "reach", "seg", "value"])

    return shipped(active).select("q", "reach").mapInArrow(run, "q bigint, reach int, seg int, value bigint")


def _first_met(radii: tuple[int, ...]) -> Column:
    """Whether this segment is the first in the order of the steps that meets the pair; a step
    of several radii counts as one radius, the largest."""
    near = [F.greatest(F.bit_count(_segment(F.col("q"), t).bitwiseXOR(_segment(F.col("code"), t))), F.lit(radii[-1] if len(radii) > 1 else 0))
            for t in range(SEGMENTS)]
    rank = [d * SEGMENTS + t for t, d in enumerate(near)]
    return F.element_at(F.array(*rank), F.col("seg") + 1) == F.least(*rank)


def _distinct_ids(met: DataFrame) -> DataFrame:
    """One row, the nearest, for every query code and id. An id of one code is met once only, so that
    just the ids of several codes (``again``) are grouped."""
    one = met.where(F.col("again")).groupBy("q", "id", "again").agg(F.min("distance").alias("distance"))
    return met.where(~F.col("again")).unionByName(one)


def search(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``query_id, rank, neighbour_id, distance``: the k nearest of ``rows(id, code)`` to every one
    of ``queries(id, code)``, which may be any rows."""
    ensure_checkpoint_dir(rows.sparkSession)
    rows = rows.where("id IS NOT NULL AND code IS NOT NULL").select("id", "code").distinct().checkpoint()
    asked = queries.where("id IS NOT NULL AND code IS NOT NULL").select("id", "code").distinct()
    several = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).withColumn("again", F.lit(True)).checkpoint()
    marked = attach(rows, several, ["id"], "n", "left").withColumn("again", F.coalesce("again", F.lit(False)))
    # the k + 1 smallest ids of a code: row_number is limited on the map side
    place = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    codes = (marked.withColumn("place", place).where(F.col("place") <= k + 1)
             .groupBy("code").agg(F.collect_list(F.struct("id", "again")).alias("ids")).checkpoint())
    entries = codes.select("code", "ids", F.explode(F.array(*[
        F.struct(F.lit(s).alias("seg"), _segment(F.col("code"), s).alias("value")) for s in range(SEGMENTS)])).alias("e")).select(
        "code", "ids", F.col("e.seg").alias("at_seg"), F.col("e.value").alias("at_value"))
    need = min(k + 1, rows.select("id").distinct().limit(k + 1).count())
    active = asked.select(F.col("code").alias("q")).distinct().withColumn("reach", F.lit(64)).checkpoint()
    best = active.select("q", F.lit(None).cast(rows.schema["id"].dataType).alias("id"), F.lit(False).alias("again"), F.lit(0).alias("distance")).limit(0)
    by_query = Window.partitionBy("q").orderBy("distance", "id")
    for radii, segments, covered in steps():
        if active.isEmpty():
            break
        probes = _probes(active, radii, segments)
        index = entries if len(segments) == SEGMENTS else entries.where(F.col("at_seg") == segments[0])
        met = (probes.join(index, (F.col("seg") == F.col("at_seg")) & (F.col("value") == F.col("at_value")))
               .where(_first_met(radii) & (_distance(F.col("q"), F.col("code")) <= F.col("reach")))
               .select("q", _distance(F.col("q"), F.col("code")).alias("distance"), F.inline("ids"))
               .select("q", "id", "again", "distance"))
        best = _distinct_ids(best.unionByName(met)).withColumn("place", F.row_number().over(by_query)).where(
            F.col("place") <= k + 1).drop("place").checkpoint()
        # with itself, k + 1 ids: the distance of the k-th other one at most
        far = (best.groupBy(F.col("q").alias("of")).agg(F.count(F.lit(1)).alias("sofar"), F.max("distance").alias("kth"))
               .where(F.col("sofar") >= need))
        active = (active.join(far, F.col("q") == F.col("of"), "left")
                  .where(F.col("kth").isNull() | (F.col("kth") > covered))
                  .select("q", F.coalesce("kth", "reach").alias("reach")).checkpoint())
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbour_id"))
    found = (asked.select(F.col("id").alias("query_id"), F.col("code").alias("own"))
             .join(best.select("q", F.col("id").alias("neighbour_id"), "distance"), F.col("own") == F.col("q"))
             .where(F.col("query_id") != F.col("neighbour_id")).groupBy("query_id", "neighbour_id").agg(F.min("distance").alias("distance")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "neighbour_id", "distance")


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K,
            query_every: int = QUERY_EVERY) -> DataFrame:
    """``search`` over the sign codes of a vector table; its queries are the rows whose id is
    divisible by ``query_every``."""
    rows = vectors.select(F.col(id_col).alias("id"), sign_code(vector_col).alias("code"))
    return search(rows, rows.where(F.col("id") % query_every == 0), k)
