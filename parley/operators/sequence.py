"""Skew-safe building blocks for ordered, per-session work.

A session (or any group key) may hold a large share of all rows. A plain
``Window.partitionBy(session)`` or an ordered ``collect_list`` would then put
the whole hot session into one task. The helpers here split each group into
blocks of consecutive positions, do the ordered work inside ``(key, block)``
— bounded by the block size — and combine the per-block results, whose
number is ``rows / block``.

Top-k per group needs no helper: ``row_number() <= k`` is planned by Spark
with a map-side ``WindowGroupLimit (Partial)`` before the shuffle, so a hot
group reaches the final window with at most ``k`` rows per map partition.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BLOCK = 4096


_SHARED: list[DataFrame] = []


def shared(df: DataFrame) -> DataFrame:
    """``df``, computed once however many branches of a plan read it.

    For an intermediate read by more than one branch: persisted lazily
    (``MEMORY_AND_DISK``), so nothing runs while a plan is built, nothing is
    written to the checkpoint folder, and lost blocks are recomputed from
    their lineage. ``release_shared`` frees what is held.
    """
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    _SHARED.append(df)
    return df


def release_shared() -> None:
    """Unpersist everything ``shared`` holds (plans that still use it recompute it)."""
    while _SHARED:
        _SHARED.pop().unpersist()


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _sql_str(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def listagg_ordered(text: str, order: list[str] | str, sep: str = " ") -> Column:
    """``listagg(text, sep) WITHIN GROUP (ORDER BY order...)`` as a Column."""
    order = [order] if isinstance(order, str) else order
    return F.expr(f"listagg({_q(text)}, {_sql_str(sep)}) WITHIN GROUP (ORDER BY "
                  + ", ".join(_q(o) for o in order) + ")")


def ordered_concat(df: DataFrame, keys: list[str], order: str, text: str,
                   sep: str = " ", out: str = "text", block: int = DEFAULT_BLOCK) -> DataFrame:
    """One row per key: ``text`` of the key's rows joined by ``sep`` in ``order``.

    ``order`` must be a non-negative integer position (e.g. ``turn``). Two
    levels: rows are joined inside ``(key, order div block)``, then the block
    strings are joined per key. Null texts are skipped (as ``listagg`` does);
    pass ``coalesce(text, '')`` to keep their separators.
    """
    blk = "_blk"
    level1 = (df.select(*keys, F.col(order), F.col(text))
              .withColumn(blk, F.floor(F.col(order) / F.lit(block)))
              .groupBy(*keys, blk)
              .agg(listagg_ordered(text, order, sep).alias("_part")))
    return level1.groupBy(*keys).agg(listagg_ordered("_part", blk, sep).alias(out))


def prefix_sum(df: DataFrame, keys: list[str], order: str, value: Column | str,
               out: str, inclusive: bool = True, block: int = DEFAULT_BLOCK) -> DataFrame:
    """Add ``out`` = running sum of ``value`` per key in ``order`` (rows before,
    plus the row itself when ``inclusive``).

    Inside a block a bounded window does the work; block totals come from a
    projection of key, position and value alone, are summed over the (few)
    earlier blocks of the key and joined back on ``(key, block)``, on which the
    rows are partitioned already. Positions should be dense (``number_rows``):
    a key then has ``rows / block`` blocks.
    """
    v = F.col(value) if isinstance(value, str) else value
    blk = "_pblk"
    d = df.withColumn("_pval", v).withColumn(blk, F.floor(F.col(order) / F.lit(block)))
    frame_end = Window.currentRow if inclusive else -1
    w_in = (Window.partitionBy(*keys, blk).orderBy(order)
            .rowsBetween(Window.unboundedPreceding, frame_end))
    totals = d.select(*keys, blk, "_pval").groupBy(*keys, blk).agg(F.sum("_pval").alias("_ptot"))
    w_blk = Window.partitionBy(*keys).orderBy(blk).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_poff", F.coalesce(F.sum("_ptot").over(w_blk), F.lit(0))).drop("_ptot")
    return (d.withColumn("_pin", F.coalesce(F.sum("_pval").over(w_in), F.lit(0)))
            .join(offsets, [*keys, blk], "inner")
            .withColumn(out, F.col("_poff") + F.col("_pin"))
            .drop("_pval", "_pin", "_poff", blk))


#: Bits of a level of ``number_rows``: a window never holds more than 16,384 blocks, and
#: the topmost one a row for every 2 ** 28 positions that a key spans.
LEVEL_BITS, LEVELS = 14, 2


def number_rows(df: DataFrame, keys: list[str], order: str, ties: list[str] | None = None,
                out: str = "_pos") -> DataFrame:
    """Add ``out`` = 0, 1, 2, ... per key in ``order``; gaps in ``order`` leave none in
    ``out``, and rows with equal ``order`` are numbered by ``ties``.

    Counts go up a tree over the position's bits (``LEVELS`` levels) and offsets
    come down again: rows are numbered inside ``(key, order >> 14)``, those
    blocks inside ``(key, order >> 28)``, and those inside the key. Sparse positions, such as
    time stamps in milliseconds, therefore still split a hot key. Rows are
    shuffled once; the tree holds counts only.
    """
    level = [f"_l{k}" for k in range(1, LEVELS + 1)]
    at = [F.shiftright(F.col(order).cast("long"), LEVEL_BITS * k) for k in range(1, LEVELS + 1)]
    counts = [df.select(*keys, *[c.alias(n) for c, n in zip(at, level)])
              .groupBy(*keys, *level).agg(F.count(F.lit(1)).alias("_n"))]
    for k in range(1, LEVELS):
        counts.append(counts[-1].groupBy(*keys, *level[k:]).agg(F.sum("_n").alias("_n")))
    offsets = None
    for k in range(LEVELS - 1, -1, -1):
        w = Window.partitionBy(*keys, *level[k + 1:]).orderBy(level[k]).rowsBetween(Window.unboundedPreceding, -1)
        own = counts[k].withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
        if offsets is not None:
            own = own.join(offsets, [*keys, *level[k + 1:]]).withColumn(
                "_before", F.col("_before") + F.col("_above")).drop("_above")
        offsets = own.withColumnRenamed("_before", "_above")
    w_in = Window.partitionBy(*keys, level[0]).orderBy(order, *(ties or []))
    return (df.withColumn(level[0], at[0]).withColumn("_in", F.row_number().over(w_in) - 1)
            .join(offsets.drop(*level[1:]), [*keys, level[0]])
            .withColumn(out, (F.col("_above") + F.col("_in")).cast("long")).drop("_above", "_in", level[0]))


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, out: str = "rank") -> DataFrame:
    """Rows ranked 1..k per key by ``order`` (map-side limited, see module doc)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)


def fixed_table(spark, rows: list, schema: str, max_rows: int = 10_000) -> DataFrame:
    """A dimension table built from parameters.

    Up to ``max_rows`` rows, known before the job runs, it is marked for
    broadcast; a larger one is an ordinary table, joined as Spark chooses.
    """
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= max_rows else df
