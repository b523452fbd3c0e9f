"""Running positions inside groups, safe when one group holds a large share of rows.

A per-group ``Window`` moves a whole group into one task.  Here a group may be as
large as a third of the table (one book holding most chapters, one job holding most
events), so the scan runs in two levels:

1. ``repartitionByRange(n, group, order)`` splits the global order into ``n``
   contiguous blocks; a hot group is cut across many blocks.  The block id is the
   partition id, so the blocked rows (keys and weights only, never text) are written
   once with ``checkpoint``: the two consumers below must see the same assignment,
   and two separately planned range exchanges could sample different bounds.
2. Inside a block, a window over ``(block, group)`` gives block-local results.
3. Per (block, group), a small table carries the offsets from the group's earlier
   blocks and the group totals (a group spans at most ``n`` blocks).  It is joined on
   (block, group): balanced even for a hot group, and already the partitioning of the
   block-local window, so the large side is not shuffled again.  For ``lag`` only the
   first group of a block continues from an earlier block, so that fix-up table has at
   most ``n`` rows: a bound that allows ``broadcast``.

``bounded=True`` (groups known to be small, e.g. books that passed the chapter
limit) uses a plain window instead: one shuffle instead of two.
"""
from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize

_BLK = "_blk"


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys meet each other; the keys come from the left side."""
    r = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"__r_{k}"])
        cond = c if cond is None else cond & c
    return left.join(r, cond, how).drop(*[f"__r_{k}" for k in keys])


def _blocks(df: DataFrame, blocks: int | None) -> int:
    if blocks:
        return blocks
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def _blocked(df: DataFrame, group: list[str], order: list[str], blocks: int | None) -> DataFrame:
    n = _blocks(df, blocks)
    # The range partitioner samples its input in a pass of its own; keep the (slim) input
    # cached for the span of the checkpoint so the source is computed once.
    src = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        b = (src.repartitionByRange(n, *[F.col(c) for c in group + order])
                .withColumn(_BLK, F.spark_partition_id()))
        return materialize(b)
    finally:
        src.unpersist()


def running_sums(df: DataFrame, group: list[str], order: list[str],
                 weights: dict[str, Column], *, bounded: bool = False,
                 blocks: int | None = None, totals: dict[str, str] | None = None) -> DataFrame:
    """Adds one BIGINT column per weight: the sum of that weight over the rows of the
    same group that come strictly before this row in ``order`` (a total order).
    ``totals`` maps an output name to a weight whose whole-group sum is wanted too."""
    totals = totals or {}
    wcols = {f"_w_{k}": F.coalesce(v.cast("bigint"), F.lit(0)) for k, v in weights.items()}
    base = df.withColumns(wcols)
    if bounded:
        w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        wall = Window.partitionBy(*group)
        out = base.withColumns({k: F.coalesce(F.sum(f"_w_{k}").over(w), F.lit(0))
                                for k in weights})
        out = out.withColumns({t: F.sum(f"_w_{k}").over(wall) for t, k in totals.items()})
        return out.drop(*wcols)

    b = _blocked(base, group, order, blocks)
    wl = Window.partitionBy(_BLK, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = b.withColumns({k: F.coalesce(F.sum(f"_w_{k}").over(wl), F.lit(0)) for k in weights})

    # One row per (block, group): offsets from the earlier blocks of the group and the
    # group totals.  A group has at most n such rows, so these windows are small.
    tot = b.groupBy(_BLK, *group).agg(*[F.sum(f"_w_{k}").alias(f"_t_{k}") for k in weights])
    wprev = Window.partitionBy(*group).orderBy(_BLK).rowsBetween(Window.unboundedPreceding, -1)
    wall = Window.partitionBy(*group)
    info = tot.select(_BLK, *group,
                      *[F.coalesce(F.sum(f"_t_{k}").over(wprev), F.lit(0)).alias(f"_o_{k}")
                        for k in weights],
                      *[F.sum(f"_t_{k}").over(wall).cast("bigint").alias(t) for t, k in totals.items()])
    # Joined on (block, group): balanced even for a hot group, and the same key as the
    # local window's partitioning, so the large side is not shuffled again.
    out = null_safe_join(local, info, [_BLK, *group])
    out = out.withColumns({k: F.col(k) + F.col(f"_o_{k}") for k in weights})
    return out.drop(_BLK, *wcols, *[f"_o_{k}" for k in weights])


def previous_values(df: DataFrame, group: list[str], order: list[str],
                    columns: dict[str, str], *, keep: list[str] | None = None, bounded: bool = False,
                    blocks: int | None = None) -> DataFrame:
    """For each ``out_name -> column``, adds the value of ``column`` on the previous row
    of the same group in ``order`` (``lag``), NULL on the first row.  The result has the
    group, the order, the columns and ``keep``; no other column of ``df`` is moved."""
    # Only what the result needs is sorted and checkpointed.
    df = df.select(*dict.fromkeys([*group, *order, *(keep or []), *columns.values()]))
    if bounded:
        w = Window.partitionBy(*group).orderBy(*order)
        return df.withColumns({k: F.lag(c).over(w) for k, c in columns.items()})

    b = _blocked(df, group, order, blocks)
    wl = Window.partitionBy(_BLK, *group).orderBy(*order)
    local = b.withColumns({k: F.lag(c).over(wl) for k, c in columns.items()})
    local = local.withColumn("_first", F.row_number().over(wl) == 1)

    src = list(dict.fromkeys(columns.values()))
    last = b.groupBy(_BLK, *group).agg(
        F.max_by(F.struct(*[F.col(c) for c in src]), F.struct(*[F.col(c) for c in order]))
        .alias("_last"))
    wt = Window.partitionBy(*group).orderBy(_BLK)
    carry = (last.select(_BLK, *group, F.lag("_last").over(wt).alias("_carry"))
                 .where(F.col("_carry").isNotNull()))   # continuing groups only: <= n rows
    out = null_safe_join(local, F.broadcast(carry), [_BLK, *group], "left")
    out = out.withColumns({
        k: F.when(F.col("_first") & F.col("_carry").isNotNull(), F.col("_carry")[c])
            .otherwise(F.col(k))
        for k, c in columns.items()})
    return out.drop(_BLK, "_first", "_carry")
