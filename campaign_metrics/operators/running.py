"""Exact running sums that never funnel one group into one task (W1 scale form).

``sum().over(Window.partitionBy(g).orderBy(t))`` sends a whole group to one
task; a campaign holding a third of all records would then be one task. Here
the rows are range-partitioned on (group, order keys), so a hot group is split
across many balanced tasks, and each task's running sum is shifted by the
totals of the earlier tasks:

1. ``repartitionByRange`` + ``sortWithinPartitions``, and in the same pass one
   Arrow-batched step per range (``mapInArrow``, vectorised numpy) adds the
   local running sum as scaled integers. The result is written once to the
   shared folder: nothing later depends on how it is read, and a lost executor
   never recomputes the input.
2. Per (range, group) totals of the written table -> offsets by a window over
   the range number: at most ranges + groups rows.
3. The offsets are written, too, so that the planner knows their size, and join
   the written rows by (range, group): a few are broadcast, and the rows are not
   shuffled a second time. They are added on the JVM side in decimal(38), so the
   totals stay exact.

The number of ranges follows from the bytes that the input reads, and is at
least the number of cores. ``running_positions`` numbers rows the same way.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from campaign_metrics.session import checkpoint_dir, staged

_PART = "_rs_part"
RANGE_BYTES = 32 << 20  # of input files


def _local_cumsums(group: str, scaled: list[str]):
    """Arrow-batch function: per-row running sums inside a partition.

    Rows arrive sorted by (group, order); a group's rows are contiguous, and
    its sum continues across batch boundaries. Vectorised segmented cumsum:
    no per-row Python, pass-through columns never leave Arrow memory.
    """
    import pyarrow as pa

    def run(batches):
        carry_group, carry = None, {c: 0 for c in scaled}
        for rb in batches:
            n = rb.num_rows
            if n == 0:
                for c in scaled:
                    rb = rb.append_column(f"{c}_loc", pa.array([], pa.int64()))
                yield rb
                continue
            g = rb.column(group).to_numpy(zero_copy_only=False)
            starts = np.empty(n, dtype=bool)
            starts[0] = True
            starts[1:] = g[1:] != g[:-1]
            seg = np.cumsum(starts) - 1
            first = np.flatnonzero(starts)
            continues = carry_group is not None and g[0] == carry_group
            new_carry = {}
            for c in scaled:
                # Scaled values are never NULL (coalesced to 0 before the pass).
                v = rb.column(c).to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
                cs = np.cumsum(v)
                local = cs - (cs[first] - v[first])[seg]
                if continues:
                    local[seg == 0] += carry[c]
                new_carry[c] = int(local[-1])
                rb = rb.append_column(f"{c}_loc", pa.array(local, pa.int64()))
            carry_group, carry = g[-1], new_carry
            yield rb
    return run


def running_sums(df: DataFrame, group: str, order: Sequence[str], values: dict[str, int],
                 num_partitions: int | None = None, suffix: str = "cumulative_") -> DataFrame:
    """Add ``{suffix}{name}`` = running sum of ``name`` per ``group`` in ``order``.

    ``values`` maps a numeric column to its decimal scale (0 for integers); the
    running sum is exact for that scale. ``order`` must be a total order inside
    a group (tie-break on a unique key). ``num_partitions`` sets the number of
    ranges, which otherwise follows from the input's size.
    """
    n = num_partitions or range_count(df)
    keys = [group, *order]
    scaled = {c: f"_rs_{c}" for c in values}
    prepared = df
    for c, scale in values.items():
        prepared = prepared.withColumn(scaled[c], F.coalesce((F.col(c) * F.lit(10 ** scale)).cast("long"), F.lit(0)))
    ranged = (prepared.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
              .withColumn(_PART, F.spark_partition_id()))
    names = list(scaled.values())
    out_schema = T.StructType(list(ranged.schema.fields) + [T.StructField(f"{s}_loc", T.LongType()) for s in names])
    local = staged(ranged.mapInArrow(_local_cumsums(group, names), out_schema), "running-sums")

    # Offsets: totals of the earlier ranges of the same group, in decimal(38,0).
    wide = T.DecimalType(38, 0)
    seg = local.groupBy(_PART, group).agg(*[F.sum(F.col(s).cast(wide)).alias(s) for s in names])
    before = Window.partitionBy(group).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = staged(seg.select(_PART, group, *[
        F.coalesce(F.sum(s).over(before), F.lit(0).cast(wide)).cast(wide).alias(f"{s}_off") for s in names]), "running-offsets")
    joined = local.join(offsets, [_PART, group], "left")
    exprs = list(df.columns)
    for c, scale in values.items():
        s = scaled[c]
        total = (F.coalesce(F.col(f"{s}_off"), F.lit(0).cast(wide)) + F.col(f"{s}_loc").cast(wide)).cast(wide)
        cum = (total / F.lit(10 ** scale)).cast(T.DecimalType(38, scale)) if scale else total.cast("long")
        exprs.append(cum.alias(f"{suffix}{c}"))
    return joined.select(*exprs)


def range_count(df: DataFrame, range_bytes: int = RANGE_BYTES) -> int:
    """Ranges for ``df``: one for every ``range_bytes`` that its plan reads, and no fewer than there are cores.

    The bytes are those of the plan's leaves (file sizes): estimates for joins above them would multiply. Where a leaf
    does not know its size, ``spark.sql.shuffle.partitions`` counts.
    """
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    if any(size >= 1 << 62 for size in sizes):
        wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    else:
        wanted = -(-sum(sizes) // range_bytes)
    return max(spark.sparkContext.defaultParallelism, wanted)


def running_positions(df: DataFrame, group: str, order: Sequence[str], name: str = "position",
                      num_partitions: int | None = None) -> DataFrame:
    """The number of each row in its group in ``order``, from 1, without a window over a group."""
    ones = running_sums(df.withColumn("_rs_one", F.lit(1)), group, order, {"_rs_one": 0}, num_partitions, suffix="_rs_sum")
    return ones.select(*df.columns, F.col("_rs_sum_rs_one").alias(name))


def running_sums_small(df: DataFrame, group: Sequence[str], order: Sequence[str], values: Sequence[str],
                       suffix: str = "cumulative_") -> DataFrame:
    """Plain window running sums for series that are already aggregated
    (bucket rows per campaign/center are few), where a group cannot be hot."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df
    for c in values:
        out = out.withColumn(f"{suffix}{c}", F.sum(c).over(w))
    return out


__all__ = ["running_sums", "running_positions", "running_sums_small", "range_count", "checkpoint_dir"]
