"""Exact global ranks and quantile bins without a one-partition window.

``unique_rank`` numbers rows 1..n by a total order.  ``row_number().over(orderBy(..))``
without ``partitionBy`` would pull every row into one task; ranking inside
``partitionBy(metric)`` would put one popular value (say frequency = 1 for a third of
users) into one task.  Instead the rows are range-partitioned on the *whole* order key
(metric, then the tie-break column), so a popular value is spread over several
partitions; each partition is sorted locally and numbered; the rank is the row's local
position plus the row count of all earlier partitions.  The per-partition counts are a
table of at most ``spark.sql.shuffle.partitions`` rows, a proven bound for the
broadcast.  The numbered rows are stored (Parquet in the shared checkpoint folder) first, so
the partition numbers are fixed and lineage is cut.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickscope.session import ensure_checkpoint_dir, materialize

RANK_ROWS_PER_PARTITION = 1_000_000


def unique_rank(df: DataFrame, order_cols: list[str | Column], rank_col: str = "rank",
                num_partitions: int | None = None) -> DataFrame:
    """``df`` plus ``rank_col`` = 1..n in ``order_cols`` order (which must be a total
    order, e.g. ending in a unique id)."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n_parts = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = (
        df.repartitionByRange(n_parts, *order_cols)
        .sortWithinPartitions(*order_cols)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    numbered = materialize(numbered, "ranked")  # freezes _pid / _mid, cuts lineage
    sizes = numbered.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    # one row per partition: a whole-table window over this table is bounded
    earlier = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_pid", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"))
    return (
        numbered.join(F.broadcast(offsets), "_pid")
        .withColumn(rank_col, (F.col("_off") + F.col("_mid") - F.col("_first") + 1).cast("long"))
        .drop("_pid", "_mid", "_first", "_off")
    )


def tercile_rule(n: int) -> tuple[int, int]:
    """Upper rank of bins 1 and 2 of ``pandas.qcut`` of the ranks 1..n into three bins."""
    b1 = (n + 1) // 3
    return b1, b1 + n // 3


def bin_limits(n: int, q: int) -> list[int]:
    """Upper rank of bins 1..q-1 of the ranks 1..n (right-closed quantile intervals)."""
    return list(tercile_rule(n)) if q == 3 else [j * (n - 1) // q + 1 for j in range(1, q)]


def qcut_bin(rank: Column | str, n: int, q: int) -> Column:
    """Bin 1..q of a unique rank 1..n."""
    r = F.col(rank) if isinstance(rank, str) else rank
    b = F.lit(1)
    for limit in bin_limits(n, q):
        b = b + F.when(r > F.lit(limit), 1).otherwise(0)
    return b


@dataclass(frozen=True)
class Statistic:
    """An order statistic: ``value`` has ``below`` smaller rows and ``equal`` rows."""

    value: int
    below: int
    equal: int


def order_statistics(df: DataFrame, wanted: dict, bounds: dict, weight: str | None = None, cell_bits: int = 14) -> tuple[dict, dict]:
    """Exact order statistics of integer columns by narrowing range counts, without a sort.

    ``wanted``: name -> ``(condition or None, column, ranks)``, the ranks (from 1) asked for
    among the rows of the condition; ``bounds``: name -> (least, greatest) value.  Rows count
    ``weight`` times.  Returns ``(name, rank) -> Statistic`` and, by name, the number of
    distinct values (at least that many where ``bounds`` span more than the cells).

    A round cuts each open range into at most ``2^cell_bits + 1`` cells and counts rows by
    cell: one aggregate for all ranges, combined before its shuffle, whose cells alone reach
    the driver.  16,384 values take one round, 64 bits take five."""
    open_ = {(name, k): (*bounds[name], 0) for name, (_, _, ks) in wanted.items() for k in ks}
    done, distinct = {}, {}
    while open_:
        groups = sorted({(name, *at) for (name, _), at in open_.items()}, key=str)
        shifts = [max(0, (hi - lo).bit_length() - cell_bits) for _, lo, hi, _ in groups]
        cells = []
        for g, ((name, lo, hi, _), shift) in enumerate(zip(groups, shifts)):
            condition, column, _ = wanted[name]
            value = F.col(column).cast("long")
            inside = value.between(lo, hi) if condition is None else condition & value.between(lo, hi)
            cells.append(F.when(inside, F.struct(F.lit(g).alias("g"), F.shiftright(value, shift).alias("cell"))))
        rows = F.lit(1).cast("long") if weight is None else F.col(weight)
        counts = (df.select(rows.alias("n"), F.explode(F.array_compact(F.array(*cells))).alias("c"))
                  .groupBy("c.g", "c.cell").agg(F.sum("n").alias("n")).collect())
        of = defaultdict(list)
        for r in sorted(counts, key=lambda r: r["cell"]):
            of[r["g"]].append((r["cell"], r["n"]))
        left = {}
        for (name, k), (lo, hi, below) in open_.items():
            g = groups.index((name, lo, hi, below))
            distinct.setdefault(name, len(of[g]))
            before = below
            for cell, n in of[g]:
                if k <= before + n:
                    break
                before += n
            first = cell << shifts[g]
            if shifts[g] == 0:
                done[name, k] = Statistic(first, before, n)
            else:
                left[name, k] = (max(lo, first), min(hi, first + (1 << shifts[g]) - 1), before)
        open_ = left
    return done, distinct


def unique_ranks(df: DataFrame, metrics: list[str], tie_col: str = "user_id", suffix: str = "_rank",
                 num_partitions: int | None = None, n: int | None = None) -> DataFrame:
    """Unique rank of several metric columns (each ascending, ties by ``tie_col``, which
    must be unique) in one range sort: the rows are stacked as ``(metric index, value,
    tie)``, ranked once by ``unique_rank``, and metric i's rank is the stacked rank minus
    ``i * n`` (every metric contributes exactly n rows).  The ranks are pivoted back per
    ``tie_col`` and joined to ``df``."""
    if not metrics:
        return df
    types = {df.schema[m].dataType.simpleString() for m in metrics}
    if len(types) != 1:
        raise ValueError(f"metrics must share one type, got {types}")
    n = df.count() if n is None else n
    if num_partitions is None:  # about RANK_ROWS_PER_PARTITION stacked rows per range partition
        cap = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        num_partitions = max(1, min(cap, -(-len(metrics) * n // RANK_ROWS_PER_PARTITION)))
    arr = F.array(*[F.struct(F.lit(i).alias("_m"), F.col(m).alias("_v")) for i, m in enumerate(metrics)])
    stacked = df.select(F.col(tie_col).alias("_t"), F.explode(arr).alias("_s")).select("_t", "_s._m", "_s._v")
    ranked = unique_rank(stacked, ["_m", "_v", "_t"], "_g", num_partitions)
    per_tie = ranked.groupBy("_t").agg(
        *[F.max(F.when(F.col("_m") == i, F.col("_g") - F.lit(i * n))).alias(f"{m}{suffix}")
          for i, m in enumerate(metrics)]
    )
    return df.join(per_tie, df[tie_col] == per_tie["_t"]).drop("_t")
