"""Order-dependent operators that do not depend on how large one group is.

A plain window puts each group into one task. That is right while groups are small, so the
size of the largest group is looked up first (a counting aggregate over the key columns only).
Groups beyond the bound are range-partitioned by (key, order) into contiguous slices, which is
how a global sort spreads its work; windows then run inside a slice:

* ``ranked`` adds the rows of earlier slices to the number inside the slice;
* ``with_neighbours`` copies the few rows before or after a slice into it, so that lag, lead
  and short frames see what they would have seen in the whole group.

Both give exactly the answer of the plain window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, WindowSpec, functions as F

from setledger.session import pin

# Rows of one group that a single task may hold and sort.
ROWS_PER_TASK = 2_000_000

_SLICE = "_slice"
_HALO = "_halo"


def order_key(*columns: str) -> Column:
    """One comparable value for several ascending columns, nulls last."""
    fields = []
    for name in columns:
        fields += [F.col(name).isNull().alias(f"{name}_missing"), F.col(name).alias(name)]
    return F.struct(*fields)


def ascending(columns: Sequence[str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in columns]


def descending(columns: Sequence[str]) -> list[Column]:
    return [F.col(c).desc_nulls_first() for c in columns]


def _window(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return W.partitionBy(*keys).orderBy(*ascending(order))


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest group; one aggregate that is combined on the map side."""
    if not keys:
        return df.count()
    biggest = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    return biggest or 0


def _slices(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int) -> DataFrame:
    count = max(2, -(-df.count() // rows) * 2)
    ranged = df.repartitionByRange(count, *[F.col(k) for k in keys], *ascending(order))
    return pin(ranged.withColumn(_SLICE, F.spark_partition_id()))


def _hot_and_rest(df: DataFrame, keys: Sequence[str], rows: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of oversized groups, and the others. At most (all rows / bound) keys are oversized,
    and the join lets Spark choose the strategy from the real size of that list."""
    if not keys:
        return df, None
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > rows)
    sizes = pin(sizes.select(*[F.col(k).alias(f"_hot_{k}") for k in keys]))
    same = [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in keys]
    hot = df.join(sizes, same, "left_semi")
    rest = df.join(sizes, same, "left_anti")
    return hot, rest


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str,
           rows_per_task: int | None = None) -> DataFrame:
    """``df`` plus the exact 1-based row number ``name`` within ``keys``. ``order`` is ascending,
    nulls last, and ends in a unique column."""
    bound = rows_per_task or ROWS_PER_TASK
    if largest_group(df, keys) <= bound:
        return df.withColumn(name, F.row_number().over(_window(keys, order)).cast("bigint"))
    hot, rest = _hot_and_rest(df, keys, bound)
    sliced = _slices(hot, keys, order, bound)
    sizes = sliced.groupBy(*keys, _SLICE).agg(F.count("*").alias("_n"))
    # one row per (key, slice): bounded by the number of slices
    earlier = W.partitionBy(*keys).orderBy(_SLICE).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*[F.col(k).alias(f"_o_{k}") for k in keys], F.col(_SLICE).alias("_o_slice"),
                           F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    inside = sliced.withColumn("_inside", F.row_number().over(_window([*keys, _SLICE], order)))
    same = [F.col(k).eqNullSafe(F.col(f"_o_{k}")) for k in keys]
    joined = inside.join(offsets, [*same, F.col(_SLICE) == F.col("_o_slice")], "left")
    done = joined.withColumn(name, F.col("_inside") + F.col("_offset")).select(*df.columns, name)
    if rest is None:
        return done
    plain = rest.withColumn(name, F.row_number().over(_window(keys, order)).cast("bigint"))
    return done.unionByName(plain)


def with_neighbours(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                    add: Callable[[DataFrame, WindowSpec], DataFrame],
                    before: int = 0, after: int = 0, rows_per_task: int | None = None,
                    derived_from: DataFrame | None = None) -> DataFrame:
    """Apply ``add(df, window)``, whose columns look at most ``before`` rows back and ``after``
    rows ahead within ``keys``.

    ``derived_from`` names the rows that ``df`` was reduced from: their groups are at least as
    large and cheaper to count. Only when those are too large is ``df`` itself stored and counted.
    """
    bound = rows_per_task or ROWS_PER_TASK
    if derived_from is not None and largest_group(derived_from, keys) > bound:
        df, derived_from = pin(df), None
    if derived_from is not None or largest_group(df, keys) <= bound:
        return add(df, _window(keys, order))
    hot, rest = _hot_and_rest(df, keys, bound)
    sliced = _slices(hot, keys, order, bound)
    spread = sliced.withColumn(_HALO, F.lit(False))
    if before:
        spread = spread.unionByName(_borrowed(sliced, keys, order, before, ahead=False))
    if after:
        spread = spread.unionByName(_borrowed(sliced, keys, order, after, ahead=True))
    # slices are contiguous in the order, so borrowed rows sort to the right end by themselves
    done = add(spread, _window([*keys, _SLICE], order)).filter(~F.col(_HALO)).drop(_HALO, _SLICE)
    if rest is None:
        return done
    return done.unionByName(add(rest, _window(keys, order)))


def _borrowed(sliced: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int,
              ahead: bool) -> DataFrame:
    """Copies of the ``rows`` rows nearest to each slice on one side, tagged with that slice.

    Each slice offers its outermost rows to the next slices of the same key. A slice may hold
    fewer than ``rows`` rows, so an offer goes as far as needed: up to ``rows`` slices on.
    """
    inward = ascending(order) if ahead else descending(order)
    outward = W.partitionBy(*keys, _SLICE).orderBy(*inward)
    edge = (sliced.withColumn("_edge", F.row_number().over(outward))
            .filter(F.col("_edge") <= rows))
    present = sliced.select(*keys, _SLICE).distinct()
    place = F.row_number().over(W.partitionBy(*keys).orderBy(_SLICE))
    numbered = pin(present.withColumn("_place", place))
    offered = edge.join(*_same_slice(numbered, keys), "inner").drop(*[f"_p_{k}" for k in keys], "_p_slice")
    step = -1 if ahead else 1
    offered = (offered.withColumn("_step", F.explode(F.sequence(F.lit(1), F.lit(rows))))
               .withColumn("_to", F.col("_place") + step * F.col("_step")))
    targets = numbered.select(*[F.col(k).alias(f"_t_{k}") for k in keys],
                              F.col(_SLICE).alias("_t_slice"), F.col("_place").alias("_t_place"))
    same = [F.col(k).eqNullSafe(F.col(f"_t_{k}")) for k in keys]
    moved = offered.join(targets, [*same, F.col("_to") == F.col("_t_place")], "inner")
    # of all offers to a slice keep the nearest rows: fewest steps, then outermost
    nearest = W.partitionBy(*keys, "_t_slice").orderBy("_step", "_edge")
    kept = moved.withColumn("_near", F.row_number().over(nearest)).filter(F.col("_near") <= rows)
    own = [c for c in sliced.columns if c != _SLICE]
    return kept.select(*own, F.col("_t_slice").alias(_SLICE), F.lit(True).alias(_HALO))


def _same_slice(numbered: DataFrame, keys: Sequence[str]):
    other = numbered.select(*[F.col(k).alias(f"_p_{k}") for k in keys],
                            F.col(_SLICE).alias("_p_slice"), "_place")
    same = [F.col(k).eqNullSafe(F.col(f"_p_{k}")) for k in keys]
    return other, [*same, F.col(_SLICE) == F.col("_p_slice")]

