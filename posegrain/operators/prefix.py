"""Ranks, prefix sums and quantiles of very large groups.

A plain window over a group without further partitions puts the whole group into one task.  Here rows are first
counted by value (which also makes ties order-free), then cut into ranges of (group, value) whose bounds are sampled
from the data, so that a range holds about as many values as any other however the values are spread.  Range totals
give each range its offset, and only the values of one range are ever sorted together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from posegrain.session import materialize

BIN = "_bin"


def same(groups: list[str], a: str, b: str) -> Column:
    """Equality of all ``groups`` of the frames named a and b; null groups are groups."""
    on = F.lit(True)
    for g in groups:
        on = on & F.col(f"{a}.{g}").eqNullSafe(F.col(f"{b}.{g}"))
    return on


def _running(ranges: DataFrame, groups: list[str], sums: list[str]) -> DataFrame:
    """Adds the partition's number and, for each of ``sums``, ``_i_<s>``: the sum over the group's earlier rows of the partition.

    The partitions are sorted by group already.  A window would shuffle them again, for it cannot be told of ranges; here
    each batch is cut at the groups' bounds and only the last group's sums are carried on.
    """
    kinds = dict(ranges.dtypes)
    names = [*ranges.columns, BIN, *(f"_i_{s}" for s in sums)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        last, carry = None, dict.fromkeys(sums, 0)
        for batch in batches:
            size = len(batch)
            if not size:
                continue
            change = np.zeros(size, bool)
            change[0] = True
            for g in groups:
                codes = pc.fill_null(pc.dictionary_encode(batch.column(g)).indices, -1).to_numpy(zero_copy_only=False)
                change[1:] |= codes[1:] != codes[:-1]
            starts = np.flatnonzero(change)
            lengths = np.diff(np.append(starts, size))
            key = lambda i: tuple(batch.column(g)[i].as_py() for g in groups)  # noqa: B023, E731
            goes_on = last is not None and key(0) == last
            out = []
            for s in sums:
                v = batch.column(s).to_numpy(zero_copy_only=False)
                upto = np.cumsum(v)
                before = upto - v
                before = before - np.repeat(before[starts], lengths)
                if goes_on:
                    before[: lengths[0]] += carry[s]
                carry[s] = before[-1] + v[-1]
                out.append(pa.array(before))
            last = key(size - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(size, part, np.int32)), *out], names=names)

    added = [f"{BIN} int", *(f"_i_{s} {kinds[s]}" for s in sums)]
    return ranges.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in ranges.dtypes), *added]))


def cumulate(counted: DataFrame, groups: list[str], order: str, sums: list[str], descending: bool = False) -> DataFrame:
    """Adds ``<s>_before`` (sum over values that come earlier) and ``<s>_all`` (sum over the group) for each of ``sums`` (bigint or double).

    ``counted`` has one row a (group, value of ``order``).  Null groups are groups; ``order`` and the sums must not be null or
    NaN.  The ranges are written once, with the sums inside each range; later steps and retries see the same ranges.  Range
    totals are at most one row a group and range; written too, they are broadcast only where their size allows it.
    """
    by = F.col(order).desc() if descending else F.col(order).asc()
    ranges = counted.repartitionByRange(*groups, by).sortWithinPartitions(*groups, by)
    c = materialize(_running(ranges, groups, sums), "ranges")
    totals = c.groupBy(*groups, BIN).agg(*(F.sum(s).alias(f"_t_{s}") for s in sums))
    over_bins = Window.partitionBy(*groups).orderBy(BIN).rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*groups)
    totals = totals.select(*groups, BIN, *(F.coalesce(F.sum(f"_t_{s}").over(over_bins), F.lit(0)).alias(f"_o_{s}") for s in sums), *(F.sum(f"_t_{s}").over(group).alias(f"{s}_all") for s in sums))
    both = c.alias("c").join(materialize(totals, "range-totals").alias("t"), same([*groups, BIN], "c", "t"))
    return both.select(*(F.col(f"c.{x}").alias(x) for x in counted.columns), *((F.col(f"_o_{s}") + F.col(f"_i_{s}")).alias(f"{s}_before") for s in sums), *(F.col(f"{s}_all") for s in sums))


def quantiles(df: DataFrame, groups: list[str], column: str, probs: list[float]) -> DataFrame:
    """(groups..., prob, n, value): exact quantiles with linear interpolation at (n - 1) prob, as pandas and SQL's quantile_cont give them."""
    c = df.where(f"{column} is not null and not isnan({column})").groupBy(*groups, F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return counted_quantiles(c, groups, probs)


def counted_quantiles(counted: DataFrame, groups: list[str], probs: list[float]) -> DataFrame:
    """quantiles() of values ``v`` that stand once a group, ``n`` times each."""
    c = cumulate(counted, groups, "v", ["n"])
    # one compact lambda instead of an expression a probability; positions are 0-based
    h = "(n_all - 1D) * p"
    point = f"transform(array({', '.join(f'{float(p)!r}D' for p in probs)}), p -> named_struct('prob', p, 'lo', cast(floor({h}) as bigint), 'hi', least(cast(floor({h}) as bigint) + 1, n_all - 1), 'part', {h} - floor({h})))"
    inside = lambda x: f"({x} >= n_before and {x} < n_before + n)"
    c = c.select(*groups, "v", "n", "n_before", "n_all", F.expr(f"inline(filter({point}, x -> {inside('x.lo')} or {inside('x.hi')}))"))
    value = lambda side, out: F.max(F.when(F.expr(inside(side)), F.col("v"))).alias(out)
    out = c.groupBy(*groups, "prob").agg(F.max("n_all").alias("n"), value("lo", "a"), value("hi", "b"), F.max("part").alias("part"))
    return out.select(*groups, "prob", "n", F.when((F.col("part") == 0) | (F.col("a") == F.col("b")), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("value"))


def average_ranks(counted: DataFrame, groups: list[str], value: str, out: str) -> DataFrame:
    """(groups..., value, out, n_all): the average rank (1-based) that rows of each value have in their group, from counts ``n`` by value."""
    r = cumulate(counted, groups, value, ["n"])
    return r.select(*groups, value, (F.col("n_before") + (F.col("n") + 1) / 2.0).alias(out), "n_all")
