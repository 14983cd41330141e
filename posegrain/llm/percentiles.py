"""Exact percentiles per group by bisection, additive over partitions, loads and days.

Value intervals are kept per group and percentile.  Each pass counts the rows below a set of midpoints of every
open interval and keeps the part that holds the target rank; the counts of separate loads add up, so that loads
counted apart and rows counted at once give the same answer.  An interval is the pair of the smallest and largest
value of its part, so it is closed as soon as they are equal; then the error is zero.  Before that, the interval
itself is the stated error bound.

The first pass uses midpoints that are the same for all groups (a fixed monotone scale), so it needs no join and
its counts can be stored per load (``bin_counts``) and merged for ever.  Later passes look only at the rows inside
intervals that are still open.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from posegrain.functions.monotone import fixed_bin, nan_to_null, root64
from posegrain.session import materialize

BIN = "_bin"
#: Copies of each open interval that the rows of a bin are spread over.
SALTS = 8
#: Open intervals (under 200 bytes each) up to which they are broadcast instead of shuffling the rows.
BROADCAST_SPANS = 200_000


def long_values(df: DataFrame, groups: dict[str, Column], columns: list[str]) -> DataFrame:
    """(groups..., column_name, value): the values to rank.  Null and NaN are no values; -0.0 is 0.0; infinities are values."""
    parts = F.array(*(F.struct(F.lit(c).alias("column_name"), (nan_to_null(F.col(c).cast("double")) + F.lit(0.0)).alias("value")) for c in columns))
    return df.select(*(e.alias(g) for g, e in groups.items()), F.inline(parts)).where("value is not null")


def bin_counts(values: DataFrame, groups: list[str]) -> DataFrame:
    """Rows, smallest and largest value by group and bin of the fixed scale.  Stored per load, it is all a later merge needs
    for percentiles with the bin's values as error bound."""
    return values.groupBy(*groups, fixed_bin(F.col("value")).alias(BIN)).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))


def merge_counts(parts: list[DataFrame], groups: list[str]) -> DataFrame:
    """Add the counts of separate loads."""
    if len(parts) == 1:
        return parts[0]
    return reduce(DataFrame.unionByName, parts).groupBy(*groups, BIN).agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def locate(counts: DataFrame, groups: list[str], percentiles: list[float]) -> DataFrame:
    """The bin that holds each target rank: (groups..., percentile, n_rows, rank, below, lo, hi).

    The rank of percentile p among n rows is max(1, ceil(p n)).  A group's window holds its occupied bins, not its rows.
    """
    upto = Window.partitionBy(*groups).orderBy(BIN).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = counts.withColumn("upto", F.sum("n").over(upto)).withColumn("n_rows", F.sum("n").over(Window.partitionBy(*groups)))
    targets = F.array(*(F.struct(F.lit(float(p)).alias("percentile"), F.greatest(F.lit(1).cast("bigint"), F.ceil(F.lit(float(p)) * F.col("n_rows"))).alias("rank")) for p in percentiles))
    c = c.withColumn("targets", F.filter(targets, lambda t: (t["rank"] <= F.col("upto")) & (t["rank"] > F.col("upto") - F.col("n"))))
    return c.where(F.size("targets") > 0).select(*groups, "n_rows", (F.col("upto") - F.col("n")).alias("below"), "lo", "hi", F.inline("targets"))


def _part(x: Column, lo: Column, hi: Column, fanout: int) -> Column:
    """Which of ``fanout`` equal parts of [lo, hi] holds x; parts are equal on the root scale where the interval spans magnitudes.

    Both ends of the interval fall into different parts, so every pass narrows it.  Infinite ends get parts of their own.
    """
    inf = float("inf")
    wide = (lo <= 0) & (hi > 0) | (hi > 16 * lo) & (lo > 0) | (lo < 16 * hi) & (hi < 0)
    wide = wide & (root64(lo) < root64(hi))
    bent = (root64(x) - root64(lo)) / (root64(hi) - root64(lo))
    flat = (x * 0.5 - lo * 0.5) / (hi * 0.5 - lo * 0.5)
    place = F.when(wide, bent).otherwise(flat)
    return F.when(x == inf, F.lit(fanout)).when(x == -inf, F.lit(-1)).when(lo == -inf, F.lit(0)).when(hi == inf, F.lit(0)).otherwise(F.least(F.floor(place * fanout), F.lit(fanout - 1))).cast("bigint")


def _narrow(frames: list[DataFrame], open_: DataFrame, groups: list[str], fanout: int) -> DataFrame:
    """One pass: count rows below the midpoints of the open intervals, in each frame apart, and keep the parts with the targets."""
    spans = open_.select(*groups, F.col("lo").alias("a"), F.col("hi").alias("b"), fixed_bin(F.col("lo")).alias("_at")).distinct()
    keys = [*groups, "_at"]
    few = spans.count() <= BROADCAST_SPANS
    if few:
        spans, salt = F.broadcast(spans), []
    else:
        # every open interval lies in one bin of the fixed scale: with the bin in the join key a hot group is spread over
        # its bins, and the salt splits what one hot value leaves in a bin
        spans, salt = spans.select("*", F.expr(f"explode(sequence(0L, {SALTS - 1}L))").alias("_salt")), [F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).alias("_salt")]
        keys = [*keys, "_salt"]
    counted = []
    for f in frames:
        v = f.select(*groups, "value", fixed_bin(F.col("value")).alias("_at"), *salt)
        near = v.alias("v").join(spans.alias("s"), reduce(lambda x, y: x & y, (F.col(f"v.{g}").eqNullSafe(F.col(f"s.{g}")) for g in keys)))
        near = near.where((F.col("value") >= F.col("a")) & (F.col("value") <= F.col("b")))
        near = near.select(*(F.col(f"v.{g}").alias(g) for g in groups), "a", "b", "value", _part(F.col("value"), F.col("a"), F.col("b"), fanout).alias(BIN))
        counted.append(near.groupBy(*groups, "a", "b", BIN).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")))
    keys = [*groups, "a", "b"]
    c = merge_counts(counted, keys)
    w = Window.partitionBy(*keys).orderBy(BIN).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = c.withColumn("upto", F.sum("n").over(w))
    o = open_.withColumnRenamed("lo", "a").withColumnRenamed("hi", "b")
    both = o.alias("o").join(c.alias("c"), reduce(lambda x, y: x & y, (F.col(f"o.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys)))
    both = both.where("rank > below + upto - n and rank <= below + upto")
    return both.select(*(F.col(f"o.{g}").alias(g) for g in groups), "n_rows", (F.col("below") + F.col("upto") - F.col("n")).alias("below"), "lo", "hi", "percentile", "rank")


def percentiles(frames: list[DataFrame], groups: list[str], wanted: list[float], fanout: int = 1024, max_error: float = 0.0) -> DataFrame:
    """(groups..., percentile, n_rows, value, max_error) of the rows of all ``frames`` together.

    ``frames`` are outputs of ``long_values`` (``groups`` then includes column_name), one for each load that is
    counted apart.  ``value`` is the value at rank max(1, ceil(p n)); with ``max_error`` 0 it is exact, else
    passes end when an interval is no wider and ``value`` is its lower end.  Ties and repeated rows count as
    rows; a null label is a group; groups without values and empty frames give no rows.
    """
    state = materialize(locate(merge_counts([bin_counts(f, groups) for f in frames], groups), groups, wanted), "intervals")
    # the first condition closes intervals of one infinite value, whose width is NaN
    undecided = (F.col("hi") > F.col("lo")) & (F.col("hi") - F.col("lo") > F.lit(float(max_error)))
    done = [state.where(~undecided)]
    open_ = state.where(undecided)
    while open_.limit(1).count():  # both ends of an interval fall into different parts, so every pass narrows it
        state = materialize(_narrow(frames, open_, groups, fanout), "intervals")
        done.append(state.where(~undecided))
        open_ = state.where(undecided)
    out = reduce(DataFrame.unionByName, done)
    return out.select(*groups, "percentile", "n_rows", F.col("lo").alias("value"), F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(F.lit(0.0)).alias("max_error"))
