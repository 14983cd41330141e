"""Top N of every group by a loser-tree merge of stored sorted runs.

Every task sorts its rows by bucket (a hash of the group), group and rank order and stores them as one run (no shuffle:
a run holds whatever rows its task had).  Runs are merged with a loser tree, at most
``FAN_IN`` at once: while there are more, each task merges that many into one run.  The last pass has a task per bucket,
which opens each run at its bucket.  Once a group has its N rows, the merge seeks to the next group: row groups of a
stored run that hold nothing but finished groups are skipped by their statistics, rows of a batch by vectorised cuts.
A merge holds one batch a run in memory, however large a group is, and no group is ever gathered in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from posegrain.session import open_shared, shared_path

#: Columns of a stored run: bucket, groups g0, g1, ..., the negated score, tie columns, payload.
ROW_GROUP_BYTES = 4 << 20
#: Runs that a task merges at once.
FAN_IN = 64


class LoserTree:
    """Merges k sorted sources of (key, rest) pairs by key; equal keys come in the order of the sources.  A pop costs log2 k comparisons."""

    def __init__(self, sources: list[Iterator[tuple]]) -> None:
        self.sources = sources
        self.k = k = max(1, len(sources))
        self.head: list[tuple | None] = [next(s, None) for s in sources] or [None]
        self.tree = [-1] * k
        for i in range(k):
            self._up(i, building=True)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return x[0] < y[0] or (x[0] == y[0] and a < b)

    def _up(self, leaf: int, building: bool = False) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            other = self.tree[node]
            if other == -1:
                if building:
                    self.tree[node] = winner
                    return
            elif self._beats(other, winner):
                self.tree[node], winner = winner, other
            node //= 2
        self.tree[0] = winner

    def peek(self) -> tuple | None:
        return self.head[self.tree[0]]

    def pop(self) -> tuple | None:
        at = self.tree[0]
        got = self.head[at]
        if got is not None:
            self.head[at] = next(self.sources[at], None)
            self._up(at)
        return got


def _stored(runs: DataFrame) -> list[str]:
    """Write one run a partition, in its order; returns the runs' files."""
    path = shared_path(runs.sparkSession, "runs")
    runs.write.option("parquet.block.size", ROW_GROUP_BYTES).option("compression", "zstd").parquet(path)
    return sorted(runs.sparkSession.read.schema(runs.schema).parquet(path).inputFiles())


def _cursor(uri: str, columns: list[str], n_groups: int, n_key: int, n: int, bucket: int | None, finished: Callable[[], tuple | None], batch_rows: int) -> Iterator[tuple]:
    """Rows of a stored run in order (of one bucket, if given), at most n of each group, without those of groups that are finished."""
    import numpy as np
    import pyarrow.parquet as pq

    with pq.ParquetFile(open_shared(uri)) as run:
        at = [run.schema_arrow.get_field_index(c) for c in columns[:n_groups]]
        last, taken = None, 0
        for rg in range(run.num_row_groups):
            stats = [run.metadata.row_group(rg).column(i).statistics for i in at]
            if bucket is not None and stats[0] is not None and stats[0].has_min_max:
                if stats[0].max < bucket:
                    continue
                if stats[0].min > bucket:
                    break
            done = finished()
            if done is not None and all(s is not None and s.has_min_max and s.min == s.max for s in stats) and tuple(s.max for s in stats) <= done:
                continue  # one finished group fills this row group
            for batch in run.iter_batches(batch_rows, row_groups=[rg], columns=columns):
                if bucket is not None:
                    own = np.flatnonzero(batch.column(0).to_numpy() == bucket)
                    batch = batch.slice(own[0], len(own)) if len(own) else batch.slice(0, 0)
                size = len(batch)
                if not size:
                    continue
                keys = [batch.column(i) for i in range(n_groups)]
                change = np.zeros(size, bool)
                change[0] = True
                for k in keys:
                    codes = k.dictionary_encode().indices.to_numpy(zero_copy_only=False)
                    change[1:] |= codes[1:] != codes[:-1]
                starts = np.flatnonzero(change)
                rank = np.arange(size) - np.repeat(starts, np.diff(np.append(starts, size)))
                first = tuple(k[0].as_py() for k in keys)
                if first == last:
                    head = starts[1] if len(starts) > 1 else size
                    rank[:head] += taken
                keep = np.flatnonzero(rank < n)
                last = tuple(k[-1].as_py() for k in keys)
                taken = int(rank[-1]) + 1
                for row in zip(*(batch.column(i).take(pa.array(keep)).to_pylist() for i in range(batch.num_columns)), strict=True):
                    done = finished()
                    if done is None or row[:n_groups] > done:
                        yield row[:n_key], row[n_key:]


def merge(spark: SparkSession, jobs: list[tuple[list[str], int | None]], schema: str, n_groups: int, n_key: int, n: int, batch_rows: int = 4096) -> DataFrame:
    """One task a job (runs, bucket or None for all): loser-tree merge, first ``n`` rows of each group in order, with their rank."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    shared = spark.sparkContext.broadcast(jobs)  # names of files: FAN_IN a job
    arrow = to_arrow_schema(_parse_datatype_string(f"{schema}, rank bigint"))
    names = arrow.names

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                uris, bucket = shared.value[number]
                state: dict[str, Any] = {"done": None}
                tree = LoserTree([_cursor(u, names[:-1], n_groups, n_key, n, bucket, lambda: state["done"], batch_rows) for u in uris])  # noqa: B023
                group, count, rows = None, 0, []
                while (pair := tree.pop()) is not None:
                    row = pair[0] + pair[1]
                    g = row[:n_groups]
                    if g != group:
                        group, count = g, 0
                    if count < n:
                        count += 1
                        rows.append((*row, count))
                        if count == n:
                            state["done"] = g  # every cursor seeks behind this group
                    if len(rows) >= 8192:
                        yield table(rows)
                        rows = []
                if rows:
                    yield table(rows)

    return spark.range(0, len(jobs), 1, len(jobs)).mapInArrow(run, f"{schema}, rank bigint")


def top_n(df: DataFrame, groups: list[str], score: str, ties: list[str], n: int, payload: list[str] | None = None, n_buckets: int | None = None, fan_in: int = FAN_IN) -> DataFrame:
    """(groups..., score, ties..., payload..., rank): the ``n`` rows of each group with the highest score, equal ones by ascending ties.

    Rows with a null group, score or tie, or a NaN score, are left out.  Rows equal in score and all ties are both kept,
    in any order; a group with fewer than n rows gives all of them; no rows give none.  Extra columns are ignored
    unless named in ``payload``; the output names are those of the input.
    """
    spark = df.sparkSession
    payload = [p for p in payload or [] if p not in groups and p not in ties and p != score]
    n_buckets = n_buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    inner = ["bucket", *(f"g{i}" for i in range(len(groups)))]
    tied = [f"t{i}" for i in range(len(ties))]
    paid = [f"p{i}" for i in range(len(payload))]
    d = df.select(*(F.col(a).alias(b) for a, b in zip([*groups, *ties, *payload], [*inner[1:], *tied, *paid], strict=True)), F.col(score).cast("double").alias("s"))
    d = d.where(F.expr(" and ".join(f"{c} is not null" for c in [*inner[1:], *tied, "s"]) + " and not isnan(s)"))
    d = d.select(F.pmod(F.xxhash64(*inner[1:]), F.lit(n_buckets)).cast("int").alias("bucket"), *inner[1:], (-F.col("s")).alias("neg_score"), *tied, *paid)
    schema = ", ".join(f"{c} {t}" for c, t in d.dtypes)
    n_key = len(inner) + 1 + len(ties)
    files = _stored(d.sortWithinPartitions(*d.columns[:n_key]))
    while len(files) > fan_in:
        files = _stored(merge(spark, [(files[i : i + fan_in], None) for i in range(0, len(files), fan_in)], schema, len(inner), n_key, n).drop("rank"))
    got = merge(spark, [(files, b) for b in range(n_buckets)], schema, len(inner), n_key, n)
    named = dict(zip([*inner[1:], *tied, *paid], [*groups, *ties, *payload], strict=True))
    return got.select(*(F.col(g).alias(named[g]) for g in inner[1:]), (-F.col("neg_score") + F.lit(0.0)).alias(score), *(F.col(c).alias(named[c]) for c in [*tied, *paid]), "rank")
