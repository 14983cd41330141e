"""Column profiles from maintained value-count tables.

Each column and load has a persistent table value -> count.  A load arrives as a delta with positive counts, rows
taken back as negative ones; applying a delta adds counts and drops what has become zero, and touches no other load.
All metrics (nulls, distinct values, range, pattern violations, median, entropy) are exact and come from the counts
alone, so the rows of a load are never read again.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from posegrain.functions.monotone import nan_to_null
from posegrain.operators.prefix import counted_quantiles
from posegrain.session import shared_path

KEY = ("table_name", "column_name", "load_id")
VALUE = ("num", "txt")
#: A printed number: digits, an optional minus, an optional point and digits, an optional exponent.
NUMBER_PATTERN = r"\A-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?\z"


def value_counts(df: DataFrame, table_name: str, numeric: list[str], text: list[str] = (), load: str = "load_id", sign: int = 1) -> DataFrame:
    """The signed delta of some loads: (table_name, column_name, load_id, num, txt, n).

    NaN counts as null; null has num and txt null.  -0.0 counts as 0.0.  All columns are unpivoted in one pass and
    pre-aggregated by value before the shuffle, so a hot value costs one row a task.
    """
    number = lambda c: nan_to_null(F.col(c).cast("double")) + F.lit(0.0)
    parts = [F.struct(F.lit(c).alias("column_name"), number(c).alias("num"), F.lit(None).cast("string").alias("txt")) for c in numeric]
    parts += [F.struct(F.lit(c).alias("column_name"), F.lit(None).cast("double").alias("num"), F.col(c).cast("string").alias("txt")) for c in text]
    long = df.select(F.col(load).alias("load_id"), F.inline(F.array(*parts)))
    return long.groupBy(F.lit(table_name).alias("table_name"), "column_name", "load_id", *VALUE).agg((F.count(F.lit(1)) * sign).alias("n"))


class ValueCountStore:
    """Persistent value counts below a path, one directory a table and load; opening the path again goes on from the last version.

    ``apply`` writes the loads it touches, and a small manifest that says where each load of the table stands; the other
    loads are neither read nor written.  A version exists once its manifest does, so a run that died leaves no trace in
    the state; readers keep the version they have opened.  One writer at a time.
    """

    SCHEMA = "table_name string, column_name string, load_id int, num double, txt string, n bigint"

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path = spark, path or shared_path(spark, "value-counts")
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._at = lambda *parts: hadoop.Path("/".join((self.path, *parts)))
        self._fs = self._at().getFileSystem(spark._jsc.hadoopConfiguration())
        folder = self._at("manifest")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        self.version = max((int(n[1:-5]) for n in names if n[:1] == "v" and n[1:-5].isdigit() and n[-5:] == ".json"), default=0)
        #: table (in hexadecimal) and load -> directory of its counts
        self.loads: dict[str, str] = self._manifest() if self.version else {}

    def _manifest(self) -> dict[str, str]:
        stream = self._fs.open(self._at("manifest", f"v{self.version}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _counts(self, loads: dict[str, str]) -> DataFrame:
        places = sorted(set(loads.values()))
        reader = self.spark.read.schema(self.SCHEMA)
        return reader.parquet(*(f"{self.path}/{p}" for p in places)) if places else self.spark.createDataFrame([], self.SCHEMA)

    def read(self) -> DataFrame:
        """The state: one row a table, column, load and value."""
        return self._counts(self.loads)

    def apply(self, *deltas: DataFrame) -> DataFrame:
        """Add signed deltas and return the new state.  Rows whose count becomes 0 vanish; a negative count is an error.

        A delta has one row a table, column, load and value, and is read twice (its loads, then its rows): write one that is
        costly to compute first.
        """
        state = None
        for d in deltas:
            d = d.select(*KEY[:2], F.col("load_id").cast("int").alias("load_id"), *VALUE, F.col("n").cast("bigint").alias("n"))
            state = d if state is None else state.unionByName(d)
        place = F.concat_ws("_", F.hex("table_name"), F.coalesce(F.col("load_id").cast("string"), F.lit("none")))
        touched = [r[0] for r in state.select(place).distinct().collect()]  # one row a load
        known = {t: self.loads[t] for t in touched if t in self.loads}
        if known:
            state = state.unionByName(self._counts(known))
        if known or len(deltas) > 1:
            state = state.groupBy(*KEY, *VALUE).agg(F.sum("n").alias("n"))
        state = state.where("n <> 0")
        state = state.withColumn("n", F.when(F.col("n") < 0, F.raise_error(F.lit("more rows were taken back than had arrived")).cast("bigint")).otherwise(F.col("n")))
        version = self.version + 1
        data = f"data/v{version}"
        if self._fs.exists(self._at(data)):  # left by a run that died before its manifest
            self._fs.delete(self._at(data), True)
        state.withColumn("place", place).write.option("compression", "zstd").partitionBy("place").parquet(f"{self.path}/{data}")
        written = {f.getPath().getName() for f in self._fs.listStatus(self._at(data)) if f.isDirectory()}
        loads = {t: p for t, p in self.loads.items() if t not in touched}
        loads |= {t: f"{data}/{d}" for t in touched if (d := f"place={t}") in written}  # a load taken back wholly has no directory
        with_manifest = self._fs.create(self._at("manifest", f"v{version}.tmp"), True)
        with_manifest.write(bytearray(json.dumps(loads).encode()))
        with_manifest.close()
        if not self._fs.rename(self._at("manifest", f"v{version}.tmp"), self._at("manifest", f"v{version}.json")):
            raise RuntimeError(f"version {version} of {self.path} exists already")
        self.version, self.loads = version, loads
        return self.read()


def _median(state: DataFrame) -> DataFrame:
    """Exact medians (mean of the two middle values) of the numeric columns; no task sorts a whole load's values."""
    return counted_quantiles(state.where("num is not null").select(*KEY, F.col("num").alias("v"), "n"), list(KEY), [0.5]).select(*KEY, F.col("value").alias("median"))


def profile(state: DataFrame, pattern: str = NUMBER_PATTERN) -> DataFrame:
    """One row a column and load: n_rows, n_null, n_distinct, n_values, min, max, n_below_0, n_above_1, n_infinite, n_bad_text, median, entropy (nats).

    A column without values in a load has null min, max, median and entropy and 0 distinct values.
    """
    n, num, txt = F.col("n"), F.col("num"), F.col("txt")
    has = num.isNotNull() | txt.isNotNull()
    count = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0)).cast("bigint")
    agg = state.groupBy(*KEY).agg(
        F.sum("n").cast("bigint").alias("n_rows"),
        count(~has).alias("n_null"),
        count(has).alias("n_values"),
        F.count(F.when(has, 1)).alias("n_distinct"),
        F.min("num").alias("min"),
        F.max("num").alias("max"),
        count(num < 0).alias("n_below_0"),
        count(num > 1).alias("n_above_1"),
        count(F.abs(num) == float("inf")).alias("n_infinite"),
        count(txt.isNotNull() & ~txt.rlike(pattern)).alias("n_bad_text"),
        F.sum(F.when(has, n * F.log(n.cast("double")))).alias("s"),
    )
    entropy = F.when(F.col("n_values") > 0, F.log(F.col("n_values").cast("double")) - F.col("s") / F.col("n_values"))
    return agg.withColumn("entropy", entropy).drop("s").join(_median(state), list(KEY), "left")


def findings(profiles: DataFrame, range_high: dict[str, str], no_infinity: list[str], text: list[str], null_step: float = 0.10, distinct_share: float = 0.2, shift: float = 2.0) -> DataFrame:
    """(table_name, column_name, load_id, finding) out of null_rate, range, distinct, shift and pattern.

    "Before" is the next lower load_id that the table has; the first load has no null_rate and no shift.
    ``range_high`` names the columns whose values must lie in [0, 1], ``no_infinity`` those that must be finite.
    One row a column and load enters the window, so its groups are as small as the number of loads.
    """
    w = Window.partitionBy("table_name", "column_name").orderBy("load_id")
    rate = F.col("n_null") / F.col("n_rows")
    p = profiles.withColumn("rate", rate).withColumn("rate_0", F.lag("rate").over(w)).withColumn("median_0", F.lag("median").over(w))
    column = F.col("column_name")
    number = ~column.isin(list(text)) if text else F.lit(True)

    def name(cond: Column, finding: str) -> Column:
        return F.when(cond, F.lit(finding))

    found = F.array(
        name(number & (F.abs(F.col("rate") - F.col("rate_0")) > null_step), "null_rate"),
        name(number & ((F.col("n_below_0") > 0) | (column.isin(list(range_high)) & (F.col("n_above_1") > 0)) | (column.isin(no_infinity) & (F.col("n_infinite") > 0))), "range"),
        name(number & (F.col("n_distinct") < distinct_share * F.col("n_values")), "distinct"),
        name(number & ((F.col("median") > shift * F.col("median_0")) | (F.col("median") < F.col("median_0") / shift)), "shift"),
        name(~number & (F.col("n_bad_text") > 0), "pattern"),
    )
    return p.select("table_name", "column_name", F.col("load_id").cast("int"), F.explode(F.array_compact(found)).alias("finding"))
