"""Result files: tiers, stages, runs, reports and packets."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

# The parts of a published benchmark.
MODELS = ("hrnet_w32", "resnet50", "vitpose_small")
DATASETS = ("coco", "crowdpose", "ochuman")
STAGES = ("gmm_no_tta", "gmm_tta", "gmm_tta_mrf")


def undotted(df: DataFrame) -> DataFrame:
    """Dots in column names become underscores, NaN becomes null; names that would clash keep a number."""
    seen: dict[str, int] = {}
    out = []
    for c, t in df.dtypes:
        name = c.replace(".", "_")
        n = seen[name] = seen.get(name, -1) + 1
        quoted = "`" + c.replace("`", "``") + "`"
        out.append((F.expr(f"nanvl({quoted}, null)") if t in ("double", "float") else F.col(quoted)).alias(name if not n else f"{name}_{n}"))
    return df.select(*out)


def with_optional(df: DataFrame, **defaults) -> DataFrame:
    """Adds the columns that are not there, with their defaults."""
    return df.select("*", *(F.lit(v).alias(c) for c, v in defaults.items() if c not in df.columns))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """A results file, or a directory of them with differing schemas."""
    return undotted(spark.read.option("mergeSchema", True).parquet(path))


def tier_name(file: str = "input_file_name()") -> str:
    """Tier of a result file as SQL: its stem without `_results`; combined files are the tier General."""
    stem = f"regexp_extract({file}, '([^/]+)\\\\.parquet[^/]*(?:/[^/]*)?$', 1)"
    return f"case when {stem} rlike 'combined|General' then 'General' else regexp_replace({stem}, '_results$', '') end"


def tier_folder(tier: str) -> str:
    """Folder of a tier's reports as SQL: the tier's name, 06_General for General."""
    return f"if({tier} = 'General', '06_General', {tier})"


def tier_files(spark: SparkSession, root: str) -> list[str]:
    """Result files of a directory: `*_results.parquet`, else all Parquet files but those of metadata, and the combined file if there is one."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    every = sorted(f.getPath().toString() for f in fs.listStatus(hadoop) if f.getPath().getName().endswith(".parquet"))
    name = lambda p: p.rsplit("/", 1)[-1]
    tiers = [p for p in every if name(p).endswith("_results.parquet")] or [p for p in every if "metadata" not in name(p) and "combined" not in name(p)]
    return [*tiers, *(p for p in every if name(p) == "all_degradations_combined.parquet")]


def read_tiers(spark: SparkSession, root: str) -> DataFrame:
    """The result files of a directory (``tier_files``) with their tier as ``degradation_level`` and its folder as ``folder``."""
    d = spark.read.option("mergeSchema", True).parquet(*tier_files(spark, root))
    return undotted(d.withColumn("degradation_level", F.expr(tier_name("_metadata.file_path")))).withColumn("folder", F.expr(tier_folder("degradation_level")))


def stage_paths(root: str) -> dict[tuple[str, str, str], str]:
    """(stage, model, dataset) -> path of each of the 27 files of a benchmark."""
    return {(s, m, d): f"{root}/{s}/{m}/{d}.parquet" for s in STAGES for m in MODELS for d in DATASETS}


def read_stages(spark: SparkSession, paths: dict[tuple[str, str, str], str]) -> DataFrame:
    """The given files, tagged and united by name; columns that a file lacks are null."""
    one = [read_results(spark, p).withColumn("pipeline_stage", F.lit(s)).withColumn("model_arch", F.lit(m)).withColumn("dataset_name", F.lit(d)) for (s, m, d), p in paths.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), one)


def missing_files(spark: SparkSession, expected: list[str], found: DataFrame) -> DataFrame:
    """Expected relative paths that ``found.path`` lacks."""
    return spark.createDataFrame([(p,) for p in expected], "path string").join(found.select("path"), "path", "left_anti")


def runs(files: DataFrame, after: str | None = None) -> DataFrame:
    """(run, run_date, path, modified) of files named results_metadata.parquet, by the date in their folder; the newest last.

    ``files`` has path and modificationTime, as a binaryFile scan without content gives them.
    """
    d = files.where("path rlike 'results_metadata\\\\.parquet$'").select(
        F.regexp_extract("path", "([^/]+)/results_metadata", 1).alias("run"), F.expr("try_cast(regexp_extract(path, '([0-9]{4}-[0-9]{2}-[0-9]{2})', 1) as date)").alias("run_date"), "path", F.col("modificationTime").alias("modified")
    )
    return d.where(F.col("run_date") >= F.lit(after).cast("date")) if after else d


def latest_run(run_table: DataFrame) -> DataFrame:
    """The run with the latest change."""
    return run_table.agg(F.max_by(F.struct("run", "run_date", "path", "modified"), F.struct("modified", "path")).alias("r")).select("r.*")


def write_results(df: DataFrame, path: str, by: str = "experiment_name", mode: str = "overwrite") -> None:
    """Partitioned by tier, so that readers of one tier touch its files only."""
    df.write.mode(mode).partitionBy(by).option("compression", "zstd").parquet(path)


def write_report(tidy: DataFrame, path: str) -> None:
    """A small tidy report (category, subset_or_exp, metric, value) as CSV and JSON lines, one file each."""
    one = tidy.coalesce(1)
    one.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    one.write.mode("overwrite").json(f"{path}/json")


def read_reports(spark: SparkSession, root: str) -> DataFrame:
    """Reports of several tiers (`<tier>/csv`) as one table with ``degradation_level``."""
    d = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(root)
    return d.withColumn("degradation_level", F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/csv/[^/]+$", 1))


def group_json(groups: DataFrame, id_col: str) -> DataFrame:
    """(group_name, ids as JSON) of focus groups; groups are bounded by their sample size."""
    return groups.groupBy("group_name").agg(F.to_json(F.array_sort(F.collect_list(id_col))).alias("ids"))


def quantized(hm: str = "hm") -> str:
    """A map as bytes (255 levels of its range), a quarter of the size of floats; as SQL giving lo, hi and levels."""
    return f"named_struct('lo', array_min({hm}), 'hi', array_max({hm}), 'levels', transform({hm}, x -> cast(round((x - array_min({hm})) / greatest(array_max({hm}) - array_min({hm}), 1e-12D) * 255) - 128 as tinyint)))"


def save_packets(df: DataFrame, path: str) -> None:
    """Packets as nested Parquet with a name made of type and image; no pickles."""
    df.withColumn("packet_name", F.concat_ws("_", "sample_type", F.col("image_id").cast("string"))).write.mode("overwrite").option("compression", "zstd").parquet(path)


def load_packets(spark: SparkSession, path: str) -> DataFrame:
    """Packets as saved; a missing path is an error of the reader."""
    return spark.read.parquet(path)


def run_config(path: str) -> dict[str, str]:
    """Facets coded in a run folder's name: date and words."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    date = re.search(r"\d{4}-\d{2}-\d{2}", name)
    return {"date": date.group(0) if date else "", "facets": re.sub(r"[^a-zA-Z0-9]+", "_", name[date.end() :] if date else name).strip("_")}


class Tracker:
    """Where scalars and tables of a run may be sent.  The default keeps nothing; subclasses override ``log``."""

    def log(self, values: dict[str, float]) -> None:
        return None

    def log_report(self, tidy: DataFrame, prefix: str = "") -> None:
        """A tidy report as prefixed scalars; reports are small by nature."""
        self.log({f"{prefix}{r.subset}/{r.metric}": r.value for r in tidy.select("subset", "metric", "value").toLocalIterator()})
