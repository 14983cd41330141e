"""Scans of person-keypoint annotation files (one JSON object with images, annotations and categories)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SCHEMA = """images array<struct<id:bigint,file_name:string,height:int,width:int>>,
 annotations array<struct<id:bigint,image_id:bigint,category_id:bigint,iscrowd:int,area:double,bbox:array<double>,keypoints:array<double>>>,
 categories array<struct<id:bigint,name:string>>"""

#: Number of joints, and what makes an annotation the main person of its image.
DATASETS = {"coco": (17, "area"), "crowdpose": (14, "bbox[2] * bbox[3]"), "ochuman": (17, "area")}


def parse_keypoints(flat: str, k: int) -> str:
    """[x, y, v] * k as an array of structs; v 0, 1, 2 is confidence 0, 0.5, 1 and anything else 0; missing numbers are null."""
    v = f"get({flat}, 3 * i + 2)"
    return f"transform(sequence(0, {k - 1}), i -> named_struct('id', i, 'x', get({flat}, 3 * i), 'y', get({flat}, 3 * i + 1), 'confidence', case {v} when 1 then 0.5D when 2 then 1D else 0D end))"


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, file_name, height, width, annotation columns): one row an annotation; missing sizes are 1000."""
    doc = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    images = doc.select(F.inline("images")).withColumnRenamed("id", "image_id")
    names = doc.select(F.inline("categories")).select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    a = doc.select(F.inline("annotations")).join(F.broadcast(names), "category_id", "left")  # categories of one file
    return a.join(images, "image_id", "left").withColumn("height", F.coalesce("height", F.lit(1000))).withColumn("width", F.coalesce("width", F.lit(1000)))


def people(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """The main person of each image: category person, no crowd, the largest by the dataset's rule, the smaller id among equals.

    Images without such an annotation have no row; unknown datasets are an error.
    """
    if dataset not in DATASETS:
        raise ValueError(f"unknown dataset {dataset!r}; one of {sorted(DATASETS)}")
    k, size = DATASETS[dataset]
    a = annotations(spark, path).where("category = 'person' and coalesce(iscrowd, 0) = 0 and size(bbox) >= 4")
    a = a.withColumn("size", F.expr(size)).select("image_id", F.struct("id", "file_name", "height", "width", "bbox", "area", "keypoints").alias("a"), F.struct(F.coalesce("size", F.lit(-1.0)), -F.col("id")).alias("o"))
    best = a.groupBy("image_id").agg(F.max_by("a", "o").alias("a"))
    return best.select("image_id", F.lit(dataset).alias("dataset_source"), "a.file_name", "a.height", "a.width", F.expr("named_struct('x', a.bbox[0], 'y', a.bbox[1], 'w', a.bbox[2], 'h', a.bbox[3])").alias("bbox"), "a.area", F.expr(parse_keypoints("a.keypoints", k)).alias("keypoints"))
