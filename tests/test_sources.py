import json

import pytest
from pyspark.sql import functions as F

from posegrain.sources import annotations, models, results
from posegrain.streaming import stages


def test_people(spark, tmp_path):
    doc = {
        "images": [{"id": 1, "file_name": "a.jpg", "height": 10, "width": 20}, {"id": 2, "file_name": "b.jpg"}],
        "categories": [{"id": 1, "name": "person"}, {"id": 2, "name": "dog"}],
        "annotations": [
            {"id": 1, "image_id": 1, "category_id": 1, "iscrowd": 0, "area": 5.0, "bbox": [0, 0, 9, 9], "keypoints": [1, 2, 1] + [3, 4, 2] + [0, 0, 7] * 15},
            {"id": 2, "image_id": 1, "category_id": 1, "iscrowd": 0, "area": 9.0, "bbox": [0, 0, 1, 1], "keypoints": [5, 6, 2]},
            {"id": 3, "image_id": 1, "category_id": 1, "iscrowd": 1, "area": 99.0, "bbox": [0, 0, 50, 50]},
            {"id": 4, "image_id": 2, "category_id": 2, "area": 9.0, "bbox": [0, 0, 1, 1]},
        ],
    }
    path = tmp_path / "ann.json"
    path.write_text(json.dumps(doc, indent=1))
    coco = annotations.people(spark, str(path), "coco").collect()
    assert [(r.image_id, r.area, r.keypoints[0].confidence, r.keypoints[1].x) for r in coco] == [(1, 9.0, 1.0, None)]
    crowd = annotations.people(spark, str(path), "crowdpose").first()
    assert crowd.area == 5.0 and len(crowd.keypoints) == 14 and [k.confidence for k in crowd.keypoints[:3]] == [0.5, 1.0, 0.0]
    with pytest.raises(ValueError):
        annotations.people(spark, str(path), "other")


def test_results_and_tiers(spark, tmp_path):
    d = spark.createDataFrame([(1, float("nan"), "clean"), (2, 0.5, "half")], "image_id int, `dataset.scale` double, experiment_name string")
    d.write.parquet(str(tmp_path / "t" / "00_Clean_results.parquet"))
    d.withColumn("extra", F.lit(1)).write.parquet(str(tmp_path / "t" / "01_Low_results.parquet"))
    got = results.undotted(d)
    assert got.columns == ["image_id", "dataset_scale", "experiment_name"] and got.where("dataset_scale is null").count() == 1
    results.write_results(got, str(tmp_path / "w"))
    assert results.read_results(spark, str(tmp_path / "w")).where("experiment_name = 'half'").count() == 1
    assert "z" in results.with_optional(got, z=0).columns and len(results.stage_paths("r")) == 27
    found = spark.createDataFrame([("a",)], "path string")
    assert [r.path for r in results.missing_files(spark, ["a", "b"], found).collect()] == ["b"]


def test_mock_and_contract(spark):
    m = models.mock_heatmaps(models.image_ids(spark, 2), "noisy", 4, 6)
    assert m.count() == 34 and models.check_contract(m).where("array_max(hm) <> 1").count() == 0
    with pytest.raises(ValueError):
        models.check_contract(m.drop("hm"))


def test_streaming(spark, tmp_path):
    src = str(tmp_path / "in")
    d = spark.sql("select timestamp'2025-01-01 10:00:00' + make_interval(0, 0, 0, id) as ts, cast(id % 2 as string) as k, cast(id as double) as v from range(6)")
    d.coalesce(1).write.parquet(src)
    q = stages.run_stage(stages.parquet_stream(spark, src, d), lambda b: b.where("v > 2"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    s = stages.windowed_summary(stages.parquet_stream(spark, src, d), "ts", "v", ["k"]).writeStream.outputMode("complete").format("memory").queryName("sums").trigger(availableNow=True).start()
    s.awaitTermination(60)
    assert sum(r.n for r in spark.table("sums").collect()) == 6


def test_tier_files_and_folders(spark, tmp_path):
    from posegrain.sources import results as R

    d = spark.createDataFrame([(1, 0.5)], "image_id int, oks double")
    for name in ("01_low_results", "all_degradations_combined", "metadata"):
        d.coalesce(1).write.parquet(f"{tmp_path}/a/{name}.parquet")
    for name in ("02_high", "run_metadata"):
        d.coalesce(1).write.parquet(f"{tmp_path}/b/{name}.parquet")
    tiers = lambda root: sorted((r.degradation_level, r.folder) for r in R.read_tiers(spark, f"file://{tmp_path}/{root}").collect())
    assert tiers("a") == [("01_low", "01_low"), ("General", "06_General")] and tiers("b") == [("02_high", "02_high")]
