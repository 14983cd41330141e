import random

import pytest

from posegrain.operators import containers as C

FILES = "file_no bigint, file_path string, content string, data string"


def files(spark, contents):
    return spark.createDataFrame([(i, f"d/{i}.jsonl", c, "clash") for i, c in enumerate(contents)], FILES)


def test_exact_round_trip(spark):
    rng = random.Random(1)
    contents = ["", None, "x" * 5000, "ünïcode \u2028 \r\n", "\x00\x01"] + ["".join(rng.choices("abc\n\r{}", k=rng.randint(0, 300))) for _ in range(200)]
    blocks = C.pack(files(spark, contents).repartition(3), block_bytes=2000)
    back = {r.file_no: None if r.content is None else bytes(r.content).decode() for r in C.unpack(blocks).collect()}
    assert back == dict(enumerate(contents))
    sizes = [r.n_bytes for r in blocks.collect()]
    assert len(sizes) > 5 and sum(sizes) == sum(len((c or "").encode()) for c in contents) and sorted(sizes)[-2] <= 2000


def test_lookup_and_index(spark):
    blocks = C.pack(files(spark, ["aa", None, "cccc"]).coalesce(1))
    assert [(r.file_no, r.offset, r.length) for r in C.index(blocks).orderBy("file_no").collect()] == [(0, 0, 2), (1, 2, None), (2, 2, 4)]
    wanted = spark.createDataFrame([("d/2.jsonl",), ("d/1.jsonl",), ("none",)], "path string")
    got = {r.path: None if r.content is None else bytes(r.content) for r in C.lookup(blocks, wanted).collect()}
    assert got == {"d/2.jsonl": b"cccc", "d/1.jsonl": None}


def test_real_files_and_named_blocks(spark, tmp_path):
    """Real files are packed, stored with a block a row group, and looked up in the named blocks only."""
    import pyarrow.parquet as pq

    for i in range(40):
        (tmp_path / "in" / str(i % 3)).mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / str(i % 3) / f"{i}.bin").write_bytes(bytes([i]) * (200 + i))
    source = C.files_below(spark, f"file://{tmp_path}/in")
    stored = C.write_blocks(C.pack(source, block_bytes=1000).coalesce(1), f"file://{tmp_path}/blocks")
    (file,) = (tmp_path / "blocks").glob("*.parquet")
    assert pq.ParquetFile(file).num_row_groups == stored.count() > 5
    assert sorted(bytes(r.content) for r in C.unpack(stored).collect()) == [bytes([i]) * (200 + i) for i in range(40)]
    wanted = source.where("file_path like '%/7.bin'").select(C.F.col("file_path").alias("path"))
    for few in (1000, 0):
        assert [bytes(r.content) for r in C.lookup(stored, wanted, few=few).collect()] == [bytes([7]) * 207]


def test_wrong_checksum_is_an_error(spark):
    bad = C.pack(files(spark, ["abc"])).selectExpr("block_id", "n_files", "n_bytes", "entries", "cast('abd' as binary) as data")
    with pytest.raises(Exception, match="wrong checksum"):
        C.unpack(bad).collect()


def test_records(spark):
    one = '{"image_id": 5, "file_name": "a/b.jpg", "timestamp": "2"}'
    two = '{"image_id": "5", "file_name": "C:\\\\x\\\\b.jpg", "timestamp": "3"}'
    contents = [one + "\r\n\n  \n" + one, two, '{"image_id": 6, "file_name": "c.jpg"}\n{"image_id": 6, "file_', one + " tail\n[1]\n7\n" + '{"image_id": null, "file_name": "z"}\n{"file_name": "z"}', None, "", one + one, '{"image_id": 7.5, "file_name": "h"}\n{"image_id": 8.0, "file_name": "w"}']
    r = C.packet_records(C.unpack(C.pack(files(spark, contents))))
    assert sorted((x.file_no, x.image_id, x.base_name) for x in r.collect()) == [(0, 5, "b.jpg"), (0, 5, "b.jpg"), (1, 5, "b.jpg"), (2, 6, "c.jpg"), (7, 8, "w")]
    assert [tuple(x) for x in C.repeated_records(r).collect()] == [(5, "b.jpg")]
    u = {x.image_id: (x.n_seen, x.ts, x.file_no) for x in C.unique_records(r).collect()}
    assert u == {5: (3, "3", 1), 6: (1, None, 2), 8: (1, None, 7)}


def test_empty(spark):
    b = C.pack(files(spark, []))
    assert b.count() == 0 and C.unpack(b).count() == 0 and C.packet_records(C.unpack(b)).count() == 0
