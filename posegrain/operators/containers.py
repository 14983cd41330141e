"""Packing of very many small files into few large, indexed archive blocks.

A block holds the original bytes of many files one after the other; its index names every file with offset,
length and CRC-32.  Packing is a narrow, streaming pass (no shuffle, no grouping by directory, so skewed
directories cost nothing), and the bytes are moved as slices of Arrow's own string buffer, not row by row.
Blocks are read in parallel; a single file is found through the index and cut out of its block by offset.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from posegrain.session import materialize

ENTRY = "struct<file_no:bigint,path:string,offset:bigint,length:bigint,crc:bigint>"
BLOCK_SCHEMA = f"block_id string, n_files bigint, n_bytes bigint, entries array<{ENTRY}>, data binary"
DEFAULT_BLOCK_BYTES = 32 << 20


def _spans(batch: pa.RecordBatch, at: int) -> tuple[memoryview, list[int]]:
    """The value buffer and the n + 1 offsets of a string or binary column."""
    column = batch.column(at)
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    import numpy as np

    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return memoryview(data if data is not None else b""), offs.tolist()


def _emit(place: str, parts: list[bytes], entries: list[dict]) -> pa.RecordBatch:
    """One block.  Its id is its place in the run and a digest of its entries: places alone repeat where a task runs several partitions."""
    import xxhash

    data = b"".join(parts)
    block_id = f"{place}-{xxhash.xxh3_128_hexdigest(repr([tuple(e.values()) for e in entries]).encode('utf-8', 'surrogatepass'))}"
    entry_type = pa.struct([("file_no", pa.int64()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("crc", pa.int64())])
    return pa.RecordBatch.from_arrays(
        [pa.array([block_id]), pa.array([len(entries)], pa.int64()), pa.array([len(data)], pa.int64()), pa.array([entries], pa.list_(entry_type)), pa.array([data], pa.binary())],
        names=["block_id", "n_files", "n_bytes", "entries", "data"],
    )


def files_below(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(file_no, file_path, n_bytes, modified_at, content binary): the real files below a folder, one row each.

    ``file_no`` is a hash of the path, so it needs no order; listing and reading are spread over the tasks.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return found.select(F.xxhash64("path").alias("file_no"), F.col("path").alias("file_path"), F.col("length").alias("n_bytes"), F.col("modificationTime").alias("modified_at"), "content")


def pack(files: DataFrame, id_col: str = "file_no", path_col: str = "file_path", content_col: str = "content", block_bytes: int = DEFAULT_BLOCK_BYTES, max_files: int = 100_000) -> DataFrame:
    """Files as rows -> blocks of about ``block_bytes`` bytes or ``max_files`` files.

    Null content has a null length (and comes back as null), empty content length 0; repeated rows are packed
    again, each with its own entry; a file larger than a block gets a block of its own; extra columns are
    ignored; no rows give no blocks.
    """
    source = files.select(F.col(id_col).cast("bigint"), F.col(path_col).cast("string"), F.col(content_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        parts: list[bytes] = []
        entries: list[dict] = []
        size = 0
        for batch in batches:
            data, offs = _spans(batch, 2)
            valid = batch.column(2).is_valid().to_pylist()
            ids, paths = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            first = 0
            for i in range(len(batch)):
                lo, hi = offs[i], offs[i + 1]
                if entries and (size + hi - lo > block_bytes or len(entries) >= max_files):
                    parts.append(bytes(data[offs[first] : lo]))
                    first = i
                    yield _emit(f"{part:06d}-{number:06d}", parts, entries)
                    parts, entries, size, number = [], [], 0, number + 1
                known = valid[i]
                entries.append({"file_no": ids[i], "path": paths[i], "offset": size, "length": hi - lo if known else None, "crc": zlib.crc32(data[lo:hi]) if known else None})
                size += hi - lo
            if len(batch):
                parts.append(bytes(data[offs[first] : offs[len(batch)]]))
        if entries:
            yield _emit(f"{part:06d}-{number:06d}", parts, entries)

    return source.mapInArrow(run, BLOCK_SCHEMA)


def unpack(blocks: DataFrame, verify: bool = True) -> DataFrame:
    """Blocks -> (block_id, file_no, path, content binary); a checksum that does not fit stops the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block_id, entries, data in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                raw = memoryview(data.as_buffer())
                flat = entries.values
                starts, lengths, sums = (flat.field(k).to_pylist() for k in (2, 3, 4))
                pieces = []
                for start, length, crc in zip(starts, lengths, sums, strict=True):
                    piece = None if length is None else raw[start : start + length]
                    if verify and piece is not None and zlib.crc32(piece) != crc:
                        raise ValueError(f"block {block_id}: wrong checksum at offset {start}")
                    pieces.append(None if piece is None else bytes(piece))
                yield pa.RecordBatch.from_arrays([pa.array([block_id] * len(pieces), pa.string()), flat.field(0), flat.field(1), pa.array(pieces, pa.binary())], names=["block_id", "file_no", "path", "content"])

    return blocks.select("block_id", "entries", "data").mapInArrow(run, "block_id string, file_no bigint, path string, content binary")


def write_blocks(blocks: DataFrame, path: str) -> DataFrame:
    """Store blocks with every block a row group of its own, and read them back: a filter on block_id then skips the others' bytes."""
    blocks.write.option("parquet.block.row.count.limit", 1).option("compression", "zstd").parquet(path)
    return blocks.sparkSession.read.schema(BLOCK_SCHEMA).parquet(path)


def index(blocks: DataFrame) -> DataFrame:
    """(block_id, file_no, path, offset, length, crc) without touching the blocks' bytes (column pruning)."""
    return blocks.select("block_id", F.inline("entries"))


def lookup(blocks: DataFrame, wanted: DataFrame, on: str = "path", few: int = 1_000) -> DataFrame:
    """The files named in ``wanted[on]``, cut out of their blocks by offset: index join first, bytes last.

    Up to ``few`` blocks are named in the scan's filter, so that stored blocks are read only where the row group's block_ids
    may be among them (``write_blocks`` makes a block a row group); more are joined, and the scan reads all bytes.
    """
    found = materialize(index(blocks).join(wanted.select(on).distinct(), on, "left_semi"), "found-entries")
    ids = [r[0] for r in found.select("block_id").distinct().limit(few + 1).collect()]
    held = blocks.select("block_id", "data")
    if len(ids) <= few:
        held = held.where(F.col("block_id").isin(ids))
    return found.join(held, "block_id").select("block_id", "file_no", "path", F.expr("if(length is null, null, substring(data, cast(offset + 1 as int), cast(length as int)))").alias("content"))


def json_lines(files: DataFrame, content_col: str = "content") -> DataFrame:
    """One row per line that is a complete JSON object: (file_no, line_no, record variant).

    LF and CRLF end lines; blank, broken and non-object lines are left out; a line with anything after its
    object is broken.  Null and empty files have no lines.
    """
    lines = files.select("file_no", F.posexplode(F.split(F.col(content_col).cast("string"), "\r?\n")).alias("pos", "line"))
    lines = lines.where(F.expr("line rlike '^\\\\s*\\\\{' and line rlike '\\\\}\\\\s*$'"))
    # the wrapping makes the parser see what stands behind the object
    wrapped = F.expr("""try_variant_get(try_parse_json(concat('[{"r":', line, '}]')), '$[0].r', 'variant')""")
    return lines.select("file_no", (F.col("pos") + 1).cast("bigint").alias("line_no"), wrapped.alias("record")).where(F.expr("record is not null"))


def packet_records(files: DataFrame) -> DataFrame:
    """(file_no, line_no, image_id bigint, base_name, dataset, model_name, ts, oks_ours): the records of JSON-lines files.

    image_id may stand as number or string, with a point only if it is whole; base_name is what follows the last / or \\ of file_name.  Records
    without one of the two are left out, for they cannot be known again.
    """
    text = lambda name: f"try_variant_get(record, '$.{name}', 'string')"
    decimal = f"try_cast(trim({text('image_id')}) as decimal(38,6))"
    out = json_lines(files).select(
        "file_no",
        "line_no",
        F.expr(f"coalesce(try_cast(trim({text('image_id')}) as bigint), if({decimal} = floor({decimal}), try_cast({decimal} as bigint), null))").alias("image_id"),
        F.regexp_extract(F.expr(text("file_name")), r"([^/\\]*)\z", 1).alias("base_name"),
        F.expr(text("dataset")).alias("dataset"),
        F.expr(text("model_name")).alias("model_name"),
        F.expr(text("timestamp")).alias("ts"),
        F.expr("try_variant_get(record, '$.oks_ours', 'double')").alias("oks_ours"),
    )
    return out.where("image_id is not null and base_name is not null")


def repeated_records(records: DataFrame) -> DataFrame:
    """(image_id, base_name) that stand in two or more files.  min and max suffice, so the partial aggregate is two numbers a key."""
    ends = records.groupBy("image_id", "base_name").agg(F.min("file_no").alias("lo"), F.max("file_no").alias("hi"))
    return ends.where("lo < hi").select("image_id", "base_name")


def unique_records(records: DataFrame) -> DataFrame:
    """Every (image_id, base_name) once, the one with the latest timestamp, then the smallest file and line; with the number of times it stood."""
    best = F.max_by(F.struct("file_no", "line_no", "dataset", "model_name", "ts", "oks_ours"), F.struct(F.coalesce("ts", F.lit("")), -F.col("file_no"), -F.col("line_no")))
    got = records.groupBy("image_id", "base_name").agg(best.alias("r"), F.count(F.lit(1)).alias("n_seen"))
    return got.select("image_id", "base_name", "r.*", "n_seen")
