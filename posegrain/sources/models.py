"""Heatmap sources.  A network's forward pass is outside the engine: its output, a table of maps, is the contract."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from posegrain.functions.heatmaps import mock
from posegrain.schema import KEYPOINTS

#: Columns of a heatmap table.
CONTRACT = "image_id bigint, kp_idx int, hm array<double>, hm_w int, hm_h int"


def mock_heatmaps(images: DataFrame, mode: str = "unimodal", width: int = 48, height: int = 64, noise: float = 0.0, seed: int = 0) -> DataFrame:
    """Maps of a stand-in model for every image and joint, scaled to a largest value of 1.

    Modes unimodal, bimodal, uniform and noisy (seeded by image and joint, so any partition gives the same).  ``noise`` adds
    its share of uniform numbers of the same kind to any mode.
    """
    d = images.select("image_id", F.explode(F.array(*(F.lit(i) for i in range(len(KEYPOINTS))))).alias("kp_idx"))
    at = f"sequence(0, {width * height - 1})"
    n = f"(shiftrightunsigned(xxhash64(image_id, kp_idx, i, {seed}), 11) / {float(1 << 53)!r}D)"
    if mode == "noisy":
        d = d.select("*", F.expr(f"transform({at}, i -> {n})").alias("b"))
    else:  # one row: the map is the same for all images and joints, and made once
        d = d.crossJoin(F.broadcast(d.sparkSession.range(1).select(F.expr(mock(mode, width, height)).alias("b"))))
    d = d.select("image_id", "kp_idx", F.expr(f"zip_with(b, {at}, (x, i) -> greatest(x + {noise}D * {n}, 0D))" if noise else "b").alias("b"))
    d = d.select("*", F.array_max("b").alias("m"))
    return d.select("image_id", "kp_idx", F.expr("transform(b, x -> if(m > 0, x / m, x))").alias("hm"), F.lit(width).alias("hm_w"), F.lit(height).alias("hm_h"))


_P1, _P2, _P3, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def _hash_int(h: np.ndarray, spare: np.ndarray, word: np.ndarray | np.uint64) -> None:
    """xxhash64 carried on from ``h`` over an int, in place; ``word`` is the int, as 32 bits without sign, times _P1."""
    h += _P5 + np.uint64(4)
    h ^= word
    np.left_shift(h, np.uint64(23), out=spare)
    h >>= np.uint64(41)
    h |= spare
    h *= _P2
    h += _P3
    for bits, factor in ((33, _P2), (29, _P3), (32, None)):
        np.right_shift(h, np.uint64(bits), out=spare)
        h ^= spare
        if factor is not None:
            h *= factor


def mock_entropy(images: DataFrame, mode: str = "unimodal", width: int = 48, height: int = 64, noise: float = 0.0, seed: int = 0) -> DataFrame:
    """(image_id, kp_idx, entropy) of all maps that ``mock_heatmaps`` gives for the same arguments, noise of at least 0.

    Every pixel of every map is made, with the same noise, but some maps at once in arrays that stay in the cores' caches: as
    columns of the engine the maps cost ten times that.  The entropy needs no scaling of a map.
    """
    if not 0 <= noise or not -(1 << 31) <= seed < 1 << 31:
        raise ValueError("noise must not be negative, and the seed must be an int")
    size, step = width * height, 8
    base = np.zeros(size) if mode == "noisy" else np.array(images.sparkSession.range(1).select(F.expr(mock(mode, width, height))).first()[0])
    shares = [1.0, noise] if mode == "noisy" else [noise]  # noisy maps are noise, to which the share is added

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, spare = np.empty((step, size), np.uint64), np.empty((step, size), np.uint64)
        x, logs = np.empty((step, size)), np.empty((step, size))
        with np.errstate(over="ignore"):
            places, last = np.arange(size, dtype=np.uint64) * _P1, np.uint64(seed & 0xFFFFFFFF) * _P1
        for b in batches:
            start = b.column("h").to_numpy().view(np.uint64)
            out = np.empty(len(start))
            for i in range(0, len(start), step):
                k = min(step, len(start) - i)
                h[:k] = start[i : i + k, None]
                with np.errstate(over="ignore"):
                    _hash_int(h, spare, places)
                    _hash_int(h, spare, last)
                h >>= np.uint64(11)
                x[:] = h.view(np.int64)
                x *= sum(shares) / (1 << 53)
                x += base
                np.maximum(x, 1e-300, out=logs)
                np.log(logs, out=logs)
                s = x.sum(axis=1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    out[i : i + k] = np.where(s > 0, np.log(s) - np.einsum("ij,ij->i", x, logs) / s, 0.0)[:k]
            yield pa.RecordBatch.from_arrays([b.column("image_id"), b.column("kp_idx"), pa.array(out)], names=["image_id", "kp_idx", "entropy"])

    d = images.select("image_id", F.explode(F.array(*(F.lit(i) for i in range(len(KEYPOINTS))))).alias("kp_idx"))
    return d.select("*", F.xxhash64("image_id", "kp_idx").alias("h")).mapInArrow(run, f"image_id {dict(d.dtypes)['image_id']}, kp_idx int, entropy double")


def check_contract(df: DataFrame) -> DataFrame:
    """The table itself, if it has the contract's columns and types; an error names what is wrong."""
    have = dict(df.dtypes)
    wrong = [c for c in CONTRACT.split(", ") if have.get(c.split(" ")[0]) != c.split(" ")[1]]
    if wrong:
        raise ValueError(f"not a heatmap table; it lacks {wrong}")
    return df


def image_ids(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "image_id")
