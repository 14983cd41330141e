"""Photometric augmentations and quality degradations of images given as arrays (row-major, values 0 to 255).

Random numbers are seeded by the image and the augmentation, not by call order, so a retry or another partition gives
the same image.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from posegrain.operators.heatmap_ops import _blurred, gaussian_kernel
from posegrain.operators.mixture_fit import generator


def odd(size: int) -> int:
    """The next odd size; 1 or less means off."""
    return size if size % 2 else size + 1


def box_kernel(size: int) -> np.ndarray:
    return np.full(size, 1.0 / size)


def photometric(img: np.ndarray, name: str, rng: np.random.Generator, delta: float = 30.0, contrast: tuple[float, float] = (0.8, 1.2), sigma: float = 10.0, blur: int = 5) -> np.ndarray:
    """brightness, contrast (about the mean), noise, blur or identity; clipped to 0..255; other names are an error."""
    img = img.astype(float)
    if name == "brightness":
        img = img + rng.uniform(-delta, delta)
    elif name == "contrast":
        img = (img - img.mean()) * rng.uniform(*contrast) + img.mean()
    elif name == "noise":
        img = img + rng.normal(0, sigma, img.shape)
    elif name == "blur":
        img = _blurred(img[None], gaussian_kernel(odd(blur)))[0] if blur > 1 else img
    elif name != "identity":
        raise ValueError(f"unknown augmentation {name!r}")
    return np.clip(np.round(img), 0, 255)


def degraded(img: np.ndarray, rng: np.random.Generator, contrast: float = 1.0, noise: float = 0.0, gaussian: int = 0, box: int = 0) -> np.ndarray:
    """Contrast, then noise, clip, Gaussian blur, box blur, clip."""
    img = (img.astype(float) - img.mean()) * contrast + img.mean()
    img = np.clip(img + (rng.normal(0, noise, img.shape) if noise > 0 else 0), 0, 255)
    for size, kernel in ((gaussian, gaussian_kernel), (box, box_kernel)):
        if size > 1:
            img = _blurred(img[None], kernel(odd(size)))[0]
    return np.clip(img, 0, 255)


def augment(df: DataFrame, keys: list[str], seed: int = 0, **how) -> DataFrame:
    """Rows with img, img_h, img_w and ``aug`` (name) -> the same rows with the augmented image.  A null image stays null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["img"] = [None if r["img"] is None else photometric(np.asarray(r["img"], float).reshape(r["img_h"], r["img_w"]), r["aug"], generator(seed, r["aug"], *(r[k] for k in keys)), **how).ravel() for r in b.to_dict("records")]
            yield b

    return df.mapInPandas(run, df.schema)


def degrade(df: DataFrame, keys: list[str], seed: int = 0, **how) -> DataFrame:
    """Rows with img, img_h, img_w -> the same rows with the degraded image."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["img"] = [None if r["img"] is None else degraded(np.asarray(r["img"], float).reshape(r["img_h"], r["img_w"]), generator(seed, *(r[k] for k in keys)), **how).ravel() for r in b.to_dict("records")]
            yield b

    return df.mapInPandas(run, df.schema)
