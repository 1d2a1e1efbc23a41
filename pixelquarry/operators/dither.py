"""Error-diffusion dithering, one grouped map per image and frame.

A pixel's error goes to the right (4 and 1 sixteenths), down-left, down and down-right (2, 4, 2)
and two rows down (1); two sixteenths are lost. All of these have a larger x + 2 y, so pixels of
equal x + 2 y are computed at once; each share is floored on its own, so their order is free.
One image must fit in a worker, at some 60 bytes a pixel; images spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelquarry.operators import palette as P
from pixelquarry.session import ship

# Where a pixel's error goes: dx, dy, sixteenths.
WEIGHTS = [(1, 0, 4), (2, 0, 1), (-1, 1, 2), (0, 1, 4), (1, 1, 2), (0, 2, 1)]


def diffuse(grid: np.ndarray, choose: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Dither an (h, w, c) grid of integers; ``choose`` maps values that are not clamped, and their places, to output values."""
    h, w, c = grid.shape
    acc, out = grid.astype(np.int64) * 16, np.zeros((h, w, c), np.int64)
    for t in range(w + 2 * (h - 1)):
        y = np.arange(max(0, -(-(t - w + 1) // 2)), min(h - 1, t // 2) + 1)
        x = t - 2 * y
        out[y, x] = choose(acc[y, x] >> 4, y, x)
        err = acc[y, x] - out[y, x] * 16
        for dx, dy, share in WEIGHTS:
            ok = (x + dx >= 0) & (x + dx < w) & (y + dy < h)
            acc[y[ok] + dy, x[ok] + dx] += err[ok] * share >> 4
    return out


def _image(pdf: pd.DataFrame, cols: list[str]) -> tuple[pd.DataFrame, np.ndarray]:
    pdf = pdf.sort_values(["y", "x"])
    h, w = int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1
    grid = np.zeros((h, w, len(cols)), np.int64)
    grid[pdf["y"], pdf["x"]] = pdf[cols].to_numpy()
    return pdf, grid


def dither_mono(pixels: DataFrame) -> DataFrame:
    """(image_id, frame, y, x, v): black or white."""
    ship(pixels.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, grid = _image(pdf, ["r", "g", "b"])
        grey = (grid @ np.array([77, 151, 28]) >> 8)[:, :, None]
        out = diffuse(grey, lambda v, y, x: np.where(v > 127, 255, 0))
        return pdf[["image_id", "frame", "y", "x"]].assign(v=out[pdf["y"], pdf["x"], 0])

    return pixels.groupBy("image_id", "frame").applyInPandas(run, "image_id long, frame int, y int, x int, v int")


def nearest_cube(entries: list[tuple[int, int, int]], skip: int = P.SKIPPED) -> np.ndarray:
    """Palette index of each five-bit cell."""
    k = np.arange(32) * 8
    key = np.stack(np.meshgrid(k, k, k, indexing="ij"), axis=-1).reshape(-1, 1, 3)
    far = ((key - np.array(entries)) ** 2 * np.array([2, 4, 3])).sum(axis=2)
    if len(entries) > skip:
        far[:, skip] = np.iinfo(np.int64).max
    return far.argmin(axis=1).reshape(32, 32, 32)


def dither_palette(pixels: DataFrame, palette_id: str) -> DataFrame:
    """(image_id, frame, y, x, idx, r, g, b): entries of the palette; only the lookup key is clamped."""
    ship(pixels.sparkSession)
    colors = np.array(P.PALETTES[palette_id])
    cube = nearest_cube(P.PALETTES[palette_id]).astype(np.uint8)  # 32 KB, made once and sent with the function

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, grid = _image(pdf, ["r", "g", "b"])
        index = np.zeros(grid.shape[:2], np.int64)

        def choose(v: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
            index[y, x] = cube[tuple((np.clip(v, 0, 255) >> 3).T)]
            return colors[index[y, x]]

        out = diffuse(grid, choose)
        at = (pdf["y"], pdf["x"])
        return pdf[["image_id", "frame", "y", "x"]].assign(idx=index[at], **{c: out[(*at, i)] for i, c in enumerate("rgb")})

    return pixels.groupBy("image_id", "frame").applyInPandas(run, "image_id long, frame int, y int, x int, idx int, r int, g int, b int")


def dither_corpus(pixels: DataFrame, mode: int, bpp: int = 24) -> DataFrame:
    """0 none, 1 by target depth, 2 mono, 3 sixteen colours, 4 the 256-entry palette."""
    if mode == 1:
        mode = 0 if bpp > 8 else 2 if bpp == 1 else 3 if bpp <= 4 else 4
    cols = ["image_id", "frame", "y", "x"]
    if mode == 0:
        return pixels.select(*cols, "r", "g", "b")
    if mode == 2:
        return dither_mono(pixels).select(*cols, *[F.col("v").alias(c) for c in "rgb"])
    return dither_palette(pixels, "vga16" if mode == 3 else "win256").select(*cols, "r", "g", "b")
