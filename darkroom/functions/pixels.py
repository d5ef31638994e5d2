"""Signals of RGBA images: an Arrow UDF over binary buffers, and relational forms over a table of pixels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIGNALS = "struct<blur_variance: float, dark_fraction: float, bright_fraction: float, mean_luminance: float, dhash: bigint, is_pocket_shot: boolean, uniformity: float, error: string>"


def luma(rgba: np.ndarray) -> np.ndarray:
    r, g, b = (rgba[..., k].astype(np.uint32) for k in range(3))
    return ((299 * r + 587 * g + 114 * b) // 1000).astype(np.uint8)


def _filter(size: int, to: int) -> np.ndarray:
    """Rows of weights of a triangle filter; its support widens with the scale when an axis shrinks."""
    scale = size / to
    reach = max(1.0, scale)
    centre = (np.arange(to) + 0.5) * scale
    at = np.arange(size) + 0.5
    weight = np.maximum(0.0, 1.0 - np.abs(at[None, :] - centre[:, None]) / reach)
    return weight / weight.sum(axis=1, keepdims=True)


def resized(images: np.ndarray, width: int, height: int) -> np.ndarray:
    """Images (n, height, width, channels) of another size."""
    if images.shape[1:3] == (height, width):
        return images
    down, across = _filter(images.shape[1], height), _filter(images.shape[2], width)
    wide = np.tensordot(down, images.astype(np.float64), axes=(1, 1))  # (y, n, x, channel)
    out = np.tensordot(across, wide, axes=(1, 2))  # (x, y, n, channel)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8).transpose(2, 1, 0, 3)


def fitted(width: int, height: int, most: int) -> tuple[int, int]:
    """The size of an image whose longest side is at most `most`: sides keep their ratio, halves round up, and none grows."""
    scale = min(1.0, most / max(width, height))
    return max(1, int(width * scale + 0.5)), max(1, int(height * scale + 0.5))


def thumbnail(width: int, height: int, data: bytes, most: int) -> tuple[int, int, bytes]:
    """(width, height, buffer) of an RGBA buffer shrunk to `most` pixels at its longest side."""
    w, h = fitted(width, height, most)
    image = np.frombuffer(data, dtype=np.uint8, count=width * height * 4).reshape(1, height, width, 4)
    return w, h, np.ascontiguousarray(resized(image, w, h)[0]).tobytes()


def laplacian_variance(grey: np.ndarray) -> np.ndarray:
    """Of images (n, height, width): population variances of the interior's Laplacian; 0 without an interior."""
    if min(grey.shape[1:]) < 3:
        return np.zeros(len(grey))
    g = grey.astype(np.int32)
    v = (g[:, :-2, 1:-1] + g[:, 2:, 1:-1] + g[:, 1:-1, :-2] + g[:, 1:-1, 2:] - 4 * g[:, 1:-1, 1:-1]).reshape(len(g), -1)
    return (v.astype(np.float64) ** 2).mean(axis=1) - v.mean(axis=1) ** 2


def exposure(grey: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(mean, dark share, bright share, share of the commonest value) of images (n, height, width)."""
    n, size = len(grey), grey.shape[1] * grey.shape[2]
    at = grey.reshape(n, -1).astype(np.int64) + np.arange(n)[:, None] * 256
    bins = np.bincount(at.ravel(), minlength=n * 256).reshape(n, 256)
    return bins @ np.arange(256) / size, bins[:, :16].sum(axis=1) / size, bins[:, 240:].sum(axis=1) / size, bins.max(axis=1) / size


def difference_hash(images: np.ndarray) -> np.ndarray:
    """64 bits of each image as a signed number: bit 8 y + x is set where a place is brighter than the one to its right."""
    small = luma(resized(images, 9, 8)).astype(np.int16)
    bits = (small[:, :, :-1] > small[:, :, 1:]).reshape(len(images), 64)
    return np.packbits(bits, axis=1, bitorder="little").view("<i8").ravel()


COLUMNS = ("blur_variance", "dark_fraction", "bright_fraction", "mean_luminance", "dhash", "is_pocket_shot", "uniformity", "error")
#: Bytes of images that are worked on together.
IMAGE_BYTES = 16 << 20


def analyze_all(width: int, height: int, data: list[bytes]) -> dict[str, np.ndarray]:
    """The signals of images of one size. Images of one colour, which no filter changes, are worked on as one pixel."""
    images = np.stack([np.frombuffer(x, dtype=np.uint8, count=width * height * 4) for x in data]).reshape(-1, height, width, 4)
    plain = (images[..., :3] == images[:, :1, :1, :3]).all(axis=(1, 2, 3))
    rest, step, out = np.nonzero(~plain)[0], _together(max(width * height, 256 * 256)), {}
    some = [(np.nonzero(plain)[0], images[plain][:, :1, :1])] if plain.any() else []
    for rows, part in [*some, *((rest[i : i + step], images[rest[i : i + step]]) for i in range(0, len(rest), step))]:
        for name, values in _signals(part).items():
            out.setdefault(name, np.empty(len(images), dtype=values.dtype))[rows] = values
    return out


def _together(pixels: int) -> int:
    """So many images of a number of pixels are worked on together."""
    return max(1, IMAGE_BYTES // (8 * 4 * pixels))


def _signals(images: np.ndarray) -> dict[str, np.ndarray]:
    if images.shape[1:3] == (1, 1):
        grey, bits = luma(images), np.zeros(len(images), dtype=np.int64)
    else:
        grey, bits = luma(resized(images, 256, 256)), difference_hash(images)
    blur = laplacian_variance(grey)
    mean, dark, bright, uniform = exposure(grey)
    pocket = (uniform > 0.92) | ((dark > 0.85) & (blur < 20))
    return dict(zip(COLUMNS, (blur, dark, bright, mean, bits, pocket, uniform)))


def problem(width: int | None, height: int | None, data: bytes | None) -> str | None:
    """Why an image has no signals."""
    if not width or not height or width < 0 or height < 0:
        return "invalid dimensions"
    return "buffer too short" if data is None or len(data) < width * height * 4 else None


def analyze(width: int | None, height: int | None, data: bytes | None) -> dict:
    """All signals of one image; a buffer that is too short, or no size, gives nulls and an error."""
    if said := problem(width, height, data):
        return dict.fromkeys(COLUMNS) | {"error": said}
    return {k: v[0].item() for k, v in analyze_all(width, height, [data]).items()} | {"error": None}


def by_size(width: pd.Series, height: pd.Series, data: pd.Series) -> Iterator[tuple[np.ndarray, int, int, list[bytes]]]:
    """(rows, width, height, buffers) of the whole images of a batch, those of one size together, IMAGE_BYTES at most."""
    groups: dict[tuple[int, int], list[int]] = {}
    for i, (w, h, d) in enumerate(zip(width, height, data)):
        w, h = (None if pd.isna(x) else int(x) for x in (w, h))
        if not problem(w, h, d):
            groups.setdefault((w, h), []).append(i)
    for (w, h), rows in groups.items():
        step = _together(w * h)
        for k in range(0, len(rows), step):
            yield np.array(rows[k : k + step]), w, h, [data.iloc[i] for i in rows[k : k + step]]


def problems(width: pd.Series, height: pd.Series, data: pd.Series) -> list[str | None]:
    return [problem(*(None if pd.isna(x) else int(x) for x in (w, h)), d) for w, h, d in zip(width, height, data)]


def signals(width: Column, height: Column, data: Column) -> Column:
    """The signals of RGBA buffers as a struct with an error field; images of one size are worked on together."""

    @F.pandas_udf(SIGNALS)
    def of(w: pd.Series, h: pd.Series, d: pd.Series) -> pd.DataFrame:
        found = {c: np.full(len(d), None, dtype=object) for c in COLUMNS}
        found["error"][:] = problems(w, h, d)
        for rows, a, b, images in by_size(w, h, d):
            for name, values in analyze_all(a, b, images).items():
                found[name][rows] = values.tolist()
        return pd.DataFrame(found)

    return of(width, height, data)


def dhash(width: Column, height: Column, data: Column) -> Column:
    """The difference hash of RGBA buffers alone; null where a buffer is too short or has no size."""

    @F.pandas_udf("long")
    def of(w: pd.Series, h: pd.Series, d: pd.Series) -> pd.Series:
        found, known = np.zeros(len(d), dtype=np.int64), np.zeros(len(d), dtype=bool)
        for rows, a, b, images in by_size(w, h, d):
            found[rows] = difference_hash(np.stack([np.frombuffer(x, dtype=np.uint8, count=a * b * 4) for x in images]).reshape(-1, b, a, 4))
            known[rows] = True
        return pd.Series(pd.array(np.where(known, found, 0), dtype="Int64")).mask(~known)

    return of(width, height, data)


def exposure_stats(pixels: DataFrame) -> DataFrame:
    """(image, mean, dark, bright, uniformity) from (image, g), aggregated by value before anything is shuffled twice."""
    bins = pixels.groupBy("image", "g").count()
    n = F.sum("count")
    share = lambda cond: F.sum(F.when(cond, F.col("count")).otherwise(0)) / n
    return bins.groupBy("image").agg(
        (F.sum(F.col("g") * F.col("count")) / n).alias("mean"), share(F.col("g") < 16).alias("dark"), share(F.col("g") >= 240).alias("bright"), (F.max("count") / n).alias("uniformity")
    )


def laplacian_stats(pixels: DataFrame) -> DataFrame:
    """(image, variance) from (image, y, x, g): the population variance of the interior's Laplacian."""
    row, col = Window.partitionBy("image", "y").orderBy("x"), Window.partitionBy("image", "x").orderBy("y")
    around = pixels.select(
        "image", (F.lag("g").over(row) + F.lead("g").over(row) + F.lag("g").over(col) + F.lead("g").over(col) - 4 * F.col("g")).cast("double").alias("v")
    )
    mean = F.avg("v")
    return around.groupBy("image").agg(F.coalesce(F.avg(F.col("v") * F.col("v")) - mean * mean, F.lit(0.0)).alias("variance"))
