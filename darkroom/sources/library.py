"""Rows of a photo library's listing as asset metadata."""

from __future__ import annotations

import re
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from darkroom.functions.pixels import fitted, resized
from darkroom.functions.scalars import created, is_burst, locally_available, resource_bytes
from darkroom.sources.schema import META_COLUMNS

#: A listing: resources are the files behind a shot, of which those of kind photo and paired_video are primary.
LISTING = (
    "local_identifier string, creation_date timestamp, favorite boolean, hidden boolean, subtypes array<string>, represents_burst boolean, burst_identifier string, "
    "location struct<latitude: double, longitude: double>, pixel_width bigint, pixel_height bigint, resources array<struct<kind: string, bytes: bigint, local: boolean>>"
)
PRIMARY = ("photo", "paired_video")


def projected(listing: DataFrame) -> DataFrame:
    """Metadata of each row of a listing. A missing date is the distant past, a shot that names a burst belongs to it, bytes
    are those of its resources (or estimated), and it is local if its primary resources are."""
    no, c = F.lit(False), F.col
    resources = F.coalesce("resources", F.array().cast("array<struct<kind: string, bytes: bigint, local: boolean>>"))
    local = lambda rows: F.transform(rows, lambda r: F.coalesce(r["local"], no))
    kind = lambda name: F.coalesce(F.array_contains("subtypes", F.lit(name)), no)
    return listing.select(
        c("local_identifier").alias("id"), created(c("creation_date")).alias("created_at"), F.coalesce("favorite", no).alias("is_favorite"), F.coalesce("hidden", no).alias("is_hidden"),
        kind("screenshot").alias("is_screenshot"), is_burst(c("represents_burst"), c("burst_identifier")).alias("is_burst"), kind("live").alias("is_live"), c("burst_identifier").alias("burst_id"),
        c("location.latitude").alias("latitude"), c("location.longitude").alias("longitude"), "pixel_width", "pixel_height",
        resource_bytes(F.transform(resources, lambda r: r["bytes"]), c("pixel_width"), c("pixel_height")).alias("byte_size"),
        locally_available(local(F.filter(resources, lambda r: r["kind"].isin(*PRIMARY))), local(resources)).alias("is_locally_available"), F.lit(None).cast("string").alias("secondary_backup_label"),
    ).select(*META_COLUMNS)


def read_images(spark: SparkSession, path: str, most: int = 256, names: str = "*") -> DataFrame:
    """(path, width, height, rgba, error) of image files, shrunk to `most` pixels at the longest side.

    Files are read by Spark's own binary source, from any store it reaches, and files behind names are left out before they are
    read. Binary pixel maps (P5, P6, P7) and uncompressed BMP are understood; any other content gives a row with
    an error. Where only path is selected no file is opened. Empty files are not listed by that source.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", names).load(path)
    return files.select("path", decoded(F.col("content"), most).alias("i")).select("path", "i.*")


def decoded(content: Column, most: int = 256) -> Column:
    """A struct of width, height, rgba and error from the content of an image file."""
    @F.pandas_udf("width int, height int, rgba binary, error string")
    def of(batch: pd.Series) -> pd.DataFrame:
        rows = []
        for data in batch:
            try:
                image = pixel_map(data)
                h, w = image.shape[:2]
                to = fitted(w, h, most)
                rows.append((*to, resized(image[None], *to)[0].tobytes(), None))
            except (ValueError, IndexError, TypeError) as e:
                rows.append((None, None, None, str(e) or "not an image"))
        return pd.DataFrame(rows, columns=["width", "height", "rgba", "error"]).astype({"width": "Int32", "height": "Int32"})

    return of(content)


def pixel_map(data: bytes | None) -> np.ndarray:
    """The pixels (height, width, 4) of a binary pixel map or an uncompressed BMP; ValueError for anything else."""
    if not data:
        raise ValueError("empty file")
    if data[:2] == b"BM":
        return _bmp(data)
    if data[:2] in (b"P5", b"P6", b"P7"):
        return _netpbm(data)
    raise ValueError("unknown image format")


def _rgba(pixels: np.ndarray, channels: int) -> np.ndarray:
    """One to four channels as four: grey is repeated, and what has no alpha is opaque."""
    grey, alpha = channels < 3, channels in (2, 4)
    colour = np.repeat(pixels[..., :1], 3, axis=2) if grey else pixels[..., :3]
    return np.ascontiguousarray(np.concatenate([colour, pixels[..., -1:] if alpha else np.full((*pixels.shape[:2], 1), 255, np.uint8)], axis=2))


def _netpbm(data: bytes) -> np.ndarray:
    if data[:2] == b"P7":
        head = re.match(rb"P7\n(.*?)ENDHDR\n", data, re.DOTALL)
        if not head:
            raise ValueError("broken header")
        said = dict(x.split(None, 1) for x in head.group(1).splitlines() if len(x.split(None, 1)) == 2)
        try:
            width, height, channels, most = (int(said[k]) for k in (b"WIDTH", b"HEIGHT", b"DEPTH", b"MAXVAL"))
        except KeyError as e:
            raise ValueError("broken header") from e
    else:
        head = re.match(rb"P[56](?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s", data)
        if not head:
            raise ValueError("broken header")
        width, height, most = map(int, head.groups())
        channels = 1 if data[:2] == b"P5" else 3
    if width < 1 or height < 1 or most != 255 or not 1 <= channels <= 4:
        raise ValueError("only 8-bit images of up to four channels")
    if len(data) - head.end() < width * height * channels:
        raise ValueError("truncated image")
    pixels = np.frombuffer(data, dtype=np.uint8, count=width * height * channels, offset=head.end())
    return _rgba(pixels.reshape(height, width, channels), channels)


def _bmp(data: bytes) -> np.ndarray:
    if len(data) < 54:
        raise ValueError("broken header")
    begin, _, width, height, _, bits, compression = struct.unpack_from("<IIiiHHI", data, 10)
    upward, height = height > 0, abs(height)
    if bits not in (24, 32) or compression not in (0, 3) or width < 1 or height < 1:
        raise ValueError("only uncompressed images of 24 or 32 bits")
    line = (width * bits // 8 + 3) // 4 * 4
    if len(data) - begin < line * height:
        raise ValueError("truncated image")
    rows = np.frombuffer(data, dtype=np.uint8, count=line * height, offset=begin).reshape(height, line)[:, : width * bits // 8].reshape(height, width, bits // 8)
    rows = rows[::-1] if upward else rows
    return _rgba(rows[..., [2, 1, 0]], 3)
