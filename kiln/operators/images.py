"""Image references, availability join, validity, flags and rasters."""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.config import IMAGE_MEAN, IMAGE_STD
from kiln.functions.text import strip
from kiln.operators.partitioning import spread
from kiln.operators.skew import lookup_join

MIN_SIDE = 10


def _split_list(c: Column) -> Column:
    """`` | ``-separated string to array; null or empty string gives []."""
    empty = F.array().cast(T.ArrayType(T.StringType()))
    return F.when(c.isNull() | (c == ""), empty).otherwise(F.split(c, r" \| ", -1))


def candidate_urls(hi_res="images_hi_res", large="images_large", k: int = 1) -> Column:
    """Hi-res URLs before large ones, first ``k`` kept before any fetch."""
    return F.slice(F.concat(_split_list(F.col(hi_res)), _split_list(F.col(large))), 1, k)


def candidate_paths(paths="image_paths", k: int = 1) -> Column:
    """``;``-separated local paths, stripped, blanks dropped, first ``k``."""
    c = F.col(paths)
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ";", -1), strip)
    return F.slice(F.filter(parts, lambda x: x != ""), 1, k)


def valid_size(width: Column, height: Column) -> Column:
    """I4: both sides at least 10 pixels."""
    return (width >= MIN_SIDE) & (height >= MIN_SIDE)


def attach_images(df: DataFrame, images: DataFrame, cand_col: str = "candidates",
                  id_col: str = "item_id", key: str = "origin", k: int | None = None) -> DataFrame:
    """I3 + I4 + I5: join each row's candidates with the table of landed
    images (``origin``, ``width``, ``height``), keep valid ones in candidate
    order, row kept when nothing matches. Adds ``images`` (array of origins)
    and ``has_images``.

    Landed images are deduplicated by origin. With ``k=1`` (one candidate per
    row, the default configuration) the candidate is looked up; otherwise each
    distinct candidate list is matched once and looked up as a whole, so rows
    stay apart whatever their ids. Hot URLs, hot lists and rows without a
    candidate do not meet in one task (``lookup_join``)."""
    imgs = images.filter(valid_size(F.col("width"), F.col("height"))).select(F.col(key).alias("look_url")).distinct()
    empty = F.array().cast(T.ArrayType(T.StringType()))
    if k == 1:
        out = lookup_join(df.withColumn("look_url", F.get(F.col(cand_col), 0)), imgs.withColumn("look_ok", F.lit(True)), "look_url")
        found = F.when(F.col("look_ok"), F.array(F.col("look_url"))).otherwise(empty)
        return out.withColumn("images", found).withColumn("has_images", F.size(found) > 0).drop("look_url", "look_ok")
    listed = df.withColumn("look_list", F.when(F.size(cand_col) > 0, F.to_json(cand_col)))
    each = (listed.filter("look_list IS NOT NULL").select("look_list", cand_col).dropDuplicates(["look_list"])
            .select("look_list", F.posexplode(cand_col).alias("look_pos", "look_url")))
    hit = (each.join(imgs, "look_url").groupBy("look_list")
           .agg(F.array_sort(F.collect_list(F.struct("look_pos", "look_url"))).alias("look_found")))
    out = lookup_join(listed, hit, "look_list")
    found = F.coalesce(F.transform("look_found", lambda s: s["look_url"]), empty)
    return out.withColumn("images", found).withColumn("has_images", F.size(found) > 0).drop("look_list", "look_found")


def has_images_value(c="has_images") -> Column:
    """I5 (collator form): 1.0 / 0.0."""
    return F.when(F.col(c), F.lit(1.0)).otherwise(F.lit(0.0))


# --- Rasters (I6, I7): NumPy over Arrow batches --------------------------------

WEIGHT_BITS = 22          # fixed value: fractional bits of the resize weights
RESIZE_PIXELS = 1 << 20   # source pixels widened to float64 at once (24 MB)


def _to_rgb(arr: np.ndarray, n_channels: int) -> np.ndarray:
    """Spark image rows store BGR / BGRA / grey; return HxWx3 RGB uint8.
    Alpha is dropped (composited on black is what a straight RGBA->RGB drop
    does for the colour channels)."""
    if n_channels == 1:
        return np.repeat(arr[:, :, :1], 3, axis=2)
    return arr[:, :, 2::-1][:, :, :3] if n_channels >= 3 else np.repeat(arr[:, :, :1], 3, axis=2)


@functools.lru_cache(maxsize=256)
def triangle_bands(n_in: int, n_out: int) -> tuple[tuple[int, int, int, int, np.ndarray], ...]:
    """The banded weight matrix of an antialiased bilinear resize from ``n_in``
    to ``n_out`` samples, as dense blocks (first output, last output, first
    input, last input, weights). Each output averages the inputs under a
    triangle around its centre, one source step wide when enlarging and as wide
    as the shrinking factor when shrinking. Weights are integers of
    ``WEIGHT_BITS`` fractional bits."""
    scale = n_in / n_out
    reach = max(scale, 1.0)
    centre = (np.arange(n_out) + 0.5) * scale
    first = np.maximum(0, np.floor(centre - reach + 0.5)).astype(np.int64)
    last = np.minimum(n_in, np.floor(centre + reach + 0.5)).astype(np.int64)
    blocks = []
    for a in range(0, n_out, 16):
        z = min(n_out, a + 16)
        lo, hi = int(first[a]), int(last[z - 1])
        x = np.arange(lo, hi)
        w = np.clip(1 - np.abs((x[None, :] - centre[a:z, None] + 0.5) * (1 / reach)), 0, None)
        w[(x[None, :] < first[a:z, None]) | (x[None, :] >= last[a:z, None])] = 0
        w /= w.sum(axis=1, keepdims=True)
        blocks.append((a, z, lo, hi, np.floor(0.5 + w * (1 << WEIGHT_BITS))))
    return tuple(blocks)


def _filtered(rows: np.ndarray, n_out: int) -> np.ndarray:
    """Resize the last axis of uint8 ``rows``, rounding to 8 bits. The products
    are integers below 2^53, so the float64 matrix product is exact."""
    out = np.empty((*rows.shape[:-1], n_out), np.uint8)
    half, unit = float(1 << (WEIGHT_BITS - 1)), float(1 << WEIGHT_BITS)
    for a, z, lo, hi, w in triangle_bands(rows.shape[-1], n_out):
        acc = rows[..., lo:hi].astype(np.float64) @ w.T
        out[..., a:z] = np.clip(np.floor((acc + half) / unit), 0, 255)
    return out


def resize(images: np.ndarray, size: int) -> np.ndarray:
    """Antialiased bilinear resize of a stack of equally large RGB images
    (n, h, w, 3) uint8 to (n, 3, size, size): along the rows, rounded to 8
    bits, then along the columns, rounded again."""
    n, h, w, _ = images.shape
    planes = images.transpose(0, 3, 1, 2)
    step = max(1, RESIZE_PIXELS // max(1, 3 * n * w))
    wide = np.empty((n, 3, h, size), np.uint8)
    for y in range(0, h, step):
        wide[:, :, y:y + step] = _filtered(planes[:, :, y:y + step], size)
    return _filtered(wide.swapaxes(2, 3), size).swapaxes(2, 3)


def normalised(planes: np.ndarray) -> np.ndarray:
    """Scale (n, 3, s, s) uint8 to [0, 1] and normalise per channel; float32,
    one flat channel-first row per image."""
    mean, std = np.array(IMAGE_MEAN)[:, None, None], np.array(IMAGE_STD)[:, None, None]
    return ((planes / 255.0 - mean) / std).astype(np.float32).reshape(len(planes), -1)


def raster(rgb: np.ndarray | None, size: int) -> np.ndarray:
    """I7 for one image: a missing image is the black raster."""
    planes = np.zeros((1, 3, size, size), np.uint8) if rgb is None else resize(rgb[None], size)
    return normalised(planes)[0]


def image_tensors(df: DataFrame, image_col: str = "image", size: int = 224,
                  id_col: str = "item_id", rows_per_slice: int = 64) -> DataFrame:
    """I6 + I7 over rows carrying a Spark image struct (or null): emits
    ``pixel_values`` (array<float>, 3·size·size). Images with a side under 10
    pixels or without data count as missing. Runs on Arrow batches: of up to
    ``rows_per_slice`` rows, images of the same size are resized as one stack,
    and all rasters are written into one NumPy buffer that becomes the Arrow
    list values, so memory per slice stays bounded (a 224² raster is 600 KB)."""
    import pyarrow as pa

    length = 3 * size * size

    def usable(img) -> bool:
        return (img is not None and img["data"] is not None and None not in (img["width"], img["height"], img["nChannels"])
                and img["width"] >= MIN_SIDE and img["height"] >= MIN_SIDE)

    def fn(batches):
        black = raster(None, size)
        for rb in batches:
            for start in range(0, rb.num_rows, rows_per_slice):
                sl = rb.slice(start, rows_per_slice)
                imgs = sl.column(image_col).to_pylist()
                out = np.empty((len(imgs), length), dtype=np.float32)
                alike: dict[tuple[int, int], list[int]] = {}
                for i, img in enumerate(imgs):
                    if usable(img):
                        alike.setdefault((img["height"], img["width"]), []).append(i)
                    else:
                        out[i] = black
                for (h, w), rows in alike.items():
                    many = max(1, RESIZE_PIXELS // (h * w))
                    for k in range(0, len(rows), many):
                        part = rows[k:k + many]
                        stack = np.stack([_to_rgb(np.frombuffer(imgs[i]["data"], np.uint8).reshape(h, w, -1), imgs[i]["nChannels"]) for i in part])
                        out[part] = normalised(resize(stack, size))
                offsets = pa.array(np.arange(len(imgs) + 1, dtype=np.int32) * length)
                values = pa.ListArray.from_arrays(offsets, pa.array(out.ravel(), type=pa.float32()))
                yield pa.RecordBatch.from_arrays([sl.column(id_col), values], names=[id_col, "pixel_values"])

    schema = T.StructType([df.schema[id_col], T.StructField("pixel_values", T.ArrayType(T.FloatType()))])
    return spread(df.select(id_col, image_col)).mapInArrow(fn, schema)
