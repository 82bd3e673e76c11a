"""Image directory source and sink."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_image_dir(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """Decode every image under ``root`` with Spark's image source. Rows keep
    ``path`` (relative to ``root``, URL-decoded), ``width``, ``height`` and the
    image struct; undecodable files get width -1 and are marked invalid."""
    df = (spark.read.format("image").option("dropInvalid", "false")
          .option("recursiveFileLookup", str(recursive).lower()).load(root))
    base = re.sub(r"^file:(//)?(?=/)", "", root.rstrip("/")) + "/"
    origin = F.col("image.origin")
    # Percent-decoding only: form decoding would turn "+" into a blank.
    rel = F.regexp_replace(F.url_decode(F.regexp_replace(origin, r"\+", "%2B")), r"^file:(//)?(?=/)", "")
    rel = F.when(rel.startswith(base), F.substring(rel, len(base) + 1, 1 << 30)).otherwise(rel)
    return df.select(rel.alias("path"), F.col("image.width").alias("width"),
                     F.col("image.height").alias("height"),
                     F.when(F.col("image.width") > 0, F.col("image")).alias("image"))


def join_images(rows: DataFrame, images: DataFrame, path_col: str = "image_path") -> DataFrame:
    """Left join rows to decoded images by relative path; a missing or
    undecodable file yields a null image and the row is kept."""
    return rows.join(images.select(F.col("path").alias(path_col), "image", "width", "height"),
                     path_col, "left")


# Fixed values of the PNG format: signature, colour types by channel count.
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
PNG_COLOUR = {1: 0, 3: 2, 4: 6}


def png_bytes(image: dict | None) -> bytes | None:
    """A PNG file of a Spark image struct (grey, BGR or BGRA, 8 bits); null
    gives null."""
    if image is None or image["data"] is None:
        return None
    h, w, c = image["height"], image["width"], image["nChannels"]
    px = np.frombuffer(image["data"], np.uint8).reshape(h, w, c)
    if c >= 3:
        px = px[:, :, [2, 1, 0, 3][:c]]
    lines = np.concatenate([np.zeros((h, 1), np.uint8), px.reshape(h, w * c)], axis=1)     # no line filter

    def chunk(tag: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))

    return (PNG_SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, PNG_COLOUR[c], 0, 0, 0))
            + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b""))


def with_png(df: DataFrame, image_col: str = "image", result: str = "png") -> DataFrame:
    """``df`` with the image as PNG file bytes."""
    schema = df.withColumn(result, F.lit(None).cast("binary")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = {c: b.column(c) for c in b.schema.names}
            cols[result] = pa.array([png_bytes(i) for i in b.column(image_col).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([cols[f.name] for f in schema.fields], names=schema.names)

    return df.mapInArrow(run, schema)


def write_files(df: DataFrame, root: str, path_col: str = "path", data_col: str = "png") -> int:
    """Write each row's bytes to ``root``/path from the executors, through the
    file system of the URI (``root`` must be a folder that all of them share);
    rows without bytes write nothing. Writing a file again after a lost
    executor replaces it. Returns the number of files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        store, base = fs.FileSystem.from_uri(root)
        made: set[str] = set()
        for b in batches:
            n = 0
            for path, data in zip(b.column(path_col).to_pylist(), b.column(data_col).to_pylist()):
                if path is None or data is None:
                    continue
                folder = f"{base}/{path}".rsplit("/", 1)[0]
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(f"{base}/{path}") as f:
                    f.write(data)
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return df.select(path_col, data_col).mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
