"""Frame sizes from text files beside a raw movie, and the shapes that a size allows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BYTE_KEYS = ("exposure_bytes_per_frame", "bytes_per_frame", "frame_bytes")
PIXEL_KEYS = ("pixels_per_frame", "pixels_per_image")


def frame_pixels(spark: SparkSession, folder: str, stem: str, itemsize: int = 2) -> DataFrame:
    """(pixels, how) from the first text file with a usable key: files that begin with the stem first, then by name;
    byte keys, which must divide by the item size, before pixel keys."""
    text = spark.read.text(f"{folder}/*.txt", wholetext=True).select(F.lower("value").alias("t"), F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"))
    found = []
    for rank, key in enumerate(BYTE_KEYS + PIXEL_KEYS):
        n = F.expr(f"try_cast(regexp_extract(t, '{key}\\\\s*[=:]\\\\s*(\\\\d+)', 1) AS bigint)")
        by = rank < len(BYTE_KEYS)
        value = F.when(n % itemsize == 0, (n / itemsize).cast("bigint")) if by else n
        found.append(F.struct(F.lit(rank).alias("rank"), value.alias("pixels"), F.concat(F.lit(f"{key}="), n.cast("string")).alias("how")))
    rows = text.select("name", F.explode(F.array(*found)).alias("f")).where("f.pixels is not null")
    w = Window.orderBy(~F.col("name").startswith(stem), "name", "f.rank")
    return rows.select("f.pixels", F.concat("name", F.lit(": "), "f.how").alias("how"), F.row_number().over(w).alias("_n")).where("_n = 1").drop("_n")


def factor_pairs(spark: SparkSession, pixels: int, lo: int, hi: int) -> DataFrame:
    """(nrow, ncol) with nrow * ncol = pixels and both within the limits."""
    d = spark.range(lo, hi + 1).withColumnRenamed("id", "nrow")
    return d.where(F.lit(pixels) % F.col("nrow") == 0).select("nrow", F.expr(f"{pixels}L div nrow").alias("ncol")).where(F.col("ncol").between(lo, hi))
