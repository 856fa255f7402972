"""Output files: layers, GeoJSON features, shapefile attribute tables, reports, manifests."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_layers(layers: dict[str, DataFrame], path: str) -> None:
    """One Parquet table partitioned by layer name; layers may have different columns."""
    out = None
    for name, df in layers.items():
        df = df.withColumn("layer", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    out.write.partitionBy("layer").mode("overwrite").parquet(path)


def geojson_features(df: DataFrame, properties: list[str]) -> DataFrame:
    """value: one GeoJSON feature per row of boxes x0, y0, x1, y1."""
    corner = lambda x, y: F.array(F.col(x).cast("double"), F.col(y).cast("double"))
    ring = F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1"), corner("x0", "y0"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))).alias("value"))


def report_json(row: dict) -> str:
    """JSON text of a report; NaN and infinite values are an error."""

    def check(v: object) -> None:
        for x in v.values() if isinstance(v, dict) else v if isinstance(v, list) else ():
            check(x)
        if isinstance(v, float) and not math.isfinite(v):
            raise ValueError("a report value is not finite")

    check(row)
    return json.dumps(row, ensure_ascii=False, indent=2, allow_nan=False)


def csv_summary(df: DataFrame, path: str) -> None:
    """A summary of few rows as one CSV file with a header that starts with a byte order mark."""
    first = df.columns[0]
    df.withColumnRenamed(first, "﻿" + first).coalesce(1).write.mode("overwrite").csv(path, header=True, encoding="UTF-8")


def output_manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256 of every file below a path; an empty file is an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    digest = F.when(F.col("length") > 0, F.sha2("content", 256)).otherwise(F.raise_error(F.concat(F.lit("empty output "), "path")))
    return files.select("path", F.col("length").alias("bytes"), digest.alias("sha256"))
