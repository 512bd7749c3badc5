"""Writers of sets, sequences, reports and manifests."""

from __future__ import annotations

import datetime
import json
import platform

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_splits(splits: DataFrame, path: str, kind: str = "parquet") -> None:
    """One folder for each regime and side."""
    splits.write.mode("overwrite").partitionBy("regime", "side").format(kind).save(path)


def write_predictions(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)


def write_fasta(entities: DataFrame, path: str) -> None:
    entities.select(F.concat(F.lit(">"), F.col("entity_id").cast("string"), F.lit("\n"), "seq")).write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def markdown_rows(df: DataFrame) -> DataFrame:
    """Each row as a line of a Markdown table: three decimals, and thousands apart in whole numbers."""
    shown = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        c = F.col(f.name)
        text = F.format_string("%.3f", c.cast("double")) if kind in ("double", "float") else F.format_number(c, 0) if kind in ("long", "integer") else c.cast("string")
        shown.append(F.coalesce(text, F.lit("")))
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *shown), F.lit(" |")).alias("line"))


def content_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of the files below a path."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def manifest(**settings: object) -> str:
    """When and with what a run was made, as JSON."""
    now = datetime.datetime.now(datetime.UTC).isoformat()
    return json.dumps({"created": now, "python": platform.python_version(), "pyspark": pyspark.__version__, "settings": settings}, sort_keys=True, default=str)
