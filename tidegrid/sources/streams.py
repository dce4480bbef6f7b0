"""Streams of records: from Kafka, from files that arrive in a folder, and as a batch of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.config import StreamConfig
from tidegrid.sources.decode import decode


def kafka(spark: SparkSession, brokers: str, topic: str, starting: str = "earliest") -> DataFrame:
    """Records of a topic: key, value (text), ingest_ts. Needs Spark's Kafka package on the class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", brokers).option("subscribe", topic).option("startingOffsets", starting).load()
    return raw.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), F.col("timestamp").alias("ingest_ts"))


def text_files(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """One record (value) per line of the files in a folder, as they arrive."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)


def tables(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files of a folder, as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def shapes(records: DataFrame, config: StreamConfig, kind: str = "pt") -> DataFrame:
    """Decoded rows of a stream (or batch) of records, by its configuration; rows without a shape go."""
    options: dict = {"date_format": config.date_format}
    if config.format == "GeoJSON":
        options |= {"oid_property": config.oid_property, "time_property": config.time_property}
    elif config.format == "WKT":
        options |= {"delimiter": config.delimiter}
    else:
        options |= {"delimiter": config.delimiter, "attrs": config.csv_attrs}
    rows = decode(records, config.format, kind, **options)
    need = {"pt": "x", "pg": "parts", "ls": "paths", "mp": "points", "gc": "members"}[kind]
    return rows.where(F.col(need).isNotNull())
