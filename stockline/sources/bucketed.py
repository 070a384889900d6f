"""Bucketed layout of the fact tables: a position's rows lie in one bucket.

``write`` stores weekly sales, batches and purchase orders as catalog tables
bucketed (and sorted) by (product, warehouse), with equal bucket numbers, so
aggregations per position, the joins between them and the key count of (week,
product, warehouse) need no exchange; the dimensions stay plain tables.
``weekly_sales`` keeps its month folders, so trailing windows still prune.

A bucketed scan is one task per bucket, which a position that holds a large
share of all rows would make long.  ``read`` therefore looks at the bucket files'
sizes: if the largest bucket of a table has more than ``SKEW`` times the mean,
that table is read as plain files instead, cut by size, and its aggregates are
combined before an ordinary exchange.

A table that comes in as many parts by the same columns (``stage`` keeps rows in
that order between two jobs) is written as it lies, without an exchange.

The bucket specification lives in the session's catalog; ``register`` makes the
tables known to another session from the folder alone.
"""

from __future__ import annotations

import datetime as dt
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import TABLE_NAMES, Tables, to_date
from .files import SALES_PARTITION
from .stores import file_sizes

FACTS = ("weekly_sales", "inventory_batches", "purchase_orders")
COLUMNS = ("product_id", "warehouse_id")
SKEW = 4.0
CODEC = "zstd"
_BUCKET = re.compile(r"_(\d+)\.c\d+\.")


def _laid_out(name: str, df: DataFrame) -> DataFrame:
    if name != "weekly_sales":
        return df
    return df.drop(SALES_PARTITION).withColumn(SALES_PARTITION, F.trunc("week_start", "month"))


def stage(df: DataFrame, path: str, buckets: int, columns: tuple[str, ...]) -> DataFrame:
    """``df`` written under ``path``, dealt by ``columns``, and read from there with its buckets known."""
    name = path.rstrip("/").rsplit("/", 1)[-1].replace("-", "_")
    out = df.repartition(buckets, *columns).write.bucketBy(buckets, *columns).sortBy(*columns)
    out.format("parquet").option("compression", CODEC).mode("errorifexists").option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def write(tables: Tables, root: str, prefix: str, buckets: int) -> None:
    """Write all tables under ``root`` and register them as ``{prefix}_{table}``."""
    root = root.rstrip("/")
    for name, df in tables.frames().items():
        target = f"{prefix}_{name}"
        if name in FACTS:
            # dealt by the buckets' own hash: a task writes one bucket, a bucket is one file (per month)
            out = _laid_out(name, df).repartition(buckets, *COLUMNS).write.bucketBy(buckets, *COLUMNS).sortBy(*COLUMNS)
            out = out.partitionBy(SALES_PARTITION) if name == "weekly_sales" else out
        else:
            out = df.write
        out = out.format("parquet").option("compression", CODEC).mode("errorifexists")
        out.option("path", f"{root}/{name}").saveAsTable(target)


def register(spark: SparkSession, root: str, prefix: str, buckets: int, schemas: dict[str, T.StructType]) -> None:
    """Make tables that ``write`` left under ``root`` known to this session's catalog."""
    root = root.rstrip("/")
    for name in TABLE_NAMES:
        fields = [f for f in schemas[name].fields if f.name != SALES_PARTITION]
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        partition = clustered = ""
        if name == "weekly_sales":
            columns, partition = f"{columns}, {SALES_PARTITION} date", f"PARTITIONED BY ({SALES_PARTITION})"
        if name in FACTS:
            keys = ", ".join(COLUMNS)
            clustered = f"CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {buckets} BUCKETS"
        spark.sql(f"CREATE TABLE {prefix}_{name} ({columns}) USING parquet {partition} {clustered} LOCATION '{root}/{name}'")
        if partition:
            spark.sql(f"ALTER TABLE {prefix}_{name} RECOVER PARTITIONS")


def skew(spark: SparkSession, path: str, buckets: int) -> float:
    """Bytes of the largest bucket of a table against the mean bucket."""
    size: Counter[int] = Counter()
    for name, length in file_sizes(spark, path):
        found = _BUCKET.search(name)
        if found:
            size[int(found.group(1))] += length
    return max(size.values()) * buckets / sum(size.values()) if size else 0.0


def read(spark: SparkSession, root: str, prefix: str, buckets: int, as_of: dt.date | str) -> Tables:
    """The tables, each fact bucketed unless one bucket is far larger than the others."""
    root = root.rstrip("/")
    frames = {}
    for name in TABLE_NAMES:
        table = spark.table(f"{prefix}_{name}")
        if name in FACTS and skew(spark, f"{root}/{name}", buckets) > SKEW:
            table = spark.read.schema(table.schema).parquet(f"{root}/{name}")
        frames[name] = table
    return Tables(as_of=to_date(as_of), **frames)
