"""CSV / Parquet readers and writers for the six tables, and the full-refresh publish.

* ``read_tables`` reads a folder with one entry per table, always with the
  declared schema (never inferred); one malformed CSV value ends it.
* ``load_csv`` is the reader for large loads: rows that parse go on, the others
  go to a quarantine table with their original line, and a limit decides.
* ``write_tables`` is the sink: one folder per table; ``weekly_sales`` is
  partitioned by month (``sales_month``, first day of the month) so the
  trailing 12-week reads prune all but the last few partitions.
* ``publish_tables`` is the full-refresh load: write a new snapshot folder, run
  the quality gate (every constraint of the schema) on the written files, and
  claim the next version number (``snapshots``).
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from ..tables import TABLE_NAMES, Tables, to_date
from .schemas import SCHEMAS

SALES_PARTITION = "sales_month"
CORRUPT = "_corrupt_record"
REJECTED = "_rejected"


def read_table(spark: SparkSession, path: str, name: str, fmt: str = "parquet") -> DataFrame:
    schema = SCHEMAS[name]
    if fmt == "csv":
        # enforceSchema=False makes Spark check the header against the schema
        # instead of silently applying it by position.
        return (
            spark.read.schema(schema)
            .option("header", True)
            .option("enforceSchema", False)
            # a malformed value is an error, not a NULL
            .option("mode", "FAILFAST")
            .option("dateFormat", "yyyy-MM-dd")
            .csv(path)
        )
    df = spark.read.parquet(path)
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def read_tables(
    spark: SparkSession,
    root: str,
    as_of: dt.date | str,
    fmt: str = "parquet",
    names: dict[str, str] | None = None,
) -> Tables:
    """Read ``{root}/{table}[.csv]`` for the six tables into a ``Tables`` bundle."""
    suffix = ".csv" if fmt == "csv" else ""
    frames = {}
    for name in TABLE_NAMES:
        path = (names or {}).get(name, f"{root.rstrip('/')}/{name}{suffix}")
        frames[name] = read_table(spark, path, name, fmt)
    return Tables(as_of=to_date(as_of), **frames)


@dataclass(frozen=True)
class CsvLoad:
    """Rows that parsed, and per table the quarantined rows (original line) and both numbers."""

    tables: Tables
    rejected: dict[str, DataFrame]
    accepted_rows: dict[str, int]
    rejected_rows: dict[str, int]

    def quarantine(self) -> DataFrame:
        """(table_name, line) of every rejected row."""
        parts = [df.select(F.lit(name).alias("table_name"), F.col(CORRUPT).alias("line")) for name, df in self.rejected.items()]
        return reduce(DataFrame.unionByName, parts)


def split_csv(spark: SparkSession, path: str, name: str, out: str) -> DataFrame:
    """Parse one CSV table into Parquet under ``out``, partitioned by whether a row is rejected.

    A row is rejected when a value does not parse as its declared type or the
    number of cells differs.  All columns are parsed in this one pass, so what
    is accepted does not depend on the columns that a later reader selects (a
    pruned CSV scan checks only those).
    """
    declared = T.StructType([*SCHEMAS[name].fields, T.StructField(CORRUPT, T.StringType())])
    rows = (
        spark.read.schema(declared)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("dateFormat", "yyyy-MM-dd")
        .csv(path)
        .withColumn(REJECTED, F.col(CORRUPT).isNotNull())
    )
    rows.write.partitionBy(REJECTED).parquet(out)
    return spark.read.schema(T.StructType([*declared.fields, T.StructField(REJECTED, T.BooleanType())])).parquet(out)


def load_csv(
    spark: SparkSession,
    root: str,
    as_of: dt.date | str,
    names: dict[str, str] | None = None,
    max_rejected: int | dict[str, int] = 0,
    out: str | None = None,
) -> CsvLoad:
    """Read ``{root}/{table}.csv`` of the six tables, malformed rows set aside.

    ``max_rejected`` (rows, for every table or by name) is the gate: a table
    with more raises ``ValueError`` and names the folder of its rejected rows.
    Both kinds are written once under ``out`` (default: the shared checkpoint
    folder) and read from there.
    """
    out = out or scratch_path(spark, "csv")
    good, bad, counted = {}, {}, []
    for name in TABLE_NAMES:
        rows = split_csv(spark, (names or {}).get(name, f"{root.rstrip('/')}/{name}.csv"), name, f"{out}/{name}")
        good[name] = rows.where(~F.col(REJECTED)).drop(CORRUPT, REJECTED)
        bad[name] = rows.where(F.col(REJECTED)).drop(REJECTED)
        counted.append(rows.groupBy(REJECTED).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), REJECTED, "n"))
    sizes = {(r["name"], r[REJECTED]): r["n"] for r in reduce(DataFrame.unionByName, counted).collect()}
    accepted, rejected = ({name: sizes.get((name, kind), 0) for name in TABLE_NAMES} for kind in (False, True))
    for name, n in rejected.items():
        limit = max_rejected.get(name, 0) if isinstance(max_rejected, dict) else max_rejected
        if n > limit:
            raise ValueError(f"{name}: {n} malformed rows, {limit} allowed; see {out}/{name}/{REJECTED}=true")
    return CsvLoad(Tables(as_of=to_date(as_of), **good), bad, accepted, rejected)


def require_frames(frames: dict[str, DataFrame]) -> None:
    """Raise when a table of the set is missing (same message as the loader)."""
    missing = [name for name in TABLE_NAMES if name not in frames]
    if missing:
        raise ValueError(f"Missing required data frames: {', '.join(missing)}")


def write_tables(tables: Tables, root: str, fmt: str = "parquet") -> str:
    """Write every table under ``root``; overwrite semantics per table."""
    root = root.rstrip("/")
    for name, df in tables.frames().items():
        writer = df
        if name == "weekly_sales" and fmt == "parquet":
            # Range-partition on (month, position) so each task writes one or two
            # month folders instead of a file in every month.
            writer = df.withColumn(SALES_PARTITION, F.trunc("week_start", "month")).repartitionByRange(
                SALES_PARTITION, "product_id", "warehouse_id"
            )
            out = writer.write.mode("overwrite").partitionBy(SALES_PARTITION)
        else:
            out = writer.write.mode("overwrite")
        if fmt == "csv":
            out.option("header", True).option("dateFormat", "yyyy-MM-dd").csv(f"{root}/{name}.csv")
        else:
            out.parquet(f"{root}/{name}")
    return root


def published_schema(name: str, schema: T.StructType) -> T.StructType:
    """The schema of a table as ``write_tables`` lays it out (columns nullable, partition column last)."""
    fields = [T.StructField(f.name, f.dataType) for f in schema.fields if f.name != SALES_PARTITION]
    if name == "weekly_sales":
        fields.append(T.StructField(SALES_PARTITION, T.DateType()))
    return T.StructType(fields)


def read_published(
    spark: SparkSession, root: str, as_of: dt.date | str, schemas: dict[str, T.StructType] | None = None
) -> Tables:
    """Read a snapshot written by ``write_tables`` / ``publish_tables`` (parquet).

    ``weekly_sales`` keeps its ``sales_month`` partition column so date-window
    filters can add a partition predicate (see ``operators.inventory``).  With
    ``schemas`` (a published version declares them) columns and types are those,
    whatever the files' footers say; without, they are read from a footer.
    """
    root = root.rstrip("/")
    reader = lambda name: spark.read.schema(schemas[name]) if schemas else spark.read
    frames = {name: reader(name).parquet(f"{root}/{name}") for name in TABLE_NAMES}
    return Tables(as_of=to_date(as_of), **frames)


def publish_tables(tables: Tables, root: str, validate: bool = True) -> str:
    """Full refresh: write a snapshot, gate the written files, claim the next version.

    Returns the snapshot path.  When a rule fails nothing is published and the
    written folder is removed; see ``snapshots.publish`` for versions and
    conflicts.
    """
    from .snapshots import publish

    require_frames(tables.frames())
    return publish(tables, root, validate).path


def latest_snapshot(spark: SparkSession, root: str) -> str:
    """The folder of the published version with the highest number under ``root``."""
    from .snapshots import latest

    return latest(spark, root).path
