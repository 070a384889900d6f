"""Numbered versions of a table set: write, gate what was written, claim a number.

Spark has no transaction across tables; this protocol gives a full refresh the
same guarantees with plain files in any store that Spark reads:

1. The publisher notes the last claimed number, n, and writes all tables to a
   fresh folder ``snapshot-<id>``, which no reader looks for.
2. The quality gate runs on the *written* files.  What readers get is therefore
   what was judged, whatever the source has become since.  A refused snapshot is
   deleted by its own publisher.
3. It creates ``versions/<n + 1>.json``, which names the folder, the business
   date and the declared schema of each table.  The file is created only if it
   does not exist (an exclusive create of the store), so of two publishers that
   started from the same version exactly one claims it; the other gets
   ``PublishConflict`` and its folder stays unnamed.

Readers take the entry with the highest number; no clock is involved.  A
publisher that dies leaves a folder without entry, or an entry without content,
which readers skip and whose number is not used again.  ``orphans`` lists the
folders that no entry names.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import TABLE_NAMES, Tables, to_date
from . import files
from .stores import children, create_new, drop_folder

VERSIONS = "versions"
PREFIX = "snapshot-"


class PublishConflict(RuntimeError):
    """Another publish has claimed the version that this one was to become."""


@dataclass(frozen=True)
class Version:
    number: int
    path: str
    as_of: dt.date
    schemas: dict[str, T.StructType]


def _entry_path(root: str, number: int) -> str:
    return f"{root}/{VERSIONS}/{number:020d}.json"


def last_number(spark: SparkSession, root: str) -> int:
    """The highest number claimed under ``root``, whether or not its entry is whole; 0 if none is."""
    names = [n for n in children(spark, f"{root.rstrip('/')}/{VERSIONS}") if n.endswith(".json")]
    return max((int(n.removesuffix(".json")) for n in names), default=0)


def versions(spark: SparkSession, root: str) -> list[Version]:
    """All whole entries, by number.  One small file each, so as many rows as publishes."""
    root = root.rstrip("/")
    if not last_number(spark, root):
        return []
    rows = spark.read.text(f"{root}/{VERSIONS}/*.json", wholetext=True).select("value", F.col("_metadata.file_name").alias("name")).collect()
    out = []
    for row in rows:
        try:
            entry = json.loads(row["value"])
        except ValueError:  # its publisher died between claim and content
            continue
        schemas = {name: T.StructType.fromJson(s) for name, s in entry["schemas"].items()}
        out.append(Version(int(row["name"].removesuffix(".json")), f"{root}/{entry['snapshot']}", to_date(entry["as_of"]), schemas))
    return sorted(out, key=lambda v: v.number)


def latest(spark: SparkSession, root: str) -> Version:
    """The published version with the highest number."""
    found = versions(spark, root)
    if not found:
        raise FileNotFoundError(f"No published version under {root}")
    return found[-1]


def orphans(spark: SparkSession, root: str) -> list[str]:
    """Snapshot folders that no entry names: refused, lost or unfinished publishes, or one under way."""
    root = root.rstrip("/")
    named = {v.path for v in versions(spark, root)}
    return [p for n in children(spark, root) if n.startswith(PREFIX) and (p := f"{root}/{n}") not in named]


def read(spark: SparkSession, root: str, number: int | None = None) -> Tables:
    """The tables of a version (the latest by default), with the schemas its entry declares."""
    found = [v for v in versions(spark, root) if number is None or v.number == number]
    if not found:
        raise FileNotFoundError(f"No published version {'' if number is None else f'{number} '}under {root}")
    version = found[-1]
    return files.read_published(spark, version.path, version.as_of, version.schemas)


def publish(tables: Tables, root: str, validate: bool = True, base: int | None = None) -> Version:
    """Write a snapshot, gate it, and claim the number after ``base`` (default: the last one claimed now)."""
    spark = tables.products.sparkSession
    root = root.rstrip("/")
    number = (last_number(spark, root) if base is None else base) + 1
    snapshot = f"{PREFIX}{uuid.uuid4().hex[:12]}"
    path = files.write_tables(tables, f"{root}/{snapshot}")
    schemas = {name: files.published_schema(name, df.schema) for name, df in tables.frames().items()}
    if validate:
        from ..operators.quality import validate_tables

        try:
            validate_tables(files.read_published(spark, path, tables.as_of, schemas), scope="all")
        except ValueError:
            drop_folder(spark, path)
            raise
    entry = {"snapshot": snapshot, "as_of": tables.as_of.isoformat(), "schemas": {n: json.loads(schemas[n].json()) for n in TABLE_NAMES}}
    if not create_new(spark, _entry_path(root, number), json.dumps(entry)):
        raise PublishConflict(f"Version {number} under {root} is claimed by another publish; {path} is an orphan")
    return Version(number, path, tables.as_of, schemas)
