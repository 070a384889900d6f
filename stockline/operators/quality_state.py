"""Data-quality state that adds up: B1-B9 for a growing table set, load by load.

A load (a new month, say) is measured by itself; its state is two small tables of
counts, and the state of several loads together is the sum of theirs:

* ``counts`` -- rows of each table and violations of each row rule, per month;
* ``keys`` -- rows per value of each primary key, unique key and reference.

``evaluate`` turns a state into the rows of ``quality.dq_summary`` over all data
the loads cover, without reading any of it again: duplicates within and across
loads are keys whose counts add up to more than one, orphans are references
without a primary key in the state.  Keys are compared by value (each part cast
to text; the schema has integers, dates and strings, for which that is exact).

``save`` writes a load's state under its own name, replacing an earlier state
of that name, so a repeated or corrected load is never counted twice.  Only
reading keys grows with the data, and a key row is a few bytes beside a table row.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.schemas import PRIMARY_KEYS
from ..tables import TABLE_NAMES, Tables, to_date
from .quality import FOREIGN_KEYS, UNIQUE_RULES, row_rules

#: The date that places a row in a month; tables without one have a null month.
MONTH_OF = {"weekly_sales": "week_start", "inventory_batches": "last_count_date", "purchase_orders": "order_date"}
COUNTS_SCHEMA = "table_name string, month date, rule_id string, n bigint"
KEYS_SCHEMA = "rule_id string, key array<string>, n bigint"


@dataclass(frozen=True)
class QualityState:
    counts: DataFrame
    keys: DataFrame


def _pk_rule(table: str) -> str:
    return f"pk.{table}.{'_'.join(PRIMARY_KEYS[table])}"


def key_rules() -> list[tuple[str, str, tuple[str, ...]]]:
    """(rule, table, columns) of everything that ``keys`` counts."""
    primary = [(_pk_rule(table), table, PRIMARY_KEYS[table]) for table in TABLE_NAMES]
    references = [(rule_id, child, (column,)) for rule_id, child, column, _, _ in FOREIGN_KEYS]
    return [*primary, *UNIQUE_RULES, *references]


def _counts(df: DataFrame, table: str) -> DataFrame:
    """Rows and violations of a table per month: one scan, one small shuffle."""
    month = f"trunc({MONTH_OF[table]}, 'month')" if table in MONTH_OF else "CAST(NULL AS DATE)"
    entries = [(f"rows.{table}", "count(1)")]
    entries += [(r.rule_id, f"count(CASE WHEN NOT ({r.condition}) THEN 1 END)") for r in row_rules() if r.table == table]
    per_month = df.groupBy(F.expr(month).alias("month")).agg(*[F.expr(e).alias(f"_v{i}") for i, (_, e) in enumerate(entries)])
    stacked = ", ".join(f"'{rule_id}', _v{i}" for i, (rule_id, _) in enumerate(entries))
    return per_month.selectExpr(f"'{table}' AS table_name", "month", f"stack({len(entries)}, {stacked}) AS (rule_id, n)")


def _keys(df: DataFrame, rule_id: str, columns: tuple[str, ...]) -> DataFrame:
    key = F.array(*[F.col(c).cast("string") for c in columns])
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).select(F.lit(rule_id).alias("rule_id"), key.alias("key"), "n")


def measure(t: Tables) -> QualityState:
    """The state of the rows in these tables; a table that a load does not touch may be empty."""
    frames = t.frames()
    return QualityState(
        reduce(DataFrame.unionByName, [_counts(frames[name], name) for name in TABLE_NAMES]),
        reduce(DataFrame.unionByName, [_keys(frames[table], rule_id, columns) for rule_id, table, columns in key_rules()]),
    )


def merge(*states: QualityState) -> QualityState:
    """The state of all the loads together."""
    counts = reduce(DataFrame.unionByName, [s.counts for s in states])
    keys = reduce(DataFrame.unionByName, [s.keys for s in states])
    return QualityState(
        counts.groupBy("table_name", "month", "rule_id").agg(F.sum("n").alias("n")),
        keys.groupBy("rule_id", "key").agg(F.sum("n").alias("n")),
    )


def save(state: QualityState, root: str, load: str) -> None:
    """Write a load's state as ``{root}/counts/load=...`` and ``{root}/keys/load=...``."""
    root = root.rstrip("/")
    state.counts.write.mode("overwrite").parquet(f"{root}/counts/load={load}")
    state.keys.write.mode("overwrite").parquet(f"{root}/keys/load={load}")


def read(spark: SparkSession, root: str) -> QualityState:
    """All saved loads together."""
    root = root.rstrip("/")
    table = lambda name, schema: spark.read.schema(f"{schema}, load string").parquet(f"{root}/{name}").drop("load")
    return merge(QualityState(table("counts", COUNTS_SCHEMA), table("keys", KEYS_SCHEMA)))


def evaluate(state: QualityState) -> DataFrame:
    """(rule_id, family, table_name, violations) of every rule, as ``quality.dq_summary`` over all the loads."""
    spark = state.counts.sparkSession
    rules = [(f"non_empty.{t}", "non_empty", t) for t in TABLE_NAMES]
    rules += [(_pk_rule(t), "primary_key", t) for t in TABLE_NAMES]
    rules += [(rule_id, "unique", t) for rule_id, t, _ in UNIQUE_RULES]
    rules += [(rule_id, "foreign_key", child) for rule_id, child, *_ in FOREIGN_KEYS]
    rules += [(r.rule_id, r.family, r.table) for r in row_rules()]
    listed = spark.createDataFrame(rules, "rule_id string, family string, table_name string")

    # loads that were only unioned add up here
    sizes = state.keys.groupBy("rule_id", "key").agg(F.sum("n").alias("n"))
    empty = F.exists("key", lambda part: part.isNull())
    primary = F.col("rule_id").startswith("pk.")
    surplus = F.when(empty, F.when(primary, F.col("n")).otherwise(F.lit(0))).otherwise(F.col("n") - 1)
    repeated = sizes.where(~F.col("rule_id").startswith("fk.")).groupBy("rule_id").agg(F.sum(surplus).alias("n"))

    parents = spark.createDataFrame([(rule_id, _pk_rule(parent)) for rule_id, _, _, parent, _ in FOREIGN_KEYS], "rule_id string, parent string")
    wanted = sizes.where(F.col("rule_id").startswith("fk.") & ~empty).join(F.broadcast(parents), "rule_id")  # one row per rule
    # the keys of the tables that are referred to; a fact's own keys are as many as its rows
    referred = sorted({_pk_rule(parent) for _, _, _, parent, _ in FOREIGN_KEYS})
    known = sizes.where(F.col("rule_id").isin(referred)).select(F.col("rule_id").alias("parent"), "key")
    orphans = wanted.join(known, ["parent", "key"], "left_anti").groupBy("rule_id").agg(F.sum("n").alias("n"))

    broken = state.counts.where(~F.col("rule_id").startswith("rows.")).groupBy("rule_id").agg(F.sum("n").alias("n"))
    rows = state.counts.where(F.col("rule_id").startswith("rows.")).groupBy("table_name").agg(F.sum("n").alias("rows"))
    found = reduce(DataFrame.unionByName, [repeated, orphans, broken])
    violations = (
        F.when(F.col("family") == "non_empty", (F.coalesce("rows", F.lit(0)) == 0).cast("bigint"))
        .otherwise(F.coalesce("n", F.lit(0)))
        .cast("bigint")
    )
    return listed.join(found, "rule_id", "left").join(rows, "table_name", "left").select("rule_id", "family", "table_name", violations.alias("violations"))


def split_by_month(t: Tables, month: dt.date | str) -> tuple[Tables, Tables]:
    """The table set before a month (dimensions included), and the rows from that month on (dimensions empty)."""
    first = F.lit(to_date(month))
    before, after = {}, {}
    for name, df in t.frames().items():
        if name in MONTH_OF:
            late = F.coalesce(F.col(MONTH_OF[name]) >= first, F.lit(False))
            before[name], after[name] = df.where(~late), df.where(late)
        else:
            after[name] = df.limit(0)
    return replace(t, **before), replace(t, **after)
