"""Tables of classes: reading with a declared schema, defaults and rebuilt columns, the catalog, and settings."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, schema=None, defaults: dict | None = None) -> DataFrame:
    """A Parquet table; defaults stand in for missing values wherever it is filtered, sorted or counted."""
    df = (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in (defaults or {}).items()}) if defaults else df


def scratch(spark: SparkSession) -> str:
    """A fresh path in the folder that executors share; only where none is set, one of this machine."""
    top = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="scratch-")
    return f"{top.rstrip('/')}/scratch/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back, so that all that is made of it sees the same rows and partitions'
    numbers, also after an executor is lost."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, fetch: int = 1000, **options) -> DataFrame:
    """A database table in ranges of a numeric key, read in parallel with a cursor's batch size."""
    return spark.read.jdbc(url, table, column=key, lowerBound=low, upperBound=high, numPartitions=parts, properties={"fetchsize": str(fetch), **options})


def create(spark: SparkSession, name: str, schema, bucketed: tuple[int, str] | None = None) -> None:
    """An empty table; bucketed by a key, later joins on it need no shuffle."""
    writer = spark.createDataFrame([], schema).write.format("parquet")
    (writer.bucketBy(bucketed[0], bucketed[1]).sortBy(bucketed[1]) if bucketed else writer).saveAsTable(name)


def rebuilt(df: DataFrame, schema) -> DataFrame:
    """df in a new schema: same names are cast, new ones null, others go.  A value that cannot be cast raises."""
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields))


def catalog(spark: SparkSession) -> dict[str, list[str]]:
    """What there is: version, databases, tables, views and columns."""
    tables = spark.catalog.listTables()
    return {
        "version": [spark.version], "databases": [d.name for d in spark.catalog.listDatabases()],
        "tables": [t.name for t in tables if not t.isTemporary], "views": [t.name for t in tables if t.isTemporary],
        "columns": [f"{t.name}.{c.name}" for t in tables for c in spark.catalog.listColumns(t.name)],
    }


def latest(settings: DataFrame, changes: DataFrame) -> DataFrame:
    """Settings (key, value, at) after changes: the latest value of each key, without keys set to null."""
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.col("at").desc()))
    return settings.unionByName(changes).withColumn("_rank", rank).where("_rank = 1 and value is not null").drop("_rank")
