"""Sinks (S8-S12, S14, S15): keyed upserts as keep-last, partitioned Parquet
tables, JSON publishing and CSV export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..session import cut_lineage
from ..sources.parse import to_envelope
from .newest import newest_values

READINGS_KEY = ("sensor_id", "timestamp")


def keep_last(df: DataFrame, key=READINGS_KEY, order: str = "_ingest") -> DataFrame:
    """What a store that overwrites the written fields of a key keeps.

    Per key and column the last delivered non-NULL value, by `order`, an ingest
    sequence that is unique within a key: a partial row leaves older values alone.
    """
    others = [c for c in df.columns if c not in key and c != order]
    merged = newest_values(df.withColumn("_tie", F.lit(0)), list(key), others, order, "_tie")
    return merged.select(*key, *others)


def keep_last_at_once(df: DataFrame, key=READINGS_KEY, order: str = "_ingest") -> DataFrame:
    """What `keep_last` keeps, for deliveries written once and read back (`snapshots`).

    One grouping carries every column, since most keys have few rows: the rows
    are read and shuffled once. Its buffers make it sort by the key, so keys of
    text, whose first bytes tell little apart, come last. Rows without `order`
    never win; between rows of one key and `order` the largest value does.
    """
    others = [c for c in df.columns if c not in key and c != order]
    text_last = sorted(key, key=lambda c: isinstance(df.schema[c].dataType, T.StringType))

    def last(c):
        given = F.col(c).isNotNull() & F.col(order).isNotNull()
        return F.max(F.when(given, F.struct(F.col(order).alias("at"), F.col(c).alias("value"))))["value"].alias(c)

    if not others:
        return df.select(*key).distinct()
    return df.groupBy(*text_last).agg(*[last(c) for c in others]).select(*key, *others)


def align(df: DataFrame, schema=S.READINGS, default_now: bool = True) -> DataFrame:
    """Project any reading frame onto the canonical columns; missing -> NULL,
    missing timestamp -> now."""
    cols = []
    for f in schema.fields:
        if f.name in df.columns:
            c = F.col(f.name).cast(f.dataType)
        else:
            c = F.lit(None).cast(f.dataType)
        if f.name == "timestamp" and default_now:
            c = F.coalesce(c, F.current_timestamp())
        cols.append(c.alias(f.name))
    extra = [c for c in ("event_id",) if c in df.columns]
    return df.select(*extra, *cols)


SLOT = ("date", "hour")  # partition columns of the tables at rest


def _with_slot(df: DataFrame, by: str) -> DataFrame:
    """With the partition columns, and without marks on columns: at rest they are plain ones."""
    df = df.select([F.col(c).alias(c, metadata={}) for c in df.columns])
    return df.withColumn("date", F.to_date(by)).withColumn("hour", F.hour(by))


def _clustered(df: DataFrame, key) -> DataFrame:
    """Rows dealt by ranges of slot and key: an hour's rows may fill many files, each with few sensors."""
    cols = [c for c in (*SLOT, *key) if c in df.columns]
    return df.repartitionByRange(*cols).sortWithinPartitions(*cols)


def write_table(df: DataFrame, path: str, mode: str = "append", fmt: str = "parquet", by_date: bool = True) -> None:
    """The keyed table at rest: Parquet partitioned by event date and hour,
    files clustered by sensor so key/time filters prune files and row groups."""
    if by_date and "timestamp" in df.columns:
        out = _clustered(_with_slot(df, "timestamp"), READINGS_KEY)
        out.write.mode(mode).format(fmt).partitionBy(*SLOT).save(path)
    else:
        df.write.mode(mode).format(fmt).save(path)


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether the folder holds data, asked of the file system that Spark reads."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return fs.exists(folder) and any(f.getPath().getName()[0] not in "._" for f in fs.listStatus(folder))


def upsert_table(spark: SparkSession, batch: DataFrame, path: str, key=READINGS_KEY, by: str = "timestamp", sequence: str | None = None) -> None:
    """S8 for streams (`foreachBatch`): merge a micro-batch into the table by key.

    Only the hours that the batch touches are rewritten (dynamic partition
    overwrite). Within a batch the row with the larger `sequence` (default: the
    order of arrival) comes later. Values merge per column: a NULL leaves the
    stored value. Replaying a batch leaves the table as it is. Whatever fails
    (unreadable files, columns whose types differ) fails the batch and leaves
    the table untouched; only a folder without data counts as an empty table.
    Rows whose key or time is NULL are refused, as a keyed store refuses them.
    """
    new = batch.dropna(subset=[*key, by])
    new = new.withColumn("_ingest", F.col(sequence) if sequence else F.monotonically_increasing_id())
    new = _with_slot(new, by)
    if table_exists(spark, path):
        old = spark.read.parquet(path)
        clash = [c for c in new.columns if c in old.columns and c not in SLOT and old.schema[c].dataType != new.schema[c].dataType]
        if clash:
            raise ValueError(f"types differ from the stored table: {', '.join(clash)}")
        old = old.join(new.select(*SLOT).distinct(), list(SLOT), "left_semi").withColumn("_ingest", F.lit(-1).cast("long"))
        new = old.unionByName(new, allowMissingColumns=True)
    # materialised before the partitions it was read from are overwritten
    last = cut_lineage(keep_last(new, key=(*key, *(c for c in SLOT if c not in key))))
    out = _clustered(last, key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.partitionBy(*SLOT).parquet(path)


def publish(df: DataFrame, topic: str, path: str | None = None, fmt: str = "kafka", bootstrap: str | None = None):
    """Rows as JSON keyed by sensor to a topic (Kafka) or to JSON files."""
    env = to_envelope(df, topic).drop("event_id") if "event_id" in df.columns else to_envelope(df, topic)
    if fmt == "kafka":
        env.select("key", "value").write.format("kafka").option("kafka.bootstrap.servers", bootstrap).option(
            "topic", topic
        ).save()
    else:
        env.write.mode("append").json(path)


def export_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Header row and rows in one fixed column order."""
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def preview(df: DataFrame, columns: list[str] | None = None, n: int = 20) -> None:
    """Print the first n rows (driver output only)."""
    (df.select(*columns) if columns else df).show(n, truncate=False)


def ddl(table: str, schema=S.READINGS, location: str | None = None) -> str:
    """CREATE TABLE text for a canonical table, partitioned as `write_table` and `upsert_table` store it.

    Over a folder that holds data, `ALTER TABLE ... RECOVER PARTITIONS` (or `attach`) finds its hours.
    """
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    loc = f" LOCATION '{location}'" if location else ""
    return f"CREATE TABLE IF NOT EXISTS {table} ({cols}, `date` date, `hour` int) USING parquet PARTITIONED BY (`date`, `hour`){loc}"


def attach(spark: SparkSession, table: str, path: str, schema=S.READINGS) -> DataFrame:
    """The stored folder as a catalog table with all its partitions."""
    spark.sql(ddl(table, schema, path))
    spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")
    return spark.table(table)


def save_bucketed(df: DataFrame, table: str, buckets: int, key: str = "sensor_id", mode: str = "overwrite") -> DataFrame:
    """A catalog table whose rows lie in buckets of ``key``, sorted: joins and groups by key need no shuffle.

    A bucket holds whole keys, so this suits tables of many keys; where few sensors hold most rows, take `write_table`.
    """
    df = df.select([F.col(c).alias(c, metadata={}) for c in df.columns])
    df.repartition(buckets, key).write.mode(mode).bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    return df.sparkSession.table(table)
