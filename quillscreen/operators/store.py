"""Cutting lineage at files that all machines share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast up to so many rows and bytes, by the default sizes of its column types.
BROADCAST_ROWS, BROADCAST_BYTES = 250_000, 8 << 20


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster's ``spark.checkpoint.dir``; where it is unset a local master uses its warehouse, and others fail."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return base or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"


def checkpointed(table: DataFrame) -> DataFrame:
    """``table`` evaluated once, with its lineage cut at a checkpoint."""
    spark = table.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    return table.checkpoint()


def written(table: DataFrame) -> DataFrame:
    """``table`` evaluated once into Parquet files of the shared folder, so that each later use reads only the columns it needs."""
    spark = table.sparkSession
    path = f"{checkpoint_dir(spark)}/quillscreen-{uuid.uuid4().hex}"
    table.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(table.schema).parquet(path)


def small(table: DataFrame) -> DataFrame:
    """``table`` with a broadcast hint if it is within both bounds; beyond them the join shuffles. The table must be cheap to count."""
    rows = min(BROADCAST_ROWS, BROADCAST_BYTES // table._jdf.schema().defaultSize())
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def join_aggregate(rows: DataFrame, totals: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined to ``totals``, which holds one row per key of ``on``, so that AQE can split a hot key of ``rows``.

    An aggregate arrives partitioned on its key and would be joined in the stage that made it, which AQE never splits. A second key, derived from
    the first, asks for a shuffle of its own of the few aggregated rows.
    """
    salted = [t.withColumn("__again", F.hash(*on)) for t in (rows, totals)]
    return salted[0].join(salted[1], [*on, "__again"], how).drop("__again")


def exploded(d: DataFrame, array: Column | str, to: str, *keep: str) -> DataFrame:
    """``keep`` and a row per element of an array without nulls.

    ``explode`` would infer a filter on the size of the array and push it as far down as it goes, where the whole array is computed a second time, with each
    column that it uses written out at every place of use. The outer form infers nothing.
    """
    return d.select(*keep, F.explode_outer(array).alias(to)).filter(F.col(to).isNotNull())


#: What one core reads of a file in one piece: about a row group.
ROW_GROUP_BYTES = 128 << 20


def dealt(table: DataFrame) -> DataFrame:
    """A table read from fewer files than there are cores, and of at most a row group for each, with its rows dealt over all cores.

    A row group is read by one task, so the work on a small file would be serial. Larger tables have enough of them and are left as they are, as are files whose
    row groups already give no core over twice its share: dealing writes every row to disk.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    size = table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    few = int(str(size)) <= cores * ROW_GROUP_BYTES and len(table.inputFiles()) < cores
    return table.repartition(cores) if few and not spread(table, cores) else table


def spread(table: DataFrame, cores: int) -> bool:
    """Whether no task that reads ``table`` gets over twice a core's share of its rows; only the row counts of the files are read."""
    rows = [r["count"] for r in table.groupBy(F.spark_partition_id().alias("__p")).count().collect()]
    return bool(rows) and max(rows) * cores <= 2 * sum(rows)
