"""Helpers shared by the training-data operators.

Words are maximal runs of characters other than space and U+0009..U+000D.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_GAP = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"


def text_of(col: str | Column = "text") -> Column:
    """The text with null as the empty string."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words of a text; empty for an empty or blank text."""
    return F.filter(F.split(text, WORD_GAP, -1), lambda w: w != "")


def shared_dir(spark: SparkSession) -> str:
    """A new folder path under the cluster's shared checkpoint folder.

    The folder named by ``spark.checkpoint.dir`` is used as it is set. Where it is unset, as in tests, a folder under the warehouse
    takes its place on a local master; on a cluster that folder could be one machine's own, so it is an error there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = base or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
    return f"{base.rstrip('/')}/quillscreen-{uuid.uuid4().hex}"


#: Rows of an Arrow batch while a table is written here. Whole texts are long, and both ends hold a batch outside the heap.
ARROW_ROWS = 1000
ARROW_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    The lineage ends at files that outlive any executor, so a lost executor costs at most the running stage.
    """
    spark = df.sparkSession
    path, rows = shared_dir(spark), spark.conf.get(ARROW_KEY)
    spark.conf.set(ARROW_KEY, str(min(int(rows), ARROW_ROWS) if int(rows) > 0 else ARROW_ROWS))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(ARROW_KEY, rows)
    table = spark.read.schema(df.schema).parquet(path)
    table.cut_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``cut`` wrote and that nothing lazy reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.cut_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: A side is broadcast up to so many rows and so many bytes, by the default sizes of its column types.
BROADCAST_ROWS, BROADCAST_BYTES = 250_000, 8 << 20


def fits(table: DataFrame) -> bool:
    """Whether ``table``, which must be cheap to count, may be broadcast."""
    rows = min(BROADCAST_ROWS, BROADCAST_BYTES // table._jdf.schema().defaultSize())
    return table.limit(rows + 1).count() <= rows


def small(table: DataFrame) -> DataFrame:
    """``table`` with a broadcast hint if it is within both bounds; beyond them the join shuffles."""
    return F.broadcast(table) if fits(table) else table


def join_aggregate(rows: DataFrame, totals: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined to ``totals``, which holds one row per key of ``on``, so that AQE can split a hot key of ``rows``.

    An aggregate arrives partitioned on its key and would be joined in the stage that made it, which AQE never splits. A second key, derived from
    the first, asks for a shuffle of its own of the few aggregated rows.
    """
    salted = [t.withColumn("__again", F.hash(*on)) for t in (rows, totals)]
    return salted[0].join(salted[1], [*on, "__again"], how).drop("__again")


def shingle_hashes(words: str, size: int) -> Column:
    """Hashes of the word shingles of a stored array column, null for fewer than ``size`` words."""
    at = F.sequence(F.lit(0), F.size(words) - size)
    return F.when(F.size(words) >= size, F.transform(at, lambda i: F.xxhash64(*[F.get(F.col(words), i + k) for k in range(size)])))


def shingle_texts(words: str, size: int) -> Column:
    """The distinct word shingles themselves, joined by one space."""
    at = F.sequence(F.lit(0), F.size(words) - size)
    return F.when(F.size(words) >= size, F.array_distinct(F.transform(at, lambda i: F.concat_ws(" ", *[F.get(F.col(words), i + k) for k in range(size)]))))
