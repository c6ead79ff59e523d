"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else the context's checkpoint folder. A local
    folder is made only where all tasks run in this process (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isEmpty():
            if not spark.sparkContext._jsc.sc().isLocal():
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="cladeloom-"))
            found = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = found.get()
    return base.rstrip("/")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back."""
    path = f"{shared_dir(df.sparkSession)}/cladeloom/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a bucket that are aimed at, bytes of its row groups.
BUCKET_ROWS = 4_000_000
ROW_GROUP = 1 << 20


def bucket_count(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // BUCKET_ROWS))


def write_buckets(df: DataFrame, key: str, buckets: int, path: str) -> None:
    """df as Parquet files, one for each bucket of the key's hash, sorted by the
    key in small row groups: a join on the key moves only its other side, and a
    range of keys reads few row groups."""
    name = f"cladeloom_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, key).sortWithinPartitions(key)
    dealt.write.option("path", path).option("parquet.block.size", ROW_GROUP).option("parquet.page.row.count.limit", 5000).format("parquet").bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    df.sparkSession.sql(f"DROP TABLE {name}")  # the files stay: the table is external


def read_buckets(spark: SparkSession, key: str, buckets: int, path: str, schema: str) -> DataFrame:
    """The files of write_buckets as a bucketed table, known to this session's
    catalog by a name that follows from the path."""
    name = f"cladeloom_{hashlib.md5(path.encode()).hexdigest()}"
    where = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{where}'")
    return spark.table(name)


def number_rows(df: DataFrame, order: list, name: str, start: int = 0) -> DataFrame:
    """df with consecutive numbers in the given order, without one task that
    holds all rows: a range sort, then each partition's count as its offset.
    The offsets, one row for each partition, are broadcast."""
    sort = [c if not isinstance(c, str) else F.col(c) for c in order]
    dealt = settle(df.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id()), "numbered")
    counts = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("n"), F.min("__row").alias("low"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__part", (before + start - F.col("low")).alias("__shift"))
    return dealt.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__row") + F.col("__shift")).drop("__part", "__row", "__shift")


def running_sum(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """df with the sum of value up to and with each row in the given order: a
    range sort, a window in each of its partitions, and the sums of the
    partitions before, one row for each, which are broadcast."""
    dealt = settle(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()), "sorted")
    own = F.sum(value).over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    sums = dealt.groupBy("__part").agg(F.sum(value).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn(name, own).join(F.broadcast(sums.select("__part", before.alias("__before"))), "__part").withColumn(name, F.col(name) + F.col("__before")).drop("__part", "__before")


def running_last(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """df with the last value that is not null up to and with each row: as
    running_sum, the value that a partition ends with being carried on."""
    dealt = settle(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()), "sorted")
    own = F.last(value, True).over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    ends = dealt.groupBy("__part").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("__end"))
    before = F.last("__end", True).over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.select("__part", before.alias("__before"))
    return dealt.withColumn(name, own).join(F.broadcast(carried), "__part").withColumn(name, F.coalesce(name, "__before")).drop("__part", "__before")


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt over all cores where it comes from fewer files than there are
    cores: rows are about to be multiplied, and a file of one row group is one
    task. A table of many files is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores, key) if len(df.inputFiles()) < cores else df
