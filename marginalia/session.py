"""Session and table helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def local_session(app: str = "marginalia", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A session for one machine; a cluster brings its own settings."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; Spark reads the path, whatever store it is in."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it.

    Where ``spark.checkpoint.dir`` is unset the session must be local, and a
    temporary folder stands in for it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="marginalia-checkpoint-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends here."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The same as a compressed table, for wide rows and texts; a row's place is not kept."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list, name: str = "place", value: Column | None = None, within: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``name``: its row number in ``order``, from 1, or the sum of ``value`` over the rows before.

    With ``within`` the rows of each such group are numbered for themselves. The rows are
    dealt by ranges of group and order and numbered inside each range, so a group may be of
    any size; only totals of the ranges are added up: of those that a group began before.
    """
    one = F.lit(1).cast("long") if value is None else value
    ranged = cut(df.repartitionByRange(*within, *order).withColumn("_part", F.spark_partition_id()).withColumn("_one", one))
    before = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(*within, "_part").agg(F.sum("_one").alias("_sum"))
    bases = sums.select(*within, "_part", F.sum("_sum").over(before).alias("_base")).where("_base IS NOT NULL")
    inside = Window.partitionBy("_part", *within).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # one row for each task of the sort at the most: a range goes on with one group, others begin in it
    key = F.col("_part") == F.col("_p")
    same = [F.col(c).eqNullSafe(F.col(f"_w{k}")) for k, c in enumerate(within)]
    for s in same:
        key = key & s
    renamed = bases.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_w{k}") for k, c in enumerate(within)], "_base")
    rows = ranged.withColumn("_upto", F.sum("_one").over(inside)).join(F.broadcast(renamed), key, "left")
    upto = F.coalesce("_base", F.lit(0)) + F.col("_upto")
    rows = rows.withColumn(name, upto if value is None else upto - F.col("_one"))
    return rows.drop("_part", "_one", "_base", "_upto", "_p", *[f"_w{k}" for k in range(len(within))])


def chosen(key: Column, limit: int, n: int) -> Column:
    """Whether a row is among ``limit`` of ``n`` in expectation, by all 64 bits of the hash ``key``."""
    return key < F.lit(min(limit * 2**64 // max(n, 1), 2**64 - 1) - 2**63)


def bounded_batches(spark: SparkSession, rows: int = 256) -> None:
    """Bound the rows Arrow sends to Python at once, as texts may be very long.

    A value that the session's owner has set stays.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))
