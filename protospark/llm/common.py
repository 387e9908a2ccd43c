"""Shared helpers: the cluster's shared folder, lineage cuts, distributed ranks and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word, in every operator of this subpackage: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Buckets of a sieve.
SIEVE = 1 << 24


#: Temporary folders of local sessions that name none, by application; tables that `cut` has made, by application.
_folders: dict[str, str] = {}
_tables: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where a local session names none (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[[^,]*\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _folders:
            _folders[app] = "file://" + tempfile.mkdtemp(prefix="protospark-")
        folder = _folders[app]
    return folder.rstrip("/")


def new_path(spark: SparkSession) -> str:
    """A path for a table of this session in the shared folder; `release` deletes it."""
    path = f"{shared_dir(spark)}/protospark/{uuid.uuid4().hex}"
    _tables.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back, so that later work neither repeats it nor depends on executors that may be lost."""
    path = new_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(df: DataFrame) -> None:
    """Delete a table made by cut that nothing reads any more."""
    _delete(df.sparkSession, df.cut_path)
    _tables[df.sparkSession.sparkContext.applicationId].remove(df.cut_path)


def release(spark: SparkSession) -> None:
    """Delete all tables that this session's operators have left; results made from them must have been written."""
    for path in _tables.pop(spark.sparkContext.applicationId, []):
        _delete(spark, path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out evenly if they come in fewer partitions than there are cores (a small table, or one file of one row group).

    A plan with an exchange has dealt its rows already; asking for its partitions would run it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString() or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(df: DataFrame, order: list[Column], rank: str) -> DataFrame:
    """Add the 0-based rank of every row in a total order, without a window over all rows.

    Rows are range-partitioned and sorted, the place of each row in its partition is written with it, and the only
    thing put together is one row count per partition (as many rows as partitions: the bound of the broadcast).
    """
    spark = df.sparkSession
    placed = cut(df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn(rank, F.col("_before") + F.col("_place").bitwiseAND((1 << 33) - 1))
        .drop("_part", "_place", "_before")
    )


def sieve(ids: DataFrame) -> DataFrame:
    """A coarse set of the only column's values: rows (word, bits) of a bitmap of SIEVE buckets that values hash to.

    It has SIEVE / 64 rows at most, however many values there are, so it may be broadcast.
    """
    bucket = F.pmod(F.xxhash64(F.col(ids.columns[0])), F.lit(SIEVE))
    bit = F.expr("shiftleft(1L, cast(bucket % 64 as int))")
    return cut(ids.select(bucket.alias("bucket")).groupBy(F.expr("bucket div 64").alias("word")).agg(F.bit_or(bit).alias("bits")))


def sift(df: DataFrame, column: str, through: DataFrame, name: str = "_may") -> DataFrame:
    """Add whether a row's value may be in the sieve: false is sure, true has to be checked. The rows aren't moved."""
    bucket = F.pmod(F.xxhash64(column), F.lit(SIEVE))
    x = df.withColumn("_bucket", bucket).join(F.broadcast(through), F.expr("_bucket div 64 = word"), "left")
    return x.withColumn(name, F.expr("coalesce(shiftright(bits, cast(_bucket % 64 as int)) & 1, 0) = 1")).drop("_bucket", "word", "bits")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of an undirected graph: rows (node, component), component the smallest node reachable.

    Alternating large-star and small-star rounds over (larger, smaller) edges; every round is written to the shared
    folder, and a round that changes nothing ends the loop. The result has no row for nodes without an edge. A hub
    is never gathered: both stars aggregate a minimum with partial sums and join it back by node.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    now = cut(now)
    if now.isEmpty():
        out = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        out.cut_path = now.cut_path
        return out
    before = None
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        last, now = now, cut(small.select("e.*").where("u > v").distinct())
        discard(last)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").bitwiseAND((1 << 31) - 1)), F.bit_xor(F.xxhash64("v", "u"))).first()
        if state == before:
            out = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            out.cut_path = now.cut_path
            return out
        before = state
