"""Mixing sources to target weights by systematic sampling (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, ranked

#: Tables of a row per source are broadcast up to so many sources, and joined by shuffle beyond.
MANY_SOURCES = 50_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, most: int = 3) -> DataFrame:
    """From (source, source_size, source_rows) make each source's target words and the copies expected per document.

    Sources weigh `weights`, repeating, by code point with null last, and share `share` of all words. A target stops
    at `most` times the source's size; the excess goes to the others by weight until none is above. Sources are then
    capped in order of most * size / weight, so one running sum finds the level at which the rest is shared. The
    table has a row per source, which is what its windows hold.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kinds = F.array(*[F.lit(w).cast("long") for w in weights])
    x = sizes.withColumn("weight", F.element_at(kinds, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    x = x.withColumn("first_rank", F.coalesce(F.sum("source_rows").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    x = x.withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("weight"))
    x = x.withColumn("all_words", F.sum("source_size").over(every) * F.lit(float(share))).withColumn("all_weight", F.sum("weight").over(every))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("all_words") - F.coalesce(F.sum("cap").over(by_ratio), F.lit(0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0)))
    x = x.withColumn("level", level)
    x = x.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)["level"])
    capped = F.col("level").isNull() | (F.col("ratio") < F.col("level"))
    x = x.withColumn("target", F.when(capped, F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("level")))
    rate = F.when(capped, F.lit(float(most))).when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return x.select("source", "source_size", "target", "first_rank", rate.alias("rate"))


def _offset(source: Column, seed: int) -> Column:
    """The random offset of a source, in units of 2**-20; the seed alone decides."""
    key = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.concat(F.lit("s"), source), F.lit("n")))
    return F.conv(F.substring(F.md5(key), 1, 5), 16, 10).cast("long") / F.lit(1 << 20)


def mix(docs: DataFrame, size: str = "size", source: str = "source", key: str = "doc_id", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, most: int = 3, seed: int = 7) -> DataFrame:
    """How often a mix of all documents to target weights takes each: rows (row: all columns of docs, size, source_size, target, copies).

    Within a source, the documents whose key's md5 is in the lower half stand in order of rising size class (eighths of
    a power of two), the others after them in order of falling size class; within a class the md5 decides. A document's
    expected copies are target / source_size; prefix sums of them along that order (rate times rank) plus one random
    offset per source cross an integer once per copy, so each document's chance is its rate. Every stretch of sizes takes
    its share, and both ends of the order, where a systematic sample may be one document off, hold small documents; so
    the words taken come near the target. The ranks are global (`ranked`), so a source with a third of all rows is
    spread over many partitions. All is derived from md5 with a seed: reruns agree.

    Nulls: a null source is a source of its own, ordered last; a null size counts 0; a null key hashes as ''. Documents
    without words take part and add nothing. Repeated rows are ranked one after the other. An empty table gives an
    empty result. Columns of docs stay inside `row` and so clash with nothing.
    """
    n = F.coalesce(F.col(size).cast("long"), F.lit(0).cast("long"))
    x = docs.select(F.struct("*").alias("row"), F.col(source).alias("source"), n.alias("size"), F.coalesce(F.md5(F.col(key).cast("string")), F.lit("")).alias("_h"))
    bits = F.length(F.bin("size"))
    eighth = F.when(F.col("size") < 8, F.col("size")).otherwise(bits * 8 + F.expr("shiftright(size, cast(length(bin(size)) as int) - 4)") - 8)
    falls = F.col("_h") >= "8"
    x = x.withColumn("_class", F.when(falls, 1000 - eighth).otherwise(eighth).cast("long"))
    spread = ranked(x, [F.col("source").asc_nulls_last(), falls, F.col("_class"), F.col("_h"), F.col("size")], "_rank")
    sizes = spread.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    targets = source_targets(sizes, weights, share, most)
    targets = cut(targets)
    small = F.broadcast if targets.count() <= MANY_SOURCES else lambda t: t
    known = spread.join(small(targets.withColumnRenamed("source", "_source")), F.col("source").eqNullSafe(F.col("_source")))
    place = F.col("_rank") - F.col("first_rank")

    at = F.col("rate") * place + _offset(F.col("source"), seed)
    upto = F.col("rate") * (place + 1) + _offset(F.col("source"), seed)
    return known.select("row", "size", "source_size", "target", (F.floor(upto) - F.floor(at)).cast("long").alias("copies"))


def emit(mixed: DataFrame) -> DataFrame:
    """The mixed corpus itself: each document's row as often as the mix takes it."""
    return mixed.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).select("row.*")
