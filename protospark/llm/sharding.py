"""Sharding along a Hilbert curve over document metadata (DataFrame operations only)."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, ranked

#: Bits of each quantised dimension, and the number of dimensions: 4,096 cells in all.
BITS, DIMS = 4, 3
#: Tables of a row per distinct value, or per group in several cells, are broadcast up to so many rows (16 bytes and a value each).
MANY_VALUES = 50_000


@lru_cache(None)
def curve(bits: int = BITS, dims: int = DIMS) -> list[int]:
    """Place on the Hilbert curve of every cell of the grid; a cell's number has its first coordinate on top.

    Walking down from the top bit, the lower bits of the first axis are mirrored where an axis has the bit set and
    exchanged with that axis where not, which turns each sub-cube into the standard pose; the Gray code of the turned
    coordinates, read bit by bit across the axes, is the place.
    """
    places = []
    for cell in range(1 << bits * dims):
        x = [cell >> bits * (dims - 1 - i) & (1 << bits) - 1 for i in range(dims)]
        for b in range(bits - 1, 0, -1):
            low = (1 << b) - 1
            for i in range(dims):
                if x[i] >> b & 1:
                    x[0] ^= low
                else:
                    swap = (x[0] ^ x[i]) & low
                    x[0], x[i] = x[0] ^ swap, x[i] ^ swap
        for i in range(1, dims):
            x[i] ^= x[i - 1]
        flip = 0
        for b in range(bits - 1, 0, -1):
            if x[-1] >> b & 1:
                flip ^= (1 << b) - 1
        place = 0
        for b in range(bits - 1, -1, -1):
            for v in x:
                place = place << 1 | (v ^ flip) >> b & 1
        places.append(place)
    return places


def codes(docs: DataFrame, columns: list[Column], bits: int = BITS) -> DataFrame:
    """Add code0, code1, ...: each column quantised to `bits` bits by its place among all rows, in order of value, nulls first.

    A value's code is where the middle of its rows lies in 2**bits equal parts of all rows, so frequent values have codes
    of their own, rare neighbours share one, and a range of codes is a range of values. Counts combine before the
    shuffle; the window runs over a row per distinct value, and its table is broadcast only if it has no more than
    MANY_VALUES rows.
    """
    x = docs.withColumns({f"value{k}": c for k, c in enumerate(columns)})
    for k in range(len(columns)):
        v = f"value{k}"
        counts = x.groupBy(F.col(v).alias("_value")).agg(F.count(F.lit(1)).alias("_rows"))
        order = Window.orderBy(F.col("_value").asc_nulls_first())
        upto, total = F.sum("_rows").over(order), F.sum("_rows").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        placed = counts.select("_value", "_rows", upto.alias("_upto"), total.alias("_total"))
        table = cut(placed.select("_value", F.expr(f"cast(({1 << bits} * (2 * _upto - _rows)) div (2 * _total) as int)").alias(f"code{k}")))
        small = F.broadcast(table) if table.count() <= MANY_VALUES else table
        x = x.join(small, F.col(v).eqNullSafe(F.col("_value")), "left").drop("_value", v)
    return x


def shard(docs: DataFrame, dims: list[Column], shards: int, key: str = "doc_id", group: str | None = None, bits: int = BITS) -> DataFrame:
    """Deal rows into shards of equal counts along a Hilbert curve: rows (row: all columns of docs, curve, shard, slot).

    `dims` are coordinates already quantised to `bits` bits (null counts 0, others are clamped); their cells are looked
    up in a constant table. Rows that agree in `group` (not null) take the least place of them all on the curve. Rows are
    put in order of (curve, group, hash of key, key, hash of all columns), ranked globally without a window (`ranked`),
    and the ranks are cut into runs: shard = rank * shards div rows, so counts differ by one at most, slot counts on from 0
    in every shard, each shard covers few cells, whose minima and maxima prune files in every dimension, and a group is
    split only where a cut falls into it. One cell, or one group, may hold any part of the rows: the key's hash spreads it
    over the sort's partitions. Repeated rows get slots of their own. A null key sorts first. An empty table gives an
    empty result.
    """
    top = (1 << bits) - 1
    cell = F.lit(0)
    for d in dims:
        cell = cell * (top + 1) + F.greatest(F.lit(0), F.least(F.lit(top), F.coalesce(d.cast("int"), F.lit(0))))
    together = F.lit(None).cast("long") if group is None else F.when(F.col(group).isNotNull(), F.xxhash64(group))
    x = docs.select(F.struct("*").alias("row"), F.get(F.lit(curve(bits, len(dims))), cell).alias("curve"), together.alias("_g"), F.xxhash64(F.col(key)).alias("_h"), F.col(key).alias("_key"))
    if group is not None:
        x = cut(x)
        # only groups that lie in several cells move; a table of them that is too large for a broadcast is joined by shuffle
        moved = x.where("_g is not null").groupBy("_g").agg(F.min("curve").alias("_low"), F.max("curve").alias("_high")).where("_low < _high").drop("_high")
        moved = cut(moved)
        small = F.broadcast(moved) if moved.count() <= MANY_VALUES else moved
        x = x.join(small, "_g", "left").withColumn("curve", F.coalesce("_low", "curve")).drop("_low")
    x = ranked(x, [F.col("curve"), F.col("_g"), F.col("_h"), F.col("_key"), F.xxhash64("row")], "_rank")
    n = F.broadcast(x.agg(F.count(F.lit(1)).alias("_n")))
    x = x.join(n, F.lit(True)) if shards else x
    at = F.expr(f"(_rank * {shards}) div _n")
    return x.withColumn("shard", at.cast("int")).select("row", "curve", "shard", (F.col("_rank") - F.expr(f"(shard * _n + {shards - 1}) div {shards}")).alias("slot"))


def write_shards(sharded: DataFrame, path: str, rows: int = 1 << 20) -> None:
    """Write a folder per shard and run: `rows` slots of a shard in a row make a run, one file in slot order.

    A run is one task's output, so a file's minima and maxima are those of a stretch of the curve, and a shard of any
    size is written by as many tasks as it has runs.
    """
    out = sharded.select("row.*", F.col("shard").alias("_shard"), F.expr(f"cast(slot div {rows} as int)").alias("_run"), F.col("slot").alias("_slot"))
    out.repartition("_shard", "_run").sortWithinPartitions("_shard", "_run", "_slot").write.partitionBy("_shard", "_run").parquet(path)


def manifest(sharded: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, and minimum and maximum of the given columns of `row`, for each shard: what a reader prunes files by."""
    bounds = [f(F.col(f"row.{c}")).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))]
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), *bounds)
