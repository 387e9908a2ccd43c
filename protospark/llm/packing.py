"""Best-fit packing of documents into fixed-size bins, under source and duplicate conflicts."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions

#: Tokens of a bin, documents of one source it takes at most, and documents that are packed together.
CAPACITY, PER_SOURCE, GROUP = 2048, 3, 4096


class Packer:
    """Conflict-constrained best fit, largest piece first.

    Open bins stand in a list ordered by residual. A piece begins at the first bin with room enough and goes on to the
    successor while bins conflict, so it gets the tightest compatible bin; if there is none, it opens one. Each bin
    carries a bitmap of its duplicate clusters, and one bitmap of its sources for each of the `per_source` places: a
    source moves up a bitmap each time it is added, and conflicts once it stands in the last. Bits are numbered as
    clusters and sources come up, so bitmaps are exact.
    """

    def __init__(self, capacity: int = CAPACITY, per_source: int = PER_SOURCE) -> None:
        self.capacity, self.per_source = capacity, per_source
        self.open: list[tuple[int, int]] = []
        self.clusters: list[int] = []
        self.sources: list[list[int]] = []
        self.bits: tuple[dict, dict] = ({}, {})

    def place(self, size: int, source: str | None, cluster: int) -> tuple[int, int]:
        """Bin of the piece, and where in the bin it begins."""
        s, c = (1 << own.setdefault(x, len(own)) for own, x in zip(self.bits, (source, cluster)))
        k = bisect_left(self.open, (size, -1))
        while k < len(self.open) and (self.clusters[self.open[k][1]] & c or self.sources[self.open[k][1]][-1] & s):
            k += 1
        if k < len(self.open):
            room, at = self.open.pop(k)
        else:
            room, at = self.capacity, len(self.clusters)
            self.clusters.append(0)
            self.sources.append([0] * self.per_source)
        self.clusters[at] |= c
        for level in range(self.per_source):
            if not self.sources[at][level] & s:
                self.sources[at][level] |= s
                break
        if room > size:
            insort(self.open, (room - size, at))
        return at, self.capacity - room


def pack(docs: DataFrame, size: Column, source: Column, cluster: Column, key: str = "doc_id", capacity: int = CAPACITY, per_source: int = PER_SOURCE, group: int = GROUP) -> DataFrame:
    """Pack all documents into bins of `capacity` tokens: rows (key, piece, first, length, pack, bin, at).

    A document of more than `capacity` tokens is cut into pieces: those that fill a bin have one to themselves, the
    rest is packed like a document. No bin holds two documents of one duplicate cluster or more than `per_source` of
    one source. Documents are dealt evenly into packs of about `group` rows by a hash of all their columns and, for equal
    rows, of a number, so a hot source or a large group of copies is spread over all packs, each task holds one bounded
    pack, and reruns agree however the rows are partitioned. Best fit holds within a pack. A bin is (pack, bin); bins
    below 0 are those that one piece fills. `first` and `length` say which tokens of the document
    the piece holds, `at` where in the bin it begins.

    A null size or one below 0 counts 0; documents of size 0 have no piece. A null source is a source, a null cluster a
    cluster. Repeated rows are of one cluster if `cluster` says so. An empty table gives an empty result.
    """
    n = docs.count()
    packs = max(1, -(-n // group))
    x = docs.select(F.col(key).alias("key"), F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0)).alias("size"), source.cast("string").alias("source"), cluster.cast("long").alias("cluster"))
    # equal rows (copies that a mix takes) are numbered, so that they spread over packs as well, and reruns agree
    x = x.groupBy("key", "size", "source", "cluster").agg(F.count(F.lit(1)).alias("n")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("n")
    x = x.withColumn("pack", F.pmod(F.xxhash64("key", "size", "source", "cluster", "copy"), F.lit(packs)).cast("int"))
    kind = x.schema["key"].dataType.simpleString()

    def run(rows: pa.Table) -> pa.Table:
        packer = Packer(capacity, per_source)
        pack_no = rows.column("pack")[0].as_py()
        every = zip(*(rows.column(c).to_pylist() for c in ("key", "size", "source", "cluster")))
        every = sorted(every, key=lambda r: [(v is not None, v) for v in r])
        out: list[tuple] = []
        whole = 0
        rest = []
        for k, n, s, c in every:
            full = n // capacity
            out += [(k, p, p * capacity, capacity, pack_no, -1 - whole - p, 0) for p in range(full)]
            whole += full
            if n % capacity:
                rest.append((n % capacity, k, full, s, c))
        for length, k, p, s, c in sorted(rest, key=lambda r: -r[0]):  # equal lengths stay in order of key
            at, begin = packer.place(length, s, c)
            out.append((k, p, p * capacity, length, pack_no, at, begin))
        names = ["key", "piece", "first", "length", "pack", "bin", "at"]
        types = [rows.schema.field("key").type, pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        columns = list(zip(*out)) if out else [[]] * len(names)
        return pa.table([pa.array(list(v), t) for v, t in zip(columns, types)], names=names)

    dealt = x.repartition(partitions(docs.sparkSession), "pack")
    return dealt.groupBy("pack").applyInArrow(run, f"key {kind}, piece int, first long, length long, pack int, bin long, at long")
