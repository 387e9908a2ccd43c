"""Near-duplicates by the exact Jaccard similarity of word-shingle sets, found through prefixes of the sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, components, cut, discard, partitions, sieve, sift, spread

#: Similarity 4/5 in whole numbers: sets of a and b shingles that share i reach it if 9 * i >= 4 * (a + b).
SHINGLE = 5
#: Shared shingles that a prefix must prove, or a tenth of a larger set; sets of up to 5/4 of that are indexed whole.
PROOF = 32
#: Shared shingles that make two sets a candidate pair, where shingles are in FEW sets; one that more sets have is enough.
COMMON = 8
FEW = 8
#: Sets of a tile, and shingles of all its sets (but for a larger set); two tiles are compared at a time.
TILE = 2048
WEIGHT = 1 << 20


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct XXH64 hashes of a whole text's shingles: ASCII lower case, words between ASCII white space.

    A text of fewer words has one shingle, all of it; a text without a word has none.
    """
    words = text.lower().split() if text else []
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))] if words else [], np.uint64)
    joined = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words), initial=-1))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(joined[a + 1 : b]) for a, b in zip(ends, ends[shingle:])), np.uint64, len(words) - shingle + 1))


def least(n):
    """Shingles that a set of n shares with any set of similarity 4/5 or more."""
    return (4 * n + 4) // 5


def proof(n):
    """Shingles that the indexed parts of a set of n and of any set of similarity 4/5 or more, n at most, prove in common."""
    return np.minimum(least(n), np.maximum(PROOF, n // 10))


def proved(n):
    """Shingles that the indexed parts of a set of n and of any similar set share: such a set has least(n) shingles or more."""
    return np.minimum(least(n), np.maximum(PROOF, least(n) // 10))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of batches sorted by the first one, whole runs of equal values at a time."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        part = [c.to_numpy() for c in b.columns]
        last = int(np.searchsorted(part[0], part[0][-1]))
        if last or (held and held[-1][0][-1] != part[0][0]):
            head = [*held, [c[:last] for c in part]]
            held = []
            yield [np.concatenate(c) for c in zip(*head)]
        held.append([c[last:] for c in part])
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def _starts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, int)


def index(texts: DataFrame) -> DataFrame:
    """Rows (h, node, n): the least shingles, by hash, of each text's set of n; enough of them to prove proof(n) in common.

    Two sets that share o >= least(n) of their shingles share at least the lesser of their proof(n) of those kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                sets = [shingles(t.as_py()) for t in part.column(1)]
                size = np.array([len(s) for s in sets], np.int64)
                kept = size - least(size) + proof(size)
                h = np.concatenate([s[:k] for s, k in zip(sets, kept)])
                node = part.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.repeat(node, kept)), pa.array(np.repeat(size, kept))], ["h", "node", "n"])

    return texts.mapInArrow(run, "h long, node long, n long")


def shared(rows: DataFrame) -> DataFrame:
    """Rows (h, node, n) of index that can lead to a pair: of each set the rarest shingles, COMMON of which any similar set has as well (all, if sets prove fewer).

    A shingle that only one set has leads nowhere, but takes up the rarest places; so a set of which more than a
    fifth is its own has no row left, and common passages aren't looked up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, node, n in _runs(batches):
            first = np.append(True, (h[1:] != h[:-1]) | (node[1:] != node[:-1]))  # copies count once
            h, node, n = h[first], node[first], n[first]
            df = np.diff(np.append(_starts(h), len(h)))
            df = np.repeat(df, df)
            yield pa.RecordBatch.from_arrays([pa.array(x[df > 1]) for x in (h, node, n, df.astype(np.int64))], ["h", "node", "n", "df"])

    dealt = rows.repartition(partitions(rows.sparkSession), "h").sortWithinPartitions("h", "node")
    often = dealt.mapInArrow(run, "h long, node long, n long, df long")
    sets = often.groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("x"))
    need = F.expr(f"cast(least((4 * n + 4) div 5, greatest({PROOF}, (4 * n + 4) div 5 div 10)) as int)")
    kept = sets.where(F.size("x") >= need).withColumn("m", F.size("x") - need + F.least(need, F.lit(COMMON)))
    return kept.select(F.explode(F.slice("x", F.lit(1), F.col("m"))).alias("x"), "node", "n").select("x.h", "node", "n")


def clusters(rows: DataFrame) -> DataFrame:
    """Rows (node, component) of the sets that candidate pairs connect: no similar pair lies across two of them.

    A pair is a candidate if the sizes allow the similarity and it shares COMMON rows (as many as its sets prove, if
    fewer), or one shingle that more than FEW sets have. One shared shingle alone would connect all long texts of a
    large table by chance. Pairs are made within FEW sets only; the sets of a longer run are tied to the least of
    those they can reach by sizes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, n, node in _runs(batches):
            df = np.diff(np.append(_starts(h), len(h)))
            few = np.repeat(df <= FEW, df)
            need, found = np.minimum(COMMON, proved(n)), []
            for off in range(1, min(FEW, len(h))):
                i = np.flatnonzero(few[off:] & (h[off:] == h[:-off]) & (4 * n[off:] <= 5 * n[:-off]))
                found.append((node[i], node[i + off], np.minimum(need[i], need[i + off])))
            h, n, node = h[~few], n[~few], node[~few]
            if len(h):
                starts = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (4 * n[1:] > 5 * n[:-1])))
                first = np.repeat(node[starts], np.diff(np.append(starts, len(h))))
                edges = np.unique(np.stack([node, first])[:, node != first], axis=1)
                found.append((edges[0], edges[1], np.zeros(edges.shape[1], np.int64)))
            for a, b, least_shared in found:
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b)), pa.array(least_shared)], ["a", "b", "need"])

    dealt = rows.select("h", "n", "node").repartition(partitions(rows.sparkSession), "h").sortWithinPartitions("h", "n", "node")
    pairs = dealt.mapInArrow(run, "a long, b long, need long")
    found = components(pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.min("need").alias("need")).where("shared >= need"), "a", "b")
    # the least node of a component has no row of its own
    return found.unionAll(found.select(F.col("component").alias("node"), "component").distinct())


def forest(nodes: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges that connect all sets linked by a similarity of 4/5 or more, one less than sets at most.

    Sets stand in order of size, and each is compared with those after it that are at most 5/4 as large.
    """
    sets, nodes = zip(*sorted(zip(sets, nodes.tolist()), key=lambda x: len(x[0]))) if len(sets) else ((), ())
    size = np.array([len(x) for x in sets], np.int64)
    upto = np.searchsorted(size, 5 * size // 4, "right")
    names, at = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.append(0, np.cumsum(size))
    mark, root, edges = np.zeros(len(names), bool), np.arange(len(sets)), []
    for i in range(len(sets) - 1):
        if upto[i] == i + 1:
            continue
        own, near = at[starts[i] : starts[i + 1]], slice(i + 1, upto[i])
        mark[own] = True
        both = np.add.reduceat(mark[at[starts[i + 1] : starts[upto[i]]]], starts[near] - starts[i + 1], dtype=np.int64)
        mark[own] = False
        for j in i + 1 + np.flatnonzero((9 * both >= 4 * (size[near] + size[i])) & (root[near] != root[i])):
            if root[j] != root[i]:
                edges.append((nodes[i], nodes[j]))
                root[root == root[j]] = root[i]
    return edges


def places(members: DataFrame, alone: bool) -> DataFrame:
    """Rows (node, component, own, k) of members (node, component, n): a cluster of sets is dealt out in k tiles of about
    TILE sets and WEIGHT shingles, and a set lies in tile `own`. In tiles that stay alone, the least set lies in all: own is -1.
    """
    whole = members.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight"), F.min("node").alias("first"))
    sized = members.join(whole.where("size > 1"), "component").withColumn("k", F.ceil(F.greatest(F.col("size") / TILE, F.col("weight") / WEIGHT)).cast("int"))
    own = F.pmod(F.xxhash64("node"), F.col("k")).cast("int")
    return sized.select("node", "component", F.when(F.lit(alone) & (F.col("node") == F.col("first")), F.lit(-1)).otherwise(own).alias("own"), "k")


def links(texts: DataFrame, alone: bool = False) -> DataFrame:
    """Edges (a, b) that connect the texts' sets just as all similar pairs within a cluster do; `alone`: within a tile.

    texts: rows (node, component, own, k, text). Each set is made once and dealt to the meetings of its tile with every
    other tile of its cluster (or to its only tile); each meeting compares its sets in whole and returns a spanning
    forest, never pairs.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for node, component, own, k, text in zip(*(c.to_pylist() for c in b.columns[:4]), b.column(4)):
                hashes = pa.array(shingles(text.as_py()).view(np.int64))
                other = list(range(k)) if own < 0 else [own] if alone or k == 1 else [o for o in range(k) if o != own]
                for at in range(0, len(other), 16):
                    part = other[at : at + 16]
                    ends = [(o, o) if alone else (min(own, o), max(own, o)) for o in part]
                    low = [[component] * len(part), *map(list, zip(*ends)), [node] * len(part)]
                    sets = pa.ListArray.from_arrays(pa.array([len(hashes) * i for i in range(len(part) + 1)], pa.int32()), pa.concat_arrays([hashes] * len(part)))
                    yield pa.RecordBatch.from_arrays([*map(pa.array, low), sets], ["component", "low", "high", "node", "hashes"])

    def meet(table: pa.Table) -> pa.Table:
        nodes, held = table["node"].to_numpy(), table["hashes"].combine_chunks()
        at, flat = held.offsets.to_numpy(), held.values.to_numpy()
        edges = np.array(forest(nodes, [flat[x:y] for x, y in zip(at, at[1:])]), np.int64).reshape(-1, 2)
        return pa.table({"a": edges[:, 0], "b": edges[:, 1]})

    met = texts.select("node", "component", "own", "k", "text").mapInArrow(deal, "component long, low long, high long, node long, hashes array<long>")
    return met.groupBy("component", "low", "high").applyInArrow(meet, "a long, b long")


def row_id(key: Column, text: Column) -> Column:
    """A hash that rows share only if their key, null or not, and their text agree."""
    return F.xxhash64(key.isNull(), key, text.isNull(), text)


def representatives(docs: DataFrame, near: Callable[[DataFrame], DataFrame], key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Groups of near-duplicates: rows (row) of one row_id of each, that of the least key, nulls last, and rows (row) of all
    that have to be looked at when the others go: row_ids that are not among the first, or stand there more than once.

    Texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more are linked, and groups are what
    links reach. `near` takes rows (node, text) and returns rows (node, component), groups that are likely; their texts
    are compared first. All similar pairs are found, whatever it returns: texts that their rarest shingles connect are
    compared as well, unless the first comparison made one group of them. Texts without a word are one group. Equal
    texts are one node, so copies cost nothing; texts are compared in tiles. Whole texts are dealt out only if
    shingles of theirs led to another text, as far as a sieve can tell.
    """
    k, t = F.col(key), F.col(text)
    # texts without a word are copies of one another
    node = F.when(t.rlike(WORD), F.xxhash64(t)).otherwise(F.lit(0).cast("long"))
    rows = cut(docs.select(row_id(k, t).alias("row"), node.alias("node"), k.alias("key")))
    best = cut(rows.groupBy("node").agg(F.min(F.struct(F.col("key").isNull().alias("void"), "key", "row")).alias("best")))
    texts = docs.select(node.alias("node"), t.alias("text"))
    lookup = cut(shared(index(spread(texts.select("node", F.encode("text", "UTF-8").alias("text"))))))
    sizes = cut(lookup.select("node", "n").distinct())

    def compared(members: DataFrame, alone: bool = False) -> DataFrame:
        named = cut(places(members.join(sizes, "node"), alone).join(best, "node").select("node", "component", "own", "k", F.col("best.row").alias("row")))
        some = sift(docs.select(row_id(k, t).alias("row"), F.encode(t, "UTF-8").alias("text")), "row", sieve(named.select("row"))).where("_may")
        # rows that repeat key and text come once
        out = cut(links(some.join(named.hint("merge"), "row").dropDuplicates(["row"]), alone))
        discard(named)
        return out

    likely = compared(near(texts), alone=True)
    settled, members = components(likely, "a", "b"), cut(clusters(lookup))
    named = members.join(settled.withColumnRenamed("component", "group"), "node", "left").withColumn("group", F.coalesce("group", "node"))
    split = named.groupBy("component").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low < high")
    rest = compared(members.join(split, "component", "left_semi"))
    group = components(likely.unionAll(rest), "a", "b")
    root = best.join(group, "node", "left").select(F.coalesce("component", "node").alias("root"), "best")
    kept = cut(root.groupBy("root").agg(F.min("best").alias("best")).select("best.row"))
    for done in (lookup, sizes, likely, settled, members, rest, group, best):
        discard(done)
    counted = rows.groupBy("row").agg(F.count(F.lit(1)).alias("n")).join(kept.withColumnRenamed("row", "_kept"), F.col("row") == F.col("_kept"), "left")
    return kept, counted.where("_kept is null or n > 1").select("row")


def one_of_each(docs: DataFrame, near: Callable[[DataFrame], DataFrame], key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, all columns, that stand for their group of near-duplicates (`representatives`).

    Rows that a sieve tells to stay do so where they are; only the others are dealt out and looked up.
    """
    kept, doubtful = representatives(docs, near, key, text)
    marked = sift(docs.withColumn("_row", row_id(F.col(key), F.col(text))), "_row", sieve(doubtful))
    checked = marked.where("_may").join(kept.withColumnRenamed("row", "_keep").hint("merge"), F.col("_row") == F.col("_keep"), "left_semi").dropDuplicates(["_row"])
    return marked.where("not _may").unionByName(checked).select(*[F.col(f"`{c}`") for c in docs.columns])
