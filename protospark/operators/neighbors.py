"""Nearest guides under Hamming or Levenshtein distance: exact, in tiles."""

from __future__ import annotations

from functools import cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from ..functions.dna import LOW_BITS, packed

#: Sequences in a tile of Levenshtein distances, and queries compared at a time.
TILE, BLOCK = 4096, 128
#: Queries and sequences that meet in a search by Hamming distance, and sequences that are too few for an index.
ASKING, POOL, SMALL = 1 << 17, 1 << 21, 1 << 13
#: Queries that are worth a group of their own.
FEW = 1 << 12
#: Bases of an index's segment, the distance up to which it is searched, and candidates that are compared at a time.
WIDE, FAR, CANDIDATES = 10, 8, 1 << 20


def _codes(seqs: list[str]) -> np.ndarray:
    return np.frombuffer("".join(seqs).encode(), np.uint8).reshape(len(seqs), -1)


def letters(codes: np.ndarray, length: int) -> pa.Array:
    """Sequences of packed codes."""
    shifts = np.arange(2 * length - 2, -1, -2, dtype=np.uint64)
    text = np.frombuffer(b"ACGT", np.uint8)[(codes[:, None] >> shifts & np.uint64(3)).astype(np.uint8)]
    return pa.array(np.ascontiguousarray(text).view(f"S{length}").ravel().astype(str) if len(codes) else [], pa.string())


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bases that differ between packed codes."""
    d = x ^ y
    return np.bitwise_count((d | d >> np.uint64(1)) & np.uint64(LOW_BITS))


@cache
def mismatches(length: int, t: int) -> np.ndarray:
    """What differs between a packed word and all words that differ from it in exactly t bases."""
    out = [sum(v << 2 * at for v, at in zip(values, places)) for places in combinations(range(length), t) for values in product((1, 2, 3), repeat=t)]
    return np.array(out, np.int64)


class Pool:
    """Packed codes in ascending order, with an index by each of two segments of up to WIDE bases.

    Two sequences that differ in s + t + 1 bases at most differ in s at most in the one segment or in t at most in the
    other. So step m of a search takes the words of segment m % 2 that are m // 2 bases off, and after it all sequences
    that lie within m are known; queries that have enough there are done. Those that need more than FAR compare with all.
    A pool of less than SMALL codes is compared as a whole at once.
    """

    def __init__(self, codes: np.ndarray, length: int) -> None:
        self.codes, self.length, self.parts = np.sort(codes), length, []
        width = min(length // 2, WIDE)
        if len(codes) < SMALL or width < 3:
            return
        for shift in (0, 2 * (length - width)):
            key = (self.codes >> np.uint64(shift) & np.uint64(4**width - 1)).astype(np.int32)
            order = np.argsort(key, kind="stable").astype(np.int32)
            starts = np.append(0, np.cumsum(np.bincount(key, minlength=4**width))).astype(np.int32)
            self.parts.append((np.uint64(shift), width, order, self.codes[order], starts))

    def _step(self, q: np.ndarray, m: int, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, place in the pool, distance) of codes that step m leads to, within each query's reach."""
        shift, width, order, codes, starts = self.parts[m % 2]
        off, found = mismatches(width, m // 2), []
        if not len(off):  # more than the segment has
            return (np.zeros(0, np.int64),) * 3
        for some in range(0, len(q), max(1, (1 << 20) // len(off))):
            asks = q[some : some + max(1, (1 << 20) // len(off))]
            key = (asks >> shift & np.uint64(4**width - 1)).astype(np.int64)[:, None] ^ off
            first = starts[key]
            n = starts[key + 1] - first
            upto = np.append(0, np.cumsum(n.sum(axis=1, dtype=np.int64)))
            a = 0
            while a < len(asks):  # about CANDIDATES at a time
                b = max(a + 1, int(np.searchsorted(upto, upto[a] + CANDIDATES, side="right")) - 1)
                hits = n[a:b].ravel()
                full = np.flatnonzero(hits)
                begin, hits = first[a:b].ravel()[full].astype(np.int64), hits[full]
                at = np.repeat(begin - np.cumsum(hits) + hits, hits) + np.arange(upto[b] - upto[a])
                who = np.repeat(np.arange(some + a, some + b), np.diff(upto[a : b + 1]))
                d = distances(codes[at], q[who])
                near = np.flatnonzero(d <= reach[who])
                found.append((who[near], order[at[near]], d[near]))
                a = b
        return tuple(np.concatenate(x) for x in zip(*found))

    def nearest(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k nearest of each query, by distance, then code: (query, place in the pool, distance), in that order."""
        k, out, left = min(k, len(self.codes)), [], np.arange(len(q))
        if not k or not len(q):
            return (np.zeros(0, np.int64),) * 3
        held, reach = (np.zeros(0, np.int64),) * 3, np.full(len(q), FAR)
        for m in range(FAR + 1 if self.parts else 0):
            more = self._step(q[left], m, reach[left])
            who, place, d = (np.concatenate(x) for x in zip(held, (left[more[0]], more[1], more[2])))
            order = np.lexsort((place, d, who))
            who, place, d = who[order], place[order], d[order]
            fresh = np.append(True, (who[1:] != who[:-1]) | (place[1:] != place[:-1])) if len(who) else np.zeros(0, bool)
            who, place, d = who[fresh], place[fresh], d[fresh]
            count = np.bincount(who, minlength=len(q))
            rank = np.arange(len(who)) - (np.cumsum(count) - count)[who]
            who, place, d, rank = (x[rank < k] for x in (who, place, d, rank))
            reach[who[rank == k - 1]] = d[rank == k - 1]  # no more than the k nearest so far is wanted
            sure = (count >= k) & (reach <= m)
            out.append(tuple(x[sure[who]] for x in (who, place, d)))
            held = tuple(x[~sure[who]] for x in (who, place, d))
            left = left[~sure[left]]
            if not len(left):
                break
        size = max(1, (1 << 22) // len(self.codes))
        for at in range(0, len(left), size):
            d = distances(q[left[at : at + size], None], self.codes).astype(np.int64)
            key = d * len(self.codes) + np.arange(len(self.codes))
            best = np.sort(np.partition(key, k - 1, axis=1)[:, :k], axis=1).ravel()
            out.append((np.repeat(left[at : at + size], k), best % len(self.codes), best // len(self.codes)))
        return tuple(np.concatenate(x) for x in zip(*out))

    def within(self, q: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All codes at most `reach` off each query: (query, place in the pool, distance)."""
        if not self.parts or reach > FAR or not len(q):
            d = distances(q[:, None], self.codes)
            who, place = np.nonzero(d <= reach)
            return who, place, d[who, place]
        found = tuple(np.concatenate(x) for x in zip(*(self._step(q, m, np.full(len(q), reach)) for m in range(reach + 1))))
        both = np.unique(np.stack([found[0] * len(self.codes) + found[1], found[2].astype(np.int64)]), axis=1)
        return both[0] // len(self.codes), both[0] % len(self.codes), both[1]


def levenshtein_block(queries: list[str], others: list[str]) -> np.ndarray:
    """Distances of sequences of up to 63 letters by bit-parallel columns, all others of a query at once."""
    out = np.zeros((len(queries), len(others)), np.uint8)
    text = _codes(others)
    one = np.uint64(1)
    for i, q in enumerate(queries):
        m = len(q)
        top = np.uint64(1 << (m - 1))
        where = np.zeros(256, np.uint64)
        for k, c in enumerate(q.encode()):
            where[c] |= np.uint64(1 << k)
        up = np.full(len(others), np.uint64((1 << m) - 1))
        down = np.zeros(len(others), np.uint64)
        score = np.full(len(others), m, np.int64)
        for column in text.T:
            eq = where[column]
            diagonal = ((eq & up) + up ^ up) | eq | down
            rise, fall = down | ~(diagonal | up), up & diagonal
            score += (rise & top != 0).astype(np.int64) - (fall & top != 0)
            rise, fall = rise << one | one, fall << one
            up, down = fall | ~(diagonal | rise), rise & diagonal
        out[i] = score
    return out


def _meet(queries: DataFrame, pool: DataFrame, columns: list[str], asking: int, tile: int) -> GroupedData:
    """Each tile of about `asking` queries with each of about `tile` of the pool, as groups of rows (asks, i, j, columns).

    A row of the pool is dealt to every tile of queries, so these are as few as keep all cores busy.
    """
    n, cores = queries.count(), queries.sparkSession.sparkContext.defaultParallelism
    tiles = max(1, -(-pool.count() // tile))
    groups = max(1, -(-n // asking), min(-(-2 * cores // tiles), n // FEW))
    h = F.xxhash64(columns[0])
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = queries.select(*columns, F.lit(True).alias("asks"), F.pmod(h, F.lit(groups)).alias("i"), every(tiles).alias("j"))
    right = pool.select(*columns, F.lit(False).alias("asks"), every(groups).alias("i"), F.pmod(h, F.lit(tiles)).alias("j"))
    return left.unionByName(right).groupBy("i", "j")


def _codes_of(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    asks, code = np.asarray(group.column("asks")), group.column("code").to_numpy().view(np.uint64)
    return np.sort(code[asks]), code[~asks]


def knn(queries: DataFrame, pool: DataFrame, k: int, dtype: str = "hamming", tile: int | None = None) -> DataFrame:
    """The k nearest of the pool's distinct sequences for each distinct query, itself included: (target, rank, neighbor, dist).

    Both are columns `target` of equal length. Rank counts from 0 by distance, then sequence. Any dtype but "hamming"
    means Levenshtein. Queries and pool are dealt by hash into tiles; each pair of tiles is a group of bounded size that
    keeps the k best of each query, and the best of those are put together per query, k for each tile of the pool: no
    pair but these leaves a task. Hamming tiles hold packed sequences (up to 31 bases) and search an index (`Pool`), so
    a pair of tiles costs far less than its product; Levenshtein tiles compare all. A query with a smaller pool than k
    has fewer rows.
    """
    q, p = queries.select("target").distinct(), pool.select("target").distinct()
    if dtype == "hamming":
        length = (q.select(F.length("target").alias("n")).first() or [1])[0]
        q, p = (x.select(packed(F.col("target")).alias("code")) for x in (q, p))

        def nearest(group: pa.Table) -> pa.Table:
            ask, have = _codes_of(group)
            index = Pool(have, length)
            parts = [[], [], []]
            for at in range(0, len(ask), BLOCK):
                some = ask[at : at + BLOCK]
                who, place, d = index.nearest(some, k)
                for part, x in zip(parts, (some[who], index.codes[place], d.astype(np.int32))):
                    part.append(x)
            a, b, d = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in parts)
            return pa.table({"target": letters(a, length), "neighbor": letters(b, length), "dist": pa.array(d.astype(np.int32))})

        groups = _meet(q, p, ["code"], tile or ASKING, tile or POOL)
    else:

        def nearest(group: pa.Table) -> pa.Table:
            asks = np.asarray(group.column("asks"))
            every = np.asarray(group.column("target").to_pylist(), object)
            ask, have = every[asks].tolist(), np.sort(every[~asks]).tolist()
            out: list[list] = [[], [], []]
            for at in range(0, len(ask) if have else 0, BLOCK):
                d = levenshtein_block(ask[at : at + BLOCK], have).astype(np.int64)
                key = d * len(have) + np.arange(len(have))  # by distance, then sequence
                best = np.sort(np.partition(key, min(k, len(have)) - 1, axis=1)[:, :k], axis=1)
                for t, row in zip(ask[at : at + BLOCK], best.tolist()):
                    out[0] += [t] * len(row)
                    out[1] += [have[x % len(have)] for x in row]
                    out[2] += [x // len(have) for x in row]
            return pa.table({"target": pa.array(out[0], pa.string()), "neighbor": pa.array(out[1], pa.string()), "dist": pa.array(out[2], pa.int32())})

        groups = _meet(q, p, ["target"], tile or TILE, tile or TILE)
    found = groups.applyInArrow(nearest, "target string, neighbor string, dist int")
    best = F.slice(F.array_sort(F.collect_list(F.struct("dist", "neighbor"))), 1, k)
    ranked = found.groupBy("target").agg(best.alias("best")).select("target", F.posexplode("best").alias("rank", "b"))
    return ranked.select("target", "rank", "b.neighbor", "b.dist")


def neighbor_lists(nearest: DataFrame) -> DataFrame:
    """One row a query: (target, neighbors array of (rank, seq, dist))."""
    item = F.struct("rank", F.col("neighbor").alias("seq"), "dist")
    return nearest.groupBy("target").agg(F.sort_array(F.collect_list(item)).alias("neighbors"))


def keep_distant(lists: DataFrame, least: int) -> DataFrame:
    """Guides whose nearest other is `least` or more away; a guide without any other stays."""
    other = F.get(F.col("neighbors"), F.lit(1))["dist"]
    return lists.where(other.isNull() | (other >= least))


def close_pairs(targets: DataFrame, length: int, within: int, tile: int | None = None) -> DataFrame:
    """All pairs of distinct guides that differ in 1 to `within` bases: (target, other, dist), both directions.

    Tiles of packed guides meet as in `knn`, and an index gives each guide's close ones; a group's rows are the pairs
    themselves, no candidates.
    """
    every = targets.select("target").distinct().select(packed(F.col("target")).alias("code"))

    def close(group: pa.Table) -> pa.Table:
        ask, have = _codes_of(group)
        index, parts = Pool(have, length), [[], [], []]
        for at in range(0, len(ask), BLOCK):
            some = ask[at : at + BLOCK]
            who, place, d = index.within(some, within)
            other = d > 0
            for part, x in zip(parts, (some[who[other]], index.codes[place[other]], d[other].astype(np.int32))):
                part.append(x)
        a, b, d = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in parts)
        return pa.table({"target": letters(a, length), "other": letters(b, length), "dist": pa.array(d.astype(np.int32))})

    return _meet(every, every, ["code"], tile or ASKING, tile or POOL).applyInArrow(close, "target string, other string, dist int")


def min_distance_filter(targets: DataFrame, length: int, least: int) -> DataFrame:
    """Distinct guides with no other guide closer than `least`, without looking for the nearest."""
    every = targets.select("target").distinct()
    if least <= 1:
        return every
    return every.join(close_pairs(targets, length, least - 1).select("target").distinct(), "target", "left_anti")


def recall(found: DataFrame, exact: DataFrame, k: int = 2) -> DataFrame:
    """Part of the exact result's targets whose first k distances the other result has too."""
    first = lambda x, name: x.where(F.col("rank") < k).groupBy("target").agg(F.sort_array(F.collect_list("dist")).alias(name))
    both = first(exact, "a").join(first(found, "b"), "target", "left")
    return both.agg(F.avg(F.coalesce(F.col("a") == F.col("b"), F.lit(False)).cast("double")).alias("recall"))
