"""SimHash near-duplicates: fingerprints of word shingles, linked through deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jaccard
from .common import components, cut, partitions, spread

#: Shingles hashed at a time, so that memory doesn't follow the length of a text.
CHUNK = 1 << 15
#: A run of one key with more fingerprints than this looks neighbours up by mask instead of comparing with all.
MANY = 1 << 17


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a whole UTF-8 text: ASCII lower case, words between ASCII white space, XXH64 of each shingle."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = list(accumulate((len(w) + 1 for w in words), initial=-1))
    digest, n, votes = xxhash.xxh64_intdigest, len(words) - shingle + 1, np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        upto = min(n, at + CHUNK)
        h = np.array([digest(joined[a + 1 : b], seed) for a, b in zip(ends[at:upto], ends[at + shingle : upto + shingle])], np.uint64)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """Rows (key, fp), fp the fingerprint's 64 bits as a long; a text that is null or has no word gets 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t, shingle, seed) for t in (x.as_py() for x in b.column(1))), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["key", "fp"])

    x = spread(docs.select(F.col(key).alias("key"), F.encode(F.col(text), "UTF-8").alias("text")))
    return x.mapInArrow(run, f"key {x.schema['key'].dataType.simpleString()}, fp long")


def variants(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Index keys (segment, wildcard place, the segment's other bits) of each fingerprint, and the fingerprint of each key.

    With distance // 2 + 1 segments, two fingerprints that differ in `distance` bits at most have a segment that
    differs in one bit at most, so they share the key whose wildcard stands at that bit.
    """
    segments = distance // 2 + 1
    width = 64 // segments
    keys = []
    for s in range(segments):
        bits = width if s < segments - 1 else 64 - width * (segments - 1)
        part = fps >> np.uint64(width * s) & np.uint64((1 << bits) - 1)
        for p in range(bits):
            rest = (part >> np.uint64(p + 1)) << np.uint64(p) | part & np.uint64((1 << p) - 1)
            # wraps for a single segment: other keys may then fall together, and are told apart by their distance
            keys.append(rest * np.uint64(64 * segments) + np.uint64(s * 64 + p))
    return np.concatenate(keys), np.tile(fps, len(keys))


def _forest(fps: np.ndarray, place: int, distance: int, everything: bool) -> Iterator[tuple[int, int]]:
    """Edges that connect all fingerprints of one run that are linked; none twice, one less than nodes at most.

    Only pairs that differ at the wildcard's bit count, unless `everything`: other pairs share the segment and meet at
    its first place. A breadth-first walk compares each node with those not yet reached; a run of over MANY looks the
    neighbours of a node up by mask, so its cost follows the run's length and not the square of it.
    """
    bit = np.uint64(1 << place)
    if len(fps) > MANY:
        free = [i for i in range(64)]
        masks = np.array([sum(1 << i for i in c) for k in range(1, distance + 1) for c in combinations(free, k)], np.uint64)
        masks = masks if everything else masks[masks & bit != 0]
        fps = np.sort(fps)
        fresh = np.ones(len(fps), bool)
        for start in range(len(fps)):
            if not fresh[start]:
                continue
            fresh[start], queue = False, [start]
            while queue:
                i = queue.pop()
                near = fps[i] ^ masks
                at = np.minimum(np.searchsorted(fps, near), len(fps) - 1)
                for j in np.unique(at[(fps[at] == near) & fresh[at]]):
                    fresh[j] = False
                    queue.append(int(j))
                    yield int(fps[i]), int(fps[j])
        return
    left = fps
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            diff = left ^ x
            hit = np.bitwise_count(diff) <= distance
            if not everything:
                hit &= diff & bit != 0
            if hit.any():
                for y in left[hit]:
                    yield int(x), int(y)
                queue.extend(left[hit])
                left = left[~hit]


def links(fps: DataFrame, distance: int = 3) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints `fp` just as all pairs within `distance` bits do.

    Each fingerprint's variant keys are dealt out by key and sorted; equal keys then stand together, a run at a time,
    and every pair is verified by its exact distance. Rather than all pairs of a run, a spanning forest of its links
    goes on, so a large group of near copies adds no more edges than it has members.
    """
    segments = distance // 2 + 1
    width = 64 // segments

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(fps), 2000):
                k, f = variants(fps[at : at + 2000], distance)
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(f.view(np.int64))], ["key", "fp"])

    def runs(keys: np.ndarray, fps: np.ndarray) -> Iterator[tuple[int, int]]:
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        starts, ends = np.append(0, cuts), np.append(cuts, len(keys))
        size = ends - starts
        code = (keys.view(np.uint64) % np.uint64(64 * segments)).astype(np.int64)
        place, first = code % 64 + code // 64 * width, code % 64 == 0
        two = starts[size == 2]
        diff = fps[two] ^ fps[two + 1]
        hit = (np.bitwise_count(diff) <= distance) & (first[two] | (diff >> place[two].astype(np.uint64) & np.uint64(1) == 1))
        yield from zip(fps[two[hit]].tolist(), fps[two[hit] + 1].tolist())
        for s, e in zip(starts[size > 2].tolist(), ends[size > 2].tolist()):
            yield from _forest(fps[s:e], int(place[s]), distance, bool(first[s]))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def done(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            edges = np.array(list(runs(*map(np.concatenate, zip(*parts)))), np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            k, f = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
            last = int(np.searchsorted(k, k[-1]))
            if last or (held and held[-1][0][-1] != k[0]):
                head = [*held, (k[:last], f[:last])]
                held = []
                if last == 0:
                    yield done(head[:-1])
                elif sum(len(x) for x, _ in head):
                    yield done([x for x in head if len(x[0])])
            held.append((k[last:], f[last:]))
        if held:
            yield done(held)

    keyed = fps.select("fp").mapInArrow(index, "key long, fp long")
    dealt = keyed.repartition(partitions(fps.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(verify, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = 3, seed: int = 42) -> DataFrame:
    """Rows (key, fp, component): documents whose fingerprints differ in `distance` bits at most are linked, and
    component is the smallest key reachable through links.

    Nulls and empty texts have fingerprint 0, which links like any other. A null key never names a component unless
    all keys reached are null. Repeated rows and copies share a fingerprint; they are one node, so a group of copies
    of any size costs one node. Texts of any length are read whole, in chunks. An empty table gives an empty result.
    Other columns of docs are not read.
    """
    fp = cut(fingerprints(docs, key, text, shingle, seed))
    nodes = cut(fp.groupBy("fp").agg(F.min("key").alias("rep")))
    linked = components(links(nodes, distance), "a", "b")
    member = linked.join(nodes.withColumnRenamed("fp", "node"), "node", "right").select("node", F.coalesce("component", "node").alias("root"), "rep")
    root = member.groupBy("root").agg(F.min("rep").alias("component"))
    named = member.join(root, "root").select(F.col("node").alias("fp"), "component")
    return fp.join(named, "fp").select("key", "fp", "component")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = jaccard.SHINGLE, distance: int = 5) -> DataFrame:
    """The rows of docs, all columns, that stand for their group at a similarity of 0.8 or more of five-word shingle sets.

    Fingerprints of all texts are linked (`near_duplicates`), and the sets of linked texts are compared, which decides.
    At a similarity of 0.8 two fingerprints differ in about 10 of 64 bits, and no distance holds all pairs; those that
    fingerprints miss are found through prefixes of the sets (`jaccard`), so that none is lost.
    """

    def near(texts: DataFrame) -> DataFrame:
        return near_duplicates(texts, "node", "text", shingle, distance).select(F.col("key").alias("node"), "component").distinct()

    return jaccard.one_of_each(docs, near, key, text)
