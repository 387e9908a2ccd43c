"""Embedding near-duplicates: int8 tile products with error bounds, full precision only where they leave doubt."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut

#: Distinct vectors in a tile; rows of a tile multiplied at a time; pairs recomputed at a time.
TILE, BLOCK, PAIRS = 4096, 512, 1 << 14


def normalised(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 codes of unit vectors, the step of each, and the exact norm of what rounding took from each."""
    step = np.maximum(np.abs(unit).max(axis=1, keepdims=True), 1e-300) / 127
    codes = np.rint(unit / step)
    return codes.astype(np.int8), step[:, 0], np.linalg.norm(unit - codes * step, axis=1)


def quantised(vectors: pa.Array) -> pa.Array:
    """Codes, step and error of each vector; vectors of a batch may differ in length."""
    size = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    flat, at = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.append(0, np.cumsum(size))
    codes, step, error = [b""] * len(size), np.zeros(len(size)), np.zeros(len(size))
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        c, step[rows], error[rows] = quantise(normalised(flat[at[rows][:, None] + np.arange(n)]))
        for r, x in zip(rows.tolist(), c):
            codes[r] = x.tobytes()
    return pa.StructArray.from_arrays([pa.array(codes, pa.binary()), pa.array(step), pa.array(error)], ["codes", "step", "error"])


@dataclass
class Tile:
    """Rows of a tile: int8 codes, steps and errors of unit vectors, and how many copies each stands for."""

    codes: np.ndarray
    step: np.ndarray
    error: np.ndarray
    copies: np.ndarray


def products(a: Tile, b: Tile, least: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Which rows of a and b surely have a cosine of `least` or more, and which may have: (first row, two boolean blocks), block after block.

    With u = p + e and v = q + f (p, q the quantised vectors), u.v differs from p.q by |e| + |f| + |e||f| at most, since
    |u| = |v| = 1 gives |p.f| <= (1 + |e|)|f|; hence 2|e||f| with the last term. Products of codes are whole numbers
    under 2**24 in float32 up to 1,040 dimensions, and in double beyond, so p.q is exact but for the last rounding,
    which the added 1e-9 covers.
    """
    kind = np.float32 if a.codes.shape[1] <= 1040 else np.float64
    q = b.codes.T.astype(kind)
    for at in range(0, len(a.codes), BLOCK):
        some = slice(at, at + BLOCK)
        near = (a.codes[some].astype(kind) @ q).astype(np.float64) * a.step[some, None] * b.step
        off = a.error[some, None] + b.error + 2 * a.error[some, None] * b.error + 1e-9
        links = near - off >= least
        yield at, links, ~links & (near + off >= least)


class Forest:
    """Links of each row, and a root row for each: rows linked by any path share it.

    Instead of pairs, a label per row comes out, so a dense group of n rows gives n roots and not n * n pairs.
    """

    def __init__(self, rows: int) -> None:
        self.counts, self.root = np.zeros(rows, np.int64), np.arange(rows)

    def join(self, r: np.ndarray, c: np.ndarray) -> None:
        root = self.root
        while len(r):
            x, y = root[r], root[c]
            low = np.minimum(x, y)
            np.minimum.at(root, np.maximum(x, y), low)
            while (root[root] != root).any():
                root[:] = root[root]
            keep = root[r] != root[c]
            r, c = r[keep], c[keep]


def join_tiles(a: Tile, b: Tile | None, least: float, unit: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[Forest, np.ndarray]:
    """Links of each row with the other tile (copies counted) as a forest, and which rows have a pair that codes leave in doubt.

    b is None for a tile against itself. Rows of b follow those of a. Without `unit`, links are those that codes settle;
    with the unit vectors of both tiles, links are those of the pairs in doubt, multiplied in double.
    """
    own = b is None
    other = a if own else b
    n = len(a.codes)
    forest = Forest(n if own else n + len(other.codes))
    doubtful = np.zeros(len(forest.root), bool)
    for at, links, doubt in products(a, other, least):
        if own:
            k = np.arange(len(links))
            links[k, at + k] = doubt[k, at + k] = False
        if unit is not None:
            links = np.zeros_like(doubt)
            r, c = np.nonzero(doubt)
            for k in range(0, len(r), PAIRS):
                i, j = r[k : k + PAIRS], c[k : k + PAIRS]
                links[i, j] = (unit[0][at + i] * unit[1][j]).sum(axis=1) >= least
        doubtful[at : at + len(links)] |= doubt.any(axis=1)
        forest.counts[at : at + len(links)] += links @ other.copies
        if not own:
            doubtful[n:] |= doubt.any(axis=0)
            forest.counts[n:] += a.copies[at : at + len(links)] @ links
        r, c = np.nonzero(links)
        forest.join(r + at, c + (0 if own else n))
    return forest, doubtful


def near_duplicates(vectors: DataFrame, least: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Rows (key, n_links, component): vectors with equal, non-null labels are linked at a cosine of `least` or more.

    Equal vectors of a label are first made one class. A label's classes are dealt by hash into tiles of about TILE;
    each pair of tiles is one group of rows of bounded size, so a label with a third of all vectors becomes many tasks.
    What is dealt are int8 codes with their step and error. A group gives link counts and roots, never pairs, and the
    rows of which a pair is in doubt; only those go to a second round with their vectors, where the pairs in doubt are
    multiplied in double. The roots' graph is then solved by `components`.

    Vectors that are null, empty, zero or hold null or non-finite numbers, and those without a label, link with
    nothing: 0 links and their own key as component. Vectors of different lengths are not compared. Repeated rows are
    vectors of their own, linked with each other. A null key never names a component. An empty table gives an empty result.
    """
    x = vectors.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).alias("v"))
    good = F.col("label").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0)
    x = x.withColumn("v", F.when(F.coalesce(good, F.lit(False)), F.col("v")))
    classes = x.where("v is not null").groupBy("label", "v").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = classes.withColumn("id", F.monotonically_increasing_id()).withColumn("size", F.size("v"))
    kind = "array<double>" if "double" in dict(classes.dtypes)["v"] else "array<float>"
    coded = F.arrow_udf(quantised, "struct<codes: binary, step: double, error: double>").asNondeterministic()
    classes = cut(classes.withColumn("q", coded(F.col("v").cast(kind))).select("label", "v", "rep", "copies", "id", "size", "q.*"))
    # a number for each label and length, and its tiles
    kinds = cut(classes.groupBy("label", "size").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("tiles")).withColumn("kind", F.monotonically_increasing_id()))
    dealt = classes.join(kinds, ["label", "size"]).withColumn("t", F.pmod(F.xxhash64("id"), "tiles"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    dealt = dealt.select("kind", F.least("t", "other").alias("i"), F.greatest("t", "other").alias("j"), (F.col("t") > F.col("other")).alias("second"), "id", "copies", "codes", "step", "error")

    def parts(group: pa.Table) -> tuple[np.ndarray, np.ndarray, Tile, Tile | None, int]:
        second = group.column("second").to_numpy()
        order = np.argsort(second, kind="stable")
        one = group.column("i")[0].as_py() == group.column("j")[0].as_py()
        n = len(order) if one else int((~second).sum())
        codes = np.frombuffer(b"".join(group.column("codes").to_pylist()), np.int8).reshape(len(order), -1)
        columns = [codes[order], *(group.column(c).to_numpy()[order] for c in ("step", "error", "copies"))]
        return order, second[order], Tile(*(c[:n] for c in columns)), None if one else Tile(*(c[n:] for c in columns)), n

    def told(group: pa.Table, order: np.ndarray, forest: Forest, tell: np.ndarray, doubtful: np.ndarray, second: np.ndarray) -> pa.Table:
        ids = group.column("id").to_numpy()[order]
        at = [pa.array(np.full(tell.sum(), group.column(c)[0].as_py())) for c in ("kind", "i", "j")]
        return pa.table([*at, pa.array(ids[tell]), pa.array(ids[forest.root[tell]]), pa.array(forest.counts[tell]), pa.array(second[tell]), pa.array(doubtful[tell])], names=schema.split()[::2])

    schema = "kind long, i long, j long, id long, root long, n long, second boolean, doubtful boolean"

    def settle(group: pa.Table) -> pa.Table:
        order, second, a, b, _ = parts(group)
        forest, doubtful = join_tiles(a, b, least)
        return told(group, order, forest, doubtful | (forest.counts > 0), doubtful, second)

    def resolve(group: pa.Table) -> pa.Table:
        order, second, a, b, n = parts(group)
        v = normalised(np.asarray(group.column("v").combine_chunks().flatten(), np.float64).reshape(len(order), -1))[order]
        forest, doubtful = join_tiles(a, b, least, (v[:n], v if b is None else v[n:]))
        return told(group, order, forest, forest.counts > 0, doubtful & False, second)

    settled = cut(dealt.groupBy("kind", "i", "j").applyInArrow(settle, schema))
    whole = classes.select("id", "copies", "codes", "step", "error", F.col("v").cast(kind).alias("v"))
    again = settled.where("doubtful").select("kind", "i", "j", "second", "id").join(whole, "id")
    found = cut(settled.select("id", "root", "n").unionAll(again.groupBy("kind", "i", "j").applyInArrow(resolve, schema).select("id", "root", "n")))
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    member = components(found.where("id != root"), "id", "root")
    state = classes.join(counts, "id", "left").join(member.withColumnRenamed("node", "id"), "id", "left")
    state = state.select("label", "v", "rep", "copies", F.coalesce("component", "id").alias("root"), F.coalesce("n", F.lit(0)).alias("n"))
    named = state.groupBy("root").agg(F.min("rep").alias("component"))
    state = state.join(named, "root").select("label", "v", (F.col("n") + F.col("copies") - 1).alias("n_links"), "component")
    good, bad = x.where("v is not null").join(state, ["label", "v"]), x.where("v is null")
    return good.select("key", "n_links", "component").unionAll(bad.select("key", F.lit(0).cast("long"), "key"))
