"""Operators for training data: edge cases, and brute force on small inputs."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from protospark.llm import chat, common, embeddings, langid, licenses, mixing, packing, queries, quality, sharding, simhash, tokenbin
from protospark.llm.common import components, word_count

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, key string, size string, fp long, _rank int, label string"
RNG = random.Random(1)


def prose(n, rng=RNG, letters="abcdefg"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(n))


def docs(spark, texts, **more):
    rows = [(i, t, "en", "s", 0, "r", "k", "z", 1, 2, "l") for i, t in enumerate(texts)]
    return spark.createDataFrame([tuple(more.get(c, {}).get(r[0], v) for c, v in zip([f.split()[0] for f in DOCS.split(", ")], r)) for r in rows], DOCS)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, columns with clashing names."""
    long = prose(120_000)
    texts = [None, "", " \n\t ", long, long, "tie tie", "tie tie", prose(40), "é ß 日本 " * 9, "a\x00b\x1cc\u0085d", "12 34 !!", prose(30) + "\n\n" + "Z" * 50_000]
    rows = [(i, t, ["en", None, "de"][i % 3], ["a", "b", None][i % 3], i, None, "k", None, None, 3, "x") for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (None, "no id here " * 9, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def union(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(2000, 2200)] + [(7, 7)]
    want = union(edges, {n for e in edges for n in e})
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert all(want[n] == got.get(n, n) for n in want) and set(got) <= set(want)
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").isEmpty()


def test_sieve_lets_all_its_values_through(spark, monkeypatch):
    rng = random.Random(2)
    values = [rng.getrandbits(62) for _ in range(3000)] + [None]
    for buckets in (1 << 8, 1 << 24):
        monkeypatch.setattr(common, "SIEVE", buckets)
        table = common.sieve(spark.createDataFrame([(v,) for v in values[::3]], "v long"))
        rows = common.sift(spark.createDataFrame([(v, "x") for v in values], "v long, word string").withColumnRenamed("word", "w"), "v", table).collect()
        assert len(rows) == len(values) and all(r["_may"] for r in rows if r["v"] in set(values[::3]))
        assert (sum(r["_may"] for r in rows) < 1100) == (buckets > 1000) and table.count() <= buckets // 64
    assert not any(r["_may"] for r in common.sift(spark.createDataFrame([(1,)], "v long"), "v", common.sieve(spark.createDataFrame([], "v long"))).collect())


def test_release(spark):
    t = common.cut(spark.range(3))
    other = common.cut(spark.range(4))
    common.discard(t)
    assert other.count() == 4 and not os.path.exists(t.cut_path.removeprefix("file://"))
    common.release(spark)
    assert not os.path.exists(other.cut_path.removeprefix("file://"))


# mixing


def fill(sizes, weights, total, most=3):
    target, capped = {}, set()
    while True:
        free = [s for s in sizes if s not in capped]
        rest = total - sum(most * sizes[s] for s in capped)
        for s in free:
            target[s] = rest * weights[s] / sum(weights[x] for x in free)
        over = [s for s in free if target[s] > most * sizes[s]]
        if not over:
            return target | {s: most * sizes[s] for s in capped}
        capped |= set(over)


def test_mixing_meets_targets(spark):
    rng = random.Random(2)
    n = {"a": 40, "b": 3000, "c": 300, "é": 500, None: 200}
    rows = [(i, s, int(rng.paretovariate(1.3) * 20)) for i, s in enumerate(s for s, k in n.items() for _ in range(k))]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long"))
    x = found.select("row.*", "source_size", "target", "copies").collect()
    assert len(x) == len(rows)
    sizes = Counter()
    for _, s, k in rows:
        sizes[s] += k
    order = sorted(k for k in n if k is not None) + [None]
    want = fill(sizes, dict(zip(order, [5, 2, 1, 5, 2])), sum(sizes.values()))
    taken = Counter()
    for r in x:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]]) and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["copies"] * r["size"]
    for s in n:
        assert taken[s] == pytest.approx(want[s], rel=0.05), s
    assert all(r["copies"] == 3 for r in x if r["source"] == "a")
    assert sorted(map(str, x)) == sorted(map(str, mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long").repartition(7)).select("row.*", "source_size", "target", "copies").collect()))
    assert mixing.emit(found).count() == sum(r["copies"] for r in x)


def test_mixing_odd(spark, odd):
    sized = odd.select("*", word_count(F.col("text")).alias("words"))
    x = mixing.mix(sized, size="words").select("row.*", F.col("size").alias("n"), "copies").collect
    assert mixing.mix(sized, size="words").count() == odd.count()
    assert set(mixing.emit(mixing.mix(sized, size="words")).columns) == set(sized.columns) and x
    assert mixing.mix(sized.limit(0), size="words").isEmpty()
    nothing = docs(spark, [None, "", " "]).select("*", word_count(F.col("text")).alias("words"))
    assert mixing.mix(nothing, size="words").count() == 3


# embeddings


def test_embeddings_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 40)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    v = [(centres[i % 12] + rng.normal(size=16) * rng.choice([0.05, 0.12, 0.3])).astype(np.float32).tolist() for i in range(260)]
    v += [v[0]] * 30 + [None, [], [0.0] * 16, [float("nan")] * 16, [1.0, None] * 8, [float("inf")] * 16, [1.0, 2.0], [3.0, 6.0]]
    label = [None if i % 41 == 40 else (0 if i % 3 else i % 5) for i in range(len(v))]
    rows = [(i, x, y, "k") for i, (x, y) in enumerate(zip(v, label))] + [(0, v[0], label[0], "again")]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, key string")).collect()
    unit = {}
    for k, (_, x, y, _) in enumerate(rows):
        if x and y is not None and None not in x and np.isfinite(x).all() and np.any(x):
            unit[k] = np.array(x, np.float64) / np.linalg.norm(np.array(x, np.float64))
    links = [(a, b) for a in unit for b in unit if a < b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93]
    group = union([(rows[a][0], rows[b][0]) for a, b in links], {r[0] for r in rows})
    count = Counter(k for p in links for k in p)
    want = sorted((r[0], count[k], group[r[0]]) for k, r in enumerate(rows))
    assert sorted((r["key"], r["n_links"], r["component"]) for r in got) == want and len(links) > 500


def test_embeddings_bounds_and_empty(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=64)
    a = embeddings.normalised(np.array([base + rng.normal(size=64) * s for s in np.linspace(0.2, 0.35, 900)]))
    exact = a @ a.T >= 0.93
    tile = embeddings.Tile(*embeddings.quantise(a), np.ones(900, np.int64))
    assert tile.codes.dtype == np.int8
    for at, links, doubt in embeddings.products(tile, tile, 0.93):
        true = exact[at : at + len(links)]
        assert true[links].all() and not true[~links & ~doubt].any() and 0 < doubt.mean() < 0.5
    assert 0.1 < exact.mean() < 0.9
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>, label string")
    assert embeddings.near_duplicates(empty).isEmpty()
    one = spark.createDataFrame([(None, [1.0, 0.0], "x"), (None, [1.0, 0.0], "x"), (4, [1.0, 0.01], "x")], "vec_id long, embedding array<double>, label string")
    assert {(r["n_links"], r["component"]) for r in embeddings.near_duplicates(one).collect()} == {(2, 4)}


# token files


def test_token_files(spark, odd, tmp_path):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    t = Tokenizer.from_file(path)
    texts = odd.select("doc_id", "text").collect() + [(100, "x <|endoftext|> y  <|endoftext|>"), (101, "it's 's  \n x\t\ty"), (102, "   "), (103, " a\n b")]
    frame = spark.createDataFrame([tuple(r) for r in texts], "doc_id long, text string").repartition(3)
    out = str(tmp_path / "ids")
    tokenbin.write(frame, out, path)
    back = tokenbin.read(spark, out).orderBy("start").collect()
    want = sorted(((r[0] is not None, r[0] or 0, np.array(t.encode(r[1] or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for r in texts))
    assert sorted((r["key"] is not None, r["key"] or 0, bytes(r["ids"])) for r in back) == want
    assert [r["key"] for r in back] == sorted((r["key"] for r in back), key=lambda k: -1 if k is None else k)
    at = 0
    for r in back:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) // 4
        at += r["n_tokens"]
    crc = {(r["start"], r["crc"]) for r in tokenbin.checksums(spark, out).collect()}
    assert crc == {(r["start"], zlib.crc32(bytes(r["ids"]))) for r in back}
    assert tokenbin.export(spark, out, str(tmp_path / "f")) == at
    assert tokenbin.load(str(tmp_path / "f")).tobytes() == b"".join(bytes(r["ids"]) for r in back)
    tokenbin.write(frame.limit(0), str(tmp_path / "none"), path)
    assert tokenbin.read(spark, str(tmp_path / "none")).isEmpty()


def test_planes():
    rng = np.random.default_rng(1)
    for ids in (np.zeros(0, "<u4"), np.array([2], "<u4"), rng.integers(0, 50_257, 40_000).astype("<u4"), rng.integers(0, 1 << 32, tokenbin.BLOCK + 1).astype("<u4")):
        assert (tokenbin.unpack(tokenbin.pack(ids)) == ids).all()
    with pytest.raises(ValueError):
        tokenbin.unpack(b"none")


# quality


def slow_stats(text):
    words = [w for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_quality_statistics(monkeypatch):
    rng = random.Random(9)
    phrase = prose(11, rng)
    texts = [None, "", "a " * 50, prose(200, rng) + " " + phrase + " x " + phrase, "l 1\nl 1\n \n \nl 1", "é ß #| <>\x1c", phrase + "\n" + phrase] + [prose(rng.randint(0, 300), rng, "ab") for _ in range(40)]
    for size in (64, 1 << 19):
        monkeypatch.setattr(quality, "BATCH_WORDS", size)
        assert [tuple(r[:5]) for r in quality.statistics(pa.array(texts, pa.string()))] == [slow_stats(t) for t in texts]


def test_trees_learn_and_keep_their_constraints():
    rng = np.random.default_rng(2)
    x = rng.random((3000, 3))
    y = ((x[:, 0] < 0.6) & (np.abs(x[:, 1] - 0.5) < 0.35) ^ (rng.random(3000) < 0.03)).astype(float)
    model = quality.boost(x, y, [-1, 0, 0])
    assert ((model.score(x) > 0.5) == y).mean() > 0.93
    for row in x[:50]:
        line = np.tile(row, (60, 1))
        line[:, 0] = np.linspace(0, 1, 60)
        assert (np.diff(model.score(line)) <= 1e-12).all()
    slow = []
    for row in x[:40]:
        raw = model.base
        for f, t, v in zip(model.feature, model.threshold, model.value):
            k = 0
            while k < len(f):
                k = 2 * k + 1 + int(row[f[k]] > t[k])
            raw += v[k - len(f)]
        slow.append(1 / (1 + math.exp(-raw)))
    assert np.allclose(model.score(x[:40]), slow)
    assert quality.boost(np.zeros((0, 2)), np.zeros(0), [0, 0]).score(np.zeros((2, 2))).min() > 0.9


def test_quality_query(spark, odd):
    rng = random.Random(8)
    bad = [" ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in prose(60, rng).split()) for _ in range(150)]
    clean = [prose(rng.randint(30, 200), rng) for _ in range(300)]
    d = docs(spark, clean + bad)
    labels = spark.createDataFrame([(i, int(i < 300)) for i in range(450)] + [(3, None), (None, 1), (999, 0)], "doc_id long, quality int")
    model = quality.train(d, labels)
    kept = {r["doc_id"] for r in quality.keep_good(d, model).collect()}
    assert len(kept & set(range(300))) >= 297 and len(kept - set(range(300))) <= 3
    for m in (model, quality.train(d, labels.limit(0)), quality.train(d.limit(0), labels)):
        found = odd.select("doc_id", quality.judge(m, F.col("text")).alias("q")).select("doc_id", "q.*").collect()
        assert len(found) == odd.count() and all(r["base_failed"] and not r["kept"] for r in found if r["n_words"] < 20)
    assert quality.keep_good(odd, model).columns == odd.columns and quality.keep_good(odd.limit(0), model).isEmpty()


# sharding


def test_curve_steps_to_neighbours():
    for bits, dims in ((4, 3), (3, 2), (2, 4)):
        place = sharding.curve(bits, dims)
        assert sorted(place) == list(range(1 << bits * dims))
        cells = {p: [c >> bits * i & (1 << bits) - 1 for i in range(dims)] for c, p in enumerate(place)}
        assert all(sum(abs(a - b) for a, b in zip(cells[p], cells[p + 1])) == 1 for p in range(len(place) - 1))


def test_sharding(spark, odd, tmp_path):
    dims = [F.length("source"), F.length("lang"), F.length("text")]
    rng = random.Random(1)
    d = docs(spark, [prose(rng.choice([1, 2, 3])) for _ in range(500)] + ["same"] * 300)
    for frame, shards in ((d, 24), (odd, 4), (odd, 24)):
        rows = sharding.shard(frame, dims, shards).select("row.doc_id", "curve", "shard", "slot").collect()
        by = defaultdict(list)
        for r in rows:
            by[r["shard"]].append(r)
        n = frame.count()
        assert len(rows) == n and max(map(len, by.values())) - min([len(by[s]) for s in range(shards)]) <= 1
        assert all(sorted(r["slot"] for r in x) == list(range(len(x))) for x in by.values())
        ordered = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
        assert [r["curve"] for r in ordered] == sorted(r["curve"] for r in rows)
    assert sharding.shard(odd.limit(0), dims, 24).isEmpty()
    sharded = sharding.shard(d, dims, 5)
    sharding.write_shards(sharded, str(tmp_path / "s"), rows=50)
    files = spark.read.parquet(str(tmp_path / "s")).groupBy("_shard", "_run", F.input_file_name().alias("f")).agg(F.min("_slot").alias("a"), F.max("_slot").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    assert len(files) == len({(r["_shard"], r["_run"]) for r in files}) == 20 and all(r["a"] == 50 * r["_run"] and r["b"] - r["a"] + 1 == r["n"] for r in files)
    assert {r["rows"] for r in sharding.manifest(sharded, ["doc_id"]).collect()} == {160}


def test_codes_and_groups(spark, odd):
    rng = random.Random(4)
    rows = [(i, rng.choice(["hot"] * 9 + ["a", "b", "z", None]), rng.randint(0, 5), rng.choice([None, "g1", "g2", "g3", f"own{i}"])) for i in range(900)]
    frame = spark.createDataFrame(rows, "doc_id long, s string, n int, g string").repartition(4)
    coded = sharding.codes(frame, [F.col("s"), F.col("n")], 3).collect()
    for c, name in (("code0", "s"), ("code1", "n")):
        values = sorted(((r[name] is not None, r[name] if r[name] is not None else 0, r[c]) for r in coded), key=lambda v: (v[0], str(v[1])))
        assert [v[2] for v in values] == sorted(v[2] for v in values) and 0 <= values[0][2] <= values[-1][2] < 8
        for v in {v[:2] for v in values}:
            below, own = sum(str(x[1]) < str(v[1]) if x[0] == v[0] else x[0] < v[0] for x in values), sum(x[:2] == v for x in values)
            assert {x[2] for x in values if x[:2] == v} == {8 * (2 * below + own) // (2 * len(values))}
    dims = [F.col("code0"), F.col("code1")]
    x = sharding.shard(sharding.codes(frame, [F.col("s"), F.col("n")], 3), dims, 6, group="g", bits=3).select("row.*", "curve", "shard", "slot").collect()
    x.sort(key=lambda r: (r["shard"], r["slot"]))
    for g in ("g1", "g2", "g3"):
        places = [i for i, r in enumerate(x) if r["g"] == g]
        assert places == list(range(places[0], places[0] + len(places))) and len({x[i]["curve"] for i in places}) == 1
    assert len(x) == 900 and sharding.codes(odd, [F.col("source"), F.col("label")]).count() == odd.count() and sharding.codes(odd.limit(0), [F.col("source")]).isEmpty()


# simhash


def slow_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(monkeypatch):
    texts = [None, "", "A b", "A b C", "é É ß", prose(500), "x " * 100, "a\x1cb c d"]
    for chunk in (7, 1 << 15):
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        assert [simhash.fingerprint(t and t.encode()) for t in texts] == [slow_print(t) for t in texts]


@pytest.mark.parametrize("distance", [0, 1, 3, 5])
def test_links_are_all_within_distance(spark, distance, monkeypatch):
    rng = random.Random(distance)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    fps = {s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 7))) for s in seeds for _ in range(40)} | {0}
    low = list(fps)
    want = union([(a, b) for a in low for b in low if a < b and (a ^ b).bit_count() <= distance], low)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    frame = spark.createDataFrame([(signed(f),) for f in low], "fp long").repartition(5)
    edges = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.links(frame, distance).collect()]
    assert all(0 < (a ^ b).bit_count() <= distance for a, b in edges)
    got = union(edges, low)
    assert {frozenset(n for n in low if got[n] == got[m]) for m in low} == {frozenset(n for n in low if want[n] == want[m]) for m in low}


def test_forest_by_masks_is_the_walk(monkeypatch):
    rng = random.Random(4)
    fps = np.array(sorted({rng.getrandbits(64) ^ 0 for _ in range(30)} | {0b111 ^ (1 << rng.randint(3, 63)) ^ (1 << rng.randint(0, 5)) for _ in range(300)}), np.uint64)
    for everything in (True, False):
        walk = union(simhash._forest(fps, 2, 3, everything), fps.tolist())
        with monkeypatch.context() as m:
            m.setattr(simhash, "MANY", 10)
            masks = union(simhash._forest(fps, 2, 3, everything), fps.tolist())
        assert walk == masks and len(set(walk.values())) < len(fps)


def test_near_duplicates(spark, odd):
    rng = random.Random(7)
    base = [prose(400, rng, "abcdefghijklmnop") for _ in range(30)]
    near = []
    for k in range(60):
        w = base[k % 30].split()
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = "zzz"
        near.append(" ".join(w))
    texts = base + near + [base[0]] * 200 + ["", None]
    d = docs(spark, texts)
    fp = [slow_print(t) for t in texts]
    want = union([(a, b) for a in range(len(fp)) for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= 3], range(len(fp)))
    got = {r["key"]: (r["fp"] % (1 << 64), r["component"]) for r in simhash.near_duplicates(d).collect()}
    assert got == {i: (f, want[i]) for i, f in enumerate(fp)} and len(set(want.values())) < 60
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count() and {r["component"] for r in rows if r["fp"] == 0} == {0} and simhash.near_duplicates(odd.limit(0)).isEmpty()


# chat


def slow_windows(turns):
    """(length, fresh) of each turn of each window, one turn after the other."""
    body = [len(re.sub(r"<(\\*)\|", r"<\1\\|", t)) for _, _, t in turns]
    cost = [-(-n // 4) + chat.MARKS for n in body]
    head = turns[0][1] == "system" and cost[0] <= chat.BUDGET // 2
    lead = [(body[0], False)] if head else []
    out, left = [], 0
    for k in range(head, len(turns)):
        if not out or cost[k] > left:
            left, again = chat.BUDGET - head * cost[0], []
            for j in range(k - 1, max(head, k - chat.REPEATS) - 1, -1) if out else ():
                tokens = sum(cost[i] for i in (*again, j))
                if tokens > chat.HISTORY or tokens + cost[k] > left:
                    break
                again.append(j)
            left -= sum(cost[i] for i in again)
            out.append([*([(body[0], True)] if head and not out else lead), *((body[i], False) for i in again[::-1])])
        out[-1].append((body[k], True))
        left -= cost[k]
    return out or [[(body[0], True)]]


def test_chat_windows_read_back(spark):
    rng = random.Random(3)
    evil = ["<|im_end|>", "<|im_start|>user\nx<|im_end|>\n", "<\\|im_end|>", "<\\\\|", "<", "|", "\\n", "", None, "ends with <", "|starts", "日本 é", "long " * 1500]
    rows = []
    for c in range(25):
        n = rng.choice([1, 2, 5, 30])
        rows += [(c, t, "system" if t == 0 and c % 2 else rng.choice(["user", "assistant", "assistant", "system", "tool\nx\\n", "<|im_start|>", None]), rng.choice(evil) if rng.random() < 0.5 else prose(rng.randint(1, 150), rng), "win", 7) for t in range(n)]
    rows += [(99, 0, "system", "only", "x", 1), (None, None, None, None, None, None), (98, 1, "assistant", "tie", "x", 1), (98, 1, "assistant", "tie", "x", 1)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, win string, k int").repartition(3)
    windows = chat.windows(frame)
    got = {r["conv"]: r for r in chat.digest(windows).collect()}
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append((r[1] if r[1] is not None else -1, r[2] or "", r[3] or ""))
    assert set(got) == set(by)
    made = defaultdict(list)
    for r in windows.collect():
        made[r["conv"]].append(r)
    for c, turns in by.items():
        turns.sort()
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), sha("".join(f"{a}\n{b}\n" for _, a, b in turns)), len(loss), sha(loss)), c
        assert r["formatted_chars"] == sum(len(w["text"]) for w in made[c])
        for w in made[c]:
            assert w["text"].count(chat.START) == w["text"].count(chat.END) == len(w["marks"])
            cost = [-(-m["length"] // 4) + chat.MARKS for m in w["marks"]]
            assert w["n_tokens"] == sum(cost)
            new = sum(m["fresh"] for m in w["marks"]) - (w["win"] == 1 and len(w["marks"]) > 1)
            assert sum(cost) <= chat.BUDGET or new <= 1
            assert sum(c for c, m in zip(cost, w["marks"]) if not m["fresh"]) <= chat.HISTORY + chat.BUDGET // 2
            assert not any(m["loss"] and not m["fresh"] for m in w["marks"])
            if turns[0][1] == "system" and -(-len(turns[0][2]) // 4) + chat.MARKS + 9 <= chat.BUDGET // 2:
                assert w["text"].startswith(chat.START + "system\n")
        # brute force: each turn goes into the open window if it fits there, and opens the next if not
        assert [list(map(tuple, x)) for x in slow_windows(turns)] == [[(m["length"], m["fresh"]) for m in w["marks"]] for w in sorted(made[c], key=lambda w: w["win"])]
    assert any(len(w) > 3 for w in made.values()) and any(not m["fresh"] for w in made.values() for x in w for m in x["marks"])
    assert chat.digest(chat.windows(frame.limit(0))).isEmpty()


# licenses


def test_licenses(spark, odd):
    words = licenses.TEMPLATES["MIT"].split()
    words[10:12] = ["any", "other", "person"]
    del words[40]
    header = licenses.TEMPLATES["Apache-2.0-header"]
    texts = [prose(50) + "\nReleased under the MIT License.\n" + prose(50), prose(20) + " " + " ".join(words).upper() + " " + prose(20), "/* " + header.replace(" ", "\n * ") + " */", prose(300), "the software license under version of this", (licenses.TEMPLATES["CC-BY-NC-4.0-notice"] + " ") * 2, None, "", prose(60_000) + " " + licenses.TEMPLATES["GPL-3.0-notice"]]
    d = docs(spark, texts)
    got = {r["doc_id"]: r["s"] for r in d.select("doc_id", licenses.licenses(F.col("text")).alias("s")).collect()}
    assert [[s["license"] for s in got[i]] for i in range(9)] == [["MIT-notice"], ["MIT"], ["Apache-2.0-header"], [], [], ["CC-BY-NC-4.0-notice"] * 2, [], [], ["GPL-3.0-notice"]]
    (s,) = got[0]
    assert texts[0].encode()[s["start"] : s["end"]].decode() == "Released under the MIT License" and s["coverage"] == 1
    assert 0.9 < got[1][0]["coverage"] < 1 and got[2][0]["coverage"] == 1
    assert all(r["s"] == [] for r in odd.select(licenses.licenses(F.col("text")).alias("s")).collect())
    assert odd.limit(0).select(licenses.licenses(F.col("text"))).isEmpty()


def slow_matched(template, text, d, band=licenses.BAND):
    """Longest common subsequence of a template and a text over the cells within the band of diagonal d."""
    best = {}
    for i in range(len(template)):
        for j in range(i + d - band, i + d + band + 1):
            here = max(best.get((i - 1, j), 0), best.get((i, j - 1), 0))
            if 0 <= j < len(text) and text[j] == template[i]:
                here = max(here, best.get((i - 1, j - 1), 0) + 1)
            best[i, j] = here
    return max(best.values())


def slow_hits(text, least=licenses.LEAST):
    """Templates that some place of a text matches, by alignment at every place where enough of the template's words stand."""
    tokens, out = licenses.words(text)[0], {}
    for name, t in licenses.TEMPLATES.items():
        template = licenses.words(t.encode())[0]
        n, known = len(template), set(template)
        for d in range(-n, len(tokens)):
            near = tokens[max(0, d - licenses.BAND) : max(0, d + n + licenses.BAND)]
            if sum(w in known for w in near) >= least * n - 1e-9:
                out[name] = max(out.get(name, 0), slow_matched(template, tokens, d))
    return {k: m for k, m in out.items() if m >= least * len(licenses.words(licenses.TEMPLATES[k].encode())[0]) - 1e-9}


def test_alignment_and_fingerprints():
    rng = random.Random(6)
    for _ in range(60):
        template, text = rng.choices("abcdef", k=rng.randint(1, 20)), rng.choices("abcdefgh", k=rng.randint(0, 40))
        at = list(range(-9, 30, 4))
        assert [x[0] for x in licenses.align(template, text, at, 3)] == [slow_matched(template, text, d, 3) for d in at]
    for t in licenses.TEMPLATES.values():
        tokens = licenses.words(t.encode())[0]
        places = licenses.fingerprints(tokens)
        assert len(places) > len(tokens) - math.ceil(0.8 * len(tokens) - 1e-9) and len(places) < len(tokens) / 1.5
    assert len(licenses.fingerprints([b"the"] * 10)) == 3


def test_edits_of_every_template_are_found_as_by_brute_force(spark):
    rng = random.Random(9)
    texts = ["_Released under the MIT license_", "Licensed under the CC BY-NC 4.0", "Released under MIT License", "Available under the MIT License", "Licensed under Apache License, Version 2.0"]
    for name, text in licenses.TEMPLATES.items():
        w = text.split()
        for _ in range(8 if len(w) < 20 else 3):
            edit = list(w)
            for _ in range(rng.randint(1, 1 + len(w) // 6)):
                i = rng.randrange(len(edit))
                edit[i : i + rng.randint(0, 1)] = rng.choice([[], ["zzz"], ["zz"] * 3])
            texts.append(f"{prose(15, rng)} {' '.join(edit)} {prose(15, rng)}")
    found = docs(spark, texts).select("text", licenses.licenses(F.col("text")).alias("s")).collect()
    names = set()
    for r in found:
        want, got = slow_hits(r["text"].encode()), {x["license"]: x["coverage"] for x in r["s"]}
        assert set(got) <= set(want)
        for k, c in got.items():
            assert c == pytest.approx(want[k] / len(licenses.words(licenses.TEMPLATES[k].encode())[0]))
        # what isn't reported gave way to a template that matches as many words
        assert bool(got) == bool(want) and all(k in got or max(want[x] for x in got) >= m for k, m in want.items())
        names |= set(got)
    assert names == set(licenses.TEMPLATES)
    assert [x["license"] for x in found[0]["s"]] == ["MIT-notice"] and [x["license"] for x in found[2]["s"]] == ["MIT-notice"]


# packing


def test_packer_takes_the_tightest_compatible_bin():
    rng = random.Random(5)
    packer, bins = packing.Packer(100, 2), []
    pieces = sorted(((rng.randint(1, 100), rng.choice("abcd"), rng.randint(0, 60)) for _ in range(600)), reverse=True)
    for size, source, cluster in pieces:
        fits = [(100 - sum(p[0] for p in b), k) for k, b in enumerate(bins) if 100 - sum(p[0] for p in b) >= size and all(p[2] != cluster for p in b) and sum(p[1] == source for p in b) < 2]
        at, begin = packer.place(size, source, cluster)
        assert at == (min(fits)[1] if fits else len(bins))
        if at == len(bins):
            bins.append([])
        assert begin == sum(p[0] for p in bins[at])
        bins[at].append((size, source, cluster))


def packing_holds(rows, docs, capacity=packing.CAPACITY):
    """docs: (key, size, source, cluster), keys distinct."""
    whole, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        whole[r["key"]].append((r["first"], r["length"]))
        bins[r["pack"], r["bin"]].append(r)
    info = {d[0]: d for d in docs}
    for k, size, _, _ in docs:
        at = 0
        for first, length in sorted(whole[k]):
            assert first == at
            at += length
        assert at == size
    for b in bins.values():
        b.sort(key=lambda r: r["at"])
        assert sum(r["length"] for r in b) <= capacity and all(x["at"] + x["length"] == y["at"] for x, y in zip(b, b[1:]))
        assert max(Counter(info[r["key"]][3] for r in b).values()) == 1 and max(Counter(info[r["key"]][2] for r in b).values()) <= packing.PER_SOURCE


def test_packing(spark, odd):
    rng = random.Random(6)
    data = [(i, min(9000, int(rng.paretovariate(0.9) * 60)), rng.choice(["hot", "hot", "x", "y", None]), i if i % 4 else 1) for i in range(3000)]
    frame = spark.createDataFrame(data, "doc_id long, size long, source string, cluster long")
    rows = packing.pack(frame, F.col("size"), F.col("source"), F.col("cluster"), group=900).collect()
    packing_holds(rows, data)
    assert len({r["pack"] for r in rows}) == 4
    again = packing.pack(frame.repartition(7, "cluster"), F.col("size"), F.col("source"), F.col("cluster"), group=900).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    same = spark.createDataFrame([(1, 700, "s", 5)] * 900 + [(None, 10, None, None)] * 300, "doc_id long, size long, source string, cluster long")
    x = packing.pack(same, F.col("size"), F.col("source"), F.col("cluster"), group=300).collect()
    assert len(x) == 1200 and len({(r["pack"], r["bin"]) for r in x if r["key"] == 1}) == 900 and len({r["pack"] for r in x}) == 4
    sized = packing.pack(odd, word_count(F.col("text")), F.col("source"), F.xxhash64("text")).collect()
    assert sum(r["length"] for r in sized) == sum(r["n"] for r in odd.select(word_count(F.col("text")).alias("n")).collect())
    assert packing.pack(odd.limit(0), F.lit(3), F.col("source"), F.lit(1)).isEmpty()


# language


def test_language(spark, odd):
    rng = random.Random(2)
    alphabets = {"xx": "abcdefgh", "yy": "ijklmnop", "zz": "qrstuvéü"}
    rows = [(i, prose(rng.randint(3, 60), rng, alphabets[k]), k) for i, k in enumerate(rng.choices(list(alphabets), k=300))]
    d = spark.createDataFrame(rows + [(900, None, "xx"), (901, "abc", None), (902, "12 !", "yy")], "doc_id long, text string, lang string")
    model = langid.train(d.where("doc_id % 4 <> 2 or doc_id > 300"))
    found = {r["doc_id"]: r["l"] for r in d.select("doc_id", langid.identify(model, F.col("text")).alias("l")).collect()}
    assert sum(found[i]["lang"] == k for i, _, k in rows if i % 4 == 2) >= 0.97 * sum(i % 4 == 2 for i, _, _ in rows)
    assert found[900]["lang"] == found[902]["lang"] == "und" and found[900]["rejected"] and found[900]["score"] == 0
    assert all(0 <= x["score"] <= 1 for x in found.values())
    again = langid.train(d.where("doc_id % 4 <> 2 or doc_id > 300").repartition(5))
    assert np.array_equal(again.centroids, model.centroids)
    assert langid.has_letter("1é") and not langid.has_letter("1²!") and not langid.has_letter(None)
    foreign = spark.createDataFrame([(1, "wwwxxxyyyzzz " * 30)], "doc_id long, text string")
    assert foreign.select(langid.identify(model, F.col("text")).alias("l")).first()["l"]["rejected"]
    for m in (model, langid.train(d.limit(0))):
        assert odd.select(langid.identify(m, F.col("text")).alias("l")).count() == odd.count()
        assert langid.keep_identified(odd, m).columns == odd.columns
    assert langid.keep_identified(odd.limit(0), model).isEmpty()


def test_a_language_left_out_is_rejected_and_clean_documents_stay(spark):
    rng = random.Random(4)
    # languages with letters in common but words of their own
    lexicon = {k: ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 8))) for _ in range(150)] for k in ("xx", "yy", "zz")}
    rows = [(i, " ".join(rng.choices(lexicon[k], k=rng.randint(20, 80))), k) for i, k in enumerate(rng.choices(list(lexicon), k=900))]
    odd = [(2000 + i, t, k) for k in lexicon for i, t in enumerate(["12 !", "qq", "This.", "ww " * 40])]
    odd += [(3000 + i, " ".join(rng.choices(lexicon[a], k=50)), b) for i, (a, b) in enumerate([("xx", "yy"), ("yy", "zz"), ("zz", "xx")])]  # mislabelled
    d = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    for out in lexicon:
        model = langid.train(d.where((F.col("lang") != out) & ((F.col("doc_id") % 4 != 2) | (F.col("doc_id") >= 2000))))
        rejected = {k: [r for (i, t, x), r in zip(rows, model.predict([t for _, t, _ in rows])[3]) if x == k and i % 4 == 2] for k in lexicon}
        assert model.radius[:, 4:].min() > 0 and np.mean(rejected[out]) > 0.95
        assert sum(sum(rejected[k]) for k in lexicon if k != out) <= 1
    model = langid.train(d)
    short = [" ".join(rng.choices(lexicon[k], k=4)) for k in lexicon for _ in range(100)]
    foreign = ["".join(rng.choice("nopqrstuv") for _ in range(14)) for _ in range(100)]
    assert np.mean(model.predict(short)[3]) < 0.05 and np.mean(model.predict(foreign)[3]) > 0.8
    langs, score, cosine, _ = model.predict(["q", "日本"])
    assert langs == ["xx"] * 2 and (cosine == 0).any() and (score > 0).all()


def test_chunked_grams(monkeypatch):
    text = prose(300)
    whole = langid.grams(text)
    monkeypatch.setattr(langid, "CHUNK", 17)
    assert np.array_equal(langid.grams(text), whole)


def test_units_are_encoded_as_in_their_texts(monkeypatch):
    monkeypatch.setattr(tokenbin, "CACHE", 50)
    code, rng = tokenbin.Encoder(queries.tokenizer_path()), random.Random(1)
    parts = ["a", "Be", " ", "  ", "\n", "\t", "'", "'s", "'ll", "1", "²", "é", "́", "\xa0", "　", "日", "!", '"', "\x1c", "\x85", "А", "<|endoftext|>", "\r\n", "🙂", "\xad", "\x00", "԰", "​"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(3000)]
    for at in range(0, len(texts), 100):
        ids, n = code.encode(pa.array(texts[at : at + 100]))
        want = [e.ids for e in code.tokenizer.encode_batch(texts[at : at + 100], add_special_tokens=False)]
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want


def test_token_files_of_long_texts_and_text_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenbin, "CUT", 100)
    monkeypatch.setattr(tokenbin, "CHUNK", 40)
    code = tokenbin.Encoder(queries.tokenizer_path())
    texts = ["", prose(300), "x" * 500, "é " * 200, prose(5), "12 <|endoftext|> " * 20, prose(80)]
    batch = pa.RecordBatch.from_arrays([pa.array([f"k{i}" for i in range(len(texts))]), pa.array(texts)], ["key", "text"])

    class Task:
        get = staticmethod(lambda: type("T", (), {"partitionId": lambda self: 0})())

    monkeypatch.setattr(tokenbin, "TaskContext", Task)
    got = {}
    for b in tokenbin._chunks(iter([batch]), queries.tokenizer_path(), 2):
        (r,) = b.to_pylist()
        ids = tokenbin.unpack(r["ids"]).tolist()
        for k, n in zip(r["keys"], r["counts"]):
            got[k], ids = ids[:n], ids[n:]
        assert not ids
    assert got == {f"k{i}": code.tokenizer.encode(t, add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
