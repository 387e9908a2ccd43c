"""The corpus pipeline, stage by stage, and the registered queries on the smallest tables."""

import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from protospark.llm import jaccard, packing, queries, simhash
from test_operators import DOCS, packing_holds, prose, slow_hits, slow_print, slow_stats, union

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    alphabet = {"en": "abcdefgh", "de": "ijklmnop"}
    rows = []
    for i in range(240):
        lang = ["en", "en", "de"][i % 3]
        rows.append([i, prose(rng.randint(25, 120), rng, alphabet[lang]), lang if i % 7 else None, ["hot", "hot", "b", None][i % 4], 0])
    for i in range(40):
        rows[200 + i][1] = rows[i][1]
    for i in range(20):
        rows[100 + i][1] = " ".join(w + "###" for w in rows[100 + i][1].split())
    rows[150][1], rows[151][1], rows[152][1] = None, "", "1 2 3 " * 20
    d = spark.createDataFrame([tuple(r) for r in rows], ", ".join(DOCS.split(", ")[:5]))
    folder = str(tmp_path_factory.mktemp("corpus"))
    d.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(not 100 <= i < 120), 0) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages(spark, corpus, tmp_path):
    d = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, seen = d.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = d.collect()
        stage(spark, d, corpus).write.parquet(str(tmp_path / name))
        d = spark.read.parquet(str(tmp_path / name))
        after = d.collect()
        seen[name] = (before, after)
        if k < 4:
            assert d.columns == columns
    before, after = seen["language"]
    assert {r["doc_id"] for r in before} - {r["doc_id"] for r in after} == {150, 151, 152}
    before, after = seen["quality"]
    gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
    assert all(s[0] >= 20 and 100 * s[4] <= 30 * s[0] for s in (slow_stats(r["text"]) for r in after))
    assert gone <= set(range(100, 120)) and len(gone) >= 18
    before, after = seen["simhash"]
    fp = {r["doc_id"]: slow_print(r["text"]) for r in before}
    group = union([(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 3], fp)
    assert sorted(r["doc_id"] for r in after) == sorted(set(group.values()))
    before, after = seen["mixing"]
    words = lambda rows: sum(len(r["text"].split()) for r in rows)
    assert words(after) == pytest.approx(words(before), rel=0.1)
    before, after = seen["packing"]
    sizes = {}
    for r in before:
        sizes[r["doc_id"]] = sizes.get(r["doc_id"], 0) + len(r["text"].split()) + 1
    got = {}
    for r in after:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == sizes


def test_stages_take_odd_rows_and_empty_tables(spark, corpus, tmp_path):
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (2, prose(30), None, "x", 1), (2, prose(30), None, "x", 1), (3, "Z" * 400_000 + " " + prose(50_000), "en", "x", 2)], ", ".join(DOCS.split(", ")[:5]))
    for frame in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, frame, corpus).count()


def five(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


@pytest.mark.parametrize("tile", [20, 512])
def test_near_copies_are_all_those_of_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(jaccard, "TILE", tile)
    rng = random.Random(8)
    line = prose(12, rng)
    texts = []
    for n in [3, 5, 6, 9, 14, 30, 60, 120, 400]:
        for _ in range(3):
            base = prose(n, rng).split()
            texts.append(" ".join(base))
            for _ in range(9):
                w = list(base)
                for _ in range(rng.randint(1, 1 + n // 35)):
                    w[rng.choice([0, len(w) - 1, rng.randrange(len(w))])] = prose(1, rng) + "x"
                texts.append(" ".join(w + ([prose(1, rng)] if rng.random() < 0.3 else [])))
    base = prose(60, rng).split()  # a large group of near copies
    for i in range(90):
        w = list(base)
        w[rng.randrange(60)] = f"edit{i}"
        texts.append(" ".join(w))
    texts += [prose(rng.randint(5, 80), rng) + " " + line for _ in range(90)]  # one common line
    texts += [t.upper() for t in texts[:20]] + texts[:20]
    rng.shuffle(texts)
    sets = [five(t) for t in texts]
    group = union([(a, b) for a in range(len(texts)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])], range(len(texts)))
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], ", ".join(DOCS.split(", ")[:5])).repartition(5)
    got = corpus_pipeline.distinct(spark, d, "").collect()
    assert sorted(r["doc_id"] for r in got) == sorted(set(group.values()))
    assert all(r["text"] == texts[r["doc_id"]] for r in got) and got[0].__fields__ == d.columns


def test_texts_that_share_phrases_by_chance_are_no_candidates(spark):
    # every two of 40 long texts share three phrases; no two are similar, but one shared shingle each would connect them all
    rng = random.Random(4)
    phrases = {(i, j): [prose(8, rng) for _ in range(3)] for i in range(40) for j in range(i)}
    texts = [" ".join(x + f" own{i}n{k}" for k, x in enumerate(x for pair, three in phrases.items() if i in pair for x in three)) for i in range(40)]
    near = texts[0].split()
    near[50] = "edit"
    frame = spark.createDataFrame([(i, t.encode()) for i, t in enumerate([*texts, " ".join(near)])], "node long, text binary")
    rows = jaccard.shared(jaccard.index(frame))
    assert {(r["node"], r["component"]) for r in jaccard.clusters(rows).collect()} == {(0, 0), (40, 0)}


def test_tiles_hold_few_long_texts(spark):
    members = spark.createDataFrame([(i, 0, 300_000) for i in range(20)] + [(i, 20, 300) for i in range(20, 40)], "node long, component long, n long")
    k = {(r["component"], r["k"]) for r in jaccard.places(members, False).collect()}
    assert k == {(0, 6), (20, 1)}


def test_near_copies_go_through_fingerprints_and_sets_decide(spark, monkeypatch):
    rng = random.Random(9)
    texts = []
    for _ in range(6):
        base = prose(80, rng).split()
        for edits in (0, 1, 2, 5, 30):
            w = list(base)
            for at in rng.sample(range(80), edits):
                w[at] = prose(1, rng) + "x"
            texts.append(" ".join(w))
    sets = [five(t) for t in texts]
    group = union([(a, b) for a in range(len(texts)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])], range(len(texts)))
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], ", ".join(DOCS.split(", ")[:5]))
    seen, linked = [], simhash.near_duplicates

    def watched(*a):
        seen.append(linked(*a))
        return seen[-1]

    def lump(docs, key, *a):
        return docs.select(F.col(key).alias("key"), F.lit(1).alias("fp"), F.lit(0).cast("long").alias("component"))

    for stand_in in (watched, lump):
        monkeypatch.setattr(simhash, "near_duplicates", stand_in)
        assert sorted(r["doc_id"] for r in corpus_pipeline.distinct(spark, d, "").collect()) == sorted(set(group.values()))
    rows = seen[0].collect()
    assert len(rows) == len(texts) > len({r["component"] for r in rows})


def test_null_and_repeated_ids_lose_only_copies(spark):
    a, b, c, d, e = (prose(30, random.Random(i)) for i in range(5))
    rows = [(None, a), (None, a), (None, b), (7, c), (7, d), (7, d), (None, c), (3, e), (9, e + " x"), (None, ""), (None, None)]
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], ", ".join(DOCS.split(", ")[:5])).repartition(4)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.distinct(spark, frame, "").collect()]
    assert len(got) == 6 and {x for x in got if x[1]} == {(None, a), (None, b), (7, c), (7, d), (3, e)}


def test_run(spark, corpus):
    assert corpus_pipeline.run(spark, corpus).count() > 100


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_queries(spark, name):
    import duckdb

    out = queries.QUERIES[name](spark, DATA).toPandas()
    if name in queries.ORACLES:
        db = duckdb.connect()
        for t in ("documents", "embeddings", "conversations"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
        want = db.execute(queries.ORACLES[name]).df()
        key = lambda f: sorted(map(str, f[sorted(f.columns)].itertuples(index=False, name=None)))
        assert list(sorted(out.columns)) == list(sorted(want.columns)) and key(out) == key(want)
    else:
        assert len(out)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_packing_query(spark):
    d = spark.read.parquet(f"{DATA}/documents.parquet")
    from protospark.llm.common import word_count

    info = [tuple(r) for r in d.select("doc_id", (word_count(F.col("text")) + 1).alias("n"), "source", F.xxhash64("text")).collect()]
    packing_holds(queries.op9_packing(spark, DATA).withColumnRenamed("doc_id", "key").collect(), info, packing.CAPACITY)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_sharding_query(spark):
    d = {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    out = queries.op5_sharding(spark, DATA).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(d) and {(r["law"], r["grown_shard"]) for r in out} == {("rows", None)}
    shards = {}
    for r in out:
        raw = (d[r["doc_id"]]["text"] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))
        shards.setdefault(r["shard"], []).append(r)
    assert set(shards) == set(range(24)) and max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    assert all(sorted(r["slot"] for r in x) == list(range(len(x))) for x in shards.values())
    line = [d[r["doc_id"]] for r in sorted(out, key=lambda r: (r["shard"], r["slot"]))]
    for text in {r["text"] or "" for r in line}:
        at = [i for i, r in enumerate(line) if (r["text"] or "") == text]
        assert at == list(range(at[0], at[0] + len(at)))
    # each shard meets few of the values, which is what readers prune by
    for c, most in (("source", 0.5), ("lang", 0.6)):
        values = {r[c] for r in line}
        met = [len({d[r["doc_id"]][c] for r in x}) for x in shards.values()]
        assert sum(met) / len(met) <= most * len(values)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_quality_query_is_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = queries.op4_quality(spark, DATA).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == slow_stats(texts[r["doc_id"]])
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) and not (r["base_failed"] and r["kept"])


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_language_query(spark, tmp_path):
    from protospark.llm import langid

    known = spark.read.parquet(f"{DATA}/documents.parquet")
    rng = random.Random(3)
    # nothing of held-out rows is learned: they alone have language "zz"
    extra = [(i, prose(40, rng, "wxyz"), "zz") for i in range(100_000, 100_400) if zlib.crc32(str(i).encode()) % 4 == 2] + [(200_001, None, "en"), (200_002, "12 !", "en"), (None, known.first()["text"], None)]
    frame = known.select("doc_id", "text", "lang").unionAll(spark.createDataFrame(extra, "doc_id long, text string, lang string"))
    frame.select("*", F.lit("s").alias("source"), F.lit(0).alias("n_chars")).write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op10_langid(spark, str(tmp_path)).collect()
    langs, right = {r["doc_id"]: r["lang"] for r in frame.collect()}, []
    text = {r["doc_id"]: r["text"] for r in frame.collect()}
    assert len(rows) == len(langs)
    for r in rows:
        assert r["held_out"] is (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 if r["doc_id"] is not None else False)
        assert (r["lang_pred"] == "und") == (not langid.has_letter(text[r["doc_id"]])) and 0 <= r["score"] <= 1 and r["lang_pred"] != "zz"
        if r["held_out"] and langs[r["doc_id"]] not in (None, "zz") and langid.has_letter(text[r["doc_id"]]):
            right.append(r["lang_pred"] == langs[r["doc_id"]])
        if langs[r["doc_id"]] == "zz":
            assert r["rejected"]
    assert sum(right) >= 0.97 * len(right) > 20


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_license_query_is_brute_force(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = {r["doc_id"]: r for r in queries.op8_licenses(spark, DATA).collect()}
    assert set(rows) == set(texts) and sum(r["n_found"] for r in rows.values()) > 0
    for k, r in rows.items():
        want, got = slow_hits(texts[k].encode()), set(filter(None, r["licenses"].split(";")))
        assert got <= set(want) and bool(got) == bool(want) and r["n_found"] == len(r["spans"]) >= len(got)
        assert all(x["end"] <= y["start"] for x, y in zip(r["spans"], r["spans"][1:]))
