"""The guide design's operators, on small inputs with known or brute-force answers."""

import gzip
import json
import math
import os
import random
import struct
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from protospark.functions import dna
from protospark.operators import annotate, controls, intervals, neighbors, report, scan, scores, targets
from protospark.plans import catalog, design
from protospark.plans.design import Options, attached, flagged_targets, guide_table, nearby, release, unique_targets
from protospark.sources import genomes
from protospark.streaming.scan import stream_targets

RNG = random.Random(4)


def bases(n, rng=RNG):
    return "".join(rng.choice("ACGT") for _ in range(n))


def frame(spark, seqs):
    return spark.createDataFrame([(i, f"s{i}", s) for i, s in enumerate(seqs)], "record_idx long, seqid string, seq string")


def slow_scan(seq, pam, length, three):
    """Both strands by direct comparison: (target, pam, start, strand, context)."""
    seq, n, out = seq.upper(), len(seq), []
    for strand in (True, False):
        text = seq if strand else dna.reverse_complement_text(seq)
        for s in range(n - len(pam) + 1):
            word = text[s : s + len(pam)]
            if not all(w in dna.IUPAC[c] for w, c in zip(word, pam)):
                continue
            a = s - length if three else s + len(pam)
            c = s + len(pam) - 27 if three else s - 3
            guide = text[a : a + length] if a >= 0 else ""
            if len(guide) == length and not set(guide) - set("ACGT"):
                context = text[c : c + 30] if c >= 0 and c + 30 <= n else None
                out.append((guide, word, a if strand else n - a - length, strand, context))
    return sorted(out, key=str)


@pytest.mark.parametrize("pam,three,length", [("NGG", True, 20), ("NGG", False, 20), ("TTTV", False, 21), ("NNGRRT", True, 10), ("CC", True, 12)])
def test_scan_is_the_direct_comparison_at_any_chunk_width(spark, pam, three, length):
    seqs = [bases(700), bases(90) + "N" + bases(60), "GG", "", bases(40).lower() + bases(60), "G" * 80]
    for width in (16, 256):
        found = scan.find_targets(frame(spark, seqs), scan.Pam(pam, "3prime" if three else "5prime"), length, width)
        rows = found.select("record_idx", "target", "exact_pam", "start", "strand", "target_seq30", (F.col("stop") - F.col("start")).alias("n")).collect()
        assert all(r["n"] == length for r in rows)
        for i, s in enumerate(seqs):
            assert sorted((tuple(r)[1:6] for r in rows if r["record_idx"] == i), key=str) == slow_scan(s, pam, length, three)


def plan_of(df):
    """The physical plan before it is made ready for a run: each operator stands in it once."""
    return df._jdf.queryExecution().sparkPlan().toString()


def test_scan_moves_bases_once(spark, tmp_path):
    frame(spark, [bases(500)]).select(F.col("record_idx").alias("doc_id"), F.col("seq").alias("text")).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("pam_scan_3p", "pam_scan_5p"):
        x = catalog.QUERIES[name](spark, str(tmp_path))
        assert plan_of(x).count("Exchange") == 1 and x.count() > 0


def test_scan_of_the_opposite_strand_mirrors(spark):
    s = bases(400)
    a, b = (scan.find_targets(frame(spark, [x]), scan.Pam("NGG")).select("target", "strand").collect() for x in (s, dna.reverse_complement_text(s)))
    assert sorted((r["target"], r["strand"]) for r in a) == sorted((r["target"], not r["strand"]) for r in b)


def test_motifs():
    assert dna.expand_iupac("NGG") == ["GGG", "AGG", "TGG", "CGG"]
    assert dna.iupac_regex("NGRT") == "[ACGT]G[AG]T"
    with pytest.raises(ValueError):
        dna.check_motif("NGZ")
    with pytest.raises(ValueError):
        scan.Pam("NGG", "left")


def test_expressions(spark):
    s = bases(25)
    r = spark.createDataFrame([(s, bases(25))], "a string, b string").select(
        dna.reverse_complement(F.col("a")).alias("rc"), dna.gc_fraction(F.col("a")).alias("gc"), dna.hamming_packed(dna.packed(F.col("a")), dna.packed(F.col("b"))).alias("d"), "b", dna.matches(F.substring("a", 1, 3), "NNN").alias("m")
    ).first()
    assert r["rc"] == dna.reverse_complement_text(s) and r["gc"] == sum(c in "GC" for c in s) / 25 and r["d"] == sum(x != y for x, y in zip(s, r["b"])) and r["m"]


def test_seeds_and_sites(spark):
    g = ["A" * 10 + "CCCCCGGGGT", "T" * 10 + "CCCCCGGGGT", "A" * 10 + "CAGAATCGGT"]
    rows = [(0, "s", g[0], "AGG", 50, 70, False, False, None), (0, "s", g[1], "AGG", 90, 110, True, False, None), (1, "t", g[2], "AGG", 0, 20, True, False, None)]
    t = spark.createDataFrame(rows, "record_idx long, seqid string, target string, exact_pam string, start int, stop int, strand boolean, pam_orientation boolean, target_seq30 string")
    x = targets.flag_restriction_sites(t, ["GATTC"])
    assert {r["target"] for r in x.where("hasrestrictionsite").collect()} == {g[2]}  # on the other strand
    assert targets.flag_restriction_sites(t, []).where("hasrestrictionsite").isEmpty()
    y = targets.flag_seeds(x, 10, "3prime")
    assert {r["target"] for r in y.where("isseedduplicated").collect()} == {g[0]}  # the forward strand comes first
    assert targets.flag_seeds(x, 10, "3prime", strict=True).where("isseedduplicated").count() == 2
    assert targets.flag_seeds(x, 0, "3prime").where("isseedduplicated").isEmpty()
    assert targets.export_bed(y).count() == 2
    assert targets.raw_guides(y).columns == ["Chromosome", "Start", "Stop", "gRNA", "Strand"]


@pytest.mark.parametrize("orientation,lsr,strict", [("3prime", 3, False), ("5prime", 4, True), ("3prime", 0, False)])
def test_first_of_seeds_is_what_the_flag_leaves(spark, orientation, lsr, strict):
    found = scan.find_targets(frame(spark, [bases(900), bases(900), "ACGTTGCAGG" * 30]), scan.Pam("NGG", orientation), 12).repartition(3)
    wanted = targets.flag_seeds(found, lsr, orientation, strict).where("not isseedduplicated")
    x = targets.first_of_seeds(found, lsr, orientation, strict)
    assert sorted(x.select(*wanted.columns).collect(), key=str) == sorted(wanted.collect(), key=str) != []
    assert "Join" not in plan_of(x)  # what joins reads the scan twice, or keeps it
    batches = pa.Table.from_pylist([{"seedseq": s, "record_idx": 0, "strand": True, "start": i, "_n": 1} for i, s in enumerate("ABACABADCB")])
    fields = [f.with_nullable(f.name != "_n") for f in batches.schema]  # as Spark sends it
    batches = batches.cast(pa.schema(fields)).to_batches(max_chunksize=2)
    for at_once in (1, 4, 100):
        some = pa.Table.from_batches(targets._combined(iter(batches), at_once)).to_pylist()
        assert {s: min(r["start"] for r in some if r["seedseq"] == s) for s in "ABCD"} == {"A": 0, "B": 1, "C": 3, "D": 7} and sum(r["_n"] for r in some) == 10


def test_unique_targets_keep_no_scan(spark):
    release()
    seqs = frame(spark, [bases(900)])
    for o in (Options(), Options(enzymes=("NGRT",), drop_sites=True), Options(strict_seeds=True, lsr=4)):
        wanted = flagged_targets(seqs, o).where("not isseedduplicated")
        x = unique_targets(seqs, o)
        assert sorted(x.select(*wanted.columns).collect()) == sorted(wanted.collect()) != []
        assert x.storageLevel.useMemory
    release()


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("dtype", ["hamming", "leven"])
def test_knn_over_tiles(spark, dtype):
    pool = [bases(12) for _ in range(60)] + ["ACGTACGTACGT", "CGTACGTACGTA"]
    t = spark.createDataFrame([(p,) for p in pool * 2], "target string")
    found = neighbors.knn(t, t, 4, dtype, tile=17)
    d = (lambda a, b: sum(x != y for x, y in zip(a, b))) if dtype == "hamming" else levenshtein
    for r in neighbors.neighbor_lists(found).collect():
        assert [(n["dist"], n["seq"]) for n in r["neighbors"]] == sorted((d(r["target"], p), p) for p in set(pool))[:4]
    assert neighbors.recall(found, found).first()["recall"] == 1.0


@pytest.mark.parametrize("length", [6, 10, 20, 27])
def test_pool_index_is_brute_force(monkeypatch, length):
    monkeypatch.setattr(neighbors, "SMALL", 10)
    rng = np.random.default_rng(length)
    some = rng.integers(0, 4**length, 1500, dtype=np.uint64)
    near = some[:300] ^ np.array([sum(int(v) << 2 * int(a) for a, v in zip(rng.permutation(length)[:n], rng.integers(1, 4, n))) for n in rng.integers(1, 6, 300)], np.uint64)
    pool = neighbors.Pool(np.unique(np.concatenate([some, near])), length)
    q = np.concatenate([some[:200], rng.integers(0, 4**length, 50, dtype=np.uint64)])
    d = neighbors.distances(q[:, None], pool.codes).astype(int)
    for k in (1, 2, 5, 4000):
        who, place, dist = pool.nearest(q, k)
        got = sorted(zip(who.tolist(), dist.tolist(), place.tolist()))
        assert got == [(i, int(d[i, j]), int(j)) for i in range(len(q)) for j in np.lexsort((np.arange(d.shape[1]), d[i]))[:k]]
    for reach in (0, 2, 3, 5, 8, 9):
        assert sorted(zip(*map(np.ndarray.tolist, pool.within(q, reach)))) == [(i, j, int(d[i, j])) for i, j in zip(*np.nonzero(d <= reach))]
    assert not len(neighbors.Pool(np.zeros(0, np.uint64), length).nearest(q, 3)[0])
    assert neighbors.letters(q[:3], length).to_pylist() == ["".join("ACGT"[int(c) >> 2 * (length - 1 - i) & 3] for i in range(length)) for c in q[:3]]


def test_close_pairs_and_min_distance(spark):
    pool = list({bases(10) for _ in range(400)} | {"ACGTACGTAC", "ACGTACGTAA", "CCGTACGTAA"})
    t = spark.createDataFrame([(p,) for p in pool], "target string")
    near = {(a, b) for a, b in product(pool, pool) if 0 < sum(x != y for x, y in zip(a, b)) <= 3}
    rows = neighbors.close_pairs(t, 10, 3).collect()
    assert len(rows) == len(near) and {(r["target"], r["other"]) for r in rows} == near
    far = neighbors.min_distance_filter(t, 10, 4)
    assert {r["target"] for r in far.collect()} == set(pool) - {a for a, _ in near}
    lists = neighbors.neighbor_lists(neighbors.knn(t, t, 3))
    assert {r["target"] for r in neighbors.keep_distant(lists, 4).collect()} == set(pool) - {a for a, _ in near}
    alone = neighbors.neighbor_lists(neighbors.knn(t.limit(1), t.limit(1), 3))
    assert neighbors.keep_distant(alone, 5).count() == 1


def test_a_pool_is_dealt_to_few_tiles_of_queries(spark):
    """Copies of the pool are what a search writes to disk: 62 here with tiles of 2^14 queries."""
    q, p = (spark.range(n).select(F.col("id").alias("code")) for n in (1_000_000, 1000))
    rows = neighbors._meet(q, p, ["code"], neighbors.ASKING, neighbors.POOL).agg(F.count_if("asks").alias("a"), F.count_if(~F.col("asks")).alias("b")).agg(F.sum("a"), F.sum("b")).first()
    assert rows[0] == 1_000_000 and rows[1] <= 16 * 1000


def test_a_guide_table_keeps_no_scan(spark):
    release()
    seqs = frame(spark, [bases(900)])
    f = spark.createDataFrame([("s0", 300, 400, "+", "f")], "chrom string, fs int, fe int, fstrand string, feature string")
    guide_table(seqs, f, None, Options())
    assert design._kept and not [x for x in design._kept if "target_seq30" in x.columns and "seedseq" not in x.columns]
    release()


def slow_nearest(g, feats):
    d = lambda f: f[0] - g[1] + 1 if f[0] >= g[1] else -(g[0] - f[1] + 1) if f[1] <= g[0] else 0
    up = min(((-d(f), f) for f in feats if d(f) <= 0), default=None)
    down = min(((d(f), f) for f in feats if d(f) > 0), default=None)
    up = (-up[0], up[1]) if up else None
    return {k: v for k, v in (("downstream", down or up), ("upstream", up)) if v}


@pytest.mark.parametrize("width", [7, 64, 1 << 14])
def test_nearest_is_the_quadratic_form(spark, width):
    rng = random.Random(width)
    feats = [(s, s + rng.randint(1, 40), f"f{i}") for i, s in enumerate(rng.choices(range(50, 900), k=25))]
    feats += [(feats[0][0], feats[0][1], "twin"), (300, 700, "long")]
    guides = [(s, s + 20) for s in rng.sample(range(0, 1000), 60)]
    g = spark.createDataFrame([("c", a, b, i) for i, (a, b) in enumerate(guides)] + [("other", 5, 25, 999)], "chrom string, gs int, ge int, id int")
    f = spark.createDataFrame([("c", *x) for x in feats], "chrom string, fs int, fe int, feature string")
    found = {}
    for r in intervals.nearest(g, f, width).collect():
        found.setdefault(r["id"], {})[r["direction"]] = (r["distance"], (r["fs"], r["fe"], r["feature"]))
    assert found == {i: w for i, x in enumerate(guides) if (w := slow_nearest(x, feats))}


def features_read(df):
    return sum("ExistingRDD" in line and "fe#" in line for line in plan_of(df).splitlines())


def test_nearest_deals_features_once(spark):
    g = spark.createDataFrame([("c", 5, 25, 1)], "chrom string, gs int, ge int, id int")
    f = spark.createDataFrame([("c", 9, 20, "f")], "chrom string, fs int, fe int, feature string")
    x = intervals.nearest(g, f)
    assert 1 <= features_read(x) <= 2  # once to be dealt by bin, once for the edges of bins
    assert sorted((r["direction"], r["feature"], r["distance"]) for r in x.collect()) == [("downstream", "f", 0), ("upstream", "f", 0)]
    assert x.schema["fs"].dataType.simpleString() == "int"


def test_positional_filter(spark):
    rows = [(s, s + 20, gs, 500, 600, fs) for s in range(350, 760, 3) for gs in "+-" for fs in "+-"]
    x = spark.createDataFrame(rows, "gs int, ge int, gstrand string, fs int, fe int, fstrand string").withColumn("distance", intervals.distance())
    b, a = 70, 50

    def wanted(gs, ge, gst, fs, fe, fst, d):
        return any((gst == fst and 0 < d < b, gst == fst == "+" and d == 0 and ge - fs < a, gst == fst == "-" and d == 0 and fe - gs < a, gst + fst == "-+" and 0 < fs - ge < b, gst + fst == "+-" and 0 < gs - fe < b, gst + fst == "-+" and 0 < ge - fs < a, gst + fst == "+-" and 0 < fe - gs < a))

    for r in x.withColumn("ok", intervals.near_start(b, a)).collect():
        assert r["ok"] == wanted(*tuple(r)[:7]), r
    behind = x.where("gstrand = '-' and fstrand = '-' and distance > 0")
    assert not behind.where(intervals.near_start(b, a)).isEmpty() and behind.where(intervals.near_start(b, a, stranded=True)).isEmpty()


def test_cfd(spark):
    w = scores.rule_weights()
    assert len(w) == 240
    t = spark.createDataFrame([("GCATGCACAGCTAGCATGCATGCAGCT", "GCATGCACAGCTAGCATGCATGCAGCG"), ("A" * 20, "A" * 20), ("AACCGGTTAC", "TACCGGTTAC"), ("AC", "A")], "a string, b string")
    got = [r["s"] for r in t.select(scores.cfd(F.col("a"), F.col("b"), w).alias("s")).collect()]
    assert got[0] == pytest.approx(w["rU:dC,20"]) and got[1] == 1 and got[2] == pytest.approx(w["rA:dA,11"]) and got[3] is None


def test_on_target_features(spark):
    s = bases(25) + "GG" + bases(3)
    t = spark.createDataFrame([(s,), (bases(25) + "AA" + bases(3),), (None,)], "target_seq30 string")
    rows = [r["f"] for r in t.select(scores.on_target_features(F.col("target_seq30")).alias("f")).collect()]
    assert len(rows[0]) == 627 and rows[1] is None and rows[2] is None
    hot = rows[0][:120]
    assert ["ATCG"[hot[4 * i : 4 * i + 4].index(1)] for i in range(30)] == list(s)
    assert rows[0][120:124] == [s.count(b) for b in "ATCG"] and sum(rows[0][124:588]) == 29 and sum(rows[0][588:604]) == 29
    gc = sum(c in "GC" for c in s[4:24])
    assert rows[0][604:607] == [float(gc > 10), float(gc < 10), gc]
    assert rows[0][607:623].index(1) == "ACGT".index(s[24]) * 4 + "ACGT".index(s[27])
    out = scores.on_target_scores(t, None).collect()
    assert {(r["Efficiency"], r["efficiency_status"]) for r in out} == {(None, "no model")}


def test_features_of_texts_of_any_length(spark):
    """Features that are computed a batch at a time, for texts of several lengths, with other letters, and for none."""
    texts = [bases(30), bases(30), bases(12), "A", "", "ACGN" * 7 + "AA", "A" * 30, None, bases(40)]
    t = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "i int, s string").coalesce(1)
    s = F.col("s")
    x = t.select("i", "s", scores.melting(s).alias("tm"), F.array(*scores.pair_counts(s)).alias("pairs"), scores.one_hot(s, 1, 30).alias("hot"), scores.one_hot(s, 2, 29, text=True).alias("words"), scores.nggx(s).alias("nggx"), scores.nggx_place(s).alias("place"), scores.gc_count(s).alias("gc"), F.array(*scores.base_counts(s)).alias("n"))
    for r in x.collect():
        text = r["s"]
        if text is None:
            assert all(r[c] is None for c in ("tm", "hot", "words", "nggx", "place"))
            continue
        steps = [text[k : k + 2] for k in range(len(text) - 1)]
        assert r["pairs"] == [steps.count(p) for p in scores.PAIRS] and r["n"] == [text.count(b) for b in "ATCG"]
        assert r["hot"] == [float(text[k : k + 1] == b) for k in range(30) for b in "ATCG"]
        assert r["words"] == "".join(str(int(text[k : k + 2] == p)) for k in range(29) for p in scores.PAIRS)
        ends = text[24:25] + text[27:28]
        place = ["".join(p) for p in product("ACGT", repeat=2)].index(ends) if len(ends) == 2 and "N" not in ends else None
        assert r["place"] == place and r["nggx"] == [float(k == place) for k in range(16)] and r["gc"] == sum(c in "GC" for c in text[4:24])
        assert (r["tm"] is None) == (not steps or "N" in text)
        if steps and "N" not in text:
            ends = sum(text[k] in "AT" for k in (0, -1))
            h, e = (scores.INITIAL[k] + ends * scores.TERMINAL_AT[k] + sum(scores.STACKS[w][k] for w in steps) for k in (0, 1))
            assert r["tm"] == pytest.approx(1000 * h / (e + 0.368 * len(steps) * math.log(0.05) + 1.987 * math.log(12.5e-9)) - 273.15, abs=1e-9)


def test_features_take_no_expression_per_letter(spark):
    """Lambda functions of Spark are interpreted for each element: 16 to 464 of them a row."""
    t = spark.createDataFrame([(bases(30),)], "s string")
    s = F.col("s")
    for made in ([scores.on_target_features(s)], scores.pair_counts(s), [scores.melting(s)], [scores.one_hot(s, 2, 29, text=True)], [scores.nggx(s)], [scores.nggx_place(s)]):
        assert "lambda" not in plan_of(t.select(*made))
    for name in ("on_target_features", "dinuc_counts", "onehot_order1", "onehot_order2", "nggx", "tm_features", "tm_segments"):
        plan = plan_of(catalog.QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert "lambda" not in plan.split("MapInArrow find")[0] and "REPARTITION_BY_NUM" not in plan


def test_density_takes_places_within_five_bandwidths_only(spark):
    """Places on the very edge: a quotient's rounding let in grid points that lie just beyond."""
    places = [(f"c{extent}", pos, extent) for extent, pos in ((188, 183), (207, 202), (356, 346), (375, 365), (300, 150))]
    found = report.density(spark.createDataFrame(places, "chrom string, pos int, extent int"), 20)
    wanted = {(c, x) for c, pos, extent in places for x in (1 + k * ((extent - 1) / 19) for k in range(20)) if abs(x - pos) <= 5 * max(1, math.floor(extent / 200 + 0.5))}
    assert {(r["chrom"], r["x"]) for r in found.collect()} == wanted


def test_controls(spark):
    seqs = frame(spark, [bases(900)])
    found = scan.find_targets(seqs, scan.Pam("NGG"))
    out, stats = controls.controls(seqs, found, n=20, ladder=(2, 4), enough=21)
    rows = out.collect()
    assert len(rows) == 20 and out.columns == ["name", "Sequences", "Hamming distance"] and rows[0]["name"].startswith("Cont-")
    assert stats["min"] == min(r["Hamming distance"] for r in rows)
    again, _ = controls.controls(seqs, found, n=20, ladder=(2, 4), enough=21)
    assert sorted(rows) == sorted(again.collect())


GENBANK = """LOCUS       X1 60 bp DNA
VERSION     X1.1
FEATURES             Location/Qualifiers
     source          1..60
     CDS             complement(join(4..10,
                     20..>30))
                     /locus_tag="T_1"
                     /product="a long
                     name"
                     /note="one"
                     /note="two"
                     /translation="MK
                     V"
     gene            <5..9
ORIGIN
        1 acgtacgtac gtacgtacgt
       21 acgtacgtac
//
"""


def test_files(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">r1 some text\nacgt\nNNac\n>r2\n\n>r3\nTT\n")
    with gzip.open(tmp_path / "b.bin", "wt") as f:
        f.write(">z\nggg\n")
    rows = genomes.read_sequences(spark, [str(tmp_path / "a.fasta"), str(tmp_path / "b.bin")]).orderBy("record_idx").collect()
    assert [(r["seqid"], r["seq"]) for r in rows] == [("r1", "ACGTNNAC"), ("r2", ""), ("r3", "TT"), ("z", "GGG")]
    (tmp_path / "x.gbk").write_text(GENBANK)
    assert [(r["seqid"], len(r["seq"])) for r in genomes.read_sequences(spark, [str(tmp_path / "x.gbk")], "genbank").collect()] == [("X1.1", 30)]
    (r,) = genomes.read_genbank_features(spark, [str(tmp_path / "x.gbk")]).collect()
    assert (r["chrom"], r["fs"], r["fe"], r["fstrand"]) == ("X1.1", 3, 30, "-")
    assert r["qualifiers"] == {"locus_tag": ["T_1"], "product": ["a long name"], "note": ["one", "two"], "translation": ["MKV"]}
    assert genomes.read_genbank_features(spark, [str(tmp_path / "x.gbk")], ("gene",)).first()["fs"] == 4
    (tmp_path / "n.gff").write_text("##gff-version 3\nc\ts\tCDS\t11\t20\t.\t+\t0\tID=a;name=b=c; ;junk\nc\ts\tgene\t1\t2\t.\t-\t.\tID=g\n")
    (tmp_path / "n.gtf").write_text('#gtf-version 2\nc\ts\tCDS\t11\t20\t.\t+\t0\tgene_id "g1"; note "n"\n')
    assert genomes.sniff_annotation(str(tmp_path / "n.gff")) == "gff" and genomes.sniff_annotation(str(tmp_path / "n.gtf")) == "gtf"
    with pytest.raises(ValueError):
        genomes.sniff_annotation(str(tmp_path / "a.fasta"))
    lines = genomes.read_lines(spark, [str(tmp_path / "n.gff")])
    assert [(r["fs"], r["fe"]) for r in annotate.gff_features(lines).collect()] == [(10, 20)]
    assert annotate.gff_features(lines, one_based=False).first()["fs"] == 11
    assert sorted((r["key"], r["value"]) for r in annotate.attributes(lines, "gff").collect()) == [("ID", "a"), ("ID", "g"), ("name", "b")]
    gtf = annotate.attributes(genomes.read_lines(spark, [str(tmp_path / "n.gtf")]), "gtf")
    assert sorted((r["key"], r["value"]) for r in gtf.collect()) == [("gene_id", "g1"), ("note", "n")]


def test_options():
    for bad in ({"lsr": 21}, {"pam": "N"}, {"length": 28}, {"knum": 1}, {"dist": 6}, {"before": 0}):
        with pytest.raises(ValueError):
            Options(**bad)


def test_guide_table(spark):
    seqs = frame(spark, [bases(1500), bases(800)])
    f = spark.createDataFrame([(f"s{i % 2}", s, s + 90, "+-"[i % 3 == 0], f"F{i}") for i, s in enumerate(range(100, 780, 110))], "chrom string, fs int, fe int, fstrand string, feature string")
    q = spark.createDataFrame([(f"F{i}", f"L{i}") for i in range(4)], "`Feature id` string, locus_tag string")
    t = guide_table(seqs, f, q, Options(), weights=scores.rule_weights(), scored=True)
    rows = t.collect()
    assert rows and t.columns[:3] == ["Feature id", "Guide name", "Guide sequence"] and "Efficiency" in t.columns and "target_seq30" not in t.columns
    for r in rows:
        assert r["Guide end"] - r["Guide start"] == 19 and r["Similar guides"][0] == r["Guide sequence"] and r["Similar guide distances"][1] >= 2
        assert 0 <= r["Max CFD"] < 1
    only = guide_table(seqs, f, q, Options(attributes=("L1",))).collect()
    assert {r["Feature id"] for r in only} == {"F1"}
    with pytest.raises(ValueError):
        guide_table(seqs, f, None, Options(attributes=("L1",)))
    assert flagged_targets(frame(spark, ["ACGT"]), Options()).isEmpty()


def test_stream(spark, tmp_path):
    frame(spark, [bases(300), bases(300)]).write.parquet(str(tmp_path / "in"))
    seqs = spark.readStream.schema("record_idx long, seqid string, seq string").parquet(str(tmp_path / "in"))
    q = stream_targets(seqs, scan.Pam("NGG")).writeStream.format("memory").queryName("streamed").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    batch = scan.find_targets(spark.read.parquet(str(tmp_path / "in")), scan.Pam("NGG")).select(F.right("target", F.lit(10)).alias("seedseq")).distinct()
    assert spark.table("streamed").count() == batch.count() > 0


@pytest.mark.parametrize(
    "text,place",
    [
        ("190..255", (189, 255, "+")), ("12", (11, 12, "+")), ("<5..9", (4, 9, "+")), ("5..>9", (4, 9, "+")), ("5^6", (5, 5, "+")),
        ("join(4..10,20..30)", (3, 30, "+")), ("complement(join(4..10,20..>30))", (3, 30, "-")), ("join(complement(20..30),complement(4..10))", (3, 30, "-")),
        ("order(1..2,\n   7..8)", (0, 8, "+")), ("(3.6)..9", (2, 9, "+")), ("one-of(3,5)..9", (2, 9, "+")), ("102.110", (101, 110, "+")),
        ("join(X1.1:3..900,2..4)", (1, 4, "+")), ("X1.1:3..9", None), ("complement(join(2..3,complement(7..9)))", (1, 9, "-")),
    ],
)
def test_locations(text, place):
    assert genomes.parse_location(text) == place
    for bad in ("", "..5", "3..", "a..b", "1..2..3", "join(1..2,x)"):
        with pytest.raises(ValueError):
            genomes.parse_location(bad)


def genbank(name, seq, feats):
    lines = [f"LOCUS       {name} {len(seq)} bp DNA", f"VERSION     {name}.1", "FEATURES             Location/Qualifiers"]
    for kind, place, tag in feats:
        lines += [f"     {kind:<16}{place}", f'                     /locus_tag="{tag}"']
    lines += ["ORIGIN", *(f"{i + 1:>9} " + " ".join(seq[i + k : i + k + 10].lower() for k in range(0, 60, 10)) for i in range(0, len(seq), 60)), "//"]
    return "\n".join(lines) + "\n"


def test_annotated_genome_from_file_to_table(spark, tmp_path):
    seq = bases(3000, random.Random(20))
    places = {"t1": ("300..900", 299, 900, "+"), "t2": ("complement(1000..1400)", 999, 1400, "-"), "t3": ("join(1500..1600,1700..2000)", 1499, 2000, "+"), "t4": ("complement(<2200..2900)", 2199, 2900, "-")}
    (tmp_path / "g.gbk").write_text(genbank("G1", seq, [("CDS", p[0], t) for t, p in places.items()] + [("gene", "1..3000", "g")]))
    for path in (str(tmp_path / "g.gbk"), "file://" + str(tmp_path / "g.gbk")):
        f = genomes.read_genbank_features(spark, [path])
        assert {r["qualifiers"]["locus_tag"][0]: (r["fs"], r["fe"], r["fstrand"]) for r in f.collect()} == {t: p[1:] for t, p in places.items()}
        seqs = genomes.read_sequences(spark, [path], "genbank")
        assert [tuple(r) for r in seqs.collect()] == [(0, "G1.1", seq)]
    q = f.select(F.col("feature").alias("Feature id"), F.col("qualifiers")["locus_tag"][0].alias("locus.tag"))
    o = Options(before=100, into=150)
    rows = guide_table(seqs, f.select("chrom", "fs", "fe", "fstrand", "feature"), q, o).collect()
    feats = [(*p[1:3], t, p[3]) for t, p in places.items()]
    found = flagged_targets(seqs, o).where("not isseedduplicated and length(target_seq30) = 30").collect()
    want = set()
    for g in found:
        for d, (a, b, tag, strand) in slow_nearest((g["start"], g["stop"]), feats).values():
            own, near = "+" if g["strand"] else "-", d
            into = g["stop"] - a < 150 if strand == "+" else b - g["start"] < 150
            if own == strand:
                hit = 0 < near < 100 or near == 0 and into
            elif strand == "+":
                hit = 0 < a - g["stop"] < 100 or 0 < g["stop"] - a < 150
            else:
                hit = 0 < g["start"] - b < 100 or 0 < b - g["start"] < 150
            if hit:
                want.add((g["target"], g["start"] + 1, tag))
    lists = {r["target"]: r["neighbors"][1]["dist"] for r in neighbors.neighbor_lists(neighbors.knn(flagged_targets(seqs, o), flagged_targets(seqs, o), 2)).collect()}
    assert {(r["Guide sequence"], r["Guide start"], r["locus.tag"]) for r in rows} == {w for w in want if lists[w[0]] >= 2} != set()
    only = guide_table(seqs, f.select("chrom", "fs", "fe", "fstrand", "feature"), q, Options(before=100, into=150, attribute_key="locus.tag", attributes=("t3",)))
    assert {r["locus.tag"] for r in only.collect()} == {"t3"}
    release()


#: A GenBank file of record AP009180.1 (159,662 bases), if there is one.
GENOME = os.environ.get("ANNOTATED_GENOME", "")


@pytest.mark.skipif(not os.path.isfile(GENOME), reason="no annotated genome given")
@pytest.mark.parametrize("side,rows", [("5prime", 900), ("3prime", 944)])
def test_a_published_genome(spark, side, rows):
    f = genomes.read_genbank_features(spark, [GENOME])
    seqs, o = genomes.read_sequences(spark, [GENOME], "genbank"), Options(orientation=side)
    q = annotate.qualifier_table(f.select(F.col("feature").alias("feature_id"), F.explode("qualifiers").alias("key", "values")).select("feature_id", "key", F.explode("values").alias("value")), without=())
    assert f.count() == 182 and q.count() == 182 and len(q.columns) == 8
    f = f.select("chrom", "fs", "fe", "fstrand", "feature")
    table = guide_table(seqs, f, q, o)
    assert table.count() == rows
    if side == "5prime":
        assert nearby(flagged_targets(seqs, o), f.drop("fstrand")).count() == 7074
        assert table.where("locus_tag = 'CRP_001'").count() == 4
    release()


def test_records_of_one_name_stay_apart(spark):
    one, two = bases(600), bases(600)
    seqs = spark.createDataFrame([(0, "c", one), (1, "c", two)], "record_idx long, seqid string, seq string")
    f = spark.createDataFrame([("c", 100, 400, "+", "F")], "chrom string, fs int, fe int, fstrand string, feature string")
    x = flagged_targets(seqs, Options())
    assert attached(x, f, Options()).groupBy("record_idx", "start", "strand", "direction").count().where("count > 1").isEmpty()
    release()


def test_published_weight(spark, tmp_path):
    (tmp_path / "w.json").write_text(json.dumps({"mm": {"rU:dC,20": 0.176470588, "rA:dG,1": 0.9}, "pam": {"GG": 1.0}}))
    w = scores.load_weights(str(tmp_path / "w.json"))
    t = spark.createDataFrame([("GCATGCACAGCTAGCATGCATGCAGCT", "GCATGCACAGCTAGCATGCATGCAGCG")], "a string, b string")
    assert t.select(scores.cfd(F.col("a"), F.col("b"), w).alias("s")).first()["s"] == pytest.approx(0.176470588, abs=1e-6)


def linear_model(weights):
    """Bytes of an ONNX model y = x W for rows of len(weights) numbers."""

    def part(number, value):
        if isinstance(value, int):
            return varint(number << 3) + varint(value)
        value = value.encode() if isinstance(value, str) else value
        return varint(number << 3 | 2) + varint(len(value)) + value

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def value(name, width):
        shape = part(1, part(2, "N")) + part(1, part(1, width))
        return part(1, name) + part(2, part(1, part(1, 1) + part(2, shape)))

    tensor = part(1, len(weights)) + part(1, 1) + part(2, 1) + part(8, "W") + part(9, struct.pack(f"<{len(weights)}f", *weights))
    node = part(1, "x") + part(1, "W") + part(2, "y") + part(4, "MatMul")
    graph = part(1, node) + part(2, "g") + part(5, tensor) + part(11, value("x", len(weights))) + part(12, value("y", 1))
    return part(1, 8) + part(7, graph) + part(8, part(1, "") + part(2, 13))


def test_scores_by_a_model_and_their_gate(spark, tmp_path):
    weights = [random.Random(i).uniform(-1, 1) / 50 for i in range(627)]
    (tmp_path / "m.onnx").write_bytes(linear_model(weights))
    good = [bases(25) + "GG" + bases(3) for _ in range(7)]
    t = spark.createDataFrame([(s,) for s in [*good, bases(25) + "AA" + bases(3), "N" + good[0][1:], None]], "target_seq30 string")
    for r in scores.on_target_scores(t, str(tmp_path / "m.onnx")).withColumn("f", scores.on_target_features(F.col("target_seq30"))).collect():
        if r["target_seq30"] in good:
            assert r["Efficiency"] == pytest.approx(sum(a * b for a, b in zip(weights, r["f"])), abs=1e-3) and r["efficiency_status"] == "scored"
        else:
            assert r["Efficiency"] is None and r["efficiency_status"] == "no features"
    for more, why in (({"orientation": "5prime"}, "motif is not on the 3prime side"), ({"length": 21}, "guides do not have 20 bases"), ({"pam": "NAG"}, "motif is not NGG")):
        assert {tuple(r)[1:] for r in scores.on_target_scores(t, str(tmp_path / "m.onnx"), **more).collect()} == {(None, why)}


def test_position_words_and_melting(spark):
    """Order-2 one-hot and the four melting temperatures by direct computation from the duplex tables."""
    stack = {"AA": (-6.82, -19.0), "AU": (-9.38, -26.7), "UA": (-7.69, -20.5), "CU": (-10.48, -27.1), "CA": (-10.44, -26.9), "GU": (-11.40, -29.5), "GA": (-12.44, -32.5), "CG": (-10.64, -26.7), "GC": (-14.88, -36.9), "GG": (-13.39, -32.7)}
    turn = str.maketrans("ACGU", "UGCA")

    def tm(dna):
        rna = dna.replace("T", "U")
        steps = [stack.get(rna[i : i + 2]) or stack[rna[i : i + 2].translate(turn)[::-1]] for i in range(len(rna) - 1)]
        weak = (rna[0] in "AU") + (rna[-1] in "AU")
        h, s = 3.61 + 3.72 * weak + sum(x[0] for x in steps), -1.5 + 10.5 * weak + sum(x[1] for x in steps)
        s += 0.368 * (len(rna) - 1) * math.log(0.05)
        return 1000 * h / (s + 1.987 * math.log(12.5e-9)) - 273.15

    seqs = [bases(25) + "GG" + bases(3) for _ in range(5)]
    t = spark.createDataFrame([(s,) for s in seqs], "s string")
    for r in t.select("s", scores.on_target_features(F.col("s")).alias("f")).collect():
        words = [a + b for a in "ATCG" for b in "ATCG"]
        hot = [float(r["s"][i : i + 2] == w) for i in range(29) for w in words]
        assert r["f"][124:588] == hot and r["f"][588:604] == [sum(hot[k::16]) for k in range(16)]
        assert r["f"][623:] == pytest.approx([tm(r["s"][a:b]) for a, b in ((0, 30), (19, 24), (11, 19), (6, 11))], abs=1e-3)


def test_minimum_proportion_and_equal_lines(spark, tmp_path):
    line = "c\ts\tCDS\t11\t20\t.\t+\t0\tID=a;note=n\n"
    (tmp_path / "x.gff").write_text("##gff-version 3\n" + line * 2 + line.replace("ID=a;note=n", "ID=b") + line.replace("\t0\t", "\t1\t"))
    lines = genomes.read_lines(spark, [str(tmp_path / "x.gff")])
    assert lines.count() == 3  # a repeated line is one feature, a line of another phase another
    q = annotate.qualifier_table(annotate.attributes(lines, "gff"), minimum=0.7)
    assert q.columns == ["Feature id", "ID"]


def test_report_of_a_table(spark):
    rows = [("c1", s, s + 19, f, f + 90, d) for s, f, d in [(100, 90, 0), (150, 90, 0), (400, 420, 2), (900, 890, 0)]] + [("c2", 5, 24, 1, 50, 0)]
    t = spark.createDataFrame(rows, "Accession string, `Guide start` int, `Guide end` int, `Feature start` int, `Feature end` int, `Feature distance` int")
    found = report.table_densities(t, 20).collect()
    for kind, k in (("guide", 1), ("feature", 3)):
        own = {r["x"]: r["density"] for r in found if r["chrom"] == "c1" and r["kind"] == kind}
        h, extent = max(1, round(980 / 200)), 980
        for i in range(20):
            x = 1 + i * (extent - 1) / 19
            want = sum(math.exp(-(((x - r[k]) / h) ** 2) / 2) for r in rows if r[0] == "c1" and abs(x - r[k]) <= 5 * h) / (h * math.sqrt(2 * math.pi)) / 4
            assert own.get(x, 0) == pytest.approx(want, abs=1e-9)
    flags = spark.createDataFrame([("A", False, True), ("B", True, False), ("B", True, True)], "target string, isseedduplicated boolean, hasrestrictionsite boolean")
    got = report.design_stats(flags, t, True).first().asDict()
    assert got == {"targets": 3, "distinct_guides": 2, "seed_duplicates": 2, "with_site": 2, "removed": 2, "rows": 5, "zero_distance": 4}
    assert report.accession(t, "c2").count() == 1
