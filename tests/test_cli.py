"""The command line, from files to files; every registered query against its SQL on the smallest tables."""

import json
import os
import random

import pytest

import __spark_entry__
from protospark.__main__ import main, validated
from protospark.operators import scores
from protospark.plans import catalog

DATA = "/root/testdata/sf0.001"


def test_run_writes_tables(spark, tmp_path):
    rng = random.Random(12)
    seq = "".join(rng.choice("ACGT") for _ in range(3000))
    (tmp_path / "g.fasta").write_text(f">c1\n{seq[:2000]}\n>c2\n{seq[2000:].lower()}\n")
    rows = "".join(f"c{1 + i % 2}\tx\tCDS\t{100 + 90 * i}\t{160 + 90 * i}\t.\t{'+-'[i % 2]}\t0\tID=f{i};locus_tag=t{i}\n" for i in range(9))
    (tmp_path / "g.gff").write_text("##gff-version 3\n" + rows)
    (tmp_path / "c.yaml").write_text("CONTROL:\n  MINIMUM_HMDIST: 5\n  CONTROL_SEARCH_MULTIPLE: [2, 4]\nMINIMUM_PROPORTION: 0.2\n")
    (tmp_path / "w.json").write_text(json.dumps({"mm": scores.rule_weights(), "pam": {}}))
    out = str(tmp_path / "out")
    main(["-f", str(tmp_path / "g.fasta"), "-g", str(tmp_path / "g.gff"), "-p", "NGG", "-o", out, "--controls", "5", "--cfd_score", "--cfd_weights", str(tmp_path / "w.json"), "--doench_efficiency_score", "--plot_data", "--config", str(tmp_path / "c.yaml")])
    table = spark.read.csv(f"{out}/targets.csv.gz", header=True)
    assert table.count() > 0 and {"ID", "locus_tag", "Max CFD", "Efficiency", "Similar guides"} <= set(table.columns)
    assert spark.read.csv(f"{out}/controls.csv.gz", header=True).columns == ["index", "name", "Sequences", "Hamming distance"]
    assert spark.read.csv(f"{out}/density.csv.gz", header=True).select("kind").distinct().count() == 2 and spark.read.csv(f"{out}/locus_counts.csv.gz", header=True).count() > 0
    rows = [(r["Accession"], int(r["Feature start"]), int(r["Guide start"]), r["Guide strand"]) for r in table.collect()]
    assert rows == sorted(rows)
    main(["-f", str(tmp_path / "g.fasta"), "-p", "NGG", "-o", out, "--raw_output_only"])
    raw = [(r["Chromosome"], int(r["Start"])) for r in spark.read.csv(f"{out}/rawguides.csv.gz", header=True).collect()]
    assert raw == sorted(raw)
    assert spark.read.csv(f"{out}/rawguides.csv.gz", header=True).columns == ["Chromosome", "Start", "Stop", "gRNA", "Strand"]


@pytest.mark.parametrize("argv", [["-p", "NGG"], ["-f", "x", "-p", "NGG"], ["-f", "x", "-i", "y", "-p", "NGG"], ["-i", "x", "-p", "N"], ["-i", "x", "-p", "NGG", "--lsr", "21"], ["-i", "x", "-p", "NGG", "--cfd_score"]])
def test_wrong_arguments(argv):
    with pytest.raises(ValueError):
        validated([*argv, "-o", "out"])


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_queries(spark, name):
    import duckdb

    out = catalog.QUERIES[name](spark, DATA).toPandas()
    if name not in catalog.ORACLES:
        assert len(out)
        return
    db = duckdb.connect()
    for t in ("benchmark", "documents", "part", "orders"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = db.execute(catalog.ORACLES[name]).df()
    key = lambda f: sorted(map(str, f[sorted(f.columns)].astype(object).where(f.notna(), None).itertuples(index=False, name=None)))
    assert sorted(out.columns) == sorted(want.columns) and key(out) == key(want)


def test_entry(spark):
    if os.path.isdir(DATA):
        assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
