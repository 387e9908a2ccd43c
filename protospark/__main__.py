"""Command line: python -m protospark --fasta genome.fa --gff genes.gff --pamseq NGG --outdir out."""

from __future__ import annotations

import argparse
import os
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import annotate, controls, report, scores, targets
from .plans.design import Options, flagged_targets, guide_table, release
from .sources import genomes, sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="protospark", description="Design pools of guide RNAs for a genome.")
    p.add_argument("--genbank", "-i", nargs="+")
    p.add_argument("--fasta", "-f", nargs="+")
    p.add_argument("--gff", "-g", nargs="+", help="GFF or GTF, told by the first line")
    p.add_argument("--pamseq", "-p", required=True)
    p.add_argument("--outdir", "-o", required=True)
    p.add_argument("--raw_output_only", action="store_true")
    p.add_argument("--pam_orientation", "-r", choices=["5prime", "3prime"], default="3prime")
    p.add_argument("--guidelength", "-l", type=int, default=20)
    p.add_argument("--lsr", type=int, default=10)
    p.add_argument("--dtype", choices=["hamming", "leven"], default="hamming")
    p.add_argument("--dist", type=int, default=2)
    p.add_argument("--before", type=int, default=100)
    p.add_argument("--into", type=int, default=200)
    p.add_argument("--knum", type=int, default=5)
    p.add_argument("--controls", type=int, default=1000)
    p.add_argument("--restriction_enzyme_list", nargs="*", default=[])
    p.add_argument("--drop_restriction_sites", action="store_true")
    p.add_argument("--feature_types", nargs="+", default=["CDS"])
    p.add_argument("--attribute_key", default="ID")
    p.add_argument("--filter_by_attribute", nargs="*", default=[])
    p.add_argument("--efficiency_model", help="ONNX model of the on-target score")
    p.add_argument("--doench_efficiency_score", action="store_true")
    p.add_argument("--cfd_score", action="store_true")
    p.add_argument("--cfd_weights", help="JSON of mismatch weights, which --cfd_score needs")
    p.add_argument("--plot_data", action="store_true", help="also write what plots are drawn from")
    p.add_argument("--config", help="YAML: CONTROL (MINIMUM_HMDIST, CONTROL_SEARCH_MULTIPLE), MINIMUM_PROPORTION")
    p.add_argument("--seed", type=int, default=1)
    return p


def validated(argv: list[str] | None = None) -> tuple[argparse.Namespace, Options]:
    a = parser().parse_args(argv)
    if bool(a.genbank) == bool(a.fasta):
        raise ValueError("give either genbank or fasta")
    if a.fasta and not a.gff and not a.raw_output_only:
        raise ValueError("fasta needs gff, unless only raw guides are written")
    if a.cfd_score and not a.cfd_weights:
        raise ValueError("cfd_score needs cfd_weights")
    o = Options(a.pamseq, a.pam_orientation, a.guidelength, a.lsr, a.dtype, a.dist, a.before, a.into, a.knum, a.controls, tuple(a.restriction_enzyme_list), a.drop_restriction_sites, attribute_key=a.attribute_key, attributes=tuple(a.filter_by_attribute))
    return a, o


def settings(path: str | None) -> dict:
    """Search of controls and least proportion of a qualifier, from a YAML file; its other sections tune an index that exact search has no use for."""
    found = {}
    if path:
        import yaml

        with open(path) as f:
            found = yaml.safe_load(f) or {}
    control = found.get("CONTROL") or {}
    return {"ladder": tuple(control.get("CONTROL_SEARCH_MULTIPLE", controls.LADDER)), "enough": control.get("MINIMUM_HMDIST", controls.ENOUGH), "minimum": found.get("MINIMUM_PROPORTION", 0.0)}


def annotation(spark: SparkSession, a: argparse.Namespace, minimum: float = 0.0):
    """Features of the wanted types, and the table of their qualifiers."""
    if a.genbank:
        f = genomes.read_genbank_features(spark, a.genbank, tuple(a.feature_types))
        q = f.select(F.col("feature").alias("feature_id"), F.explode("qualifiers").alias("key", "values")).select("feature_id", "key", F.explode("values").alias("value"))
        return f.select("chrom", "fs", "fe", "fstrand", "feature"), annotate.qualifier_table(q, minimum=minimum)
    lines = genomes.read_lines(spark, a.gff).where(F.col("type").isin(*a.feature_types))
    return annotate.gff_features(lines, tuple(a.feature_types)), annotate.qualifier_table(annotate.attributes(lines, genomes.sniff_annotation(a.gff[0], spark)), minimum=minimum)


def main(argv: list[str] | None = None) -> None:
    a, o = validated(argv)
    spark = SparkSession.builder.appName("protospark").getOrCreate()
    sequences = genomes.read_sequences(spark, a.genbank or a.fasta, "genbank" if a.genbank else "fasta").persist()
    at = lambda name: os.path.join(a.outdir, name)
    found = flagged_targets(sequences, o)
    if a.raw_output_only:
        sinks.write_csv(targets.raw_guides(found).orderBy("Chromosome", "Start", "Strand"), at("rawguides.csv.gz"))
        release()
        sequences.unpersist()
        return
    more = settings(a.config)
    features, qualifiers = annotation(spark, a, more.pop("minimum"))
    weights = scores.load_weights(a.cfd_weights) if a.cfd_score else None
    table = guide_table(sequences, features, qualifiers, o, weights, a.efficiency_model, a.doench_efficiency_score).persist()
    sinks.write_csv(table.orderBy("Accession", "Feature start", "Guide start", "Guide strand"), at("targets.csv.gz"))
    if o.controls:
        best, stats = controls.controls(sequences, found, o.controls, o.length, o.dtype, a.seed, **more)
        sinks.write_controls(best, at("controls.csv.gz"))
        print(f"controls: least distance {stats['min']}, median {stats['median']}")
    if a.plot_data:
        sinks.write_csv(report.table_densities(table), at("density.csv.gz"))
        if "locus_tag" in table.columns:
            sinks.write_csv(report.locus_pam_counts(table), at("locus_counts.csv.gz"))
    flagged = flagged_targets(sequences, replace(o, drop_sites=False))
    print(report.design_stats(flagged, table, o.drop_sites).first().asDict())
    for df in (table, sequences):
        df.unpersist()
    release()


if __name__ == "__main__":
    main()
