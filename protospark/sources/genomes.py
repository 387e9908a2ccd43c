"""Spark data sources for sequence and annotation files: fasta, genbank_sequences, genbank_features.

Files may be plain or gzip, told by their first two bytes. A file is one input partition, so a folder of many files is read
in parallel; a record is one row, and the scan deals its blocks out. The data sources open paths that every executor can
open; the read functions also take paths with a scheme (`hdfs://...`), which Spark's own reader fetches.
"""

from __future__ import annotations

import glob
import gzip
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SEQUENCES = "record_idx long, seqid string, seq string"
FEATURES = "chrom string, fs int, fe int, fstrand string, type string, feature string, qualifiers map<string, array<string>>"


def is_gzip(path: str) -> bool:
    with open(path, "rb") as f:
        return f.read(2) == b"\x1f\x8b"


def open_text(path: str):
    return gzip.open(path, "rt") if is_gzip(path) else open(path)


def parse_fasta(lines: Iterator[str]) -> Iterator[tuple[str, str]]:
    """(id, upper-case sequence) of each record; the id ends at the first space."""
    name, parts = None, []
    for line in lines:
        line = line.strip()
        if line.startswith(">"):
            if name is not None:
                yield name, "".join(parts).upper()
            name, parts = (line[1:].split() or [""])[0], []
        elif name is not None:
            parts.append(line)
    if name is not None:
        yield name, "".join(parts).upper()


#: One end of a span: a number, a range of numbers or a choice of them, maybe marked as lying beyond.
END = re.compile(r"[<>]?(?:\d+|\(?\d+\.\d+\)?|one-of\(\d+(?:,\d+)*\))[<>]?")


def _arguments(text: str) -> list[str]:
    """Split at the commas that stand in no parentheses."""
    parts, depth = [""], 0
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return parts


def _spans(text: str, strand: str) -> list[tuple[int, int, str]]:
    if m := re.fullmatch(r"(complement|join|order|bond|group)\((.*)\)", text):
        turned = {"+": "-", "-": "+"}[strand] if m[1] == "complement" else strand
        return [s for x in _arguments(m[2]) for s in _spans(x, turned)]
    if re.match(r"[A-Za-z][\w.]*:", text):
        return []  # in another record
    if m := re.fullmatch(r"(\d+)\^(\d+)", text):
        return [(int(m[1]), int(m[1]), strand)]
    ends = re.split(r"\.\.", text)
    if len(ends) > 2 or not all(map(END.fullmatch, ends)):
        raise ValueError(f"not a location: {text!r}")
    first, last = ([int(n) for n in re.findall(r"\d+", e)] for e in (ends[0], ends[-1]))
    return [(min(first) - 1, max(last), strand)]


def parse_location(text: str) -> tuple[int, int, str] | None:
    """(start, end, strand) of a feature's location, 0-based half-open: the outermost ends of a compound one, the strand of its first part.

    Spans are `n`, `n..m`, `n^m` (between two bases: an empty span) with ends that may be open (`<5`), ranges (`(3.6)`) or
    choices (`one-of(3,5)`), within complement, join, order, bond and group. Parts in other records (`X1.1:3..9`) don't
    count; a location that lies there as a whole gives None.
    """
    spans = _spans(re.sub(r"\s+", "", text), "+")
    return (min(a for a, _, _ in spans), max(b for _, b, _ in spans), spans[0][2]) if spans else None


def parse_genbank(lines: Iterator[str]) -> Iterator[dict]:
    """Records with id, seq and features (type, location, qualifiers)."""
    record, part, feature, key = None, "", None, None
    for raw in lines:
        line = raw.rstrip("\n")
        if line.startswith("LOCUS"):
            record, part = {"id": line.split()[1], "seq": [], "features": []}, ""
        if record is None:
            continue
        if line.startswith("VERSION") and len(line.split()) > 1:
            record["id"] = line.split()[1]
        elif line.startswith(("FEATURES", "ORIGIN")):
            part = line.split()[0]
        elif line.startswith("//"):
            record["seq"] = "".join(record["seq"]).upper()
            yield record
            record = None
        elif part == "ORIGIN":
            record["seq"].append("".join(line.split()[1:]))
        elif part == "FEATURES" and line.strip():
            if line[5:6] != " " and line[:5].strip() == "":
                feature = {"type": line[5:21].strip(), "location": line[21:].strip(), "qualifiers": {}}
                record["features"].append(feature)
                key = None
            elif feature is not None:
                text = line.strip()
                if m := re.match(r"/([^=\s]+)(?:=(.*))?$", text):
                    key = m[1]
                    feature["qualifiers"].setdefault(key, []).append(m[2] or "")
                elif key is None:
                    feature["location"] += text
                else:
                    values = feature["qualifiers"][key]
                    values[-1] += ("" if key == "translation" else " ") + text


def fasta_rows(f: Iterator[str], types: set[str]) -> Iterator[tuple]:
    yield from parse_fasta(f)


def genbank_rows(f: Iterator[str], types: set[str]) -> Iterator[tuple]:
    for r in parse_genbank(f):
        yield r["id"], r["seq"]


def feature_rows(f: Iterator[str], types: set[str]) -> Iterator[tuple]:
    for r in parse_genbank(f):
        for i, x in enumerate(r["features"]):
            if (not types or x["type"] in types) and (place := parse_location(x["location"])):
                start, end, strand = place
                values = {k: [v.strip().strip('"').replace('""', '"') for v in vs] for k, vs in x["qualifiers"].items()}
                yield r["id"], start, end, strand, x["type"], f"{r['id']}|{start}|{end}|{strand}|{x['type']}|{i}", values


#: Name of a source, columns, its rows, and whether they are numbered.
FORMS = {"fasta": (SEQUENCES, fasta_rows, True), "genbank_sequences": (SEQUENCES, genbank_rows, True), "genbank_features": (FEATURES, feature_rows, False)}


class _Files(DataSourceReader):
    def __init__(self, form: str, options: dict) -> None:
        found = [g for p in options["path"].split(",") for g in ([p] if os.path.isfile(p) else sorted(glob.glob(os.path.join(p, "*")) if os.path.isdir(p) else glob.glob(p)))]
        if not found:
            raise FileNotFoundError(options["path"])
        self.form, self.files, self.types = form, found, set(filter(None, options.get("types", "").split(",")))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((i, f)) for i, f in enumerate(self.files)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        number, path = partition.value
        _, rows, numbered = FORMS[self.form]
        with open_text(path) as f:
            for i, row in enumerate(rows(f, self.types)):
                yield ((number << 32) + i, *row) if numbered else row


def _source(form: str) -> type:
    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return form

        def schema(self) -> str:
            return FORMS[form][0]

        def reader(self, schema: StructType) -> DataSourceReader:
            return _Files(form, self.options)

    return Source


SOURCES = [_source(f) for f in FORMS]


def register(spark: SparkSession) -> None:
    for s in SOURCES:
        spark.dataSource.register(s)


def _fetched(spark: SparkSession, paths: list[str], form: str, types: tuple[str, ...] = ()) -> DataFrame:
    """Rows of files in any store that Spark reads, each file fetched whole by its binary reader."""
    schema, rows, numbered = FORMS[form]
    names = StructType.fromDDL(schema).names
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    order = {p: i for i, p in enumerate(sorted(r["path"] for r in files.select("path").collect()))}  # a name per input file

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, raw in zip(frame["path"], frame["content"]):
                text = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
                found = list(rows(iter(text.decode().splitlines()), set(types)))
                found = [((order[path] << 32) + i, *r) for i, r in enumerate(found)] if numbered else found
                yield pd.DataFrame(found, columns=names)

    return files.mapInPandas(parse, schema)


def _read(spark: SparkSession, paths: list[str], form: str, types: tuple[str, ...] = ()) -> DataFrame:
    if any("://" in p for p in paths):
        return _fetched(spark, paths, form, types)
    register(spark)
    return spark.read.format(form).option("types", ",".join(types)).load(",".join(paths))


def read_sequences(spark: SparkSession, paths: list[str], form: str = "fasta") -> DataFrame:
    """Sequences (record_idx, seqid, seq) of FASTA or GenBank files; record_idx follows the files' order."""
    return _read(spark, paths, "fasta" if form == "fasta" else "genbank_sequences")


def read_genbank_features(spark: SparkSession, paths: list[str], types: tuple[str, ...] = ("CDS",)) -> DataFrame:
    return _read(spark, paths, "genbank_features", types)


def sniff_annotation(path: str, spark: SparkSession | None = None) -> str:
    """gff or gtf, told by the first line; a path with a scheme is read through Spark."""
    if "://" in path and spark is not None:
        first = spark.read.text(path).first()["value"]
    else:
        with open_text(path) as f:
            first = f.readline()
    for form in ("gff", "gtf"):
        if f"{form}-version" in first:
            return form
    raise ValueError(f"{path}: the first line names neither gff-version nor gtf-version")


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines of GFF or GTF files with a feature_id."""
    from ..operators.annotate import LINE, feature_id

    # a line that stands there twice is one feature
    return spark.read.csv(paths, sep="\t", comment="#", schema=LINE, quote="").withColumn("feature_id", feature_id()).dropDuplicates(["feature_id"])
