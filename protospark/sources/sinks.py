"""CSV sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def flat(table: DataFrame) -> DataFrame:
    """Arrays become text joined by ";"."""
    return table.select(*[F.array_join(F.col(f"`{c}`").cast("array<string>"), ";").alias(c) if t.startswith("array") else F.col(f"`{c}`") for c, t in table.dtypes])


def write_csv(table: DataFrame, path: str, single: bool = False) -> None:
    """Gzip CSV with a header; `single` puts it into one part, for tables known to be small."""
    out = flat(table)
    (out.coalesce(1) if single else out).write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)


def write_controls(controls: DataFrame, path: str) -> None:
    """Controls with a leading row number; there are as many as were asked for."""
    numbered = controls.withColumn("index", F.row_number().over(Window.orderBy(F.desc("Hamming distance"), "name")) - 1)
    write_csv(numbered.select("index", *controls.columns), path, single=True)
