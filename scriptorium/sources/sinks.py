"""Writers that keep private and public rows apart."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.session import shared_dir


def write_split(rows: DataFrame, public_col: str, order: str, path: str | None = None) -> tuple[str, str]:
    """JSON lines of private and public rows, each to a folder of its own, sorted within
    files. A null flag counts as private. Returns the two paths."""
    path = path or f"{shared_dir(rows.sparkSession)}/corpus-{uuid.uuid4().hex}"
    out = []
    for name, chosen in (("private", ~F.coalesce(F.col(public_col), F.lit(False))), ("public", F.coalesce(F.col(public_col), F.lit(False)))):
        rows.where(chosen).drop(public_col).sortWithinPartitions(order).write.mode("overwrite").json(f"{path}/{name}")
        out.append(f"{path}/{name}")
    return out[0], out[1]


def rebuild_sources(rows: DataFrame, source_col: str, path: str) -> None:
    """Replace only the sources that `rows` has; the saved rows of the others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(source_col).parquet(path)
