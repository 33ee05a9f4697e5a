"""What every job needs from the session: tables, a shared folder, and the package on the workers."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parent.parent
_SHIPPED = "spark.scriptorium.shipped"
#: Rows of a batch between the JVM and Python at most: rows of texts are wide, and a batch exists several times.
BATCH_ROWS, _BATCH = 2_000, "spark.sql.execution.arrow.maxRecordsPerBatch"
#: For Parquet of rows whose values hardly repeat: dictionaries of them are long work and make nothing shorter.
UNIQUE = {"compression": "zstd", "parquet.enable.dictionary": "false"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """`df` dealt over all tasks by `key`, before work that is long for each row: a row group of Parquet is one task
    otherwise, however many cores there are."""
    return df.repartition(key)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a
    local session gets a temporary folder and any other one a folder in the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local["):
        found = "file://" + tempfile.mkdtemp(prefix="scriptorium-")
    else:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scriptorium"
    spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Folders that this process wrote to cut lineages.
_WRITTEN: list[str] = []


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cut the lineage: write `df` to the shared folder as Parquet and read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def collect_garbage(spark: SparkSession) -> None:
    """The driver collects its garbage, on which Spark deletes the shuffles of results that are gone."""
    gc.collect()
    spark._jvm.System.gc()


class Scratch:
    """The folders that one call writes to cut lineages. It deletes its own and no others, so calls in
    one session don't meet."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def write(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """`df`, written to the shared folder as Parquet and read again."""
        path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        self.paths.append((name, path))
        df.write.options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, keep: tuple[str, ...] = ()) -> None:
        """Delete all but the folders named `keep`, once nothing that is still wanted is made from them. Then
        the driver collects its garbage, on which Spark deletes the shuffles of results that are gone."""
        self.drop_named(*{name for name, _ in self.paths if name not in keep})

    def drop_named(self, *names: str) -> None:
        """Delete the folders with these names, likewise."""
        fs = self.spark._jvm.org.apache.hadoop.fs
        for name, path in [x for x in self.paths if x[0] in names]:
            at = fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
            self.paths.remove((name, path))
        collect_garbage(self.spark)


def written() -> int:
    """How many folders `materialise` wrote so far, for `forget`."""
    return len(_WRITTEN)


def forget(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> int:
    """Delete what `materialise` wrote after the first `since` folders but for the names `keep`, when no
    result that is made from it is wanted any more; how many folders that was. Then the driver
    collects its garbage, on which Spark deletes the shuffles of results that are gone."""
    fs = spark._jvm.org.apache.hadoop.fs
    gone = [p for p in _WRITTEN[since:] if p.rsplit("/", 1)[1].rsplit("-", 1)[0] not in keep]
    for p in gone:
        path = fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _WRITTEN.remove(p)
    collect_garbage(spark)
    return len(gone)


def ship(spark: SparkSession) -> None:
    """Make this package importable on the workers, once per application. Only workers of a local
    session are known to see the driver's own path. Batches of rows become small enough for texts."""
    if int(spark.conf.get(_BATCH)) > BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    on_path = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if spark.sparkContext.master.startswith("local") and str(_ROOT) in on_path or spark.conf.get(_SHIPPED, ""):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="scriptorium-"), "scriptorium.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted((_ROOT / "scriptorium").rglob("*.py")):
            z.write(p, p.relative_to(_ROOT))
    spark.sparkContext.addPyFile(target)
    spark.conf.set(_SHIPPED, "1")
