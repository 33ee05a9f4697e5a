"""Files of folder trees as rows, and rows as files."""

from __future__ import annotations

import os
import re
import shutil
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import markup
from scriptorium.session import ship

_DEALT, _SAVED = "part", "file"
#: Folders that a saved tree's files are dealt to. Each is written by one task and so renamed into place at once, and
#: listed by one task.
PARTS = 256
_STRIPPED = "\\A\\s+|\\s+\\z"
#: Characters that Spark's writer spells out in the name of a folder, and its name for no value.
_SPELLED, _NONE = re.compile("[\\x00-\\x1f\"#%'*/:=?\\\\\\x7f{\\[\\]^]"), "__HIVE_DEFAULT_PARTITION__"
#: Bytes and names in a batch of files that a task reads, or lists.
_BYTES, _NAMES = 4_000_000, 2_000


def _qualified(spark: SparkSession, folder: str) -> str:
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def _mounted(spark: SparkSession, folder: str) -> str | None:
    """`folder` as a path of the machines' own file system; nothing if it is in another store.

    There, tasks write and read files by calls of their own: Hadoop's local file system, where its native library is
    missing, starts a program to set the permissions of each file and folder."""
    found = re.match("file:(?://)?(/.*)", _qualified(spark, folder))
    return found.group(1).rstrip("/") or "/" if found else None


def save_tree(rows: DataFrame, path_col: str, content_col: str, folder: str) -> None:
    """One text file for each row, in a folder that its path names (escaped); it ends with a line feed. Rows of one path
    are several files of it."""
    spark = rows.sparkSession
    dealt = F.pmod(F.xxhash64(path_col), F.lit(PARTS)).alias(_DEALT)
    named = rows.select(dealt, F.col(path_col).cast("string").alias(_SAVED), F.coalesce(F.col(content_col), F.lit("")).alias("value")).repartition(_DEALT)
    mounted = _mounted(spark, folder)
    if mounted is None:
        named.write.partitionBy(_DEALT, _SAVED).text(folder)
        return
    os.makedirs(mounted)
    ship(spark)
    named.withColumn("value", F.col("value").cast("binary")).mapInArrow(lambda batches: _saved(batches, mounted), "files long").write.format("noop").mode("overwrite").save()
    for entry in os.scandir(mounted):
        if entry.name.startswith("_"):  # of tasks that failed
            shutil.rmtree(entry.path)


def _saved(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Write the rows (part, path, content) of a task, which has all rows of its parts: to a hidden folder, from which
    whole parts are renamed into place; one that is there was written by another try of the task."""
    own, parts, n = f"{folder}/_{uuid.uuid4().hex}", set(), 0
    os.mkdir(own)
    for batch in batches:
        for part, path, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if part not in parts:
                os.mkdir(f"{own}/{_DEALT}={part}")
                parts.add(part)
            at = f"{own}/{_DEALT}={part}/{_SAVED}={_SPELLED.sub(lambda c: f'%{ord(c.group()):02X}', path) if path else _NONE}"
            try:
                os.mkdir(at)
            except FileExistsError:  # another row of this path
                pass
            with open(f"{at}/{n}.txt", "xb", buffering=0) as f:
                f.write(value.as_py() + b"\n")
            n += 1
    for part in parts:
        try:
            os.rename(f"{own}/{_DEALT}={part}", f"{folder}/{_DEALT}={part}")
        except OSError:
            if not os.path.isdir(f"{folder}/{_DEALT}={part}"):
                raise
    shutil.rmtree(own)
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["files"])


def read_tree(spark: SparkSession, folder: str) -> DataFrame:
    """path (relative to the folder), content (bytes), length and modified of every file below a folder, files of `save_tree`
    by the path that they were saved under. Hidden files and markers of jobs are left out."""
    mounted = _mounted(spark, folder)
    if mounted is None:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
        found = found.select(F.substring(F.col("path"), len(_qualified(spark, folder)) + 2, 1_000_000).alias("path"), "content", "length", F.col("modificationTime").alias("modified"))
    else:
        found = _read_mounted(spark, mounted)
    saved = F.regexp_extract("path", f"^{_DEALT}=[0-9]+/{_SAVED}=([^/]+)/[^/]+$", 1)
    return found.withColumn("path", F.when(saved != "", F.url_decode(F.regexp_replace(saved, "\\+", "%2B"))).otherwise(F.col("path")))


def _read_mounted(spark: SparkSession, folder: str) -> DataFrame:
    """The files below a folder: its entries are listed by one task, those below them and their contents by many. Nothing
    is listed in the driver, and a task reads many small files."""
    if not os.path.isdir(folder):
        raise FileNotFoundError(folder)
    ship(spark)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    top = spark.range(1, numPartitions=1).mapInArrow(lambda batches: _entries(batches, folder), "path string, is_dir boolean")
    listed = top.repartition(tasks, "path").mapInArrow(lambda batches: _below(batches, folder), "path string")
    return listed.repartition(tasks, "path").mapInArrow(lambda batches: _contents(batches, folder), "path string, content binary, length long, modified timestamp")


def _seen(folder: str) -> Iterator[os.DirEntry]:
    """The entries that Spark's readers see, too."""
    with os.scandir(folder) as entries:
        yield from (e for e in entries if not (e.name.startswith(".") or e.name.startswith("_") and "=" not in e.name or e.name.endswith("._COPYING_")))


def _entries(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _ in range(batch.num_rows):
            found = [(e.name, e.is_dir()) for e in _seen(folder)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.bool_())], names=["path", "is_dir"])


def _walked(folder: str, path: str) -> Iterator[str]:
    for e in _seen(f"{folder}/{path}"):
        if e.is_dir():
            yield from _walked(folder, f"{path}/{e.name}")
        else:
            yield f"{path}/{e.name}"


def _below(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    named = lambda paths: pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], names=["path"])
    for batch in batches:
        paths = []
        for path, is_dir in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for x in _walked(folder, path) if is_dir else [path]:
                paths.append(x)
                if len(paths) >= _NAMES:
                    yield named(paths)
                    paths = []
        yield named(paths)


def _contents(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    kinds = {"path": pa.string(), "content": pa.binary(), "length": pa.int64(), "modified": pa.timestamp("us", "UTC")}
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], names=list(kinds))
    for batch in batches:
        rows, held = [], 0
        for path in batch.column(0).to_pylist():
            with open(f"{folder}/{path}", "rb", buffering=0) as f:
                content, modified = f.readall(), os.fstat(f.fileno()).st_mtime_ns // 1_000_000 * 1_000
            rows.append((path, content, len(content), modified))
            held += len(content)
            if held >= _BYTES:
                yield made(rows)
                rows, held = [], 0
        yield made(rows)


def extension(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(path, "\\.([A-Za-z0-9]+)$", 1))


def load_files(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """Adds body and skipped: text files as they are but for white space at their ends, pages and mails
    through their loaders; other extensions and empty bodies are skipped with the reason. Content is text or
    bytes of it."""
    kind, text = extension(path_col), F.col(content_col).cast("string")
    body = F.when(kind.isin("md", "txt"), F.regexp_replace(text, _STRIPPED, "")).when(kind == "html", markup.html_text(text)).when(kind == "eml", markup.own_mail_text(text))
    rows = files.withColumn("_extension", kind).withColumn("body", body)
    reason = F.when(F.col("body").isNull(), F.concat(F.lit("unsupported: "), "_extension")).when(F.trim("body") == "", "empty")
    return rows.withColumn("skipped", reason).drop("_extension")


def scanned_files(files: DataFrame, banned: dict[str, str], media: list[str]) -> DataFrame:
    """path, length, sha256 of every file, and `found`: the names of banned patterns (of text files) and 'media'
    for a media extension, joined by commas, null if there are none."""
    kind, text = extension("path"), F.col("content").cast("string")
    hits = [F.when(~kind.isin(media) & text.rlike(p), F.lit(name)) for name, p in banned.items()] + [F.when(kind.isin(media), F.lit("media"))]
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), F.nullif(F.array_join(F.array_compact(F.array(*hits)), ","), F.lit("")).alias("found"))
