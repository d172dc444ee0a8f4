"""Many small files, a row each: written, listed and read inside the tasks, so that no folder has to be made for a file and the
driver holds no list of them. This takes a folder that every machine opens under one path (``file:``, such as a shared mount);
for other file systems ``shared_folder`` says None, and the callers leave the files to Spark's own reader and writer.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from textlab.session import written

#: a task reads about so many files, or bytes of them, and hands on about so many bytes at once
TASK_FILES, TASK_BYTES, BATCH_BYTES = 8192, 64 << 20, 1 << 20

#: endings of files that Hadoop's text reader unpacks
PACKED = r"\.(gz|bz2|deflate|snappy|lz4|zst)$"

_LISTED = "path string, size long, folder boolean"


def shared_folder(spark: SparkSession, path: str) -> str | None:
    """``path`` as tasks open it, or None where it lies in a file system that only Spark opens."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def write_files(rows: DataFrame, root: str, name: Callable[..., str]) -> None:
    """Each row as a file of ``root``, replacing what is there: the last column and a newline, in the file that ``name`` names
    by the other columns. A task's files share a folder ``part-<n>``; one that fails leaves nothing, as tasks write beside
    ``root`` and the folders of those that succeeded are moved there at the end."""
    new = f"{os.path.dirname(root)}/.{os.path.basename(root)}-{uuid.uuid4().hex}"

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part = f"part-{task.partitionId():05d}"
        at, n = f"{part}-{task.taskAttemptId()}", 0
        for batch in batches:
            *keys, values = batch.columns
            os.makedirs(f"{new}/{at}", exist_ok=True)
            for *key, value in zip(*(k.to_pylist() for k in keys), values):
                file = f"{new}/{at}/{name(*key)}"
                if file.count("/") > new.count("/") + 2:
                    os.makedirs(os.path.dirname(file), exist_ok=True)
                with open(file, "xb") as f:
                    f.write(value.as_buffer())
                    f.write(b"\n")
                n += 1
        if n:
            yield pa.RecordBatch.from_pydict({"at": [at], "part": [part]})

    try:
        done = rows.mapInArrow(put, "at string, part string").collect()
        if os.path.lexists(root):
            shutil.rmtree(root)
        os.makedirs(root)
        for r in done:
            os.rename(f"{new}/{r.at}", f"{root}/{r.part}")
        open(f"{root}/_SUCCESS", "wb").close()
    finally:
        shutil.rmtree(new, ignore_errors=True)


def _listing(root: str, deep: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Replaces folders by what they hold; with ``deep`` until no folder is left."""
    def hidden(name: str) -> bool:  # Spark's readers pass it over
        return name.startswith(".") or name.endswith("._COPYING_") or name.startswith("_") and "=" not in name

    def children(path: str) -> Iterator[tuple[str, int, bool]]:
        with os.scandir(f"{root}/{path}") as found:
            for x in found:
                if not hidden(x.name):
                    folder = x.is_dir()
                    yield (f"{path}/{x.name}" if path else x.name), (0 if folder else x.stat().st_size), folder

    def files(path: str) -> Iterator[tuple[str, int, bool]]:
        left = [path]
        while left:
            for x in children(left.pop()):
                if x[2] and deep:
                    left.append(x[0])
                else:
                    yield x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                for x in files(row[0]) if row[2] else [row]:
                    held.append(x)
                    if len(held) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held)], ["path", "size", "folder"])
                        held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held)], ["path", "size", "folder"])
    return run


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, size) of the files with content in ``root`` and below, paths within ``root``: one task lists ``root`` itself,
    all of them the folders in it."""
    top = spark.range(0, 1, 1, 1).select(F.lit("").alias("path"), F.lit(0).cast("long").alias("size"), F.lit(True).alias("folder"))
    first = top.mapInArrow(_listing(root, deep=False), _LISTED)
    found = first.repartition(4 * spark.sparkContext.defaultParallelism).mapInArrow(_listing(root, deep=True), _LISTED)
    return written(found.filter("size > 0").select("path", "size"), "files")


def read_files(listed: DataFrame, root: str, n: int, size: int) -> DataFrame:
    """(path, value): the bytes of the ``n`` files of ``listed``, ``size`` bytes in all, dealt out evenly."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, values, held = [], [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open(f"{root}/{path}", "rb") as f:
                    values.append(f.read())
                paths.append(path)
                held += len(values[-1])
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(values, pa.binary())], ["path", "value"])
                    paths, values, held = [], [], 0
        if paths:
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(values, pa.binary())], ["path", "value"])

    parts = max(listed.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_FILES), -(-size // TASK_BYTES))
    return listed.select("path").repartition(parts).mapInArrow(run, "path string, value binary")
