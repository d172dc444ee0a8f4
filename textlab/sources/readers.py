"""Readers for the reference's file formats."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from textlab.operators.indexing import assign_row_id
from textlab.sources import appends, files

ANNOTATION_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("pub_title", T.StringType()),
    T.StructField("dataset_title", T.StringType()), T.StructField("dataset_label", T.StringType()),
    T.StructField("cleaned_label", T.StringType()),
])

SECTIONS_JSON = T.ArrayType(T.StructType([T.StructField("section_title", T.StringType()),
                                          T.StructField("text", T.StringType())]))

SECTION_TABLE = T.StructType([
    T.StructField("file_id", T.StringType()), T.StructField("publication_name", T.StringType()),
    T.StructField("section_title", T.StringType()), T.StructField("dataset", T.StringType()),
    T.StructField("label", T.IntegerType()), T.StructField("section_txt", T.StringType()),
])


#: session setting: partitions that input tables are dealt out to before any work (unset: as scanned)
INPUT_PARTITIONS = "spark.textlab.input.partitions"


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet scan; dealt out round-robin only where the session asks for it (``INPUT_PARTITIONS``),
    for files whose single row group would keep all work in one task."""
    df = spark.read.parquet(path)
    n = spark.conf.get(INPUT_PARTITIONS, None)
    return df.repartition(int(n)) if n else df


def read_annotations(spark: SparkSession, path: str, schema: T.StructType = ANNOTATION_SCHEMA) -> DataFrame:
    """Comma CSV with a header; columns by name, and ``row_no``, an orderable (file, line) of each row:
    a multi-line CSV file is one split, so ids that grow within a partition grow with the file's lines."""
    rows = spark.read.schema(schema).option("header", True).option("multiLine", True) \
        .option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False) \
        .option("ignoreTrailingWhiteSpace", False).csv(path)
    return rows.withColumn("row_no", F.struct(F.col("_metadata.file_path").alias("file"),
                                              F.monotonically_increasing_id().alias("line")))


def _section_texts(spark: SparkSession, root: str, id_from: str) -> DataFrame:
    """(file_id, chunk, value) of the files in ``root``, as Spark lists and reads them."""
    reader = spark.read.option("recursiveFileLookup", id_from == "file_name")
    if id_from != "file_name":  # ids are text: "007" stays "007"
        reader = reader.schema("value string, file_id string, chunk int")
    raw = reader.text(root, wholetext=True)
    if id_from == "file_name":
        raw = raw.withColumn("file_id", F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", ""))
    if "chunk" not in raw.columns:
        raw = raw.withColumn("chunk", F.lit(0))
    return raw.select("file_id", "chunk", "value")


#: what a URI quotes, as file names in ``_metadata`` are
_QUOTED = r"""[\x00-\x20"#%<>?\[\\\]^`{|}\x7f-\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"""


def _section_ids(id_from: str) -> Callable[[Iterable[str]], tuple[list[str | None], list[int | None]]]:
    """file_id and chunk of paths within a root: the file's name as Spark's ``_metadata`` has it, or ``name=value`` parts of
    folders' names and of the file's own (there between commas)."""
    def of_names(paths):
        names = [re.sub(_QUOTED, lambda m: quote(m[0], safe=""), p.rpartition("/")[2]) for p in paths]
        return [n.removesuffix(".json") for n in names], [0] * len(names)

    def value(v):
        return None if v in ("", "__HIVE_DEFAULT_PARTITION__") else re.sub("%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), v)

    def of_parts(paths):
        ids, chunks = [], []
        for path in paths:
            *folders, name = path.split("/")
            parts = dict(p.partition("=")[::2] for p in [*name.removesuffix(".json").split(","), *folders] if "=" in p)
            if "file_id" not in parts:
                raise ValueError(f"no file_id in the path {path}")
            chunk = value(parts.get("chunk", "0"))
            ids.append(value(parts["file_id"]))
            chunks.append(None if chunk is None else int(chunk))
        return ids, chunks
    return of_names if id_from == "file_name" else of_parts


def _section_texts_in_tasks(spark: SparkSession, folder: str, id_from: str) -> DataFrame | None:
    """The same of a folder that tasks can open; None if it has packed files."""
    listed = files.list_files(spark, folder)
    n, size, packed = listed.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0)),
                                 F.coalesce(F.bool_or(F.col("path").rlike(files.PACKED)), F.lit(False))).first()
    if packed:
        return None

    ids_of = _section_ids(id_from)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, chunks = ids_of(b.column("path").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(chunks, pa.int32()), b.column("value")], ["file_id", "chunk", "value"])

    raw = files.read_files(listed, folder, n, size).mapInArrow(run, "file_id string, chunk int, value binary")
    return raw.withColumn("value", F.col("value").cast("string"))


def read_sections_json(spark: SparkSession, root: str, id_from: str = "file_name",
                       chunk_size: int = 10000) -> DataFrame:
    """JSON files holding arrays of ``{section_title, text}``, one publication per file
    (``<id>.json``), per file ``file_id=<id>,chunk=<c>.json`` or per ``file_id=<id>/chunk=<c>/`` directory.

    Each file is one row; the array is parsed with a fixed
    schema and ``posexplode`` keeps the section order (a chunk adds
    ``chunk * chunk_size``). The files of a folder that tasks can open are listed and read
    inside tasks (``files``), others by Spark's ``wholetext``, which lists them on the driver.
    """
    folder = files.shared_folder(spark, root)
    raw = _section_texts_in_tasks(spark, folder, id_from) if folder is not None and os.path.isdir(folder) else None
    if raw is None:
        raw = _section_texts(spark, root, id_from)
    parsed = raw.select("file_id", "chunk", F.posexplode(F.from_json("value", SECTIONS_JSON)).alias("pos", "s"))
    return parsed.select("file_id", (F.col("chunk") * chunk_size + F.col("pos")).cast("int").alias("pos"),
                         F.col("s.section_title").alias("section_title"), F.col("s.text").alias("section_txt"))


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | None = None, sep: str = "$") -> DataFrame:
    """``sep``-separated CSV with a header, quoted fields holding the separator,
    quotes (doubled) and newlines.  ``multiLine`` makes each file one split:
    this is an interchange format; Parquet is the working format."""
    r = spark.read.option("header", True).option("sep", sep).option("multiLine", True) \
        .option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False) \
        .option("ignoreTrailingWhiteSpace", False)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    return r.csv(path)


def read_folds(spark: SparkSession, root: str, split: str | None = "train") -> DataFrame:
    """Fold directories ``fold=<i>/split=<name>/`` as one partitioned scan; a
    ``split`` filter prunes directories instead of reading them."""
    df = spark.read.parquet(root)
    return df.filter(F.col("split") == split) if split is not None else df


def read_report_lines(spark: SparkSession, path: str, key: str = "run") -> DataFrame:
    """Text reports -> ``(key, line_no, line)``: one row per line, numbered from 0
    as a Python file loop sees them (a final newline adds no empty line).
    ``key`` is text: from a ``<key>=<value>`` directory when present, else the file name."""
    raw = spark.read.text(path, wholetext=True)
    if key in raw.columns:
        raw = spark.read.schema(f"value string, `{key}` string").text(path, wholetext=True)
    else:
        raw = raw.withColumn(key, F.col("_metadata.file_name"))
    body = F.regexp_replace("value", r"\n\z", "")
    return raw.select(key, F.posexplode(F.split(body, "\n", -1)).alias("line_no", "line")) \
        .withColumn("line_no", F.col("line_no").cast("bigint"))


def read_appended_report(spark: SparkSession, path: str, key: str = "run") -> DataFrame:
    """(append, key, line_no, line): what ``writers.append_test_report`` added, ``line_no`` counting through all lines in the order
    in which they were added (within one addition by key)."""
    raw = spark.read.schema(f"value string, append bigint, `{key}` string").text(f"{path}/data", wholetext=True)
    raw = appends.committed(raw, path)
    body = F.regexp_replace("value", r"\n\z", "")
    lines = raw.select("append", key, F.posexplode(F.split(body, "\n", -1)).alias("_at", "line"))
    return assign_row_id(lines, ["append", key, "_at"], "line_no").select("append", key, "line_no", "line")


def read_metrics(spark: SparkSession, path: str, ids: Sequence[str], step: str = "step") -> DataFrame:
    """(*ids, step, tag, value): the last value that ``writers.log_metrics`` put down for each (ids, step, tag)."""
    rows = appends.committed(spark.read.parquet(f"{path}/data"), path)
    return rows.groupBy(*ids, step, "tag").agg(F.max_by("value", "append").alias("value"))
