"""Writers: delimited interchange files, partitioned logs, report text."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from textlab.sources import appends, files


def write_delimited(df: DataFrame, path: str, sep: str = "$", mode: str = "overwrite") -> None:
    """``sep`` CSV with a header and no index; fields with the separator,
    quotes or newlines are quoted, quotes doubled."""
    (df.write.mode(mode).option("header", True).option("sep", sep).option("quote", '"')
     .option("escape", '"').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))


#: what Spark escapes in the name of a partition, the comma, and a leading underscore
_UNSAFE = re.compile(r"""[\x00-\x1f\x7f"#%'*/:=?\\{\[\]^,]|^_""")


def _section_file(key: str):
    """Name of the file of a publication's chunk: ``<key>=<id>,chunk=<c>.json``, or folders of these names if it is too long for one."""
    def field(name: str, v) -> str:
        v = "__HIVE_DEFAULT_PARTITION__" if v is None else _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", str(v))
        return f"{name}={v}"

    def name(id_, chunk) -> str:
        parts = [field(key, id_), field("chunk", chunk)]
        flat = ",".join(parts) + ".json"
        return flat if len(flat.encode()) <= 255 else "/".join([*parts, "part.json"])
    return name


def write_sections_json(sections: DataFrame, root: str, key: str = "file_id", pos: str = "pos",
                        title: str = "section_title", text: str = "section_txt",
                        chunk_size: int = 10000) -> None:
    """JSON arrays of ``{section_title, text}`` per publication, in section order, a file each:
    ``<root>/part-<n>/<key>=<id>,chunk=<c>.json``.  A publication's sections are
    gathered in chunks of at most ``chunk_size`` (a publication holding a third
    of the corpus still spreads over many tasks); most publications are one
    chunk, i.e. one file.  In a file system that only Spark opens each file has folders of its own,
    ``<root>/<key>=<id>/chunk=<c>/``."""
    chunk = F.expr(f"cast(`{pos}` as bigint) div {int(chunk_size)}")
    per_pub = (sections.groupBy(key, chunk.alias("chunk"))
               .agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(title).alias("section_title"),
                                                         F.col(text).alias("text")))).alias("_s"))
               .select(key, "chunk",
                       F.to_json(F.transform("_s", lambda s: F.struct(s["section_title"].alias("section_title"),
                                                                      s["text"].alias("text")))).alias("value")))
    folder = files.shared_folder(sections.sparkSession, root)
    if folder is None:
        per_pub.write.mode("overwrite").partitionBy(key, "chunk").text(root)
    else:
        files.write_files(per_pub.withColumn(key, F.col(key).cast("string")), folder, _section_file(key))


#: folders that a task fills at once, and bytes of a Parquet row group that each of them holds in memory
OPEN_FOLDERS, FOLD_GROUP_BYTES = 64, 8 << 20


def write_folds(folds: DataFrame, root: str) -> None:
    """Parquet under ``fold=<i>/split=<name>/``. A task keeps a file of each of its folders open (``OPEN_FOLDERS`` at most; beyond
    that Spark sorts what is left), so that paragraphs that recur in the folds are not sorted, and spilled, by folder."""
    conf, name = folds.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(name)
    conf.set(name, str(max(int(before), OPEN_FOLDERS)))
    try:
        (folds.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", FOLD_GROUP_BYTES)
         .partitionBy("fold", "split").parquet(root))
    finally:
        conf.set(name, before)


def write_epoch_log(df: DataFrame, path: str, run: str = "run") -> None:
    """Per-run epoch table (loss, accuracy, recall, F-beta ...), replaced per run."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(run).parquet(path))


def _documents(lines: DataFrame, run: str, line_no: str) -> DataFrame:
    """(run, value): a run's lines joined in line order (a report is a handful of lines)."""
    return (lines.groupBy(run)
            .agg(F.array_sort(F.collect_list(F.struct(F.col(line_no).alias("n"), F.col("line").alias("l"))))
                 .alias("_ls"))
            .select(run, F.array_join(F.transform("_ls", lambda x: x["l"]), "\n").alias("value")))


def write_test_report(lines: DataFrame, path: str, run: str = "run", line_no: str = "line_no") -> None:
    """Report lines as text, one directory per run, replacing what is there.  A run's lines are joined in
    line order into one text value, so the file does not depend on physical row order."""
    _documents(lines, run, line_no).write.mode("overwrite").partitionBy(run).text(path)


def append_test_report(lines: DataFrame, path: str, name: str, run: str = "run", line_no: str = "line_no") -> int:
    """Report lines added after all that earlier calls added; the same ``name`` again replaces what it added, in its place.
    Read back by ``readers.read_appended_report``."""
    doc = _documents(lines, run, line_no)
    return appends.append(lines.sparkSession, path, name, lambda at: doc.write.mode("overwrite").partitionBy(run).text(at))


def log_metrics(wide: DataFrame, path: str, ids: Sequence[str], metrics: Sequence[str],
                step: str = "step", name: str | None = None) -> DataFrame:
    """Wide metric rows -> tall ``(ids..., step, tag, value)``, added to the log at ``path``; the log holds one value for each
    (ids, step, tag), the last one logged (``readers.read_metrics``). ``name`` names the addition: the same name
    again replaces it (a retry); by default each call is a new one."""
    import uuid
    tall = wide.unpivot([*ids, step], list(metrics), "tag", "value").withColumn("value", F.col("value").cast("double"))
    appends.append(wide.sparkSession, path, name or uuid.uuid4().hex, lambda at: tall.write.mode("overwrite").parquet(at))
    return tall
