"""Label sections arriving as files, against a static publication table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from textlab.operators import cleaning, labeling


def labelled_stream(sections: DataFrame, pubs: DataFrame, min_chars: int = 5,
                    max_broadcast_bytes: int | None = None) -> DataFrame:
    """Streaming (or batch) sections -> one labelled row per section."""
    s = cleaning.skip_tiny_sections(sections, "section_txt", min_chars)
    return labeling.label_sections(s, pubs, max_broadcast_bytes=max_broadcast_bytes)


#: bytes of text of a file of sections, and the fewest files
ARRIVAL_BYTES, LEAST_FILES = 64 << 20, 4


def write_arrivals(sections: DataFrame, path: str, max_bytes: int = ARRIVAL_BYTES) -> int:
    """``sections`` as files of about ``max_bytes`` of text each, as many as that takes, dealt out by all of the row's numbers so that
    no task gets more than its share; the number of files dealt out to (an even one)."""
    texts = [f.name for f in sections.schema if f.dataType.typeName() == "string"]
    size = sections.agg(F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(0)).cast("bigint"))).first()[0] or 0
    files = max(LEAST_FILES, -(-int(size) // max_bytes))
    files += files % 2
    sections.repartition(files, *[c for c in sections.columns if c not in texts]).write.parquet(path)
    return files


def start_labelling(spark: SparkSession, source_dir: str, schema: StructType, pubs: DataFrame,
                    out_dir: str, checkpoint_dir: str, available_now: bool = True,
                    max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Watch ``source_dir`` for Parquet files of sections, label them, append
    Parquet to ``out_dir``.  Progress lives in ``checkpoint_dir`` (a shared
    folder), so a restarted query resumes where it stopped."""
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = labelled_stream(r.parquet(source_dir), pubs)
    w = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint_dir).outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start(out_dir)
