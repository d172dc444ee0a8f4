"""Query: labelling over a file stream (survey 2.12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlab.catalog.common import longs, with_ctes
from textlab.catalog.labeling import LABELLED_SQL
from textlab.operators import labeling
from textlab.registry import query
from textlab.session import scratch_dir
from textlab.sources import fixtures as fx
from textlab.streaming.labeling import start_labelling, write_arrivals


@query("stream_label_sections", with_ctes("sections", "annotations", extra=LABELLED_SQL) + """
SELECT file_id::BIGINT AS file_id, pos::BIGINT AS pos, dataset, label::BIGINT AS label FROM lab""")
def q_stream_label(spark, sf_dir):
    src, out, ck = scratch_dir(spark, "stream-src"), scratch_dir(spark, "stream-out"), scratch_dir(spark, "stream-ck")
    secs = fx.sections(spark, sf_dir).select("file_id", "pos", "section_title", "section_txt")
    files = write_arrivals(secs, src)
    pubs = labeling.build_publications(fx.annotations(spark, sf_dir))
    q = start_labelling(spark, src, secs.schema, pubs, out, ck, available_now=True, max_files_per_trigger=files // 2)
    q.awaitTermination()
    return longs(spark.read.parquet(out).select("file_id", "pos", "dataset", F.col("label")))
