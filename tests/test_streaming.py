"""The file stream labels what arrives and resumes from its checkpoint after a restart."""

from pyspark.sql import functions as F

from textlab.operators import labeling
from textlab.session import scratch_dir
from textlab.streaming.labeling import start_labelling


def test_stream_resumes_from_checkpoint(spark):
    schema = "file_id long, pos int, section_title string, section_txt string"
    pubs = labeling.build_publications(spark.createDataFrame(
        [(0, 1, "P", "alpha"), (1, 2, "Q", "beta")], "row_no long, id long, pub_title string, mention string"))
    src, out, ck = scratch_dir(spark, "s-src"), scratch_dir(spark, "s-out"), scratch_dir(spark, "s-ck")
    first = spark.createDataFrame([(1, 0, "t", "the alpha set"), (1, 1, "t", "nothing at all")], schema)
    first.write.mode("append").parquet(src)
    q = start_labelling(spark, src, first.schema, pubs, out, ck)
    q.awaitTermination()
    assert spark.read.parquet(out).count() == 2
    second = spark.createDataFrame([(2, 0, "t", "beta inside"), (3, 0, "t", "no publication")], schema)
    second.write.mode("append").parquet(src)
    q = start_labelling(spark, src, first.schema, pubs, out, ck)  # restart on the same checkpoint
    q.awaitTermination()
    got = sorted((r.file_id, r.pos, r.dataset, r.label) for r in spark.read.parquet(out).collect())
    assert got == [(1, 0, "alpha", 1), (1, 1, "None", 0), (2, 0, "beta", 1)]


def test_arrivals_grow_in_number_not_in_size(spark):
    """More text gives more files; one long publication is no single file. All rows arrive."""
    from textlab.streaming.labeling import write_arrivals
    secs = spark.range(4000).selectExpr("if(id < 3000, 0, id) AS file_id", "cast(id as int) AS pos", "'t' AS section_title", "repeat('x', 100) AS section_txt")
    few, many = scratch_dir(spark, "few"), scratch_dir(spark, "many")
    assert write_arrivals(secs, few) == 4
    assert write_arrivals(secs, many, 20_000) == 22  # 404,000 bytes
    back = spark.read.parquet(many)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, secs.collect()))
    sizes = [r[0] for r in back.groupBy(F.input_file_name()).count().select("count").collect()]
    assert len(sizes) == 22 and max(sizes) < 400
    assert write_arrivals(secs.limit(0), scratch_dir(spark, "none")) == 4
