"""A file per publication: written, listed and read inside tasks, whatever the ids, and left to Spark elsewhere."""

import gzip
import json
import os

import pytest

from textlab.sources import files, readers, writers

SCHEMA = "file_id string, pos int, section_title string, section_txt string"


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_a_file_but_no_folder_for_each_publication(spark, tmp_path):
    root = str(tmp_path / "json")
    rows = [(f"p{i}", j, f"t{j}", f"text {i} {j}") for i in range(300) for j in range(3)]
    writers.write_sections_json(spark.createDataFrame(rows, SCHEMA).repartition(5, "pos"), root)
    found = [(d, x) for d, _, names in os.walk(root) for x in names if x != "_SUCCESS"]
    assert sorted(x for _, x in found) == sorted(f"file_id=p{i},chunk=0.json" for i in range(300))
    assert len({d for d, _ in found}) <= 8  # tasks; there were 600 folders
    with open(os.path.join(*found[0])) as f:
        assert [s["section_title"] for s in json.load(f)] == ["t0", "t1", "t2"]
    back = readers.read_sections_json(spark, root, id_from="partition")
    assert _rows(back) == sorted(rows, key=str)
    assert [r.n for r in back.groupBy("file_id").count().withColumnRenamed("count", "n").collect()] == [3] * 300


def test_ids_of_any_kind_come_back(spark, tmp_path):
    root = str(tmp_path / "json")
    ids = ["a b", "ü%41,=x", "_u", " sp ", "007", "c/d", "x.json", "l" * 240, "chunk=7", None]
    rows = [(i, 0, "t", "x\ny") for i in ids] + [("many", 4, "t", "e"), ("many", 1, None, None), ("many", 0, "", "b")]
    df = spark.createDataFrame(rows, SCHEMA)
    for _ in range(2):  # the second time replaces the first
        writers.write_sections_json(df, root, chunk_size=2)
    want = [(i, 0, "t", "x\ny") for i in ids] + [("many", 4, "t", "e"), ("many", 1, None, None), ("many", 0, "", "b")]
    assert _rows(readers.read_sections_json(spark, root, id_from="partition", chunk_size=2)) == sorted(want, key=str)
    writers.write_sections_json(df.limit(0), root)
    assert readers.read_sections_json(spark, root, id_from="partition").collect() == []


def test_a_failed_write_leaves_what_was_there(spark, tmp_path):
    root = str(tmp_path / "out")
    good = spark.createDataFrame([("a", "1"), ("b", "2")], "name string, value string")
    files.write_files(good, root, lambda x: x)

    def name(x):
        if x == "c":
            raise ValueError("no name for c")
        return x

    with pytest.raises(Exception, match="no name for c"):
        files.write_files(spark.createDataFrame([("a", "3"), ("c", "4")], "name string, value string"), root, name)
    assert os.listdir(tmp_path) == ["out"]
    listed = files.list_files(spark, root)
    assert sorted(bytes(r.value) for r in files.read_files(listed, root, 2, 4).collect()) == [b"1\n", b"2\n"]


def test_files_are_found_and_named_as_spark_does(spark, tmp_path, monkeypatch):
    body = json.dumps([{"section_title": "t", "text": "x"}]).encode()
    for name in ("plain.json", "a b[1]%.json", "ü.json", "sub/deep/n.json", "_hidden.json", ".dot.json", "_h/n2.json", "_k=v.json"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    (tmp_path / "empty.json").write_bytes(b"")
    in_tasks = _rows(readers.read_sections_json(spark, str(tmp_path)))
    monkeypatch.setattr(readers.files, "shared_folder", lambda *x: None)
    assert in_tasks == _rows(readers.read_sections_json(spark, str(tmp_path)))
    assert len(in_tasks) == 5
    monkeypatch.undo()
    (tmp_path / "packed.json.gz").write_bytes(gzip.compress(body))
    assert ("packed.json.gz", 0, "t", "x") in _rows(readers.read_sections_json(spark, str(tmp_path)))


def test_a_path_without_an_id_is_an_error(spark, tmp_path):
    (tmp_path / "a.json").write_text("[]")
    with pytest.raises(Exception, match="no file_id in the path a.json"):
        readers.read_sections_json(spark, str(tmp_path), id_from="partition").collect()


def test_a_store_that_only_spark_opens(spark, tmp_path):
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.files.link./t", f"file://{tmp_path}")
    assert files.shared_folder(spark, "viewfs://files/t/json") is None
    assert files.shared_folder(spark, str(tmp_path)) == str(tmp_path)
    rows = [("7", 0, "t", "x"), ("7", 1, "u", "y"), ("8", 0, "t", "z")]
    writers.write_sections_json(spark.createDataFrame(rows, SCHEMA), "viewfs://files/t/json")
    assert _rows(readers.read_sections_json(spark, "viewfs://files/t/json", id_from="partition")) == rows
    assert _rows(readers.read_sections_json(spark, str(tmp_path / "json"), id_from="partition")) == rows
