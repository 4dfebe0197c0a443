"""Readers and writers on files of their own."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quirework.sources import files, sinks


def test_json_lines(spark, tmp_path) -> None:  # noqa: ANN001
    (tmp_path / "a.jsonl").write_text('{"id": 1, "t": "x"}\n\n{"id": 2, "t": null}\n')
    (tmp_path / "b.jsonl").write_text('{"id": 1, "t": "x"}\n{broken\n')
    schema = "id long, t string"
    assert {(r.id, r.t) for r in files.read_jsonl(spark, str(tmp_path / "a.jsonl"), schema).collect()} == {(1, "x"), (2, None)}
    assert files.read_jsonl(spark, str(tmp_path / "b.jsonl"), schema, strict=False).filter("id = 1").count() == 1
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        files.read_jsonl(spark, str(tmp_path / "b.jsonl"), schema).collect()


def test_one_document_and_mapping(spark, tmp_path) -> None:  # noqa: ANN001
    (tmp_path / "d.json").write_text(json.dumps({"a": {"b": [1, 2]}}, indent=1))
    assert files.read_document(spark, str(tmp_path / "d.json"), "a struct<b:array<long>>").first()["a"]["b"] == [1, 2]
    (tmp_path / "m.jsonl").write_text('{"k": "a", "v": "1"}\n{"k": "b", "v": "2"}\n')
    assert files.read_mapping(spark, str(tmp_path / "m.jsonl"), "k string, v string", "k", ["v"]).count() == 2
    for bad in ('{"k": "a", "v": ""}\n', '{"k": "a", "v": "1"}\n{"k": "a", "v": "2"}\n'):
        (tmp_path / "m.jsonl").write_text(bad)
        with pytest.raises(ValueError):
            files.read_mapping(spark, str(tmp_path / "m.jsonl"), "k string, v string", "k", ["v"])


def test_artifact_and_responses(spark, tmp_path) -> None:  # noqa: ANN001
    for name in ("run/b_content_list.json", "run/a_content_list.json", "run/other.json"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("[]")
    assert files.locate_artifact(spark, str(tmp_path / "run")).endswith("/a_content_list.json")
    (tmp_path / "run/layout.json").write_text("{}")
    assert files.locate_artifact(spark, str(tmp_path / "run")).endswith("/layout.json")
    chunk = {"id": "c", "content": "t", "similarity": 0.5}
    bodies = [(1, json.dumps({"data": {"chunks": [chunk]}})), (2, json.dumps({"data": {"reference": {"chunks": [chunk, chunk]}}})), (3, "{}")]
    found = files.response_chunks(spark.createDataFrame(bodies, "i long, body string"), "body").groupBy("i").agg(F.count("chunk").alias("n"))
    assert {(r.i, r.n) for r in found.collect()} == {(1, 1), (2, 2), (3, 0)}


def test_a_failed_replacement_leaves_the_old_table(spark, tmp_path) -> None:  # noqa: ANN001
    path = str(tmp_path / "t")
    sinks.replace_table(spark.range(3), path)
    sinks.replace_table(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5
    with pytest.raises(Exception, match="no such luck"):
        sinks.replace_table(spark.range(2).select(F.raise_error(F.lit("no such luck")).cast("long").alias("id")), path)
    assert spark.read.parquet(path).count() == 5
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith("t.new")] == ["t"]


def test_only_given_versions_are_replaced(spark, tmp_path) -> None:  # noqa: ANN001
    path = str(tmp_path / "v")
    sinks.replace_versions(spark.createDataFrame([(1, "a"), (2, "b")], "id long, version string"), path, "version")
    sinks.replace_versions(spark.createDataFrame([(9, "b")], "id long, version string"), path, "version")
    assert {(r.id, r.version) for r in spark.read.parquet(path).collect()} == {(1, "a"), (9, "b")}
