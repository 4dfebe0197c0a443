"""The wrappers of op8 to op10: bounded samples, folds whose labels are never read, columns, held-out accuracy."""

from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F

pytest.importorskip("quirework.llm")

from quirework.llm import langid, queries  # noqa: E402
from quirework.llm.labelled import labelled_sample  # noqa: E402

SF = "/root/testdata/sf0.01"
HELD = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(20_000)}


def test_samples_stay_bounded_when_ids_repeat(spark):  # noqa: ANN001, ANN201
    docs = spark.range(40).select((F.col("id") % 4).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    labels = spark.range(40).select((F.col("id") % 4).alias("doc_id"), (F.col("id") % 2).alias("quality"))
    assert labelled_sample(docs, labels, "quality", sample=25).count() == 25
    one = [tuple(r) for r in labelled_sample(docs.repartition(5), labels.repartition(3), "quality", sample=7).collect()]
    assert sorted(one) == sorted(tuple(r) for r in labelled_sample(docs, labels, "quality", sample=7).collect())
    assert labelled_sample(docs, labels.limit(0), "quality").count() == 0


def test_language_rows_without_ids_are_drawn(spark):  # noqa: ANN001, ANN201
    words = {"a": "alpha beta gamma delta", "b": "uno dos tres cuatro"}
    rows = [(None, f"{words[k]} {i}", k) for k in words for i in range(90)] + [(1, None, "a"), (2, "x", None), (3, "123", "c")]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, label string").repartition(4)
    model = langid.fit(labelled, sample=100)
    assert model.labels == ["a", "b"]
    found = langid.predict(labelled.filter("label IN ('a', 'b')"), model, [F.col("label")]).filter("lang_pred = row.label").count()
    assert found == 180
    assert langid.fit(labelled.limit(0)).labels == []


@pytest.fixture(scope="module")
def copied(spark, tmp_path_factory):  # noqa: ANN001, ANN201
    """The tables, with what held-out rows are labelled turned around."""
    path = str(tmp_path_factory.mktemp("turned"))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    docs.withColumn("lang", F.when(held, "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("other")).write.parquet(f"{path}/documents.parquet")
    labels.withColumns({c: F.when(held, 1 - F.col(c)).otherwise(F.col(c)) for c in ("quality", "toxic")}).write.parquet(f"{path}/labels.parquet")
    return path


@pytest.mark.parametrize(("name", "label"), [("op8_quality", "quality"), ("op9_toxicity", "toxic"), ("op10_language_id", "lang")])
def test_held_out_labels_are_never_read(spark, copied, name, label):  # noqa: ANN001, ANN201
    given = {r["doc_id"]: r for r in queries.QUERIES[name](spark, SF).collect()}
    turned = {r["doc_id"]: r for r in queries.QUERIES[name](spark, copied).collect()}
    what = "lang_pred" if label == "lang" else "predicted"
    assert set(given) == set(turned) and all(given[i]["held_out"] == HELD[i] and given[i][what] == turned[i][what] and abs(given[i]["score"] - turned[i]["score"]) < 1e-9 for i in given)
    assert all(0 <= r["score"] <= 1 for r in given.values())
    table, cut = ("documents", None) if label == "lang" else ("labels", 0.3 if label == "quality" else 0.5)
    truth = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{SF}/{table}.parquet").collect()}
    held = [i for i in truth if HELD[i] and i in given]
    assert sum(given[i][what] == truth[i] for i in held) / len(held) > 0.9
    if cut:
        assert all(r["predicted"] == int(r["score"] >= cut) for r in given.values())
