"""The pipeline over a small table with planted cases."""

from __future__ import annotations

import corpus_pipeline
from odolake.llm.decontaminate import contaminations


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    base = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{base}/documents.parquet")
    first = docs.filter("length(text) > 400 and lang = 'en'").orderBy("doc_id").first()
    item = spark.read.parquet(f"{base}/benchmark.parquet").filter("length(text) > 150").first()["text"]
    extra = [(9001, None, "en", "s", 0), (9002, "", "en", "s", 0), (9003, "1234", "en", "s", 4), (9004, first["text"], "en", "s", 5),
             (9005, first["text"] + " tail", "en", "s", 5), (9006, first["text"][::-1] + ". " + item, "en", "s", 5)]
    folder = str(tmp_path)
    docs.unionByName(spark.createDataFrame(extra, docs.schema)).write.parquet(f"{folder}/documents.parquet")
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{base}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    rows = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, folder)
        assert out.columns == docs.columns
        out.write.parquet(f"{folder}/out-{name}")
        rows = spark.read.parquet(f"{folder}/out-{name}")
        kept[name] = {r["doc_id"] for r in rows.select("doc_id").collect()}
        if name == "lines":
            assert rows.filter("n_chars != length(text)").isEmpty()
    assert not kept["language"] & {9001, 9002, 9003} and len(kept["language"]) > 0.97 * docs.count()
    assert kept["lines"] == kept["language"]
    assert not kept["near_duplicates"] & {9004, 9005} and first["doc_id"] in kept["near_duplicates"]
    assert 9006 in kept["near_duplicates"] and 9006 not in kept["decontamination"]
    assert contaminations(rows, spark.read.parquet(f"{folder}/benchmark.parquet")).isEmpty()
    final = corpus_pipeline.run(spark, folder)
    assert {r["doc_id"] for r in final.select("doc_id").collect()} == kept["decontamination"]
    assert final.filter("rate is null or rate < 0").isEmpty()
