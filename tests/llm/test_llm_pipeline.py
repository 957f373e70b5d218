from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from sparkquill.llm import mixing, near_dup, token_coder, toxicity


def test_stages(spark, sf, tmp_path):
    """Each stage against brute force or its own operator, on the files that the stage before wrote."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id for r in docs.select("doc_id").collect()}
    benchmark = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        scores = None
        if name == "toxicity":
            scores = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        assert out.columns == docs.columns
        rows = out.collect()
        ids = [r.doc_id for r in rows]
        assert len(ids) == len(set(ids)) and set(ids) <= before
        if name == "toxicity":
            assert set(ids) == {i for i in before if scores[i] < 0.5}
        if name == "near_duplicates":
            assert near_dup.near_duplicates(out, percent=80).where("not kept").count() == 0
        if name == "decontamination":
            assert not any(b in " ".join(r.text.lower().split()) for r in rows for b in benchmark)
        if name == "mixing":
            assert set(ids) == before
        before, docs = set(ids), out
    place = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int")
    lying = [(r.doc_id, r.text) for r in docs.select("doc_id", "text", place.alias("file"), F.col("_metadata.row_index").alias("row")).orderBy("file", "row").collect()]
    slots = {r.doc_id: (r.slot, r.key) for r in mixing.schedule(docs, mixing.WEIGHTS).collect()}
    assert [i for i, _ in lying] == sorted(slots, key=slots.get)  # the files lie in the order of the mix
    tok = Tokenizer.from_file(token_coder.default_tokenizer())
    start, want = 0, []
    for i, text in lying:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    last = corpus_pipeline.STAGES[-1][1]
    assert sorted(map(tuple, last(spark, docs, sf).collect()), key=lambda r: r[1]) == want
    loose = spark.createDataFrame(docs.collect(), docs.schema)  # rows of no file are mixed first
    assert sorted(map(tuple, last(spark, loose, sf).collect()), key=lambda r: r[1]) == want
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect()), key=lambda r: r[1]) == want


def test_stages_of_empty_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0
