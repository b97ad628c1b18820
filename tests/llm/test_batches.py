"""The pipeline's stages send texts to Python in small batches."""

import pyarrow as pa
import pytest

import corpus_pipeline
from shardloom.llm import jaccard, kernels, packing, puquality

BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
ROWS = 3000


@pytest.fixture
def unbounded(spark):
    kept = spark.conf.get(BATCH_CONF, None)
    spark.conf.unset(BATCH_CONF)
    yield spark
    spark.conf.unset(BATCH_CONF)
    if kept is not None:
        spark.conf.set(BATCH_CONF, kept)


def texts(spark):
    return spark.range(ROWS).selectExpr("id AS doc_id", "concat('d', id, ' ', repeat('some words ', 400)) AS text")


def test_packing_holds_few_bytes_at_once(unbounded, monkeypatch):
    def sizes(capacity):
        def run(batches):
            for batch in batches:
                zero, none = pa.array([0], pa.int32()), pa.array([None], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), zero, zero, pa.array([batch.nbytes]), zero, zero, none], names=["doc_id", "piece", "lane", "window", "start", "length", "text"])

        return run

    monkeypatch.setattr(packing, "lane_batches", sizes)
    got = corpus_pipeline.packed(unbounded, texts(unbounded), "").collect()
    assert sum(r.doc_id for r in got) == ROWS and max(r.window for r in got) <= kernels.CHUNK_BYTES


def test_small_batches_give_the_same_packing(unbounded):
    whole = sorted(map(tuple, packing.pack(texts(unbounded)).collect()))
    assert len(whole) >= ROWS and sorted(map(tuple, corpus_pipeline.packed(unbounded, texts(unbounded), "").collect())) == whole


@pytest.mark.parametrize("stage, module, inner", [(corpus_pipeline.quality, puquality, "quality_stage"), (corpus_pipeline.near_dedup, jaccard, "near_stage")])
def test_other_stages_with_texts_bound_them_too(unbounded, monkeypatch, stage, module, inner):
    bounds = []
    monkeypatch.setattr(module, inner, lambda *_: bounds.append(unbounded.conf.get(BATCH_CONF, None)))
    stage(unbounded, None, "/root/testdata/sf0.001")
    assert bounds[0] is not None and int(bounds[0]) <= kernels.CHUNK_BYTES


def test_a_bound_of_the_session_stays(unbounded):
    unbounded.conf.set(BATCH_CONF, "123456")
    corpus_pipeline.packed(unbounded, texts(unbounded), "")
    assert unbounded.conf.get(BATCH_CONF) == "123456"
