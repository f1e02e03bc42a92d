"""What the pipeline's Python workers hold at once, and what they leave for the next stage."""

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlake.llm import decontaminate, near_dedup, piece_ids, quality, store

TEXTS = pa.array([f"word{i} " * 3000 for i in range(120)])  # some 3 MB


class Docs:
    """Stands in for a DataFrame and keeps the function given to mapInArrow."""

    def select(self, *_):
        return self

    def mapInArrow(self, work, _):
        self.work = work
        return self


def test_other_work_drops_the_encoders_that_packing_left():
    batch = pa.RecordBatch.from_arrays([TEXTS[:1]], ["text"])
    piece_ids.byte_encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert list(store.lean(lambda b: b, keeps=True)(iter([batch]))) == [batch]
    assert piece_ids._ENCODERS
    assert list(store.lean(lambda b: b)(iter([batch]))) == [batch]
    assert not piece_ids._ENCODERS


@pytest.mark.parametrize("module, name", [(near_dedup, "shingle_sets"), (quality, "features"), (decontaminate, "coded")])
def test_texts_are_worked_on_a_million_bytes_at_a_time(spark, monkeypatch, module, name):
    docs, seen, real = Docs(), [], getattr(module, name)
    if module is near_dedup:
        near_dedup.sketches(docs, 5)
    elif module is quality:
        docs.schema = spark.createDataFrame([], "doc_id long, text string").schema
        model = quality.Model(quality.np.zeros(quality.SIZE), quality.np.zeros(2))
        quality.score(docs, model)
    else:
        items = decontaminate.Items([(1, "what stands here is an item of some words")])
        decontaminate.search(docs, items, decontaminate.np.ones((1 << decontaminate.BITS, 4), "f4"))
    monkeypatch.setattr(module, name, lambda texts, *a: (seen.append((len(texts), texts.nbytes)), real(texts, *a))[1])
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(TEXTS))), TEXTS], ["doc_id", "text"])
    list(docs.work(iter([batch])))
    assert sum(n for n, _ in seen) == len(TEXTS)
    assert max(size for _, size in seen) <= 1_010_000


def test_leaks_need_no_python_rows_beside_the_search(spark):
    docs = spark.range(3).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    items = spark.range(1).select(F.col("id").alias("item_id"), F.lit("what stands here is an item").alias("text"))
    for bench in (items, items.limit(0)):
        out = decontaminate.leaks(docs, bench)
        assert out.dtypes == [("doc_id", "bigint"), ("item_id", "bigint"), ("share", "double")] and not out.count()
        assert "ExistingRDD" not in out._jdf.queryExecution().toString()


def test_every_stage_reads_and_sends_few_rows_at_a_time(spark, tmp_path):
    keys = ["spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxRecordsPerBatch"]
    session = spark.newSession()
    docs = session.createDataFrame([(1, "mail a@b.com")], "doc_id long, text string")
    assert corpus_pipeline.redact_pii(session, docs, str(tmp_path)).select(F.col("text")).first().text != "mail a@b.com"
    assert all(int(session.conf.get(k)) <= 1000 for k in keys)
