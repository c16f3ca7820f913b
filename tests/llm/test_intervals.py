"""Blocks travel once per owner, and large rows come to Python a few at a time."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from phenospark.llm import intervals, texts as tx


@pytest.mark.parametrize("width", [1, 3, 4])
def test_every_pair_meets_once(spark, width):
    n = 10
    blocks = spark.createDataFrame([(i, [i, i + 100]) for i in range(n)], "block long, v array<long>")
    wanted = {(a, b) for a in range(n) for b in range(a, n) if a == b or (a + b) % 3}
    pairs = spark.createDataFrame(sorted(wanted), "a long, b long")
    rows = intervals.with_partners(pairs, blocks, ["v"], n, width)

    def met(batches):
        for own, other in intervals.partners(batches, ["v"]):
            a = own[0][0].as_py()
            b = a if other is None else other[0][0].as_py()
            yield pa.RecordBatch.from_pydict({"a": pa.array([min(a, b)]), "b": pa.array([max(a, b)])})

    got = [tuple(r) for r in rows.mapInArrow(met, "a long, b long").collect()]
    assert len(got) == len(wanted) and set(got) == wanted
    if width > 1:  # a block is sent once to an owner of several blocks
        assert rows.count() < len(wanted)


def test_batches_of_large_rows_are_small(spark):
    rows = spark.range(64).coalesce(1).withColumn("x", F.repeat(F.lit("x"), 100_000))
    count = lambda: rows.mapInArrow(lambda it: (pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows])}) for b in it), "n long")
    assert count().count() == 1
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    with tx.small_batches(spark, "1m"):
        assert count().agg(F.max("n")).first()[0] <= 12
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


@pytest.mark.parametrize("stage", [f for _, f in cp.STAGES], ids=[n for n, _ in cp.STAGES])
def test_stages_leave_small_batches_for_their_result(spark, stage, monkeypatch):
    """The result of a stage is written after it returns."""
    for module, name in ((cp.quality, "keep_good"), (cp.simhash, "similar_texts"), (cp.suffix_dedup, "strip_texts"), (cp.decontaminate, "remove_contaminated"), (cp.packing, "pack")):
        monkeypatch.setattr(module, name, lambda *a: 1 / 0)
    before = spark.conf.get(tx.BATCH_BYTES)
    try:
        with pytest.raises(ZeroDivisionError):
            stage(spark, spark.range(1), "/root/testdata/sf0.001")
        assert spark.conf.get(tx.BATCH_BYTES) == tx.SMALL_BATCH
    finally:
        spark.conf.set(tx.BATCH_BYTES, before)
