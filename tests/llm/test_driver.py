"""What the operators ask of the driver: few jobs, however many partitions, and little memory."""

import tracemalloc
from contextlib import contextmanager

import numpy as np

from ledgerloom.llm import common, ngram_join
from ledgerloom.llm.langid import train
from ledgerloom.llm.mixing import mix
from ledgerloom.llm.ngram_join import ngram_classes
from ledgerloom.llm.token_binary import read_tokens


@contextmanager
def many_partitions(spark):
    kept = {"spark.sql.shuffle.partitions": "120", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in kept}
    for k, v in kept.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def jobs(spark, work) -> int:
    """Spark numbers its jobs: those between two of our own."""

    def last() -> int:
        spark.sparkContext.setJobGroup(group := f"count-{np.random.default_rng().integers(1 << 60)}", "")
        spark.sparkContext.parallelize([1], 1).count()
        return max(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    before = last()
    work()
    return last() - before - 1


def test_jobs_do_not_follow_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(100)
    slots = lambda batch: batch.column(0).to_numpy() % 1024
    with many_partitions(spark):
        assert jobs(spark, lambda: common.summed(docs.select("doc_id"), slots, 10, "x")) <= 4
        assert jobs(spark, lambda: train(docs)) <= 25
        assert jobs(spark, lambda: mix(docs)) <= 50
        manifest = spark.createDataFrame([(i, f"p{i}", 1, i) for i in reversed(range(300))], "part long, path string, size long, n_ids long")
        assert jobs(spark, lambda: read_tokens(manifest)) <= 4


def test_marks(spark):
    ids = spark.range(0, 20_000, 3, 7).select("id")
    tracemalloc.start()
    got = common.marked(ids, lambda batch: batch.column(0).to_numpy() & ((1 << 23) - 1), 23)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20  # a bit a cell; a count a cell were 64 MB
    assert np.flatnonzero(np.unpackbits(got, bitorder="little")).tolist() == list(range(0, 20_000, 3))
    assert not common.marked(ids.limit(0), lambda batch: batch.column(0).to_numpy(), 4).any()


def test_classes_take_little_driver_memory(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    ngram_classes(docs.limit(2)).count()
    tracemalloc.start()
    ngram_classes(docs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * (1 << ngram_join.CELL_BITS) * 4  # a few arrays of as many counts; 68 MB of marks before
