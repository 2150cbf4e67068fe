"""Memory that is given back between stages."""

import inspect

import corpus_pipeline
from sievemill.llm.common import driver_gives_back, give_back


def test_give_back_collects_in_every_task(spark):
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    count = lambda: sum(b.getCollectionCount() for b in beans())
    before = count()
    give_back(spark)
    # on one machine the driver's JVM runs the tasks too
    assert count() - before >= 4 * spark.sparkContext.defaultParallelism


def test_stages_after_large_ones_give_back():
    stages = dict(corpus_pipeline.STAGES)
    assert all("give_back(spark)" in inspect.getsource(stages[s]) for s in ("near_dedup", "substrings", "packing"))


def test_driver_heap_shrinks_to_what_lives(spark):
    jvm = spark.sparkContext._jvm
    driver_gives_back(spark)
    heap = jvm.java.lang.management.ManagementFactory.getMemoryMXBean().getHeapMemoryUsage()
    # 30 % may stay free, and some regions are young by then; by default 70 %
    assert 0.6 * heap.getCommitted() <= heap.getUsed() + (24 << 20)
