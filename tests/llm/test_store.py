"""What intermediate tables leave on disk and in the driver."""

import gc
import re
import time
from pathlib import Path

from corpus_samples import prose

from gridlode.llm.store import CLEANUP, materialize
from gridlode.llm.substring_dedup import substring_dedup


def shuffled(spark):
    """The shuffle files of the session."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for k in range(files.size()) if (n := files.apply(k).getName()).startswith("shuffle_")}


def left_by(spark, work):
    """Names of the shuffle files that ``work`` leaves; they are removed without being waited for."""
    before = shuffled(spark)
    out = work()
    until = time.time() + 10
    while (left := shuffled(spark) - before) and time.time() < until:
        time.sleep(0.1)
    return out, left


def test_a_written_table_leaves_no_shuffle_files(spark):
    before = spark.conf.get(CLEANUP)
    counts = spark.range(10_000).selectExpr("id % 97 AS k").groupBy("k").count()
    table, left = left_by(spark, lambda: materialize(counts, "counts"))
    assert not left and spark.conf.get(CLEANUP) == before
    assert table.count() == 97 and counts.count() == 97


def test_passages_are_found_without_the_shuffles_of_the_first_passes(spark, make_docs):
    """The texts, fingerprints and windows of the first passes are not on disk while words are lent and texts are cut."""
    docs = make_docs([(i, prose(i % 20, 60)) for i in range(60)]).repartition(3)
    docs = materialize(docs, "docs")
    done, left = left_by(spark, lambda: substring_dedup(docs, buckets=5, parts=3))
    assert not left
    assert done.where("n_removed > 0").count() == 40


def resident(spark):
    """MB of the driver's JVM."""
    pid = spark.sparkContext._jvm.java.lang.ProcessHandle.current().pid()
    return int(re.search(r"VmRSS:\s+(\d+)", Path(f"/proc/{pid}/status").read_text())[1]) / 1024


def test_memory_of_the_driver_goes_back(spark):
    """Native memory that was freed between pieces still held, as a compiler leaves it, and heap that a plan has grown."""
    sc, kept, loose = spark.sparkContext, [], []
    for k in range(3_000):
        (kept if k % 100 == 99 else loose).append(sc._jvm.java.nio.ByteBuffer.allocateDirect(1 << 16))
    before = resident(spark)
    del loose
    gc.collect()
    sc._gridlode_tidied = -1e9
    materialize(spark.range(1), "one")
    until = time.time() + 20
    while (now := resident(spark)) > before - 100 and time.time() < until:  # buffers go after the collection that finds them
        sc._gridlode_tidied = -1e9
        materialize(spark.range(1), "one")
    assert now < before - 100


def test_memory_is_handed_back_no_more_often_than_said(spark):
    materialize(spark.range(1), "one")
    at = spark.sparkContext._gridlode_tidied
    materialize(spark.range(1), "one")
    assert spark.sparkContext._gridlode_tidied == at or time.monotonic() - at > 5
