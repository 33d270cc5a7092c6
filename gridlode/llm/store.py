"""Where intermediate tables go: the shared folder that the session names, never a machine-local one on a cluster."""

from __future__ import annotations

import tempfile
import time
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch in the stages that are written here.
BATCH_ROWS = 1_000
#: Spark's setting that removes the shuffle files of a query when it has ended; else they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Seconds at least between two times that the driver hands memory back.
TIDY_S = 10


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of our own only where it is unset (tests on one machine)."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not getattr(sc, "_gridlode_dir", None):
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc._gridlode_dir = "file://" + tempfile.mkdtemp(prefix="gridlode-")
    return sc._gridlode_dir


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read the table back. Later reads know its size.

    What the write has shuffled is removed from disk when it is done: nothing reads it again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/gridlode-{name}-{uuid.uuid4().hex}"
    # texts are long: fewer rows in an Arrow batch keep executors small; the setting is the session's again afterwards
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, cleanup = spark.conf.get(key), spark.conf.get(CLEANUP, "false")
    spark.conf.set(key, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
        spark.conf.set(CLEANUP, cleanup)
    if not hasattr(spark.sparkContext, "_gridlode_tables"):
        spark.sparkContext._gridlode_tables = []
    spark.sparkContext._gridlode_tables.append(path)
    tidy(spark)
    return spark.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Hands memory that the driver has done with back to the system, every TIDY_S seconds at most.

    Plans of many steps make garbage by which the heap grows long before it is full, and malloc keeps native memory
    that was freed. The latter goes back by a diagnostic command, where the JVM has it.
    """
    sc, now = spark.sparkContext, time.monotonic()
    if now - getattr(sc, "_gridlode_tidied", -TIDY_S) < TIDY_S:
        return
    jvm, array = sc._jvm, sc._gateway.new_array
    jvm.java.lang.System.gc()
    try:
        kinds, given = array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4)
        for k, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[k] = jvm.java.lang.Class.forName(name)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # the server's own class is closed to callers, its interface is not
        call = jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds)
        call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JError:  # a JVM that does not have it
        pass
    sc._gridlode_tidied = time.monotonic()


def discard(spark: SparkSession) -> int:
    """Removes the intermediate tables that this application has written, and says how many; call it when results are stored."""
    paths, jvm = getattr(spark.sparkContext, "_gridlode_tables", []), spark.sparkContext._jvm
    for p in paths:
        place = jvm.org.apache.hadoop.fs.Path(p)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    done = len(paths)
    del paths[:]
    return done


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
