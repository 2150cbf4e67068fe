"""Scratch tables in the cluster's shared folder, connected components, and small helpers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; on one machine (a local master) without it, a new temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        now = spark.sparkContext._jsc.sc().getCheckpointDir()
        if now.isDefined():
            return now.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        at = tempfile.mkdtemp(prefix="sievemill-")
        spark.sparkContext.setCheckpointDir(at)
    return at


class Scratch:
    """Tables written once below the shared folder, so that any executor can read them again after a loss.

    `keep` writes a frame and returns it as read from the files, with its lineage cut; `drop` deletes a table that no
    later step reads. What is left goes when the driver's Python ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}.parquet"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        # small row groups: a writer holds one in memory
        df.write.mode("overwrite").option("parquet.block.size", 16 << 20).parquet(self._path(name))
        return self.spark.read.schema(df.schema).parquet(self._path(name))

    def _delete(self, path: str) -> None:
        try:
            jvm = self.spark._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session has ended; the folder is the cluster's to clear
            pass

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self._path(name))

    def close(self) -> None:
        self._delete(self.root)


def driver_gives_back(spark: SparkSession) -> None:
    """Has the driver's JVM give memory back: a full collection, which also unloads the classes of earlier plans, lets the heap
    shrink to some 1.4 times what lives (by default 3.3 times), and freed native memory goes back to the system.

    The share of the heap that may stay free holds from then on. A JVM that can't do one of these does the others.
    """
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array

    def bean(name: str, operation: str, *args: str) -> None:
        # by way of the interface: the server's own class can't be reached
        kind, text = jvm.java.lang.Class.forName, jvm.java.lang.String
        given, types = array(jvm.java.lang.Object, len(args)), array(text, len(args))
        for i, arg in enumerate(args):
            given[i], types[i] = arg, "java.lang.String"
        kinds, values = array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4)
        for i, k in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = kind(k)
        values[0], values[1], values[2], values[3] = jvm.javax.management.ObjectName(f"com.sun.management:type={name}"), operation, given, types
        with contextlib.suppress(Py4JError):
            kind("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)

    bean("HotSpotDiagnostic", "setVMOption", "MinHeapFreeRatio", "15")
    bean("HotSpotDiagnostic", "setVMOption", "MaxHeapFreeRatio", "30")
    jvm.System.gc()
    bean("DiagnosticCommand", "systemTrimNativeHeap")


def give_back(spark: SparkSession) -> None:
    """Has the JVMs of the driver and of the executors give memory back that their heaps hold without use.

    A heap grows to the need of its largest stage and stays so, beside the Python workers of all later ones; a full
    collection lets it shrink. Its tasks are short: one that an executor doesn't get is no harm.
    """
    driver_gives_back(spark)
    n = 4 * spark.sparkContext.defaultParallelism
    # one row a task; the call has no value
    spark.range(n, numPartitions=n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc")).alias("x")).write.format("noop").mode("overwrite").save()


def small_batches(spark: SparkSession) -> None:
    """Limits the Arrow batches of the session's Python stages to 4 MB of rows, or fewer if the session says so.

    By default a batch holds 10,000 rows, so its memory, in the JVM and again in Python, would grow with the texts.
    """
    name, most = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if now > most:
        spark.conf.set(name, str(most))


def pick(df: DataFrame, **cols: str) -> DataFrame:
    """Only the named columns under plain names; extra columns, also clashing ones, go."""
    return df.select(*[F.col(f"`{c}`").alias(k) for k, c in cols.items()])


#: A map of ids has so many bits for each id, in words of 64, and at most 2 ** BITS: 2 ** 21 rows of 16 bytes.
EACH, BITS = 16, 27


def _map_of(ids: DataFrame, key: str) -> tuple[DataFrame, int]:
    """The words of the map of the column `key` of `ids` that aren't 0, as rows (__word, __set), and its bits."""
    n = ids.count()
    bits = min(BITS, max(16, (n * EACH).bit_length()))
    h = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(64)).cast("int"))
    return ids.groupBy(F.shiftright(h, 6).alias("__word")).agg(F.bit_or(one).alias("__set")), bits


def _marked(df: DataFrame, ids: DataFrame, key: str, value: Column) -> DataFrame:
    """Adds __in: false if `value` is surely not among the ids."""
    words, bits = _map_of(ids, key)
    h = F.pmod(F.xxhash64(value), F.lit(1 << bits))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(64)).cast("int"))
    out = df.join(F.broadcast(words), F.shiftright(h, 6) == F.col("__word"), "left")
    return out.withColumn("__in", F.coalesce(F.col("__set").bitwiseAND(one) != 0, F.lit(False))).drop("__word", "__set")


def perhaps_in(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of `df` whose `key` may be among the column `key` of `ids`, before a join that would shuffle all of them.

    The map that is broadcast grows with the ids up to 32 MB (`BITS`), which serves some ten million ids with few rows
    passed in vain; of more it passes more, up to all. No row of an id is lost. `ids` is read twice: keep it first.
    """
    return _marked(df, ids, key, F.col(key)).where("__in").drop("__in")


def split_by(df: DataFrame, ids: DataFrame, key: str, value: Column) -> tuple[DataFrame, DataFrame]:
    """The rows of `df` whose `value` is surely not among the column `key` of `ids`, and the others (see `perhaps_in`).

    So rows that a join with few ids doesn't concern, with their texts, stay where they are. Null values are in one of both.
    """
    both = _marked(df, ids, key, value)
    return both.where("not __in").drop("__in"), both.where("__in").drop("__in")


def labels(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest of the numbers below n that each is joined with by edges u, v: roots are hooked below smaller ones."""
    label = np.arange(n)
    while True:
        a, b = label[u], label[v]
        if (a == b).all():
            return label
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, up := label[label]):
            label = up


def _labelled(it):
    """Rows (node, component) of all edges of a task."""
    batches = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in it if b.num_rows]
    if batches:
        ends = np.concatenate([x for side in zip(*batches, strict=True) for x in side])
        nodes, at = np.unique(ends, return_inverse=True)
        m = len(ends) // 2
        found = nodes[labels(at[:m], at[m:], len(nodes))]
        for lo in range(0, len(nodes), 1 << 16):
            yield pa.RecordBatch.from_pydict({"node": nodes[lo : lo + (1 << 16)], "component": found[lo : lo + (1 << 16)]})


def components(scratch: Scratch, edges: DataFrame, name: str = "cc", at_once: int = 0) -> DataFrame:
    """Smallest id reachable from each node of `edges` (a, b long): rows (node, component).

    Alternating large-star and small-star steps; each halves the depth of the trees, and each is written to the shared
    folder. A star step reads each edge once, so a node with very many edges is a sorted group only in the shuffle of
    its minimum, which is pre-aggregated; the rows themselves meet it in a join that Spark may split.

    Up to `at_once` edges (some 100 bytes of memory each) are joined in one task instead, in two jobs.
    """
    e = scratch.keep(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}0")
    if at_once and e.count() <= at_once:
        out = scratch.keep(e.coalesce(1).mapInArrow(tidied(_labelled), "node long, component long"), f"{name}1")
        scratch.drop(f"{name}0")
        return out
    i = 0
    while True:
        # large star: every neighbour above u goes to the smallest of u and its neighbours
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: u and its neighbours below it go to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").where("a <> b").distinct()
        i += 1
        new = scratch.keep(small, f"{name}{i}")
        same = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if i > 1 and same == last or not same[0]:
            scratch.drop(f"{name}{i - 1}")
            return new.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(new.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        scratch.drop(f"{name}{i - 1}")
        last, e = same, new


def tidied(fn, *release):
    """A function over a task's batches that gives memory back at its end: Python workers live on between tasks.

    `release` are calls that empty what the process has kept, such as a loaded tokenizer.
    """

    def run(it):
        try:
            yield from fn(it)
        finally:
            for call in release:
                call()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only
            if trim:
                trim(0)

    return run
