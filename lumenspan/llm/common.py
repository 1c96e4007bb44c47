"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words in every word-based contract.
SPACES = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    Catalyst may inline a projected column into a lambda and so evaluate it
    for each element; binding it as a lambda variable prevents that.
    """
    return F.transform(F.array(value), body)[0]


def spaced(text: Column) -> Column:
    """``text`` with a space for every ASCII white space; NULL: empty.  Byte searches, which cost far less than ``translate`` or a pattern."""
    out = F.coalesce(text, F.lit(""))
    for c in SPACES[1:]:
        out = F.replace(out, F.lit(c), F.lit(" "))
    return out


def word_array(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space; NULL text: none."""
    return F.array_remove(F.split(spaced(text), " "), "")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, from ``spark.checkpoint.dir``.

    Where the setting is absent, a single machine (tests) gets a folder of its
    own; on a cluster that is an error, since executors could not see it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='corpus-')}")
    return str(spark.sparkContext._jsc.sc().getCheckpointDir().get()).rstrip("/")


#: What was written to shared folders: (application, path, table or "").
_WRITTEN: list[tuple[str, str, str]] = []


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    This cuts lineage: lost executors cost nothing that is already written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark.sparkContext.applicationId, path, ""))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Deletes all that ``staged`` and ``Rows`` wrote; for when the results that read it are written."""
    own = [x for x in _WRITTEN if x[0] == spark.sparkContext.applicationId]
    for x in own:
        if x[2]:
            spark.sql(f"DROP TABLE IF EXISTS {x[2]}")
        at = spark._jvm.org.apache.hadoop.fs.Path(x[1])
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _WRITTEN.remove(x)


def give_back(spark: SparkSession) -> None:
    """Executors collect their garbage, and so return heap, generated classes and buffers that past jobs took.

    A heap that one stage has filled stays with its process, beside what the
    Python workers of the next stage need.  A task per core reaches the
    executors by chance of scheduling; one that is missed only keeps its memory.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


class Rows:
    """Long rows at rest: ``df`` with a unique long ``key``, written once, that later joins look into where they lie.

    Each task writes its rows into one bucket of a table, so writing shuffles
    nothing, and the bucket of a row can be told from its key.  ``join`` deals
    the other, short side to the buckets' tasks and reads the table in place:
    the long rows are never shuffled, whatever the sizes.
    """

    def __init__(self, df: DataFrame, key: str, name: str) -> None:
        spark = df.sparkSession
        self.key, (self.bucket,) = key, unused(df, "bucket")
        self.n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        values = spark.range(20 * self.n).groupBy(F.pmod(F.hash("id"), F.lit(self.n)).alias("of")).agg(F.min("id").alias("value")).collect()
        self.values = [r["value"] for r in sorted(values, key=lambda r: r["of"])]
        path, table = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
        _WRITTEN.append((spark.sparkContext.applicationId, path, table))
        # a bucket's tasks then serve a join by (bucket, key) without another shuffle
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        rows = df.withColumn(key, F.monotonically_increasing_id())
        rows.withColumn(self.bucket, self._of(F.col(key))).write.bucketBy(self.n, self.bucket).option("path", path).format("parquet").saveAsTable(table)
        self.all = spark.table(table)

    def _of(self, key: Column) -> Column:
        """The bucket of a key: tasks are dealt to buckets in turn."""
        turn = F.shiftright(key, 33) % len(self.values)
        return F.element_at(F.lit(self.values), turn.cast("int") + 1)

    @property
    def df(self) -> DataFrame:
        return self.all.drop(self.bucket)

    def dealt(self, few: DataFrame) -> DataFrame:
        """``few``, which has the key, with its bucket, in the buckets' tasks: a group by key needs no further shuffle."""
        return few.withColumn(self.bucket, self._of(F.col(self.key))).repartition(self.n, self.bucket)

    def join(self, few: DataFrame, how: str = "inner", *columns: str) -> DataFrame:
        """The rows (or ``columns`` of them) joined by key with ``few``, a row a key at most."""
        own = self.all.select(self.bucket, self.key, *columns) if columns else self.all
        few = few if self.bucket in few.columns else self.dealt(few)
        return own.join(few.hint("shuffle_hash"), [self.bucket, self.key], how).drop(self.bucket)


#: Bytes of rows that Spark hands to Python at once; its own bound (64 MB) is held several times over, in the JVM and in the worker.
BATCH_BYTES = 4 << 20


def in_arrow(df: DataFrame, run: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """``df.mapInArrow(run, schema)`` in bounded memory: small batches, and at a task's end the worker gives freed memory back to the system."""

    def tidied(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
            trim(0)

    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(conf.get(key).rstrip("bB")) == 64 << 20:  # nobody has set it
        conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(tidied, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, changed where ``df`` has columns so called, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
