"""Small helpers that operators share: tables, checkpoints, row numbers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    Where the session has none, as in local tests, a temporary folder is set once.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-docgrid-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder at which nothing is yet."""
    return f"{shared_dir(spark).rstrip('/')}/docgrid/{uuid.uuid4().hex}"


def deleter(spark: SparkSession, path: str) -> Callable[[], None]:
    """A function that deletes the folder ``path`` of the shared store."""

    def delete() -> None:
        sc = spark.sparkContext
        place = sc._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)

    return delete


def stored(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """``df`` as Parquet in the shared folder, read back, and a function that deletes it once no plan reads it any more."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), deleter(spark, path)


def stored_by(df: DataFrame, by: str, made: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, Callable[[], None]]:
    """As ``stored``, in as many buckets of ``by`` as a shuffle has partitions: what is grouped or joined by it, however often, is not shuffled again.

    ``made`` is applied to the rows after they have been dealt; it keeps ``by``.
    """
    spark = df.sparkSession
    path, name, n = new_path(spark), f"docgrid_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    made(df.repartition(n, by)).write.format("parquet").bucketBy(n, by).option("path", path).saveAsTable(name)
    files = deleter(spark, path)

    def delete() -> None:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        files()

    return spark.table(name), delete


def written(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as Parquet in the shared folder and read it back."""
    return stored(df)[0]


#: Rows of a side that may be broadcast.
MOST_BROADCAST = 10_000


def is_small(df: DataFrame, most: int = MOST_BROADCAST) -> bool:
    """Whether ``df`` has at most ``most`` rows; stops counting beyond."""
    return df.limit(most + 1).count() <= most


def hinted(df: DataFrame, small: bool) -> DataFrame:
    """``df`` to be broadcast if it is small, else to be merged, whatever size Spark guesses for it."""
    return F.broadcast(df) if small else df.hint("merge")


def few(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    return hinted(df, is_small(df, most))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with so many underscores before it that no column of ``df`` has it in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


#: Rows and bytes of an Arrow batch: texts are long, so Spark's defaults of 10,000 rows and 64 MB would make batches of many megabytes.
BATCH_ROWS, BATCH_BYTES = 1000, 8_000_000
_ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(df):
    """``df``, after its session has been told to hand Python ``BATCH_ROWS`` rows and ``BATCH_BYTES`` at once, unless sizes are set there already."""
    conf = df.sparkSession.conf
    if conf.get(_ROWS) == "10000":
        conf.set(_ROWS, str(BATCH_ROWS))
    if conf.get(_BYTES) in ("67108864b", "64MB"):
        conf.set(_BYTES, f"{BATCH_BYTES}b")
    return df


def hashed_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


def running_start(df: DataFrame, order_by: list[str], weight: str, out: str = "row_start") -> DataFrame:
    """Add ``out``: the sum of ``weight`` over all rows before this one in the order of ``order_by``.

    Rows are range-partitioned by sampled splitters and sorted within their partition; one
    number for each partition reaches the driver, never the rows. The sorted rows are
    checkpointed, since a second sampling could choose other splitters.
    """
    schema = df.schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def number(batches):
        from pyspark import TaskContext

        import numpy as np

        part, total = TaskContext.get().partitionId(), 0
        for b in batches:
            w = b.column(b.schema.get_field_index(weight)).to_numpy(zero_copy_only=False).astype(np.int64)
            starts = total + np.cumsum(w) - w
            total += int(w.sum())
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(starts), pa.array(np.full(len(w), part, np.int32))],
                names=[*b.schema.names, "_local_start", "_part"],
            )

    asc = [F.asc_nulls_first(F.col(c)) for c in order_by]
    ordered = df.repartitionByRange(*asc).sortWithinPartitions(*asc)
    ordered = cut(ordered.mapInArrow(number, f"{fields}, _local_start long, _part int"))
    totals = sorted(ordered.groupBy("_part").agg(F.sum(weight).alias("n")).collect())
    offsets, at = [], 0
    for part, n in totals:
        offsets.append((part, at))
        at += n
    small = df.sparkSession.createDataFrame(offsets, "_part int, _offset long")
    return (
        ordered.join(F.broadcast(small), "_part")  # one row for each partition of the sort
        .withColumn(out, F.col("_offset") + F.col("_local_start"))
        .drop("_part", "_offset", "_local_start")
    )
