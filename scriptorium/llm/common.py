"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A key with more than this share of the rows is hot; there are at most as many hot keys.
HOT_SHARE = 1000
#: Rows that one step of an Arrow function holds as Python objects, and bytes of text where steps have many rows.
SLICE_ROWS, SLICE_BYTES = 256, 8 << 20
#: Rows and bytes of a step where a worker reads several tables from disk in each.
MANY_BLOCKS = 10_000, SLICE_BYTES
#: Lower-case A-Z and blank out every other ASCII byte that is no letter or digit.
_ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, a temporary folder is set in local mode, as
    in tests; on a cluster that is a RuntimeError, as executors see no folder of the driver.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = known.get() if known.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="scriptorium-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def table_written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    This cuts the lineage and outlives lost executors; the files go when the
    shared folder is cleaned.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/scriptorium/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """As ``table_written``, in about ``buckets`` buckets by ``key``, at most as many as Spark allows, so that joins on it don't shuffle this table.

    The table leaves the catalog at once; its files stay, and the result reads them.
    """
    spark = df.sparkSession
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000"))
    name = f"scriptorium_{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(max(1, min(buckets, most)), key).option("path", f"{shared_folder(spark)}/scriptorium/{name}").format("parquet").saveAsTable(name)
    out = spark.read.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


def drop_table(df: DataFrame) -> None:
    """Remove the files of a table that ``table_written`` wrote and nothing reads any more."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def join_hot(rows: DataFrame, table: DataFrame, on: list[str], total: int) -> DataFrame:
    """``rows`` joined with ``table(*on, n, ..)``, in which each key occurs once with ``n``, the number of its rows; ``n`` is left out.

    Keys with over a HOT_SHARE-th of the ``total`` rows, HOT_SHARE of them at
    most, are broadcast, so that their rows stay where they are; the other keys
    are shuffled.  Rows whose key isn't in the table are left out.
    """
    hot = F.broadcast(table.filter(F.col("n") * HOT_SHARE > total))
    rest = rows.join(hot.select(*on), on, "left_anti").join(table.filter(F.col("n") * HOT_SHARE <= total), on)
    return rows.join(hot, on).unionByName(rest).drop("n")


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, size: int | None = None) -> Iterator[pa.RecordBatch]:
    """Short pieces of each batch, in rows and, if ``size`` is given, in bytes of text, so that few texts are Python objects at once; a longer row is a piece of its own."""
    for batch in batches:
        if size is None or batch.nbytes <= size:
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)
            continue
        sizes = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
                sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        before, at = np.cumsum(sizes) - sizes, 0
        while at < batch.num_rows:
            end = max(at + 1, min(at + rows, int(np.searchsorted(before + sizes, before[at] + size, "right"))))
            yield batch.slice(at, end - at)
            at = end


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """A string column's values as UTF-8."""
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


def space_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a UTF-8 text; none for null."""
    return text.split() if text else []


def alnum_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text whose A-Z are lower-cased; none for null."""
    return text.translate(_ALNUM).split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijective scrambling of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def running(df: DataFrame, key: list[str], bucket: Column, order: list[Column], value: Column, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows before this one, by ``key`` in the order of (bucket, order).

    No task sees a whole key: sums of each bucket are accumulated first, and
    rows are then accumulated in their bucket.  ``bucket`` must follow the order.
    """
    df = df.withColumn("__bucket", bucket).withColumn("__value", value)
    cells = df.groupBy(*key, "__bucket").agg(F.sum("__value").alias("__cell"))
    before = Window.partitionBy(*key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)],
        F.col("__bucket").alias("__b"),
        F.coalesce(F.sum("__cell").over(before), F.lit(0)).alias("__base"),
    )
    same = (F.col("__bucket") == F.col("__b"))
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    inside = Window.partitionBy(*key, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("__inside", F.coalesce(F.sum("__value").over(inside), F.lit(0)))
        .join(cells, same)
        .withColumn(out, F.col("__base") + F.col("__inside"))
        .drop("__bucket", "__value", "__inside", "__b", "__base", *[f"__k{i}" for i in range(len(key))])
    )
