"""What the operators of this subpackage share: reading, materialising and bounded Arrow batches."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, NumericType, StringType

#: Java pattern of a word; bytes.split() of Python splits at exactly the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"

#: Text bytes that one NumPy step works on at most, unless a single text is longer.
STEP_BYTES = 1 << 19


def tune(spark: SparkSession) -> None:
    """Bound what one Arrow batch brings into a Python worker, in rows and in bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a table, as Spark would hold it in memory, that may be broadcast: what Spark allows itself by default.
BROADCAST_BYTES = 10 << 20
_written: dict[str, list[str]] = {}  # by application: what `materialize` wrote and `release` has not deleted


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share.

    Only where a session on this machine alone names none, as in a local test, a temporary folder is
    made and set; on a cluster that is an error, since executors would not see each other's files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-checkpoint-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that `release` will delete."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: the lineage is cut, and lost executors lose nothing.

    The files stay until `release`, as results read them later.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(spark: SparkSession) -> list[str]:
    """The paths that `release` would delete, the oldest first."""
    return list(_written.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete the given paths, or all that operators wrote in this application, once no DataFrame that reads them is needed."""
    mine = _written.get(spark.sparkContext.applicationId, [])
    for path in written(spark) if paths is None else paths:
        found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(found, True)
        if path in mine:
            mine.remove(path)
    # Spark deletes the shuffle files of DataFrames that are gone when the driver collects its garbage
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def keep_last(spark: SparkSession, before: list[str]) -> None:
    """Delete what was written since `written` gave `before`, but for the last path: a table just written needs nothing it was made from."""
    release(spark, [x for x in written(spark)[:-1] if x not in before])


def is_small(df: DataFrame, most_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether df's rows have at most most_bytes together: each counts with its fixed parts and with the bytes of its strings.

    df should be a table just written: it is counted.
    """
    fixed, varying = 16, F.lit(0)
    for field in df.schema.fields:
        fixed += 8 + 16 * isinstance(field.dataType, (StringType, BinaryType))
        if isinstance(field.dataType, (StringType, BinaryType)):
            varying = varying + F.coalesce(F.octet_length(field.name), F.lit(0))
        elif not isinstance(field.dataType, (NumericType, BooleanType)):
            raise TypeError(f"{field.name}: only columns of numbers and strings have a known size")
    got = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(varying), F.lit(0)).alias("size")).first()
    return got["n"] * fixed + got["size"] <= most_bytes


def small_side(df: DataFrame, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast if it is small, else unmarked (a shuffle join follows)."""
    return F.broadcast(df) if is_small(df, most_bytes) else df


def unused(name: str, *taken: DataFrame) -> str:
    """name, with as many underscores before it as it takes to clash with no column of the given tables, whatever their case."""
    known = {c.lower() for df in taken for c in df.columns}
    while name.lower() in known:
        name = f"_{name}"
    return name


def with_row(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a struct (file, at) that tells its rows apart, and that column's name.

    It names a file and a place in it, so it is the same however a scan is split and whenever it is
    repeated. A DataFrame that isn't a plain table of files is written first.
    """
    try:
        if not docs._jdf.queryExecution().analyzed().children().isEmpty():
            raise ValueError("rows of a derived table have no place of their own in a file")
        meta = docs.metadataColumn("_metadata")
        named = docs.select("*", F.struct(F.xxhash64(meta["file_path"]).alias("file"), meta["row_index"].alias("at")).alias(unused("_row", docs)))
        files = docs.inputFiles()
        if not files or docs.sparkSession.createDataFrame([(f,) for f in files], "f string").select(F.count_distinct(F.xxhash64("f"))).first()[0] < len(files):
            raise ValueError("two files with the same hash")
        return named, named.columns[-1]
    except (AnalysisException, ValueError):
        return with_row(materialize(docs, "rows"))


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets) of a string column, offsets from 0; null counts as empty."""
    pa.default_memory_pool().release_unused()  # a worker serves many tasks and should not keep what earlier batches took
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def steps(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most `most` bytes together; a longer text comes alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def place_of(row: str | None) -> list[Column]:
    """The columns file and at of a struct that `with_row` made; none if there is none."""
    return [F.col(row)[x].alias(x) for x in ("file", "at")] if row else []


def at_places(named: DataFrame, row: str, places: DataFrame, how: str) -> DataFrame:
    """The join of named (see `with_row`) with a table just written that has file and at, which it loses, beside columns of other names than those of named."""
    file, at = unused("_file", named), unused("_at", named)
    renamed = small_side(places.withColumnsRenamed({"file": file, "at": at}))
    joined = named.join(renamed, (F.col(row)["file"] == F.col(file)) & (F.col(row)["at"] == F.col(at)), how)
    return joined.drop(file, at, row)


def running(df: DataFrame, order: list, sums: dict[str, str], name: str) -> DataFrame:
    """df with, for each (new: old) of sums, the sum of column old over the rows before this one; order must tell all rows apart.

    Rows are sorted into ranges, each range sums its own, and the sums of whole ranges, one row for
    each partition, are added up: no task holds more than a range.
    """
    part = unused("_range", df)
    cut = materialize(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), name)
    ranges = cut.groupBy(F.col(part).alias("_r")).agg(*[F.sum(old).alias(f"_sum_{new}") for new, old in sums.items()])
    # one row for each shuffle partition
    ranges = ranges.select("_r", *[F.coalesce(F.sum(f"_sum_{new}").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_before_{new}") for new in sums])
    own = cut.select("*", *[F.coalesce(F.sum(old).over(Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_own_{new}") for new, old in sums.items()])
    joined = own.join(F.broadcast(ranges), F.col(part) == F.col("_r"))
    return joined.select(*df.columns, *[(F.col(f"_own_{new}") + F.col(f"_before_{new}")).alias(new) for new in sums])
