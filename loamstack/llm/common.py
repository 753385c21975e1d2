"""What the training-data operators share: the cluster's shared folder, cut points, row ids and Arrow maps."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it; a local one is made only where none is named."""
    folder = spark.conf.get(SETTING, None)
    if not folder:
        # The folder of one machine serves only where all tasks run in this process.
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"{SETTING} must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="loamstack-")
        spark.conf.set(SETTING, folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, with the scheme that Spark itself would take, so that all libraries agree on it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}")
    full = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub(r"^file:/+", "file:///", full)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes a table into the shared folder and reads it back: short lineage that outlives any executor. It goes when the driver ends."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    context = df.sparkSession.sparkContext
    made = context._jvm.org.apache.hadoop.fs.Path(path)
    made.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(made)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that ``cut`` wrote, once nothing reads it any more."""
    context = df.sparkSession.sparkContext
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = context._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def plain(df: DataFrame, *needed: str) -> DataFrame:
    """``df`` with names that can't clash: the needed columns keep theirs, the others become c_0, c_1 and so on by place.

    A needed column is the one of exactly that name, else the first whose name differs by case only.
    """
    at = {}
    for name in needed:
        same = [i for i, c in enumerate(df.columns) if c == name] or [i for i, c in enumerate(df.columns) if c.lower() == name]
        if not same:
            raise ValueError(f"no column {name} among {df.columns}")
        at[same[0]] = name
    return df.toDF(*(at.get(i, f"c_{i}") for i in range(len(df.columns))))


def nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def map_rows(
    df: DataFrame,
    columns: list[str],
    make: Callable[[], Callable[..., Iterable[tuple]]],
    schema: str | T.StructType,
) -> DataFrame:
    """An Arrow map from some columns to new rows. ``make`` runs once a task; what it returns gets lists, one a column."""
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    kind = to_arrow(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in pieces(batch):
                rows = list(work(*(column.to_pylist() for column in part.columns)))
                if rows:
                    data = [pa.array(list(values), type=f.type) for f, values in zip(kind, zip(*rows, strict=True), strict=True)]
                    del rows
                    yield pa.RecordBatch.from_arrays(data, schema=kind)
        del work
        release()

    return plain(df, *columns).select(*columns).mapInArrow(run, fields)


def keep_rows(df: DataFrame, columns: list[str], make: Callable[[], Callable[..., list[bool]]]) -> DataFrame:
    """A filter over whole rows, all columns unchanged; ``make`` as for map_rows, giving a flag for each row."""
    names, df = df.columns, plain(df, *columns)
    at = [df.columns.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in pieces(batch):
                yield part.filter(pa.array(work(*(part.column(i).to_pylist() for i in at)), type=pa.bool_()))
        del work
        release()

    return df.mapInArrow(run, nullable(df.schema)).toDF(*names)


def release() -> None:
    """Gives a worker's freed memory back to the machine, so that what one task needed doesn't stay with the worker for the next."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def pieces(batch: pa.RecordBatch, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``limit`` bytes, so that long texts don't add up in a worker's memory."""
    step = max(1, int(batch.num_rows * limit / max(limit, batch.nbytes)))
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


def to_arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def word_count(text: str = "text"):
    """Runs of non-blank characters in a text; 0 for null and empty ones. Stays in the JVM."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("bigint")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Memo(dict):
    """A dict that computes what it lacks, and forgets all beyond a number of entries."""

    def __init__(self, compute: Callable, most: int = 300_000):
        super().__init__()
        self.compute, self.most = compute, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.compute(key)
        return value


BITMAP_BITS = 1 << 26
_WORD = 32768


def _slot(column):
    return F.pmod(F.xxhash64(column.cast("bigint")), F.lit(BITMAP_BITS))


def bitmap(ids: DataFrame) -> DataFrame:
    """The slots of the ids (one column of integers) as BITMAP_BITS / 32768 rows at most, of 4 KB each."""
    (name,) = ids.columns
    return (
        ids.where(F.col(name).isNotNull())
        .select(_slot(F.col(name)).alias("__slot"))
        .groupBy(F.floor(F.col("__slot") / _WORD).cast("bigint").alias("__word"))
        .agg(F.bitmap_construct_agg(F.col("__slot") % _WORD).alias("__bits"))
    )


def maybe_in(docs: DataFrame, ids: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``docs`` with a flag ``__maybe``: false only if the row's id is surely not among ``ids`` (one column of integers).

    The ids are hashed into a bitmap of fixed size (8 MB, twice that as a hash table) that is broadcast, so what is sent
    doesn't grow with the data; past its capacity more rows are flagged, and the join that follows decides. Null ids are
    not flagged.
    """
    held = F.expr(
        "shiftright(cast(conv(hex(substring(__bits, cast(floor(__at % 32768 / 8) as int) + 1, 1)), 16, 10) as int), cast(__at % 8 as int)) & 1 = 1"
    )
    joined = docs.withColumn("__at", _slot(docs[id_column])).join(F.broadcast(bitmap(ids)), F.floor(F.col("__at") / _WORD) == F.col("__word"), "left")
    bit = F.col("__bits").isNotNull() & docs[id_column].isNotNull() & held
    return joined.withColumn("__maybe", F.coalesce(bit, F.lit(False))).select(*docs.columns, "__maybe")
