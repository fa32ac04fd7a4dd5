"""Shared pieces: scratch tables, passthrough maps, byte-level word splitting."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. Arrow batches are kept small, as texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    A cluster must name one. Only on a local master, as in tests, a folder
    under /tmp is used where the setting is missing.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (found or "/tmp/checkpoints").rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there.

    A lost executor costs only the tasks that were running; later stages read
    the files again instead of recomputing what made them.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/lamella/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a materialised table that nothing reads any more."""
    spark = df.sparkSession
    root = f"{scratch_root(spark)}/lamella/"
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        if "/lamella/" in folder and folder.split("/lamella/")[0].split(":")[-1].lstrip("/") == root.split(":")[-1].lstrip("/").split("/lamella/")[0]:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(hadoop).delete(path, True)


def texts_of(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, nulls as None."""
    return column.cast(pa.binary()).to_pylist()


def add_columns(
    df: DataFrame,
    inputs: list[str],
    added: T.StructType,
    make: Callable[[], Callable[..., list[tuple]]],
) -> DataFrame:
    """Appends columns computed from ``inputs``, batch by batch.

    ``make()`` runs once per task and returns a function from the input
    columns (Arrow arrays) to one tuple a row. All other columns pass through
    untouched, whatever their type; an input column whose name equals an
    added one is replaced by it.
    """
    new = {f.name.lower() for f in added.fields}
    keep = [f for f in df.schema.fields if f.name.lower() not in new]
    helpers = [F.col(f"`{c}`").cast("string").alias(f"__in{i}") for i, c in enumerate(inputs)]
    source = df.select(*[F.col(f"`{f.name}`") for f in keep], *helpers)
    schema = T.StructType([*keep, *added.fields])
    width = len(keep)
    arrow_added = pa.schema([pa.field(f.name, arrow_type(f.dataType)) for f in added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = work(*[batch.column(width + i) for i in range(len(inputs))])
            cols = list(zip(*rows))
            arrays = [pa.array(c, type=f.type) for c, f in zip(cols, arrow_added)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(width)] + arrays,
                names=[f.name for f in keep] + arrow_added.names,
            )

    return source.mapInArrow(run, schema)


def arrow_type(kind: T.DataType) -> pa.DataType:
    simple = {
        T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64(), T.FloatType: pa.float32(),
        T.BooleanType: pa.bool_(), T.StringType: pa.string(), T.BinaryType: pa.binary(),
    }
    if isinstance(kind, T.ArrayType):
        return pa.list_(arrow_type(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([pa.field(f.name, arrow_type(f.dataType)) for f in kind.fields])
    return simple[type(kind)]


def rows_map(
    df: DataFrame, schema: T.StructType, make: Callable[[], Callable[[pa.RecordBatch], Iterator[list[tuple]]]], partitioned: bool = False
) -> DataFrame:
    """mapInArrow whose worker yields lists of result tuples for each batch.

    The function made by ``make`` is called with each batch, then once with
    None at the end of the partition to flush what it holds.
    """
    arrow = pa.schema([pa.field(f.name, arrow_type(f.dataType)) for f in schema.fields])

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows:
                for rows in work(batch):
                    if rows:
                        yield pack(rows)
        for rows in work(None):
            if rows:
                yield pack(rows)

    return df.mapInArrow(run, schema)
