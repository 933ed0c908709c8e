"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Text bytes handled at once inside a task; bounds what one Python worker holds.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about SLICE_BYTES of one column."""
    rows = batch.num_rows
    if not rows:
        return
    size = batch.column(column).nbytes
    step = max(1, min(rows, int(rows * SLICE_BYTES / max(size, 1))))
    for start in range(0, rows, step):
        yield batch.slice(start, step)


def append_columns(
    df: DataFrame,
    text_col: str,
    fields: list[T.StructField],
    make: Callable[[], Callable[[list], list[list]]],
    binary: bool = False,
    drop: tuple[str, ...] = (),
) -> DataFrame:
    """Add columns computed from one text column, batch by batch, without a shuffle.

    ``make`` runs once in each task and returns a function from a list of texts
    (``bytes`` if ``binary``; None for null) to one list for each new field.
    Input columns whose names clash with a new field, in any case, are replaced;
    columns in ``drop`` are left out of the result.
    """
    names = {f.name.lower() for f in fields}
    kept = [c for c in df.columns if c.lower() not in names and c not in drop]
    body = unused("text")
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").alias(body))
    schema = T.StructType([f for f in source.schema.fields if f.name != body] + fields)
    types = to_arrow_schema(T.StructType(fields)).types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for whole in batches:
            for batch in slices(whole, body):
                column = batch.column(body)
                values = (column.cast(pa.binary()) if binary else column).to_pylist()
                made = [pa.array(v, t) for v, t in zip(work(values), types, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + made, names=kept + [f.name for f in fields])

    return source.mapInArrow(run, schema)


def unused(name: str) -> str:
    """A column name that no input table has."""
    return f"{name}_{uuid.uuid4().hex}"


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share, named by ``spark.checkpoint.dir``.

    Where that is unset, a local master (as in tests) uses a folder below the
    warehouse; on a cluster that could be one machine's disk, so it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
    return f"{root.rstrip('/')}/docloom-{uuid.uuid4().hex}"


def materialize(df: DataFrame, path: str | None = None, rows_a_file: int = 0) -> DataFrame:
    """Write a DataFrame to the shared folder and read it back: lineage is cut and lost executors cost nothing.

    Rows of many MB need a limit for a file (0: none), as Spark reads the rows of a file thousands at a time.
    """
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_a_file).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove an intermediate table of the shared folder."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[..., DataFrame]]:
    """A function that materializes a DataFrame; its tables go when the block ends, by an error too."""
    paths: list[str] = []

    def stored(df: DataFrame, rows_a_file: int = 0) -> DataFrame:
        paths.append(shared_dir(spark))
        return materialize(df, paths[-1], rows_a_file)

    try:
        yield stored
    finally:
        for path in paths:
            drop_path(spark, path)


#: A table of at most so many rows, each of a few short columns, may be broadcast.
SMALL_ROWS = 20_000


def lookup(facts: DataFrame, dims: DataFrame, on: list[str], how: str = "inner", salts: int = 16) -> DataFrame:
    """``facts`` joined with ``dims``, a stored table with one row a key.

    ``dims`` is counted first: up to SMALL_ROWS rows are broadcast. Beyond that
    every key is split into ``salts`` parts by a hash of the fact row, so one
    key with a third of all rows is dealt to that many tasks. These are merged:
    Spark judges ``dims`` by its file and would broadcast all parts of every key.
    ``salts`` of 1 is for facts that are large only with ``dims``: each part is a copy of ``dims``.
    """
    if dims.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        return facts.join(F.broadcast(dims), on, how)
    if salts == 1:
        return facts.join(dims.hint("merge"), on, how)
    salt = unused("salt")
    dealt = facts.withColumn(salt, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in facts.columns]), F.lit(salts)).cast("int"))
    parts = dims.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(parts.hint("merge"), [*on, salt], how).drop(salt)
