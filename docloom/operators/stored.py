"""Tables that a plan reads more than once, and joins with small sides of a checked size."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

#: A side of at most so many narrow rows may be broadcast.
SMALL_ROWS = 100_000


def stored(df: DataFrame) -> DataFrame:
    """Write a table to the folder named by ``spark.checkpoint.dir`` and read it back, so that it is computed once and no lineage is kept.

    Where that is unset, a local master uses a folder below the warehouse; on a
    cluster that is an error, as executors would not share it.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
    path = f"{root.rstrip('/')}/docloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_small(rows: DataFrame, small: DataFrame, on: list[str], salt_by: str, salts: int = 16, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``small``, a stored table: broadcast up to SMALL_ROWS rows; beyond, each key is split by a hash of ``salt_by``."""
    if small.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        return rows.join(F.broadcast(small), on, how)
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int"))
    return dealt.join(small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [*on, "_salt"], how).drop("_salt")
