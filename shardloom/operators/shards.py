"""Logical sharding of any table, and operators that work inside shards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

SHARD, OFFSET = "__shard__", "__shard_offset__"


def with_shards(df: DataFrame, shard: Column, order: list) -> DataFrame:
    """df with its shard and the row number from 0 inside it, by ``order`` (a total order)."""
    return df.withColumn(SHARD, shard).withColumn(OFFSET, F.row_number().over(Window.partitionBy(SHARD).orderBy(*order)).cast("bigint") - 1)


def zip_columns(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Columns of two column groups of the same shards, side by side by row position."""
    right = right.select(SHARD, OFFSET, *[F.col(f"`{c}`") for c in right.columns if c not in (SHARD, OFFSET, *left.columns)])
    return left.join(right, [SHARD, OFFSET], how)


def null_fill(shards: DataFrame, df: DataFrame, bad: Column) -> DataFrame:
    """Rows of all shards(shard, n); those of a shard for which ``bad`` holds are NULL in every column but shard and offset."""
    places = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n").cast("bigint") - 1))
    every = shards.where("n > 0").select(F.col("shard").alias(SHARD), places.alias(OFFSET), bad.alias("__bad"))
    values = [c for c in df.columns if c not in (SHARD, OFFSET)]
    joined = every.join(df, [SHARD, OFFSET], "left")
    return joined.select(SHARD, OFFSET, *[F.when(~F.col("__bad"), F.col(f"`{c}`")).alias(c) for c in values])


def per_shard_agg(df: DataFrame, *aggregates: Column) -> DataFrame:
    """One row for each shard: how aggregate expressions are evaluated when each shard is a query of its own."""
    return df.groupBy(SHARD).agg(*aggregates)


def per_shard_window() -> Window:
    return Window.partitionBy(SHARD).orderBy(OFFSET)


def shard_pipe(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """An Arrow table function for each shard by itself, its rows in order."""
    return df.groupBy(SHARD).applyInArrow(lambda t: function(t.sort_by(OFFSET)), schema)


def missing_matrix(present: DataFrame, dirs: list[str]) -> DataFrame:
    """present(dir, shard) -> for each dir the shards it has, those it lacks of the union, and its state."""
    names = present.sparkSession.createDataFrame([(d,) for d in dirs], "dir string")
    union = present.select("shard").distinct()
    have = present.select("dir", "shard").distinct().withColumn("here", F.lit(True))
    grid = F.broadcast(names).crossJoin(union).join(have, ["dir", "shard"], "left")
    counted = grid.groupBy("dir").agg(F.count_if(F.col("here")).alias("n_present"), F.count_if(F.col("here").isNull()).alias("n_missing"))
    return counted.withColumn("state", F.when(F.col("n_missing") == 0, F.lit("COMPLETE")).otherwise(F.concat(F.lit("MISSING "), F.col("n_missing").cast("string"))))


def misaligned_keys(left: DataFrame, right: DataFrame, key: str = "__key__") -> DataFrame:
    """Positions whose keys differ between two column groups; a key that only one has is NULL on the other side."""
    a = left.select(SHARD, OFFSET, F.col(key).alias("left_key"))
    b = right.select(SHARD, OFFSET, F.col(key).alias("right_key"))
    return a.join(b, [SHARD, OFFSET], "full_outer").where("NOT (left_key <=> right_key)")
