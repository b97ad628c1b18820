"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from shardloom.shared import shared_folder, shared_path

from . import kernels

BROADCAST_ROWS = 1_000_000  # rows of a few numbers each, 50 MB at most; more are joined by a shuffle
KEY_TYPE = "k struct<a: long, b: long>"
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = kernels.CHUNK_BYTES * 7 // 8  # with its last row a batch is still one chunk, mostly


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """df by way of compressed files in the shared folder; cuts the lineage."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def limited(df: DataFrame) -> DataFrame:
    """df, as a broadcast if its counted rows are few; rows must be a few numbers wide."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def bounded_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of about BATCH_BYTES, from now on and in the whole session, unless it has a bound of its own.

    Spark's 64 MB, or 10 000 rows, are held by the executor and by each of its workers, several times while they grow.
    """
    if spark.conf.get(BATCH_CONF, None) is None:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def kind_of(df: DataFrame, column: str) -> str:
    """The SQL type of a column; identifiers keep theirs."""
    return df.schema[column].dataType.simpleString()


def new_name(df: DataFrame, name: str) -> str:
    """A name that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def columns(df: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in df.columns]


def row_key(id_col: str = "doc_id", text_col: str = "text"):
    """A key of 128 bits of a document's identifier and text."""
    both = [F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`").cast("string")]
    said = [F.when(x.isNull(), F.lit(1)).otherwise(F.lit(0)) for x in both]  # a null isn't hashed
    return F.struct(F.xxhash64(F.lit(7), *both, *said).alias("a"), F.xxhash64(F.lit(11), *both, *said).alias("b"))


def keep_rows(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of groups(k, group): the one with the smallest identifier, nulls last.

    k is the row's key and occurs once in groups; rows without a group stay.
    Rows that repeat identifier and text have one key: one of them is kept.
    """
    spark = docs.sparkSession
    shared_folder(spark)
    keyed = docs.select(row_key(id_col, text_col).alias("k"), F.col(f"`{id_col}`").alias("i"))
    counted = keyed.join(groups, "k").groupBy("k", "group").agg(F.min("i").alias("i"), F.count(F.lit(1)).alias("n"))
    counted = counted.join(counted.groupBy(F.col("group").alias("g")).agg(F.min(F.struct(F.col("i").isNull().alias("none"), "i", "k")).alias("best"), F.sum("n").alias("all")).where("all > 1"), F.col("group").eqNullSafe(F.col("g")))
    marked = stored(counted.select("k", (F.col("k") == F.col("best.k")).alias("kept"), "n").where("NOT kept OR n > 1"))
    packed = docs.select(F.struct(*columns(docs)).alias("row"), row_key(id_col, text_col).alias("k"))
    gone = limited(marked.select("k"))
    rest = packed.join(gone, "k", "left_anti")
    again = marked.where("kept").select("k")
    if not again.isEmpty():
        one = packed.join(limited(again), "k", "left_semi").withColumn("place", F.row_number().over(Window.partitionBy("k").orderBy(F.lit(1)))).where("place = 1").drop("place")
        rest = rest.unionByName(one)
    return rest.select("row.*")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the smallest node of each node's connected component.

    Every round links each node to the smallest root among its own and its
    neighbours' and then jumps to that root's root, so the rounds grow with the
    logarithm of a component's diameter.  Each round's table is checkpointed.
    """
    spark = edges.sparkSession
    shared_folder(spark)
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node IS NOT NULL AND other IS NOT NULL AND node <> other")
    both = both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct().checkpoint()
    roots = both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("root")).checkpoint()
    while True:
        seen = both.join(roots.select(F.col("node").alias("other"), F.col("root").alias("near")), "other").groupBy("node").agg(F.min("near").alias("near"))
        step = roots.join(seen, "node").select("node", F.least("root", "near").alias("next"), "root")
        jump = step.select(F.col("node").alias("next"), F.col("next").alias("far"))
        step = step.join(jump, "next", "left").select("node", F.least("next", "far").alias("root"), (F.least("next", "far") < F.col("root")).alias("moved"))
        step = step.checkpoint()
        roots = step.select("node", "root")
        if step.where("moved").isEmpty():
            return roots
