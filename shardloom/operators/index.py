"""The shard/episode index: building, merging, totals and lookups.

files(name, shard_id, offset, audio_duration, speech_duration) has a row for each
source file or episode; shards(shard_id, partition, shard, n_samples,
global_offset) one for each shard, in the order of (partition, shard).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

TOLERANCE = 0.01
BROADCAST_SHARDS = 1_000_000


def episodes(segments: DataFrame) -> DataFrame:
    """segments(shard, file, offset, duration) -> a row for each file of a shard: first offset, segments, duration."""
    return segments.groupBy("shard", "file").agg(F.min("offset").alias("offset"), F.count(F.lit(1)).alias("n_segments"), F.sum("duration").alias("duration"))


def running_offsets(shards: DataFrame, order: list[str], size: str = "n_samples") -> DataFrame:
    """shards with shard_id and the exclusive running sum of their sizes (one row per shard: thousands of rows, one task)."""
    every = Window.partitionBy(F.lit(0)).orderBy(*order)
    before = F.coalesce(F.sum(size).over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint")
    return shards.withColumn("shard_id", (F.row_number().over(every) - 1).cast("int")).withColumn("global_offset", before)


def shard_index(files: DataFrame, segmented: bool, partition: str = "") -> DataFrame:
    """files(shard, n_segments, ...) -> shards with sizes and offsets."""
    size = F.sum("n_segments") if segmented else F.count(F.lit(1))
    counted = files.groupBy("shard").agg(size.cast("bigint").alias("n_samples")).withColumn("partition", F.lit(partition))
    return running_offsets(counted, ["partition", "shard"]).select("shard_id", "partition", "shard", "n_samples", "global_offset")


def small(shards: DataFrame) -> bool:
    """Is the shards table small enough to broadcast?  Counted up to the bound only."""
    return shards.limit(BROADCAST_SHARDS + 1).count() <= BROADCAST_SHARDS


def totals(files: DataFrame, shards: DataFrame) -> DataFrame:
    """One row: shards, files, samples, durations; speech durations of -1 (not known) aren't summed."""
    a = shards.agg(F.count(F.lit(1)).alias("n_shards"), F.coalesce(F.sum("n_samples"), F.lit(0)).alias("n_samples"))
    known = F.sum(F.when(F.col("speech_duration") >= 0, F.col("speech_duration")))
    return a.crossJoin(files.agg(F.count(F.lit(1)).alias("n_files"), F.sum("audio_duration").alias("audio_duration"), known.alias("speech_duration")))


def lookup_by_index(probes: DataFrame, shards: DataFrame, index: str = "i") -> DataFrame:
    """probes with shard_id and the offset in the shard; NULLs if there is no such sample.

    Shards partition the line of global offsets, so each probe asks for the last
    shard that begins at or before it.  Shards and probes meet in blocks of the
    line that are as long as the longest shard: an equi-join at any size.
    """
    width = F.lit(max(1, shards.agg(F.max("n_samples")).first()[0] or 1))
    reach = F.explode(F.sequence(F.floor(F.col("global_offset") / width), F.floor((F.col("global_offset") + F.col("n_samples") - 1) / width)))
    s = shards.where("n_samples > 0").select("shard_id", "global_offset", "n_samples", reach.alias("__block"))
    p = probes.withColumn("__block", F.floor(F.col(index) / width))
    on = (p["__block"] == s["__block"]) & (p[index] >= s["global_offset"]) & (p[index] < s["global_offset"] + s["n_samples"])
    return p.join(s, on, "left").select(*[p[c] for c in probes.columns], "shard_id", (p[index] - F.col("global_offset")).alias("offset"))


def lookup_by_key(probes: DataFrame, files: DataFrame, shards: DataFrame) -> DataFrame:
    """probes(file, segment) -> with shard_id, the offset in the shard and the global offset; only segments that the file has."""
    s = shards.select("shard_id", "global_offset")
    s = F.broadcast(s) if small(shards) else s
    hit = probes.join(files.select(F.col("name").alias("file"), "shard_id", F.col("offset").alias("__first"), "n_segments"), "file").where("segment >= 0 AND segment < n_segments")
    hit = hit.join(s, "shard_id")
    local = F.col("__first") + F.col("segment")
    return hit.select(*probes.columns, "shard_id", local.alias("offset"), (F.col("global_offset") + local).alias("global_offset"))


def export(files: DataFrame, shards: DataFrame) -> DataFrame:
    """The readable index: name, durations, shard and its size."""
    return files.join(shards.select("shard_id", "shard", "n_samples"), "shard_id").select("name", "audio_duration", "speech_duration", "shard", "n_samples")


def dump(files: DataFrame, shards: DataFrame) -> DataFrame:
    return files.join(shards.select("shard_id", "shard"), "shard_id").select("name", "shard", "offset").orderBy("name", "shard", "offset")


def with_source_durations(segments: DataFrame, sources: DataFrame) -> DataFrame:
    """Episodes with their source's audio duration; episodes without a source vanish."""
    return segments.join(sources.select(F.col("name").alias("file"), "audio_duration"), "file")


def merge(batches: list[DataFrame], by: str = "name", order: list | None = None) -> DataFrame:
    """The union of index batches with one row of each name, the first by (batch, order), sorted by name."""
    every = None
    for at, batch in enumerate(batches):
        batch = batch.withColumn("batch", F.lit(at))
        every = batch if every is None else every.unionByName(batch, allowMissingColumns=True)
    first = Window.partitionBy(by).orderBy("batch", *(order or []))
    return every.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n").orderBy(by)


def duplicate_files(files: DataFrame, order: list, tolerance: float = TOLERANCE) -> DataFrame:
    """Names that occur again: whether the duration agrees with the first's within the tolerance (skip) or not (error)."""
    w = Window.partitionBy("name").orderBy(*order)
    first = F.first("duration").over(w)
    again = files.withColumn("first_duration", first).withColumn("__n", F.row_number().over(w)).where("__n > 1").drop("__n")
    return again.withColumn("action", F.when(F.abs(F.col("duration") - F.col("first_duration")) < tolerance, F.lit("skip")).otherwise(F.lit("error")))


def expected_keys(files: DataFrame, shards: DataFrame, digits: int = 3) -> DataFrame:
    """All keys that the index says a shard has, in order: from the distance of each file's offset to the next's."""
    from shardloom.functions.keys import make_key

    w = Window.partitionBy("shard_id").orderBy("offset")
    f = files.join(shards.select("shard_id", "n_samples"), "shard_id").withColumn("__m", F.lead("offset", 1).over(w))
    f = f.withColumn("__m", F.coalesce("__m", "n_samples") - F.col("offset")).where("__m > 0")
    f = f.select("shard_id", "name", "offset", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__m") - 1)).alias("segment"))
    return f.select("shard_id", (F.col("offset") + F.col("segment")).alias("offset"), make_key(F.col("name"), F.col("segment"), digits).alias("key"))


def episode_stats(segments: DataFrame) -> DataFrame:
    """segments(file, segment, position): is each episode complete, every segment one after the one before?"""
    w = Window.partitionBy("file").orderBy("position")
    step = F.coalesce(F.col("segment") - F.lag("segment").over(w), F.lit(1))
    return segments.withColumn("__step", step).groupBy("file").agg(F.bool_and(F.col("__step") == 1).alias("consecutive"), F.count(F.lit(1)).alias("n_segments"))


def diff_keys(sources: DataFrame, derived: dict[str, DataFrame]) -> DataFrame:
    """Source files against the episode statistics of each derived dataset, outer joined; columns get the dataset's name."""
    out = sources.select("file")
    for name, stats in derived.items():
        out = out.join(stats.select("file", F.col("consecutive").alias(f"consecutive_{name}"), F.col("n_segments").alias(f"n_segments_{name}")), "file", "full_outer")
    return out


def overlay(samples: DataFrame, flags: DataFrame, name: str, index: str = "global_offset") -> DataFrame:
    """samples with a positional Boolean column; rows that it doesn't reach are NULL, none are dropped."""
    return samples.join(flags.select(index, F.col("flag").alias(name)), index, "left")
