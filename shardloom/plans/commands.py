"""Commands over datasets: list, inspect, index and validate them; what a command line and scheduled jobs call."""

from __future__ import annotations

import io
import json
import os
import sqlite3
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from shardloom.functions.keys import dataset_key
from shardloom.operators import index as ix
from shardloom.operators import validate as check
from shardloom.plans.dataset import Dataset
from shardloom.sources.catalog import KEY, Catalog, read_schema

IN_PROGRESS = ".in-progress"


# -- looking at datasets


def list_keys(data: Dataset, ref: tuple[str, str]) -> Iterator[str]:
    """The keys of a shard in order; ValueError if its batches are uneven, so positions can't be trusted."""
    group = data.catalog.fields[KEY][0][0]
    footer = check.read_footer(data.catalog.path(group, ref))
    if not footer["ok"] or not footer["even"]:
        raise ValueError(f"shard {ref} is damaged or has uneven batches")
    for row in data.sequence(ref, [KEY]):
        yield row[KEY]


def inspect(data: Dataset) -> DataFrame:
    """(field, type, dir, column, shards) of every field."""
    rows = [(f.name, f.dataType.simpleString(), f.metadata.get("dir"), f.metadata.get("column"), len(data.catalog.shards.get(f.metadata.get("dir"), {})) or None) for f in data.schema]
    return data.spark.createDataFrame(rows, "field string, type string, dir string, column string, shards int")


def head_shard(data: Dataset, ref: tuple[str, str], n: int = 5, fields: list[str] | None = None) -> list:
    return list(data.sequence(ref, fields or list(data.catalog.fields), 0, n))


def dump_index(data: Dataset) -> DataFrame:
    """(name, shard, offset) of the dataset's index."""
    return ix.dump(*data.index)


def files_of_shard(data: Dataset, partition: str, shard: str) -> DataFrame:
    """(name, offset) of the files of one shard, by the index."""
    files, shards = data.index
    return files.join(shards.where((F.col("partition") == partition) & (F.col("shard") == shard)).select("shard_id"), "shard_id").select("name", "offset")


def as_file(value) -> io.IOBase:
    """A file object of a path, of bytes, or of a scalar that holds bytes."""
    if isinstance(value, (str, os.PathLike)):
        return open(value, "rb")  # noqa: SIM115
    if hasattr(value, "read"):
        return value
    return io.BytesIO(bytes(value.as_py() if hasattr(value, "as_py") else value))


# -- building an index


def episode_list(data: Dataset, audio_duration: str = "0.0", speech_duration: str = "CAST(NULL AS DOUBLE)") -> DataFrame:
    """(partition, shard, file, offset, n_segments, audio_duration, speech_duration) of one batch; durations are expressions over its fields."""
    rows = data.select(KEY, "__partition__", "__shard__", "__shard_offset__", f"{audio_duration} AS audio", f"{speech_duration} AS speech")
    file, _ = dataset_key(F.col(KEY), data.segmented)
    found = rows.where(F.col(KEY).isNotNull()).select(F.col("__partition__").alias("partition"), F.col("__shard__").alias("shard"), file.alias("file"), F.col("__shard_offset__").alias("offset"), "audio", "speech")
    return found.groupBy("partition", "shard", "file").agg(F.min("offset").alias("offset"), F.count(F.lit(1)).alias("n_segments"), F.sum("audio").cast("double").alias("audio_duration"), F.sum("speech").cast("double").alias("speech_duration"))


def extract(spark: SparkSession, roots: dict[str, str], to: str, segmented: bool = False, **durations) -> DataFrame:
    """Episode lists and field maps of several datasets, one folder for each; (name, files, error) of each.  A dataset that can't be read is logged, and the others go on."""
    done = []
    for name, root in sorted(roots.items()):
        try:
            data = Dataset(spark, root, segmented=segmented)
            episode_list(data, **durations).write.mode("overwrite").parquet(f"{to}/{name}/episodes")
            text = json.dumps({f: places for f, places in data.catalog.fields.items()}, sort_keys=True)
            spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{to}/{name}/fields")
            done.append((name, spark.read.parquet(f"{to}/{name}/episodes").count(), None))
        except Exception as e:  # noqa: BLE001
            done.append((name, None, f"{type(e).__name__}: {e}"[:1000]))
    log = spark.createDataFrame(done, "name string, files long, error string")
    log.coalesce(1).write.mode("overwrite").parquet(f"{to}/log")
    return log


def merge_index(spark: SparkSession, folder: str, to: str, tolerance: float = ix.TOLERANCE, **metadata) -> tuple[DataFrame, DataFrame]:
    """One stored index of the extracted episode lists; files that occur again in a later batch with another duration are an error."""
    names = sorted(r["name"] for r in spark.read.parquet(f"{folder}/log").where("error IS NULL").collect())
    lists = [spark.read.parquet(f"{folder}/{n}/episodes").withColumn("batch", F.lit(i)) for i, n in enumerate(names)]
    every = lists[0]
    for one in lists[1:]:
        every = every.unionByName(one)
    again = ix.duplicate_files(every.select(F.col("file").alias("name"), F.col("audio_duration").alias("duration"), "batch", "shard", "offset"), ["batch", "shard", "offset"], tolerance)
    wrong = again.where("action = 'error'").limit(3).collect()
    if wrong:
        raise ValueError("other durations: " + ", ".join(r["name"] for r in wrong))
    counted = every.groupBy("partition", "shard").agg(F.sum("n_segments").cast("bigint").alias("n_samples"))
    shards = ix.running_offsets(counted, ["partition", "shard"]).select("shard_id", "partition", "shard", "n_samples", "global_offset")
    first = ix.merge([every.drop("batch")], "file", ["shard", "offset"]).drop("batch")
    files = first.join(shards.select("partition", "shard", "shard_id"), ["partition", "shard"]).select(F.col("file").alias("name"), "shard_id", "offset", "n_segments", "audio_duration", F.coalesce("speech_duration", F.lit(-1.0)).alias("speech_duration"))
    files.write.mode("overwrite").parquet(f"{to}/files")
    shards.coalesce(1).write.mode("overwrite").parquet(f"{to}/shards")
    spark.createDataFrame([(json.dumps(metadata),)], "value string").coalesce(1).write.mode("overwrite").text(f"{to}/metadata")
    return spark.read.parquet(f"{to}/files"), spark.read.parquet(f"{to}/shards")


def index_totals(files: DataFrame, shards: DataFrame, metadata: dict) -> dict:
    """Shards, files, samples and durations; a duration that the metadata states wins over the sum."""
    row = ix.totals(files, shards).first().asDict()
    return {**row, **{k: metadata[k] for k in ("audio_duration", "speech_duration") if metadata.get(k) is not None}}


def sqlite_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """(files, shards, metadata) of an index in a SQLite file, opened read-only.  It is read by the driver, in pieces, into Parquet of the shared folder."""
    from shardloom.shared import shared_path

    out = []
    with sqlite3.connect(f"file:{Path(path).resolve()}?mode=ro&immutable=1", uri=True) as db:
        for table, schema in (("files", "name string, shard_id int, offset long, audio_duration double, speech_duration double"), ("shards", "shard_id int, shard string, n_samples long, global_offset long, partition string")):
            columns, to = [c.split()[0] for c in schema.split(", ")], shared_path(spark, "sqlite")
            rows = db.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM {table}")  # noqa: S608
            spark.createDataFrame([], schema).write.mode("append").parquet(to)
            while part := rows.fetchmany(100_000):
                spark.createDataFrame(part, schema).write.mode("append").parquet(to)
            out.append(spark.read.schema(schema).parquet(to))
        found = db.execute("SELECT value FROM metadata").fetchone()
    return *out, json.loads(found[0]) if found else {}


def write_link(root: str, name: str, dataset_dir: str, vad_column: str, loader: str = "segment", suffix: str = ".shard") -> Path:
    """The link file by which a segmented dataset finds its source."""
    path = Path(root) / f"{name}{suffix}-link"
    part = path.with_name(path.name + ".part")
    part.write_text(json.dumps({"dataset_dir": dataset_dir, "loader": loader, "vad_column": vad_column}, indent=1))
    part.replace(path)
    return path


# -- validation


def finish(folder: str, suffix: str = ".shard") -> bool:
    """Drop ``.in-progress`` from the name of a column group once all its shards have a schema."""
    path = Path(folder)
    shards = [e for e in path.iterdir() if e.name.endswith(suffix)] if path.is_dir() else []
    if not path.name.endswith(IN_PROGRESS) or not shards or any(read_schema(e) is None for e in shards):
        return False
    path.rename(path.with_name(path.name[: -len(IN_PROGRESS)]))
    return True


def validate_dataset(spark: SparkSession, root: str, segmented: bool = False) -> list[tuple[str, str]]:
    """(what, problem): damaged or uneven shards, schemas that differ, column groups of other lengths or keys, an index that is missing or wrong."""
    try:
        data = Dataset(spark, root, segmented=segmented)
    except ValueError as e:
        return [(root, str(e))]
    if not data.catalog.shards:
        return [(root, "has no shards")]
    found = check.footers(spark, data.catalog).cache()
    out = [(f"{r.dir}/{r.shard}", "damaged") for r in found.where("NOT ok").collect()]
    out += [(f"{r.dir}/{r.shard}", "uneven batches") for r in check.uneven_batches(found).collect()]
    out += [(r.dir, "different schemas") for r in check.schema_groups(found).groupBy("dir").count().where("count > 1").collect()]
    out += [(r.shard, f"{r.least} to {r.most} rows") for r in check.row_count_conflicts(found).collect()]
    found.unpersist()
    groups = [d for d, _ in data.catalog.fields.get(KEY, [])]
    for other in groups[1:] if not out else []:
        n = data.key_mismatches(groups[0], other).count()
        if n:
            out.append((other, f"{n} keys differ from {groups[0]}"))
    if not (Path(data.catalog.root) / "index" / "files").is_dir():
        return [*out, (root, "has no index")]
    data.open_index()
    stated = data.index[1].agg(F.sum("n_samples")).first()[0] or 0
    if not stated:
        out.append((root, "the index is empty"))
    elif not out and stated != data.select(KEY).count():
        out.append((root, f"the index says {stated} samples"))
    return out


def validate_tree(spark: SparkSession, root: str) -> list[tuple[str, str]]:
    """validate_dataset() of every dataset below a folder: folders that hold column groups."""
    out = []
    for path, dirs, _ in os.walk(root):
        if any(e.name.endswith(".shard") for d in dirs for e in os.scandir(Path(path) / d) if e.is_file()):
            out += [(f"{os.path.relpath(path, root)}: {what}", problem) for what, problem in validate_dataset(spark, path)]
            dirs.clear()
    return out


def main(arguments: list[str] | None = None) -> int:
    """python -m shardloom COMMAND DATASET [...]"""
    import argparse

    parser = argparse.ArgumentParser(prog="shardloom", description=__doc__)
    parser.add_argument("command", choices=["list", "inspect", "head_shard", "dump_index", "init", "validate", "validate_tree", "finish"])
    parser.add_argument("dataset")
    parser.add_argument("--shard", default="")
    parser.add_argument("--partition", default="")
    parser.add_argument("--segmented", action="store_true")
    parser.add_argument("-n", type=int, default=5)
    a = parser.parse_args(arguments)
    if a.command == "finish":
        return 0 if finish(a.dataset) else 1
    spark = SparkSession.builder.getOrCreate()
    if a.command in ("validate", "validate_tree"):
        problems = validate_dataset(spark, a.dataset, a.segmented) if a.command == "validate" else validate_tree(spark, a.dataset)
        for what, problem in problems:
            print(f"{what}: {problem}")
        return 1 if problems else 0
    data, ref = Dataset(spark, a.dataset, segmented=a.segmented), (a.partition, a.shard)
    try:
        if a.command == "list":
            for key in list_keys(data, ref):
                print(key)
        elif a.command == "inspect":
            print(data.summary())
            for r in inspect(data).toLocalIterator():
                print(r.field, r.type, r.dir or "-")
        elif a.command == "head_shard":
            for row in head_shard(data, ref, a.n):
                print(row.asDict())
        elif a.command == "init":
            print(data.write_index())
        else:
            data.open_index()
            for r in dump_index(data).toLocalIterator():
                print(r["name"], r["shard"], r["offset"])
    except (ValueError, FileNotFoundError) as e:
        print(e)
        return 1
    return 0
