"""Spark data source for Arrow shards: one input partition for each shard, column groups zipped inside it."""

from __future__ import annotations

import json
import os
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThanOrEqual, In, InputPartition, LessThan
from pyspark.sql.types import StructType

from shardloom import errors
from shardloom.errors import KeyMismatchError
from shardloom.sources import types

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(types)
cloudpickle.register_pickle_by_value(errors)
FORMAT = "shardloom"
BATCH_ROWS = 4096
KEY = "__key__"
SPECIAL = ("__partition__", "__shard__", "__shard_path__", "__shard_offset__")


class ShardPartition(InputPartition):
    def __init__(self, shard: dict, low: int = 0, high: int | None = None):
        self.shard, self.low, self.high = shard, low, high


def row_ranges(path: str, columns: list[str], low: int, high: int | None):
    """The table slices of a shard's batches between two rows; whole batches outside are skipped by the footer's batch size."""
    source = pa.memory_map(path)
    with source, pa.ipc.open_file(source, options=pa.ipc.IpcReadOptions()) as reader:
        at, size = 0, int((reader.schema.metadata or {}).get(b"batch_size", 0))
        first = low // size if size else 0
        at = first * size
        for number in range(first, reader.num_record_batches):
            if high is not None and at >= high:
                return
            batch = reader.get_batch(number).select(columns)
            begin, end = max(0, low - at), batch.num_rows if high is None else min(batch.num_rows, high - at)
            at += batch.num_rows
            if begin < end:
                yield batch.slice(begin, end - begin)


class Rows:
    """Takes as many rows as are asked for from a stream of batches of any size."""

    def __init__(self, batches):
        self.batches, self.held = iter(batches), None

    def available(self) -> int:
        while self.held is None or not self.held.num_rows:
            self.held = next(self.batches, None)
            if self.held is None:
                return 0
        return self.held.num_rows

    def take(self, n: int) -> pa.RecordBatch:
        out, self.held = self.held.slice(0, n), self.held.slice(n)
        return out


def read_shard(partition: ShardPartition, columns: list[list[str]], schema: pa.Schema, verify: list[str] = ()):
    """columns: [name, directory, stored name] of the fields, or [name] for special columns; the directories ``verify`` must have equal keys."""
    shard, low = partition.shard, partition.low
    by_dir: dict[str, list[str]] = {}
    for column in columns:
        if len(column) > 1 and column[2] not in by_dir.setdefault(column[1], []):
            by_dir[column[1]].append(column[2])
    for d in verify:
        if KEY not in by_dir.setdefault(d, []):
            by_dir[d].append(KEY)
    if not shard["ok"]:  # all columns are NULL, for as many rows as the index says
        count = shard["n"] or 0
        end = count if partition.high is None else min(count, partition.high)
        for at in range(low, end, BATCH_ROWS):
            n = min(BATCH_ROWS, end - at)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, f.type) for f in schema], schema=schema)
        return
    streams = {d: Rows(row_ranges(shard["paths"][d], names, low, partition.high)) for d, names in by_dir.items()}
    at = low
    while True:
        ready = [s.available() for s in streams.values()]
        n = min([BATCH_ROWS, *ready])
        if not n or not ready:
            if any(ready):
                raise ValueError(f"column groups of shard {shard['shard']} have different numbers of rows")
            return
        parts = {d: s.take(n) for d, s in streams.items()}
        keys = {d: parts[d].column(parts[d].schema.get_field_index(KEY)) for d in verify}
        for d in list(keys)[1:]:
            if not keys[d].equals(keys[verify[0]]):
                wrong = next(i for i, (x, y) in enumerate(zip(keys[verify[0]].to_pylist(), keys[d].to_pylist())) if x != y)
                raise KeyMismatchError(f"{shard['shard']}[{at + wrong}]: {verify[0]} has {keys[verify[0]][wrong]}, {d} has {keys[d][wrong]}")
        out = []
        for column, f in zip(columns, schema):
            if len(column) > 1:
                out.append(types.as_readable(parts[column[1]].column(parts[column[1]].schema.get_field_index(column[2])), f.type))
            elif column[0] == "__shard_offset__":
                out.append(pa.array(range(at, at + n), pa.int64()))
            else:
                value = {"__partition__": shard["partition"], "__shard__": shard["shard"], "__shard_path__": shard["key_path"]}[column[0]]
                out.append(pa.array([value] * n, pa.string()))
        yield pa.RecordBatch.from_arrays(out, schema=schema)
        at += n


class ShardReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.options, self.kind = options, schema
        self.columns, self.shards = json.loads(options["columns"]), json.loads(options["shards"])
        self.verify = json.loads(options.get("verify", "[]"))
        self.low, self.high = int(options.get("low", 0)), int(options["high"]) if "high" in options else None

    def pushFilters(self, filters):
        """Filters on shard, partition and offset prune shards and batches; all others are left to Spark."""
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            if isinstance(f, (EqualTo, In)) and name in ("__shard__", "__partition__"):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.shards = [s for s in self.shards if s["ok"] and s[name.strip("_")] in wanted]
            elif name == "__shard_offset__" and isinstance(f, EqualTo):
                self.low, self.high = max(self.low, f.value), min(f.value + 1, self.high if self.high is not None else f.value + 1)
            elif name == "__shard_offset__" and isinstance(f, GreaterThanOrEqual):
                self.low = max(self.low, f.value)
            elif name == "__shard_offset__" and isinstance(f, LessThan):
                self.high = f.value if self.high is None else min(self.high, f.value)
            yield f  # Spark applies it again: NULL-filled rows have no offset

    def partitions(self):
        return [ShardPartition(s, max(0, self.low), self.high) for s in self.shards]

    def read(self, partition):
        if partition is None:
            return
        from pyspark.sql.pandas.types import to_arrow_schema

        yield from read_shard(partition, self.columns, to_arrow_schema(self.kind), self.verify)


class ShardStream(DataSourceStreamReader):
    """New shards of a directory, in the order of their names; shards appear atomically and later ones sort after earlier ones."""

    def __init__(self, schema: StructType, options: dict):
        self.kind, self.columns, self.base, self.suffix = schema, json.loads(options["columns"]), json.loads(options["dirs"]), options["suffix"]
        self.per_trigger = int(options.get("shardsPerTrigger", 1000))
        self.last = ""

    def names(self) -> list[str]:
        sets = [{e[: -len(self.suffix)] for e in os.listdir(d) if e.endswith(self.suffix)} for d in self.base.values()]
        return sorted(set.intersection(*sets)) if sets else []

    def initialOffset(self):
        return {"shard": ""}

    def latestOffset(self):
        new = [n for n in self.names() if n > self.last][: self.per_trigger]
        self.last = new[-1] if new else self.last
        return {"shard": self.last}

    def partitions(self, start, end):
        self.last = max(self.last, end["shard"])
        first = next(iter(self.base))
        return [
            ShardPartition({"ok": True, "n": None, "partition": "", "shard": n, "key_path": f"{self.base[first]}/{n}{self.suffix}", "paths": {d: f"{p}/{n}{self.suffix}" for d, p in self.base.items()}})
            for n in self.names()
            if start["shard"] < n <= end["shard"]
        ]

    def read(self, partition):
        from pyspark.sql.pandas.types import to_arrow_schema

        yield from read_shard(partition, self.columns, to_arrow_schema(self.kind))

    def commit(self, end):
        pass


class ShardSource(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return StructType.fromJson(json.loads(self.options["schema"]))

    def reader(self, schema):
        return ShardReader(schema, dict(self.options))

    def streamReader(self, schema):
        return ShardStream(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ShardSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
