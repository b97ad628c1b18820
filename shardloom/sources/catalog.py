"""What a dataset's directory holds: column groups, shards, fields, links.

<root>/[<partition>/]<column dir>/<shard><suffix>; <root>/<name><suffix>-link.
"""

from __future__ import annotations

import json
import os
import posixpath
from dataclasses import dataclass, field
from pathlib import Path

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.types import LongType, StringType, StructField, StructType

from shardloom.errors import ShardMissingError
from shardloom.sources.types import spark_schema

SUFFIX = ".shard"
SEARCH_PATH = "SHARDLOOM_SEARCH_PATH"
KEY = "__key__"
SPECIAL = {"__partition__": StringType(), "__shard__": StringType(), "__shard_path__": StringType(), "__shard_offset__": LongType()}
TAIL = b"ARROW1"


def resolve(root: str) -> Path:
    """A path as it is, or the first place of the colon-separated search path that has it."""
    if Path(root).is_dir():
        return Path(root)
    for base in filter(None, os.environ.get(SEARCH_PATH, "").split(":")):
        if (Path(base) / root).is_dir():
            return Path(base) / root
    raise ValueError(f"no dataset {root!r}, here or in {SEARCH_PATH}")


def object_path(*parts: str) -> str:
    """Path of an object in a store: non-empty parts, normalised, without leading ``../``."""
    path = posixpath.normpath(posixpath.join(*[p for p in parts if p]))
    while path.startswith("../"):
        path = path[3:]
    return path


def read_schema(path: str | Path) -> pa.Schema | None:
    """The Arrow schema in a shard's footer; None for a file that is absent, empty or damaged."""
    try:
        with pa.memory_map(str(path)) as source:
            return pa.ipc.open_file(source).schema
    except (OSError, pa.ArrowInvalid):
        return None


def has_tail(path: str | Path) -> bool:
    """Does the file end as a complete shard does?"""
    try:
        with open(path, "rb") as f:
            f.seek(-len(TAIL), os.SEEK_END)
            return f.read() == TAIL
    except OSError:
        return False


@dataclass
class Catalog:
    root: Path
    suffix: str = SUFFIX
    #: column dir -> {(partition, shard): path}
    shards: dict[str, dict[tuple[str, str], str]] = field(default_factory=dict)
    schemas: dict[str, pa.Schema] = field(default_factory=dict)
    #: field -> [(column dir, stored name), ... alternatives]
    fields: dict[str, list[tuple[str, str]]] = field(default_factory=dict)
    links: dict[str, dict] = field(default_factory=dict)

    @classmethod
    def discover(cls, root: str, suffix: str = SUFFIX, partitions: tuple[str, ...] = ("",)) -> Catalog:
        made = cls(resolve(root), suffix)
        for partition in partitions:
            base = made.root / partition
            for entry in sorted(base.iterdir()):
                if entry.is_dir():
                    # Only the suffix is cut off: names may have dots, brackets and anything else.
                    found = {(partition, e.name[: -len(suffix)]): str(e) for e in sorted(entry.iterdir()) if e.name.endswith(suffix)}
                    if found:
                        made.shards.setdefault(entry.name, {}).update(found)
                elif entry.name.endswith(suffix + "-link") and not partition:
                    made.links[entry.name[: -len(suffix + "-link")]] = json.loads(entry.read_text())
        made.find_fields()
        return made

    def find_fields(self) -> None:
        keys: list[tuple[int, str]] = []
        at: dict[str, list[str]] = {}
        for name, shards in sorted(self.shards.items()):
            for path in shards.values():
                schema = read_schema(path)
                if schema is not None:
                    self.schemas[name] = schema
                    if KEY in schema.names:
                        keys.append((os.path.getsize(path), name))
                    for column in schema.names:
                        if column != KEY:
                            at.setdefault(column, []).append(name)
                    break
        found = {KEY: [(d, KEY) for _, d in sorted(keys)]} if keys else {}
        for column, dirs in at.items():
            if len(dirs) == 1:
                found[column] = [(dirs[0], column)]
            else:  # the bare name would be ambiguous
                found |= {f"{d}.{column}": [(d, column)] for d in dirs}
        self.fields = dict(sorted(found.items()))

    def schema(self) -> StructType:
        """Every field and the special columns."""
        out = []
        for name, places in self.fields.items():
            directory, column = places[0]
            kind = spark_schema(pa.schema([self.schemas[directory].field(column)])).fields[0].dataType
            out.append(StructField(name, kind, True, {"dir": directory, "column": column}))
        return StructType(out + [StructField(n, t, True) for n, t in SPECIAL.items()])

    def shard_list(self) -> list[tuple[str, str]]:
        return sorted({ref for shards in self.shards.values() for ref in shards})

    def path(self, directory: str, ref: tuple[str, str]) -> str:
        return str(self.root / ref[0] / directory / (ref[1] + self.suffix))

    def require(self, ref: tuple[str, str]) -> None:
        if ref not in set(self.shard_list()):
            raise ShardMissingError(f"{ref} in {self.root}")


def valid_shards(spark: SparkSession, catalog: Catalog, refs: list[tuple[str, str]], dirs: list[str]) -> dict[tuple[str, str], bool]:
    """Is each shard complete in all the directories?  A Spark job reads the tails when there are many."""
    paths = [(i, catalog.path(d, ref)) for i, ref in enumerate(refs) for d in dirs]
    if len(paths) <= 512:
        good = [(i, has_tail(p)) for i, p in paths]
    else:
        from pyspark.sql import functions as F

        def tails(batches):
            for batch in batches:
                ok = [has_tail(p) for p in batch.column("path").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(ok)], names=["i", "ok"])

        rows = spark.createDataFrame(paths, "i int, path string").repartition(min(1024, len(paths) // 256 + 1))
        good = [(r.i, r.ok) for r in rows.mapInArrow(tails, "i int, ok boolean").groupBy("i").agg(F.bool_and("ok").alias("ok")).collect()]
    bad = {i for i, ok in good if not ok}
    return {ref: i not in bad for i, ref in enumerate(refs)}
